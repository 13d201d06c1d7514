"""The search over tables against the plain one, on random trees and samples, and what it must get right."""

import random

import numpy as np
import pytest

from seqlake.operators import tree_search as ts
from seqlake.operators.corrections import corrected_nodes, poisson_quantile

from . import plain_search as ps

NODE, METRIC = "id long, parent long, is_leaf boolean, category string, length long", "sample long, node long, covered long, mean double"
PARENTS = {7: None, 5: 7, 6: 7, 1: 5, 2: 5, 3: 6, 4: 6}


def nodes_of(parents, categories, lengths):
    inner = set(parents.values())
    return [(i, p, i not in inner, categories.get(i, "2"), lengths.get(i, 4000)) for i, p in parents.items()]


def plain(nodes, covered, preset, correct=None):
    """covered: node -> (covered, mean) of one sample."""
    kids = {}
    for i, p, *_ in nodes:
        kids.setdefault(p, []).append(i)
    made = {i: ps.Node(i, p, tuple(sorted(kids.get(i, []))), c, n, covered.get(i, (0, 0.0))[0] / n if n else 0.0, covered.get(i, (0, 0.0))[1]) for i, p, _, c, n in nodes}
    return ps.Search(made, preset, correct).run()


def found(spark, nodes, samples, presets, correct=None):
    metrics = [(s, i, c, float(m)) for s, x in samples.items() for i, (c, m) in x.items()]
    out = ts.search(spark.createDataFrame(nodes, NODE), spark.createDataFrame(metrics, METRIC), presets, correct)
    return {(r.sample, r.cluster, r.how, round(r.ab, 6), round(r.cov, 6), round(r.covered, 4), r.total, round(r.share, 6)) for r in out.collect()}


def expected(nodes, samples, presets, correct=None):
    out = set()
    for s, x in samples.items():
        for p in presets:
            if hits := plain(nodes, x, p, correct(s) if correct else None):
                out |= {(s, f.cluster, f.how, round(f.ab, 6), round(f.cov, 6), round(f.covered, 4), f.total, round(f.share, 6)) for f in hits}
                break
    return out


def random_tree(rng, leaves):
    """Leaves 1.., inner nodes above them; joined at random."""
    parents, top, new = {}, list(range(1, leaves + 1)), leaves
    while len(top) > 1:
        new += 1
        for _ in range(2):
            parents[top.pop(rng.randrange(len(top)))] = new
        top.append(new)
    return parents | {top[0]: None}


def random_samples(rng, nodes, n):
    out = {}
    for s in range(n):
        strong = rng.random()
        out[s] = {i: (rng.randint(0, length), rng.choice([0.4, 1.2, 3.0, 60.0, 900.0])) for i, _, _, _, length in nodes if rng.random() < 0.4 + 0.6 * strong and length}
        if rng.random() < 0.6:  # much of one line is covered
            at = rng.choice([i for i, _, leaf, *_ in nodes if leaf])
            parent = {i: p for i, p, *_ in nodes}
            length = {i: n for i, _, _, _, n in nodes}
            while at is not None:
                out[s][at] = (int(length[at] * rng.choice([0.03, 0.5, 0.97, 1.0])), rng.choice([1.4, 8.0, 800.0]))
                at = parent[at]
    return out


def test_search_equals_the_plain_one(spark):
    rng = random.Random(25)
    parents = random_tree(rng, 10)
    inner = set(parents.values())
    lengths = {i: rng.choice([0, 400, 1500, 6000]) for i in parents}
    categories = {i: ("1" if i not in inner else "0") if n < 1000 else rng.choice(["", "", "o"]) + ("1" if n < 3000 else "2") for i, n in lengths.items()}
    nodes = nodes_of(parents, categories, lengths)
    samples = random_samples(rng, nodes, 150)
    new = {(s, i): (rng.choice(["1", "2", "o1", "o2"]), 1000, rng.randint(0, 1000), rng.choice([0.0, 1.5, 7.0, 70.0])) for s in samples for i in parents}

    def plain_correct(s):
        def correct(n, leaves):
            c, length, covered, mean = new[s, n.id]
            return c, length, covered / length, mean

        return correct

    table = spark.createDataFrame([(s, i, *x) for (s, i), x in new.items()], "sample long, node long, category string, length long, covered long, mean double")
    presets = (ts.Preset(0.1, 0.4, 1), ts.Preset(0.02, 0.05, 1))
    want = expected(nodes, samples, presets, plain_correct)
    assert found(spark, nodes, samples, presets, lambda todo, leaves: todo.join(table, ["sample", "node"])) == want
    assert {h for _, _, h, *_ in want} >= {"accepted"} and len({s for s, *_ in want}) > 30
    assert want != expected(nodes, samples, presets)  # corrections matter here


def test_all_ways_to_find_a_leaf_occur(spark):
    rng = random.Random(9)
    nodes = nodes_of(random_tree(rng, 9), {}, {})
    samples = random_samples(rng, nodes, 200)
    presets = (ts.Preset(0.1, 0.93, 1),)
    want = expected(nodes, samples, presets)
    assert {h for _, _, h, *_ in want} == {"accepted", "rejected", "qualified"} and found(spark, nodes, samples, presets) == want


def test_coverage_decides(spark):
    """Sample 0: leaf 1 is covered well at depth 9, its sibling hardly, at a mean count of 2000, and counts as absent. Samples 1 and 3:
    0.06 is enough for a small leaf, not for a full one. Sample 6: the leaf has a coverage of 0.05, its path 0.33: the best rejected."""
    nodes = nodes_of(PARENTS, {1: "1", 3: "2"}, {1: 2000})
    line = {7: (3600, 9), 5: (3600, 9), 6: (3600, 9)}
    samples = {0: {7: (3600, 9), 5: (3600, 9), 1: (1800, 9), 2: (2, 2000)}, 1: line | {1: (120, 9)}, 3: line | {3: (240, 9)}, 5: {2: (1, 1)}, 6: {7: (1600, 3), 5: (1600, 3), 1: (101, 2)}}
    got = {(s, c, h) for s, c, h, *_ in found(spark, nodes, samples, (ts.Preset(0.1, 0.4, 1),))}
    assert got == {(s, c, h) for s, c, h, *_ in expected(nodes, samples, (ts.Preset(0.1, 0.4, 1),))}
    assert {x for x in got if x[0] in (0, 6)} == {(0, 1, "accepted"), (6, 1, "rejected")}
    assert (1, 1) in {(s, c) for s, c, _ in got} and (3, 3) not in {(s, c) for s, c, _ in got}


def test_search_of_nothing(spark):
    nodes = nodes_of(PARENTS, {}, {})
    assert found(spark, nodes, {}, ts.PRESETS[0]) == set()
    assert {(s, c, h) for s, c, h, *_ in found(spark, [(3, None, True, "2", 100)], {0: {3: (90, 4)}, 1: {3: (1, 4)}}, ts.PRESETS[1])} == {(0, 3, "accepted")}


@pytest.mark.parametrize("least", [10, 25])
def test_corrections_equal_the_plain_ones(spark, least):
    """K-mers of accepted leaves are dropped where enough others are left, else their abundances are taken off, value by value."""
    rng = random.Random(least)
    leaves = {s: [(i, rng.choice([0.1, 1.0, 6.0, 40.0]), float(rng.randint(1, 3))) for i in (1, 2, 3)[: s % 4]] for s in range(8)}
    of = {k: {i for i in (1, 2, 3) if rng.random() < 0.3} for k in range(120)}
    node_kmer = [(k, n) for n, least_, most in ((10, 0, 70), (11, 40, 120), (12, 0, 6)) for k in range(least_, most)]
    counts = {(s, k): rng.choice([1, 3, 8, 45, 9000]) for s in leaves for k in of if rng.random() < 0.7}
    got = corrected_nodes(
        spark.createDataFrame([(s, n) for s in leaves if leaves[s] for n in (10, 11, 12)], "sample long, node long"),
        spark.createDataFrame([(s, *x) for s, xs in leaves.items() for x in xs], "sample long, leaf long, ab double, path_ab double"),
        spark.createDataFrame(node_kmer, "kmer long, node long"),
        spark.createDataFrame([(*k, c) for k, c in counts.items()], "sample long, kmer long, cnt long"),
        spark.createDataFrame([(i, k) for k, x in of.items() for i in x], "cluster long, kmer long"),
        least,
    ).collect()
    assert len(got) == 3 * sum(bool(x) for x in leaves.values())
    for r in got:
        rows = [(counts.get((r.sample, k), 0), frozenset(of[k])) for k, n in node_kmer if n == r.node]
        own = [ps.Node(i, 9, (), "2", ab=ab, path_ab=path) for i, ab, path in leaves[r.sample]]
        category, length, cov, ab = ps.corrected(rows, own, least)
        assert (r.category, r.length, round(r.covered / r.length, 9), round(r["mean"], 9)) == (category, length, round(cov, 9), round(ab, 9))
    assert {r.category for r in got} >= {"1", "o1"}


def test_poisson_quantiles():
    for mean in (0.1, 4.0, 900.0):
        assert poisson_quantile(mean, (np.arange(101) + 0.5) / 101).tolist() == ps.poisson_quantiles(mean, 101)
    q = poisson_quantile(900.0, (np.arange(1001) + 0.5) / 1001)
    assert abs(q.mean() - 900) < 1 and abs(q.std() - 30) < 1 and poisson_quantile(0.0, np.array([0.5])).tolist() == [0]
