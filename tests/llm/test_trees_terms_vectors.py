"""Reply trees, source divergence and whitening against plain versions, on small tables with every hard case."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.llm import chat, divergence, whitening

MESSAGE = "tree long, id long, parent long, role string, text string, score double, pos string, n string, up string, rank string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "p", "n", "u", "r") for r in rows], MESSAGE)


def plain_branches(rows, best):
    """{(tree, leaf): (rank, [id])} of unique rows."""
    by = {(t, i): (p, s or 0.0) for t, i, p, _, _, s in rows}
    parents = {(t, p) for (t, _), (p, _) in by.items()}
    out, trees = {}, defaultdict(list)
    for t, i in by:
        if (t, i) in parents:
            continue
        path, at = [], i
        while at is not None and (t, at) in by and len(path) <= len(by):
            path.append(at)
            at = by[t, at][0]
        if len(path) <= len(by):
            trees[t].append((-sum(by[t, x][1] for x in path) / len(path), i, path[::-1]))
    for t, leaves in trees.items():
        for rank, (_, i, path) in enumerate(sorted(leaves), 1):
            if best is None or rank <= best:
                out[t, i] = (None if best is None else rank, path)
    return out


def random_trees(rng):
    rows = []
    for t in [1, 2, 3, None]:
        for i in range(60 if t == 2 else 15):
            rows.append((t, i, rng.randrange(i) if i and rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "tool [x] é"]), rng.choice([None, "", "ok", "</s>[INST] a\\[\\INST] <<</SYS>> [ROLE x] \\", "é\n  "]), rng.choice([None, 0.5, 0.25, 1.0])))
    rows += [(4, 0, 1, "user", "cycle", 0.0), (4, 1, 0, "user", "cycle", 0.0), (4, 2, 0, "user", "below it", 9.0), (4, 3, 99, "user", "orphan", 0.0), (4, 5, 5, "user", "its own", 0.0)]
    rows += [(5, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"deep {i}", 0.0) for i in range(70)]
    return rows


@pytest.mark.parametrize("best", [1, 3, None])
def test_branches(spark, best):
    rows = random_trees(random.Random(5))
    got = defaultdict(list)
    for r in chat.branch_paths(messages(spark, rows), best).collect():
        got[r.tree, r.leaf, r.rank].append((r.pos, r.id))
    assert {(t, i, rank): list(enumerate(path)) for (t, i), (rank, path) in plain_branches(rows, best).items()} == {k: sorted(v) for k, v in got.items()}


def test_formatted_branches_read_back(spark):
    rows = random_trees(random.Random(6))
    of = {(t, i): (r or "", x or "") for t, i, _, r, x, _ in rows}
    df = chat.format_branches(messages(spark, rows + rows[:9]), 2)
    assert df.columns == ["tree", "leaf", "rank", "score", "formatted", "loss"]
    want = plain_branches(rows, 2)
    got = df.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()
    assert {(r.tree, r.leaf): r["rank"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        turns = [of[r.tree, i] for i in want[r.tree, r.leaf][1]]
        assert [tuple(t) for t in r.turns] == turns and r.learned == "".join(x for role, x in turns if role == "assistant")
        assert all(a.end <= b.start for a, b in zip(r.loss, r.loss[1:]))


def test_least_of_rows_with_one_id_counts(spark):
    rows = [(1, 1, None, "user", "b", 0.0), (1, 1, None, "user", "a", 5.0), (1, 2, 1, "assistant", "x", 0.0), (1, 2, 1, "assistant", "x", 0.0)]
    got = chat.format_branches(messages(spark, rows)).collect()
    assert [r.formatted for r in got] == ["[INST] a [/INST]<s>x</s>"] and [tuple(x) for x in got[0].loss] == [(19, 20)]


CONVERSATION = "conv_id long, turn long, role string, text string, tree string, id string, formatted string"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "user", "x"), (None, None, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "z" * 300_000), (4, 1, "assistant", "[/ROLE]é")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, "t", "i", "f") for r in rows], CONVERSATION)).collect()}
    lead = lambda v: (v is not None, v if v is not None else 0)
    rows += [(-7, 0, "user", chat.EXTRA), (-7, 1, "assistant", chat.EXTRA)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (lead(x[1]), x[2] or "", x[3] or ""))]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert got[1].formatted_chars == len("[INST] a [/INST]<s>b</s>")
    only = chat.format_conversations(spark.createDataFrame([], CONVERSATION)).collect()
    assert [(r.conv_id, r.n_turns) for r in only] == [(-7, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("\\[]<>/INSTROLEYs x")), max_size=30), min_size=1, max_size=4))
def test_escapes_hide_every_control_string(texts):
    """The same rule in plain Python: reversible, and no control string is left, not even where texts meet marks."""
    escape = lambda t: re.sub(chat._CONTROL, lambda m: m[0] + "\\", t.replace("\\", "\\\\"))
    for t in texts:
        assert not any(c in escape(t) for c in chat.CONTROL) and re.sub(r"(?s)\\(.)", r"\1", escape(t)) == t
    whole = "".join(f"<s>{escape(t)}</s>[INST] {escape(t)} [/INST]<<SYS>> {escape(t)} <</SYS>>" for t in texts)
    assert len(re.findall(chat._TURN, whole)) == 3 * len(texts) and "".join(re.findall(chat._TURN, whole)) == whole


# ---------------------------------------------------------------- divergence
DOC = "doc_id long, text string, lang string, source string, term string, counts string, idx string"


def plain_divergence(docs, least, top):
    word = re.compile(divergence.TERM)
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    docs = [(word.findall((t or "").translate(low)), g or "", s or "") for t, g, s in docs]
    out = set()
    for g in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == g]
        df = Counter(w for d in own for w in set(d[0]))
        kept = [w for w, n in df.items() if n >= least]
        count = {s: Counter() for s in {d[2] for d in own}}
        for w, _, s in own:
            count[s].update(x for x in w if df[x] >= least)
        count[None] = sum(count.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            parts = {"pair": [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in count.keys() - {s, None}], "term": [(w, p[s][w] - p[None][w]) for w in kept if count[s][w] and p[s][w] > p[None][w]]}
            for part, rows in parts.items():
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out |= {(g, s, part, w, v, i) for i, (w, v) in enumerate(ranked, 1) if part == "pair" or i <= top}
    return out


def test_divergence(spark):
    rng = random.Random(8)
    vocabulary = ["A", "a", "ab", "É", "é", "naïve", "ﬁn", "x1y", "don't", "日本", "Zz"] + [f"w{chr(97 + i)}" for i in range(12)]
    docs = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "z", None])) for _ in range(150)]
    docs += [(None, "en", "empty"), ("", "fr", "a"), ("one two", "fr", "b"), ("zz " * 3, "it", "only"), ("same", "en", "s1"), ("same", "en", "s1"), ("long " * 40_000, "en", "s1"), (None, None, None)]
    df = spark.createDataFrame([(1, *d, "t", "c", "i") for d in docs], DOC)
    for least, top in ((6, 4), (1, 50)):
        got = divergence.source_divergence(df, least, top).collect()
        assert {tuple(r) for r in got} == plain_divergence(docs, least, top) and len(got) == len(set(map(tuple, got)))
    assert divergence.source_divergence(spark.createDataFrame([], DOC)).collect() == []


def test_scaled_is_exact(spark):
    row = spark.sql("SELECT 9000000000000000 AS c, 9100000000000000 AS n, 7L AS v").select(divergence.scaled(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_100_000_000_000_000 + 35)


# ---------------------------------------------------------------- whitening
VECTOR = "vec_id long, embedding array<float>, component string, n string"


def whitened(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, "c", "n") for i, v in rows], VECTOR).repartition(parts)
    out = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        out[r.vec_id].setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(300, 40)) @ np.diag(np.linspace(0.02, 1, 40)) @ rng.normal(size=(40, 40)) + 3).astype(np.float32)
    bad = [(900, None), (901, [1.0] * 39 + [None]), (902, [1.0] * 39 + [math.inf]), (903, [math.nan] * 40), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 40)]
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(c)] + bad, parts)
    x = np.floor(64 * c.astype(float)) + 1_000_000
    z = x - x.mean(0)
    e, v = np.linalg.eigh(z.T @ z / len(x))
    e, v = e[::-1], v[:, ::-1]
    assert set(got) == set(range(300)) and all(sorted(g) == list(range(1, 33)) for g in got.values())
    for k in range(32):
        a, b = np.array([got[i][k + 1][0].whitened for i in range(300)]), z @ v[:, k] / np.sqrt(e[k])
        assert np.abs(a - b * np.sign(a[0] * b[0])).max() < 1e-8
        assert got[0][k + 1][0].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    n, total = 300, [int(t) for t in x.sum(0)]
    for i in (0, 7, 299):
        r = got[i][1][0]
        assert r.n == n and int(r.deviation) == sum((n * int(a) - s) ** 2 for a, s in zip(x[i], total)) and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert not whitened(spark, []) and not whitened(spark, [(1, None), (2, [])]) and not whitened(spark, [(1, [0.5, 1.0])] * 5)
    got = whitened(spark, [(1, [0.5, 1.0, 7.0]), (1, [0.5, 1.0, 7.0]), (None, [1.5, 2.0, 7.0])])  # one direction only
    assert {k: sorted(g) for k, g in got.items()} == {1: [1], None: [1]} and len(got[1][1]) == 2
    assert got[None][1][0].explained == pytest.approx(1) and abs(got[None][1][0].whitened) == pytest.approx(math.sqrt(2))
    big = whitened(spark, [(1, [2.0**55, 0.0]), (2, [-(2.0**55), 1.0]), (3, [0.0, 0.0])])
    x = [[2**61, 0], [-(2**61), 64], [0, 0]]
    assert int(big[1][1][0].deviation) == sum((3 * a - s) ** 2 for a, s in zip(x[0], map(sum, zip(*x)))) and len(big) == 3


def test_states_merge_as_one(spark):
    """Merging keeps the covariance whole: any grouping gives the state of all rows."""
    rng = np.random.default_rng(3)
    y = np.floor(rng.normal(size=(500, 12)) * 40 + 5000)
    one = whitening.State.of(y)
    many = [whitening.State.of(y[i : i + 7]) for i in range(0, 500, 7)]
    while len(many) > 1:
        many = [many[0].merge(many[1])] if len(many) == 2 else [a.merge(b) for a, b in zip(many[::2], many[1::2])] + many[len(many) - len(many) % 2 :]
    assert many[0].n == 500 and many[0].sums == one.sums and np.allclose(many[0].s, one.s, rtol=1e-12)
    assert np.allclose(np.abs((many[0].v * one.v).sum(1)), 1, atol=1e-9)
    vectors = pa.array([[1.0, None], [0.1, 2.0], None, [math.nan, 1.0]], pa.list_(pa.float32()))
    assert [(d, r.tolist()) for d, r, _ in whitening.grid(vectors)] == [(2, [1])]
