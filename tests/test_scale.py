"""Steps that must not grow faster than their input, on small cases with the results worked out plainly."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqlake.functions import sequence as S
from seqlake.functions import stats as st
from seqlake.operators import corrections
from seqlake.operators import dominance as dm
from seqlake.operators import kmer_sets as ks
from seqlake.operators import profiles
from seqlake.operators import similarity as sm


def _genomes(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (400, 300, 31, 30, 0)]
    rows = [(1, base[0]), (2, base[0][50:350] + base[1]), (3, base[1] + "A" * 80), (3, base[0][:90]), (4, base[2]), (5, base[3]), (6, base[4]), (7, None), (None, base[0][:60]), (8, base[0][:200] + "N" + base[1][100:])]
    return spark.createDataFrame(rows, "strain long, seq string"), rows


def _places(rows, k, strand="given"):
    out = {}
    for i, x in rows:
        for c in S.codes_of((x or "").encode(), k, strand).tolist():
            out.setdefault(c, []).append(i)
    return out


def test_whole_incidence_by_runs(spark):
    g, rows = _genomes(spark)
    for strand in ("given", "canonical"):
        got = sorted((r.kmer, r.strain, r.times, r.total, r.n_strains, r.first, r.lo, r.hi) for r in ks.whole_incidence(g, 31, F.col("strain") % 3, strand).collect())
        want = []
        for c, of in _places(rows, 31, strand).items():
            known = {i for i in of if i is not None}
            want += [(c, i, of.count(i), len(of), len(known), min(known), min(j % 3 for j in known), max(j % 3 for j in known)) for i in known]
        assert got == sorted(want)
    runs = S.kmer_runs(g.where("strain is not null"), 31, 1000).collect()
    letters = sum(len(r.part) for r in runs)
    assert letters < 6 * sum(len(r.part) - 30 for r in runs)  # what is shuffled for a k-mer; it was the k-mer and its strain, 16 bytes


def test_patterns_of_runs(spark):
    g, rows = _genomes(spark)
    sets = {}
    for of in _places(rows, 31, "canonical").values():
        known = tuple(sorted({i for i in of if i is not None}))
        sets[known] = sets.get(known, 0) + 1
    got = ks.whole_patterns(g, 31, "canonical").collect()
    by = {}
    for r in got:
        by.setdefault((r.p, r.q, r.f, r.n), []).append(r.strain)
    assert sorted((tuple(sorted(v)), k[3]) for k, v in by.items()) == sorted((k, n) for k, n in sets.items() if k)


def test_first_unique_of_long_and_of_crowded_strains(spark):
    g, rows = _genomes(spark)
    unique = {}
    for c, of in _places(rows, 31).items():
        known = {i for i in of if i is not None}
        if len(known) == 1:
            unique.setdefault(min(known), []).append(c)
    for cap in (2, 20):
        got = sorted((r.strain, r.kmer) for r in ks.first_unique(g, 31, cap).collect())
        assert got == sorted((i, c) for i, cs in unique.items() for c in sorted(cs)[:cap])


def test_percent_rounds_as_printf(spark):
    pairs = [(n, t) for t in (1000, 1600, 60000) for n in range(1, 400)]
    x = spark.createDataFrame(pairs, "n long, t long").select("n", "t", st.percent(F.col("n"), F.col("t")).alias("p")).collect()
    assert [r.p for r in x] == ["%.2f%%" % (100 * n / t) for n, t in pairs]


def test_least_kmers_without_a_sort(spark):
    g = spark.createDataFrame([(1, "GATTACA" * 9), (2, "C" * 31), (3, "ACGTTGCA" * 5)], "strain long, seq string")
    x = S.kmer_codes(g, 31, strand="both").groupBy("strain").agg(F.min(S.lettered(F.col("kmer"))).alias("lo"))
    got = {r.strain: r.s for r in x.select("strain", S.decode(S.lettered(F.col("lo")), 31).alias("s")).collect()}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {i: min(z for j in range(len(s) - 30) for z in (s[j : j + 31], turned(s[j : j + 31]))) for i, s in ((r.strain, r.seq) for r in g.collect())}
    assert "SortAggregate" not in x._jdf.queryExecution().toString()


def test_few_pairs_are_counted_at_once(spark, monkeypatch):
    """Strains that share many rare k-mers: each k-mer in two of 24 strains. The search by rare patterns read all of both for each pair."""
    rows = [(i, 100 * i + j) for i in range(24) for j in range(24) if i < j] + [(j, 100 * i + j) for i in range(24) for j in range(24) if i < j] + [(0, -1), (1, -1)]
    inc = spark.createDataFrame(rows, "strain long, kmer long")
    pat = sm.pattern_incidence(inc)
    assert sm.cheap_to_pair(pat)
    key = lambda df: sorted((r.a, r.b, r.shared, round(r.jaccard, 9)) for r in df.collect())
    got, forest = key(sm.similar_pairs(pat, 0.02)), sorted(map(tuple, sm.spanning_edges(inc).collect()))
    monkeypatch.setattr(sm, "FEW", -1)
    assert got == key(sm.similar_pairs(pat, 0.02)) and len(got) == 276
    assert forest == sorted(map(tuple, sm.spanning_edges(inc).collect())) and len(forest) == 23


def test_corrections_read_only_what_samples_have(spark, monkeypatch):
    staged = {}
    keep = corrections.stage
    monkeypatch.setattr(corrections, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    node_kmer = spark.createDataFrame([(1, k) for k in range(1000)] + [(2, k) for k in range(40)], "node long, kmer long")
    counts = spark.createDataFrame([(7, 3, 5), (7, 500, 2), (8, 700, 9), (9, 5, 1)], "sample long, kmer long, cnt long")
    todo = spark.createDataFrame([(s, n) for s in (7, 8, 9) for n in (1, 2)], "sample long, node long")
    leaves = spark.createDataFrame([(7, 40, 1.0, 1.0), (7, 41, 1.0, 0.5), (8, 41, 1.0, 1.0)], "sample long, leaf long, ab double, path_ab double")
    cluster_kmer = spark.createDataFrame([(40, k) for k in range(30)] + [(41, k) for k in range(20, 60)], "cluster long, kmer long")
    got = {(r.sample, r.node): (r.category, r.length, r.covered, r.mean) for r in corrections.corrected_nodes(todo, leaves, node_kmer, counts, cluster_kmer, 25).collect()}
    assert got == {
        (7, 1): ("2", 940, 1, 2.0), (7, 2): ("o1", 40, 1, 4.0), (8, 1): ("2", 960, 1, 9.0), (8, 2): ("o1", 40, 0, 0.0), (9, 1): ("2", 1000, 1, 1.0), (9, 2): ("1", 40, 1, 1.0),
    }
    assert max(x.count() for x in staged.values()) < 10


def test_snp_codes_equal_snp_kmers(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACGT-N", (9, 9, 9, 9, 4, n), k=300))) for i, n in enumerate((0, 0, 1, 1, 2))]
    rows += [(9, ""), (10, "-" * 40), (11, "ACGTN"), (12, "ACG-T" * 8), (13, "N" * 35 + "ACGTACG" * 5)]
    g = spark.createDataFrame(rows, "strain long, row string")
    want = sorted((r.strain, r.kmer or "") for r in S.snp_kmers(g, 31).collect())
    got = S.snp_codes(g, 31).select("strain", S.decode(F.col("kmer"), 31).alias("kmer")).collect()
    assert sorted((r.strain, r.kmer or "") for r in got) == want

def test_regression_of_a_large_cluster_takes_only_pairs_that_share(spark):
    """Strains in pairs: the sparse products give the same coefficients as the dense matrix, and 4000 strains no table of all pairs (2.7 GB)."""
    r = np.random.default_rng(4)
    gram, n = np.zeros((dm.SPLITS + 1, 8, 8)), np.full(dm.SPLITS + 1, 400.0)
    for k in range(dm.SPLITS + 1):
        for j in range(0, 8, 2):
            gram[k, j, j], gram[k, j + 1, j + 1], gram[k, j, j + 1] = r.integers(50, 60, 2)[0], r.integers(50, 60), r.integers(5, 40)
            gram[k, j + 1, j] = gram[k, j, j + 1]
    gram[0], n[0] = 2 * gram[1:].mean(0), 800.0
    true = np.array([3.0, 0, 1, 2, 0, 0, 5, 1])
    xy = gram @ true
    yy = xy @ true
    want, penalty = dm.net_of_sums(gram, xy, yy, n)
    assert np.allclose(want, true, atol=0.2) and penalty > 0
    row, col = np.nonzero(gram.any(0))
    many = 500
    add = np.repeat(8 * np.arange(many), len(row))
    big = dm.Gram(8 * many, np.tile(row, many) + add, np.tile(col, many) + add, np.tile(gram[:, row, col].T, (many, 1)))
    got, same = dm.net_of_sums(big, np.tile(xy, many), yy * many, n * 1.0)
    assert np.isclose(same, penalty) and np.allclose(got, np.tile(want, many), atol=1e-9)
    assert len(big.levels) == 2


def test_pairs_are_counted_where_their_strains_lie(spark, monkeypatch):
    """Many buckets, repeated rows, null and lone strains: counts are those of all pairs, and no pair is shuffled."""
    rng = random.Random(8)
    rows = [(rng.randrange(40) * 1000 - 9000, rng.randrange(60)) for _ in range(900)] + [(7, 1000), (None, 3), (None, 1000), (50_000, None)]
    rows += [(s, 2000 + k) for s in range(3) for k in range(5)]
    inc = spark.createDataFrame(rows, "strain long, kmer long")
    of = {}
    for s, k in rows:
        if s is not None:
            of.setdefault(s, set()).add(k)
    want = sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a <= b and of[a] & of[b])
    for size in (1 << 18, 30):
        monkeypatch.setattr(sm, "BUCKET_ROWS", size)
        assert sorted(map(tuple, sm.counted(inc).collect())) == want
    assert sorted(map(tuple, sm.shared(inc).collect())) == [x for x in want if x[0] < x[1]]
    got = {(r.a, r.b): (round(r.distance, 9), round(r.back, 9)) for r in sm.hamming(inc).collect()}
    assert got == {(a, b): (round(len(of[a] ^ of[b]) / len(of[a]), 9), round(len(of[a] ^ of[b]) / len(of[b]), 9)) for a, b, _ in want if a < b}
    plan = sm.counted(inc)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    assert sm.counted(inc.limit(0)).count() == 0


def test_sample_metrics_move_only_rows_of_counts(spark, monkeypatch):
    """Medians of even and odd numbers of counts, outliers, and a sample spread over tasks equal those worked out plainly."""
    rng = random.Random(6)
    node_kmer = [(n, k) for n in range(6) for k in range(60) if rng.random() < 0.5]
    counts = [(s, k, rng.choice((0, 1, 2, 7, 300))) for s in range(5) for k in range(70) if rng.random() < 0.6]
    cnt, want = {(s, k): c for s, k, c in counts if c > 0}, []
    for s in range(5):
        for n in range(6):
            x = [cnt[s, k] for m, k in node_kmer if m == n and (s, k) in cnt]
            y = [c for c in x if c < 10 * np.median(x)] if x else []
            want += [(s, n, len(y), round(sum(y) / len(y), 9))] if y else []
    nk, cs = spark.createDataFrame(node_kmer, "node long, kmer long"), spark.createDataFrame(counts, "sample long, kmer long, cnt long")
    for most in (1 << 20, 33):
        monkeypatch.setattr(profiles, "MOST_KMERS", most)
        got = profiles.sample_metrics(nk, cs, 10.0)
        assert sorted((r.sample, r.node, r.covered, round(r["mean"], 9)) for r in got.collect()) == want
    monkeypatch.setattr(profiles, "MOST_KMERS", 1 << 20)
    plan = profiles.sample_metrics(nk, cs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")].replace("AQEShuffleRead", "")


def test_pattern_rows_have_their_strains_and_products_do_not_depend_on_few(spark, monkeypatch):
    """Rows carry lists of strains, found where the k-mers lie: one exchange of l2, one of each count, one of rows."""
    at = [(c, s, 100 * c + m) for c in (1, 2) for m in range(40) for s in range(6) if (m * 7 + s * s) % (s + 2) < 2]
    l2 = spark.createDataFrame(at + at[:9], "cluster long, strain long, kmer long")
    c = spark.createDataFrame([(k, k % 5) for k in range(100, 240, 2)], "kmer long, cnt long")
    rows, member = dm.pattern_rows(l2, c, c)
    want = {}
    for cl, s, m in at:
        want.setdefault((cl, m), set()).add(s)
    count = {}
    for (cl, m), s in want.items():
        y = m % 5 if m % 2 == 0 and m % 5 > 1 else 0
        count[cl, tuple(sorted(s)), y] = count.get((cl, tuple(sorted(s)), y), 0) + 1
    assert {(r.cluster, tuple(r.strains), r.y): r.w0 for r in rows.collect()} == count
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2  # with counts only
    found = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (2, 3)], "cluster long, strain long")
    sums = lambda: {(r.cluster, r.kind, r.i, r.j): r.v for r in dm.sums(rows, member, found).collect()}
    few = sums()
    monkeypatch.setattr(dm, "FEW", 1)
    assert few == sums()
    assert {(a, b) for cl, k, a, b in few if k == "xx" and cl == 1} <= {(0, 0), (0, 2), (0, 5), (2, 2), (2, 5), (5, 5)} and (2, "xx", 3, 3) in few


def test_codes_of_a_batch_are_not_held_at_once(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from seqlake.functions import sequence

    df = spark.createDataFrame([], "strain long, seq string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = sequence.kmer_codes(df, 11)
    rng = np.random.default_rng(3)
    texts = ["".join(np.array(list("ACGT"))[rng.integers(0, 4, 4000)]) for _ in range(20)]
    batch = pa.record_batch([pa.array(range(1000)), pa.array(texts * 50)], names=["strain", "seq"])
    tracemalloc.start()
    n = total = 0
    for b in run(iter([batch])):
        n, total = n + b.num_rows, total + int(np.array(b.column("strain")).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * 3990 and total == 3990 * sum(range(1000)) and peak < 30e6
    got = [list(zip(b.column("strain").to_pylist(), b.column("kmer").to_pylist(), strict=True)) for b in run(iter([batch.slice(7, 3), batch.slice(0, 0)]))]
    assert [x for b in got for x in b] == [(i, int(c)) for i in range(7, 10) for c in sequence.codes_of(texts[i].encode(), 11)]


def test_sizes_meet_pairs_where_these_are_counted(spark, monkeypatch):
    """No pair is staged or shuffled on its way to the similarity."""
    staged, keep = [], sm.stage
    monkeypatch.setattr(sm, "stage", lambda df, name: staged.append(df.columns) or keep(df, name))
    rng = random.Random(3)
    inc = spark.createDataFrame([(rng.randrange(30), rng.randrange(90)) for _ in range(700)] + [(None, 3)], "strain long, kmer long")
    of = {}
    for s, k in ((r.strain, r.kmer) for r in inc.collect()):
        if s is not None:
            of.setdefault(s, set()).add(k)
    want = sorted((a, b, len(of[a] & of[b]), round(len(of[a] & of[b]) / len(of[a] | of[b]), 9)) for a in of for b in of if a < b and of[a] & of[b])
    x = sm.jaccard(inc)
    assert sorted((r.a, r.b, r.shared, round(r.jaccard, 9)) for r in x.collect()) == want
    assert staged and not [c for c in staged if "b" in c]
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hash" not in plan[: plan.index("Generate explode")]
    monkeypatch.setattr(sm, "MOST_STRAINS", 0)
    assert sorted((r.a, r.b, r.shared, round(r.jaccard, 9)) for r in sm.jaccard(inc).collect()) == want


def test_reassignment_stages_no_pairs(spark, tmp_path, monkeypatch):
    """All distances are met by clusters where they are counted, and those with a representative are counted apart (F8)."""
    from seqlake.plans import queries

    rng = random.Random(9)
    line = [(rng.randrange(40), rng.randrange(80), 1.0) for _ in range(900)]
    spark.createDataFrame(line, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, s % 7) for s in range(40)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = sorted(map(tuple, sm.reassigned(c := queries.v.region(spark, str(tmp_path)), sm.medoids(c, p := queries._dist(spark, str(tmp_path))), p).collect()))
    staged = []
    for m in (sm, queries):
        monkeypatch.setattr(m, "stage", lambda df, name, keep=m.stage: staged.append(df.columns) or keep(df, name))
    assert sorted(map(tuple, queries.t3_reassign(spark, str(tmp_path)).collect())) == want and len(want) == 35
    assert staged and not [c for c in staged if "distance" in c]


def test_similar_strains_by_their_first_kmers(spark, monkeypatch):
    """Copies and near copies among strains of few common k-mers: no incidence is paired, and the pairs are those of all."""
    rng = random.Random(12)
    rows = [(s, rng.randrange(400) if s else rng.randrange(5)) for s in range(30) for _ in range(1 + 7 * s)]
    rows += [(s + 100, k) for s, k in rows] + [(s + 200, k) for s, k in rows if k % 40] + [(None, 3), (7, None)]
    of = {}
    for s, k in rows:
        if s is not None:
            of.setdefault(s, set()).add(k)
    inc = spark.createDataFrame(rows, "strain long, kmer long")
    monkeypatch.setattr(sm, "FEW", 100)
    monkeypatch.setattr(sm, "similar_pairs", lambda *a: 1 / 0)
    for least in (0.99, 0.9, 0.5, 0.2):
        want = sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a < b and len(of[a] & of[b]) >= least * len(of[a] | of[b]) - 1e-12)
        got = sorted((r.a, r.b, r.shared) for r in sm.jaccard(inc, least=least).collect())
        assert got == want and len(want) >= 30
    monkeypatch.setattr(sm, "MOST_STRAINS", 0)
    assert sorted((r.a, r.b, r.shared) for r in sm.jaccard(inc, least=0.2).collect()) == want


def test_a_copy_without_kmers_is_a_cluster(spark, tmp_path):
    """All orders of strain 2 are divisible by 211, so that its third copy has none (c2_triples, F6)."""
    from seqlake.plans import cases

    spark.createDataFrame([(1, 5), (1, 6), (2, 211), (2, 422)], "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, cases.c2_triples(spark, str(tmp_path)).collect()))
    m = 1_000_000
    assert got == [(1, 1), (2, 2), (1 + m, 1), (2 + m, 2), (1 + 2 * m, 1), (2 + 2 * m, 2 + 2 * m)]


def test_pairs_of_genomes_move_no_patterns(spark, monkeypatch):
    """Candidates are counted where their patterns lie, strains that are mostly their own are left out, and runs take two bits a letter (F2)."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    shared, rows = [letters(900) for _ in range(5)], []
    for i in range(60):
        seq = list(shared[i % 5] + letters(5 * (i % 3)))
        for _ in range(i % 4):
            seq[rng.randrange(900)] = "A"
        rows.append((i, "".join(seq)))
    rows += [(100 + i, shared[0][:100] + letters(400)) for i in range(20)] + [(200, ""), (201, None)]
    g = spark.createDataFrame(rows, "strain long, seq string").repartition(3)
    of = {i: {min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for j in range(len(s or "") - 30) for x in [s[j : j + 31]]} for i, s in rows}
    want = sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a < b and of[a] | of[b] and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]))
    pat = ks.whole_patterns(g, 31, "canonical").persist()
    staged, keep = {}, sm.stage
    monkeypatch.setattr(sm, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    monkeypatch.setattr(sm, "FEW", -1)
    x = sm.similar_pairs(pat, 0.8)
    assert sorted((r.a, r.b, r.shared) for r in x.collect()) == want and len(want) > 100
    assert "MapInArrow" in x._jdf.queryExecution().executedPlan().toString() and not staged["able"].where("strain >= 100").count()
    monkeypatch.setattr(sm, "MOST_STRAINS", 0)
    assert sorted((r.a, r.b, r.shared) for r in sm.similar_pairs(pat, 0.8).collect()) == want
    parts = S.kmer_runs(g, 31, 1000, pack=True).select("part").toArrow()["part"].combine_chunks()
    plain = S.kmer_runs(g, 31, 1000).select("part").toArrow()["part"].to_pylist()
    text, size = S.unpacked(parts)
    assert sorted(plain) == sorted(text[e - n : e].decode() for n, e in zip(size, np.cumsum(size))) and 3 * sum(map(len, parts.to_pylist())) < sum(map(len, plain))


def test_corrections_keep_a_sample_together(spark, monkeypatch):
    """Nodes judged by their own k-mers or by what leaves of several turns leave over equal a plain version, and no row
    for each k-mer of a sample's node is staged (F4, F5)."""
    rng = random.Random(31)
    of_node = {n: {k for k in range(120) if rng.random() < 0.1 + 0.1 * n} for n in range(8)}
    of_leaf = {c: {k for k in range(120) if rng.random() < 0.3} for c in range(40, 44)}
    cnt = {(s, k): rng.choice((0, 1, 3, 8, 900)) for s in range(6) for k in range(130) if rng.random() < 0.7}
    todo = [(s, n) for s in range(6) for n in range(8) if (s + n) % 3]
    leaves = [(s, c, 2.0 * c - 79, float((s * c) % 7)) for s in range(5) for c in range(40, 44) if (s + c) % 2 or s == 3]
    want = {}
    for s, n in todo:
        mine = sorted((x for x in leaves if x[0] == s), key=lambda x: (-x[3], x[1]))
        own = of_node[n] - set().union(*(of_leaf[x[1]] for x in mine))
        if len(own) >= 25:
            got = [cnt[s, k] for k in own if cnt.get((s, k), 0) > 0]
            got = [x for x in got if x < 100 * np.median(got)]
            want[s, n] = ("1" if len(own) < 75 else "2", len(own), got)
        else:
            left = {k: cnt[s, k] for k in of_node[n] if cnt.get((s, k), 0) > 0}
            for _, c, ab, _ in mine:
                hit = sorted((k for k in left if k in of_leaf[c]), key=lambda k: (left[k], k))
                for k, x in zip(hit, corrections.poisson_quantile(ab, (np.arange(len(hit)) + 0.5) / max(1, len(hit)))):
                    left[k] -= int(x)
                left = {k: x for k, x in left.items() if x > 0}
            want[s, n] = ("o1" if len(of_node[n]) < 75 else "o2", len(of_node[n]), list(left.values()))
    want = {k: (c, n, len(x), round(sum(x) / len(x), 9) if x else 0.0) for k, (c, n, x) in want.items()}
    assert {c[0] for c, *_ in want.values()} >= {"1", "o"}
    tables = (
        spark.createDataFrame(todo, "sample long, node long"), spark.createDataFrame(leaves, "sample long, leaf long, ab double, path_ab double"),
        spark.createDataFrame([(n, k) for n, ks_ in of_node.items() for k in ks_], "node long, kmer long"), spark.createDataFrame([(s, k, c) for (s, k), c in cnt.items()], "sample long, kmer long, cnt long"),
        spark.createDataFrame([(c, k) for c, ks_ in of_leaf.items() for k in ks_], "cluster long, kmer long"),
    )
    staged, keep = [], corrections.stage
    monkeypatch.setattr(corrections, "stage", lambda df, name: staged.append(df.columns) or keep(df, name))
    for most, turns in ((0, 1), (1 << 20, 9)):
        staged.clear()
        monkeypatch.setattr(corrections, "MOST_KMERS", most, raising=False)
        monkeypatch.setattr(corrections, "TURNS", turns, raising=False)
        x = corrections.corrected_nodes(*tables, 25)
        assert {(r.sample, r.node): (r.category, r.length, r.covered, round(r.mean, 9)) for r in x.collect()} == want
    assert not [c for c in staged if "kmer" in c]


def test_rows_of_few_alike_are_not_moved(spark, monkeypatch):
    """Rows of one k-mer each and merged ones give the same sums, scan and coefficients; the former take no shuffle."""
    rng = random.Random(41)
    l2 = [(c, 10 * c + s, k) for c in range(3) for s in range(6) for k in range(150) if rng.random() < 0.4] + [(0, 1, 3)] * 3
    counts = spark.createDataFrame([(k, rng.choice((0, 1, 5, 9, 40))) for k in range(120)], "kmer long, cnt long")
    l2 = spark.createDataFrame(l2, "cluster long, strain long, kmer long")
    seen = []
    for alike in (1 << 30, 0):
        monkeypatch.setattr(dm, "ALIKE", alike, raising=False)
        r, member = dm.pattern_rows(l2, counts, counts, apart=True)
        if alike:
            assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString() and r.agg(F.max("w0")).first()[0] == 1
        found = member.select("cluster", "strain").distinct()
        sums = sorted((x.cluster, x.kind, x.i or 0, x.j or 0, tuple(x.v)) for x in dm.sums(r, member, found).collect())
        net = sorted((x.cluster, x.strain, round(x.c, 9)) for x in dm.coefficients(r, member, found).collect())
        scan = sorted((x.cluster, x.strain, x.turn, x.covered, x.total, x.valid, round(x.remain, 9), round(x.depth, 9) if x.turn == 0 else 0) for x in dm.scan(r, member, dm.ScanConfig(least_new=3)).collect())
        seen.append((sums, net, scan, sorted(map(tuple, member.collect()))))
    assert seen[0] == seen[1] and len(seen[0][1]) == 18 and any(c for _, _, c in seen[0][1])
