"""Operators that SQL does not cover, on literal fixtures, and properties of those that it does."""

import gzip
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions import sequence as S
from seqlake.functions import stats
from seqlake.operators import dominance as dm
from seqlake.operators import kmer_filter as kf
from seqlake.operators import kmer_sets as ks
from seqlake.operators import profiles as pf
from seqlake.operators import reports as rp
from seqlake.operators import similarity as sm
from seqlake.plans import index as ix
from seqlake.plans import queries
from seqlake.sources import readers, writers

from . import plain_scan as psc
from . import plain_search as ps


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- sequences
def test_revcomp_is_an_involution_and_keeps_codes(spark):
    x = spark.createDataFrame([("ACGTNRYKMacgtu",), ("",), (None,)], "s string")
    out = [tuple(r) for r in x.select("s", S.revcomp(F.col("s")).alias("r"), S.revcomp(S.revcomp(F.col("s"))).alias("rr")).collect()]
    # U pairs with A as T does, so it alone comes back as T
    assert out[0][1:] == ("aacgtKMRYNACGT", "ACGTNRYKMacgtt") and out[1][1] == "" and out[2][1] is None


def test_kmers_of_short_and_long_sequences(spark):
    g = spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, ""), (4, None)], "strain long, seq string")
    assert rows(S.kmers(g, 3)) == [(1, 1, "ACG"), (1, 2, "CGT"), (1, 3, "GTA")]
    assert rows(S.kmers(g, 3, drop_last=True)) == [(1, 1, "ACG"), (1, 2, "CGT")]
    assert rows(S.both_strands(S.kmers(g, 5))) == [(1, 1, "ACGTA"), (1, 1, "TACGT")]


@pytest.mark.parametrize("k", [5, 31])
@pytest.mark.parametrize("strand", ["given", "both", "canonical"])
def test_kmers_and_codes_equal_every_position(spark, k, strand):
    r = random.Random(k)
    t = "".join(r.choice("ACGTN" if i % 90 == 0 else "ACGT") for i in range(700))
    texts = {1: t, 2: t[:128], 3: t[:129], 4: t[:159], 5: "ACGT", 6: "", 7: t[1:290]}
    g = spark.createDataFrame([*texts.items(), (8, None)], "strain long, seq string")
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for drop in (False, True):
        want = []
        for i, x in texts.items():
            for j in range(len(x) - k + 1 - drop):
                a, b = x[j : j + k], turn(x[j : j + k])
                want += [(i, j + 1, a)] if strand == "given" else [(i, j + 1, min(a, b))] if strand == "canonical" else [(i, j + 1, a), (i, j + 1, b)]
        assert rows(S.kmers(g, k, drop_last=drop, strand=strand).select("strain", "pos", "kmer")) == sorted(want)
        codes = [(i, int("".join(str("AGCT".index(c)) for c in x), 4)) for i, _, x in want if "N" not in x]
        assert rows(S.kmer_codes(g, k, drop_last=drop, strand=strand)) == sorted(codes)


def test_long_sequences_take_linear_time(spark):
    import time

    t = "".join(random.Random(1).choices("ACGT", k=320_000))
    g = spark.createDataFrame([(1, t)], "strain long, seq string")
    S.kmers(g.limit(1), 31).count()
    began = time.time()
    assert S.kmers(g, 31, strand="canonical").agg(F.max("kmer"), F.count("*")).first()[1] == len(t) - 30
    assert time.time() - began < 10  # a walk from the start for each k-mer takes minutes


def test_two_bit_codes_round_trip(spark):
    r = random.Random(1)
    k = ["".join(r.choice("ACGT") for _ in range(31)) for _ in range(50)] + ["A" * 31, "T" * 31]
    x = spark.createDataFrame([(s,) for s in k], "k string").select("k", S.encode(F.col("k")).alias("c")).select("k", "c", S.decode(F.col("c"), 31).alias("b"))
    for s, c, b in x.collect():
        assert b == s and c == sum("AGCT".index(ch) * 4 ** (30 - i) for i, ch in enumerate(s))


def test_snp_kmer(spark):
    f = lambda row, i, k: spark.createDataFrame([(row,)], "r string").select(S.snp_kmer(F.col("r"), F.lit(i), k)).first()[0]
    assert f("AACCGGTT", 4, 5) == "CCGGT"
    assert f("AA-CCGG-TT", 5, 5) == "CCGGT"  # gaps are skipped
    assert f("AANCGGTTA", 4, 5) == "CGGTT"  # a side that an N ends is made up for
    assert f("AAN-GNTT", 4, 5) is None and f("AC-GT", 2, 3) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.sampled_from([0.05, 0.25, 0.5, 0.75, 0.95]))
def test_nearest_rank(spark, values, q):
    x = spark.createDataFrame([(sorted(values),)], "v array<int>").select(stats.nearest(F.col("v"), q)).first()[0]
    assert x == sorted(values)[int(np.round(q * (len(values) - 1)))]


def test_binomial_tail(spark):
    x = spark.createDataFrame([(n, m) for n in (1, 10, 11, 71, 164, 500) for m in (0, 1, 2, 3) if m <= n], "n long, m long")
    for n, m, p in x.select("n", "m", stats.binomial_tail(F.col("n"), F.col("m"))).collect():
        assert math.isclose(p, ps.noise_probability(n, m), abs_tol=1e-12)
    both = lambda x, y: ps.noise_probability(x + y, min(x, y)) < 0.05
    assert both(9, 1) and not both(10, 1) and both(69, 2) and not both(70, 2)


def test_noise_of_deep_samples(spark):
    assert 0 <= ps.noise_probability(3000, 1400) < 1e-300 and ps.noise_probability(10**7, 3) > 0.999 and ps.noise_probability(5, 6) == 0
    for n, m in ((40, 0), (40, 1), (400, 2), (900, 9)):
        direct = 1 - sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(m))
        assert math.isclose(ps.noise_probability(n, m), direct, abs_tol=1e-12)
    x = spark.createDataFrame([(3000, 1400), (400_000, 2100), (5, 6), (5, 5)], "n long, m long")
    for n, m, p in x.select("n", "m", stats.binomial_tail(F.col("n"), F.col("m"))).collect():
        assert math.isclose(p, ps.noise_probability(n, m), abs_tol=1e-9)


# ---------------------------------------------------------------- files
def test_fastq_in_many_splits(spark, tmp_path):
    """Records that lie across splits are whole, each once; blank and cut ends give none."""
    r = random.Random(2)
    reads = [(f"q{i}", "".join(r.choices("ACGT", k=r.randint(1, 90)))) for i in range(500)]
    text = "".join(f"@{n} x\n{x}\n+\n{'@' * len(x)}\n" for n, x in reads)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text("@only\r\nACGT\r\n+\r\nIIII\r\n@cut\nAC")
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("@zip\nGG\n+\nII\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_fastq(spark, str(tmp_path))
            assert size == "128m" or got.rdd.getNumPartitions() > 20
            assert rows(got) == sorted([(n, x, "@" * len(x)) for n, x in reads] + [("only", "ACGT", "IIII"), ("zip", "GG", "II")])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta_fastq_and_tables(spark, tmp_path):
    g = tmp_path / "g"
    g.mkdir()
    (g / "s1.x.fna").write_text(">c1 desc\nACG\nTT\n>c2\nGG\n")
    with gzip.open(g / "s2.fa.gz", "wt") as f:
        f.write(">only\r\nacgn\r\n")
    (g / "notes.txt").write_text(">no\nAAA\n")
    assert rows(readers.read_genomes(spark, str(g))) == [("s1", "c1", "ACGTT"), ("s1", "c2", "GG"), ("s2", "only", "acgn")]
    a, b = tmp_path / "r1.fq", tmp_path / "r2.fq.gz"
    a.write_text("@q1 1\nACGT\n+\nIIII\n@q2 1\nTTTT\n+\n@@@@\n")
    with gzip.open(b, "wt") as f:
        f.write("@q1 2\nGGGG\n+\nIIII\n")
    assert rows(readers.read_reads(spark, "x", str(a), str(b)).drop("qual")) == [("x", 1, "q1", "ACGT"), ("x", 1, "q2", "TTTT"), ("x", 2, "q1", "GGGG")]
    m = tmp_path / "m.tsv"
    m.write_text("##\t/d/a.fna\t/d/b.fna\n/d/a.fna\t1\t0.5\n/d/b.fna\t0.5\t1\n")
    assert rows(readers.matrix_pairs(spark, str(m))) == [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)]
    c = tmp_path / "c.tsv"
    c.write_text("1\t2\ta,b\n2\t1\tc\n")
    assert rows(readers.read_clusters(spark, str(c))) == [(1, "a"), (1, "b"), (2, "c")]
    t = tmp_path / "t.tsv"
    t.write_text("3\tN\t1 2\tN\n1\t3\tN\ta\n2\t3\tN\tb\n")
    assert [tuple(r) for r in readers.read_tree(spark, str(t)).orderBy("id").collect()] == [(1, 3, None, "a"), (2, 3, None, "b"), (3, None, [1, 2], None)]
    k = tmp_path / "k.gff"
    k.write_text("##gff\ns1\tx\tb\t11\t20\t.\t-\t.\tID=7\n")
    assert rows(readers.read_blocks(spark, str(k))) == [("7", "s1", "-", 10, 20)]


def test_writers_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "TTTTTTTTTT")], "strain string, seq string")
    writers.write_fasta(x, str(tmp_path / "f"), "strain")
    assert rows(readers.fasta_records(spark.read.text(str(tmp_path / "f"), wholetext=True)).groupBy("contig").agg(F.max("seq"))) == rows(x)
    writers.write_table(x, str(tmp_path / "t"), "strain")
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("strain", "seq")) == rows(x)
    writers.write_report(x, str(tmp_path / "r"))
    assert rows(spark.read.csv(str(tmp_path / "r"), sep="\t", header=True)) == rows(x)
    b = spark.createDataFrame([("1", "a", "-", 2, 6), ("1", "b", "+", 0, 4)], "block string, strain string, strand string, start long, end long")
    assert writers.block_text(b, x).first()[0] == "a\ns a 2 4 - 10 GTAC\ns b 0 4 + 10 TTTT\n"
    assert rows(writers.representatives(x, spark.createDataFrame([("a",)], "rep string"))) == [("a", "ACGTACGTAC")]


# ---------------------------------------------------------------- sets, similarity, clusters
def random_inc(spark, n_strains=8, n_kmers=60, seed=0):
    r = random.Random(seed)
    data = {(s, k) for s in range(n_strains) for k in range(n_kmers) if r.random() < 0.5}
    return data, spark.createDataFrame(sorted(data), "strain long, kmer long")


def test_jaccard_and_sketch(spark):
    data, inc = random_inc(spark)
    of = {s: {k for t, k in data if t == s} for s in range(8)}
    got = {(a, b): j for a, b, _, j in sm.jaccard(inc).collect()}
    assert got == {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in of for b in of if a < b}
    near = sm.jaccard_sketched(inc, spark.createDataFrame(list(got), "a long, b long")).collect()
    assert all(abs(r.jaccard - got[r.a, r.b]) < 0.05 for r in near)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_single_linkage_is_union_find(spark, edges):
    root = list(range(13))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    items = spark.createDataFrame([(i,) for i in range(13)], "strain long")
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges] or [(0, 0, 1.0)], "a long, b long, similarity double")
    assert dict(rows(sm.single_linkage(items, pairs, 0.95))) == dict(enumerate(root))


def test_complete_linkage_splits_a_chain(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "strain long")
    pairs = spark.createDataFrame([(0, 1, 0.99), (1, 2, 0.96), (0, 2, 0.5), (3, 4, 0.97)], "a long, b long, similarity double")
    assert len({c for _, c in rows(sm.single_linkage(items, pairs, 0.95))}) == 2
    assert rows(sm.complete_linkage(items, pairs, 0.95)) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)]


def test_dendrogram_and_node_sets(spark):
    tree = sm.dendrogram([1, 2, 3, 4], [(1, 2, 0.9), (3, 4, 0.8), (2, 3, 0.1)])
    assert dict(tree) == {1: 5, 2: 5, 3: 6, 4: 6, 5: 7, 6: 7, 7: None}
    nodes = spark.createDataFrame(tree, "id long, parent long")
    up = ks.closure(nodes)
    assert up.where("node = 1").count() == 3 and up.count() == 4 * 3 + 2 * 2 + 1
    leaves = up.where("node <= 4").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))
    ck = [(c, k, core) for k, cs, core in (("all", (1, 2, 3, 4), True), ("left", (1, 2), True), ("one", (1,), True), ("cross", (1, 3), True), ("spec", (3, 4), False)) for c in cs]
    got = ks.node_sets(spark.createDataFrame(ck, "cluster long, kmer string, is_core boolean"), leaves)
    assert rows(got) == [(1, "one"), (5, "left"), (7, "all")]


def test_weak_leaves_join_their_nearest(spark):
    """Clusters 1 (strains 1, 2) and 5 have enough k-mers of their own, 4 has one and is closest to 5."""
    k = {1: range(0, 10), 2: range(0, 10), 4: [*range(20, 26), 90], 5: range(20, 32)}
    mult = spark.createDataFrame([(t, x, 1) for t, xs in k.items() for x in xs], "strain long, kmer long, mult long")
    cluster = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 5)], "strain long, cluster long")
    sims = spark.createDataFrame([(1, 4, 0.1), (4, 5, 0.5), (2, 5, 0.05), (1, 2, 1.0)], "a long, b long, similarity double")
    assert rows(ix.repaired(mult, cluster, sims, ix.BuildConfig(mink=3, alpha=0.5)).select("strain", "cluster")) == [(1, 1), (2, 1), (4, 4), (5, 4)]


def test_closure_of_a_long_chain(spark):
    n = 1500
    nodes = spark.createDataFrame([(i, i + 1 if i < n else None) for i in range(1, n + 1)], "id long, parent long")
    up = ks.closure(nodes)
    assert up.count() == n * (n + 1) // 2 and up.agg(F.max("up")).first()[0] == n - 1
    assert up.where("ancestor - node <> up").isEmpty() and ks.depths(nodes).where(f"depth <> {n} - id").isEmpty()


def test_jaccard_with_a_threshold_is_that_of_all_pairs(spark):
    for seed in range(3):
        data, inc = random_inc(spark, 10, 40, seed)
        twin = inc.unionByName(inc.where("kmer <> 7").select((F.col("strain") + 100).alias("strain"), "kmer"))
        every = rows(sm.jaccard(twin))
        for least in (0.3, 0.9, 1.0):
            assert rows(sm.jaccard(twin, least=least)) == [x for x in every if x[3] >= least]


def test_spanning_forest_gives_the_same_dendrogram(spark):
    r = random.Random(4)
    pairs = [(a, b, r.random()) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.6]
    got = sm.spanning_forest(spark.createDataFrame(pairs, "a long, b long, similarity double").repartition(5)).collect()
    assert len(got) <= 5 * 11 and sm.dendrogram(list(range(12)), [tuple(x) for x in got]) == sm.dendrogram(list(range(12)), pairs)


def test_forest_without_all_pairs(spark):
    """Groups of near strains, loose ones, and one with no k-mer in common: the same edges as of all pairs, ties included."""
    r = random.Random(14)
    base = [set(r.sample(range(400), 80)) for _ in range(4)]
    of = {i: (base[i % 4] - set(r.sample(sorted(base[i % 4]), r.choice([0, 2, 20, 60])))) | set(r.sample(range(400), r.choice([0, 3, 20]))) for i in range(1, 30)}
    of |= {30: {900, 901}, 31: set(of[1]), 32: set(of[1])}
    inc = spark.createDataFrame([(i, k) for i, x in of.items() for k in x], "strain long, kmer long")
    ranked = sorted(((a, b, len(of[a] & of[b]) / len(of[a] | of[b])) for a in of for b in of if a < b and of[a] & of[b]), key=lambda e: (-e[2], e[0], e[1]))
    root, kept = {i: i for i in of}, []
    for a, b, j in ranked:
        if root[a] != root[b]:
            x, y = root[a], root[b]
            root = {i: x if c == y else c for i, c in root.items()}
            kept.append((a, b, j))
    assert rows(sm.spanning_edges(inc)) == sorted(kept)


def test_complete_linkage_equals_a_plain_version(spark):
    r = random.Random(6)
    for n in (9, 16):
        pairs = {(a, b): r.choice((0.5, 0.9, 0.93, 0.96, 1.0)) if n == 9 else r.choice((0.4, 0.91, 0.95)) if (a - b) % 4 else 0.97 for a in range(n) for b in range(a + 1, n)}
        groups = [[i] for i in range(n)]
        while True:
            far = lambda x, y: max(1 - pairs[min(i, j), max(i, j)] for i in x for j in y)
            d, x, y = min(((far(x, y), x, y) for n, x in enumerate(groups) for y in groups[n + 1 :]), key=lambda t: (t[0], min(t[1]), min(t[2])), default=(2, 0, 0))
            if d > 0.1 + 1e-12:
                break
            groups = sorted([g for g in groups if g not in (x, y)] + [x + y], key=min)
        items = spark.createDataFrame([(i,) for i in range(n)], "strain long")
        got = sm.complete_linkage(items, spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, similarity double"), 0.9)
        assert rows(got) == sorted((i, min(g)) for g in groups for i in g)


def test_near_identical_strains_are_one(spark):
    k = {1: range(100), 2: range(1, 100), 3: range(50, 160), 4: range(1000, 1100)}
    inc = spark.createDataFrame([(1 if s < 4 else 2, s, x) for s, xs in k.items() for x in xs], "cluster long, strain long, kmer long")
    assert rows(sm.near_identical(inc, 0.011)) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 4, 4)]
    assert rows(sm.near_identical(inc, 0.005)) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 4)]


def test_medoids_and_reassignment(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "strain long, cluster long")
    d = {(1, 2): 0.1, (2, 3): 0.1, (1, 3): 0.3, (4, 5): 0.2, (5, 6): 0.05}
    p = spark.createDataFrame([(a, b, d.get((a, b), 0.9)) for a in range(1, 7) for b in range(a + 1, 7)], "a long, b long, distance double")
    reps = sm.medoids(c, p)
    assert rows(reps) == [(1, 2), (2, 4), (3, 6)]
    assert rows(sm.reassigned(c, reps, p)) == [(1, 1, 1), (3, 1, 1), (5, 2, 3)]


def test_medoid_counts_members_without_a_common_kmer(spark, tmp_path):
    """Strain 4 is near to 5 and shares nothing with the others; 1 is related to all of these (F9). 9 has no k-mers."""
    kmers = {1: range(0, 30), 2: range(0, 20), 3: range(10, 30), 4: range(100, 110), 5: range(100, 109), 6: range(5, 25)}
    line = [(s, k, 1.0) for s, ks in kmers.items() for k in ks]
    spark.createDataFrame(line, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    nation = dict.fromkeys((1, 2, 3, 4, 5, 6, 9), 0) | {7: 1, 8: 1}
    spark.createDataFrame(list(nation.items()), "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(queries.t2_medoid(spark, str(tmp_path))) == [(0, 1), (1, 7)]
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "strain long, cluster long")
    p = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, distance double")
    assert rows(sm.medoid_stats(c, p, 1.0)) == [(1, 1, 0.75, 0.5, 1.0), (1, 2, 0.75, 0.5, 1.0), (1, 3, 1.0, 1.0, 1.0)]
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(queries.ORACLE["t2_medoid"]).fetchall()) == [(0, 1), (1, 7)]


# ---------------------------------------------------------------- search
def test_identify_corrects_for_accepted_leaves(spark):
    from seqlake.plans import index as ix

    leaf, rest = [f"a{i}" for i in range(40)], [f"d{i}" for i in range(40)]
    kmers = {9: [f"r{i}" for i in range(40)], 1: leaf, 8: [f"c{i}" for i in range(40)], 3: leaf[:12] + [f"b{i}" for i in range(12)], 4: rest}
    depth = dict.fromkeys(kmers[9], 15) | dict.fromkeys(leaf, 10) | dict.fromkeys(kmers[8] + rest, 5)
    node = spark.createDataFrame([(i, p, i < 8, len(kmers[i]), i == 3) for i, p in ((9, None), (1, 9), (8, 9), (3, 8), (4, 8))], ix.SCHEMAS["node"])
    node_kmer = spark.createDataFrame([(k, i) for i, x in kmers.items() for k in x], ix.SCHEMAS["node_kmer"])
    cluster_kmer = spark.createDataFrame([(i, k) for i in (1, 3, 4) for k in kmers[i]], ix.SCHEMAS["cluster_kmer"])
    index = ix.Index(None, node, node_kmer, None, cluster_kmer, ix.BuildConfig(mink=10))
    counts = spark.createDataFrame(list(depth.items()), "kmer string, cnt long")
    assert {f.cluster for f in ix.find_clusters(index, counts.withColumn("sample", F.lit("s"))).collect()} == {1, 4}


# ---------------------------------------------------------------- strains
def mixture(seed=0, weights=(3, 0, 1, 0, 0, 0)):
    r = np.random.default_rng(seed)
    x = r.random((40, 6)) < 0.5
    n = r.integers(60, 120, 40)
    return x, n, x @ np.array(weights) * 10


def test_scan_finds_dominant_then_second():
    x, n, y = mixture()
    found = psc.scan(x, y, y, n, dm.ScanConfig(least_new=100))
    assert [r["strain"] for r in found][:1] == [0] and 2 in [r["strain"] for r in found] and len(found) <= 16


def test_elastic_net_meets_its_conditions():
    x, n, y = mixture(1, (2, 1, 0, 0, 0, 4))
    xf = x.astype(float)
    g, q = (xf * n[:, None]).T @ xf / n.sum(), (xf * n[:, None]).T @ y / n.sum()
    w = dm._descend(g, q, 0.3, 0.1, np.zeros(6), 1e-12, 100_000)
    grad = g @ w - q + 0.3 + 0.1 * w
    assert (w >= 0).all() and np.allclose(grad[w > 0], 0, atol=1e-6) and (grad[w == 0] >= -1e-6).all()


def scanned(spark, cases, cfg):
    """Rows of dm.scan and of detect over planted clusters. cases: cluster -> (patterns, y, own, n); a k-mer for each of the n."""
    l2, counts, own, k = [], [], [], 0
    for c, (x, y, o, n) in cases.items():
        for p in range(len(x)):
            for _ in range(n[p]):
                l2 += [(c, 100 + s, k) for s in range(x.shape[1]) if x[p, s]]
                counts.append((k, int(y[p])))
                own.append((k, int(o[p])))
                k += 1
    l2 = spark.createDataFrame(l2, "cluster long, strain long, kmer long")
    counts, own = (spark.createDataFrame(t, "kmer long, cnt long") for t in (counts, own))
    rows_, member = dm.pattern_rows(l2, counts, own)
    return l2, counts, own, rows_, member, dm.scan(rows_, member, cfg).collect()


def test_scan_of_all_clusters_equals_the_plain_one(spark):
    """Mixtures, one without exclusive counts, one hardly covered, one below the floor, one of a single strain; patterns with ties."""
    r = np.random.default_rng(7)
    cases = {}
    for c in range(7):
        x = np.unique(r.random((40, 5)) < 0.5, axis=0)
        x = x[x.any(1)]
        n = r.integers(20, 60, len(x))
        y = x @ r.integers(0, 5, 5) * r.integers(1, 6)
        cases[c] = (x, y, np.where(r.random(len(x)) < 0.7, y, 0), n)
    cases[3] = (*cases[3][:2], cases[3][1] * 0, cases[3][3])
    cases[4] = (cases[4][0], cases[4][1] * 0 + np.eye(1, len(cases[4][0]), 2, dtype=int)[0] * 7, cases[4][2] * 0, np.where(np.eye(1, len(cases[4][0]), 2)[0], 1, 60))
    cases[5] = (np.ones((1, 1), bool), np.array([9]), np.array([9]), np.array([50]))
    for cfg in (dm.ScanConfig(least_new=40), dm.ScanConfig(coverage=0.0, least_new=20, remain=0.0, rounds=3)):
        got = {}
        for t in scanned(spark, cases, cfg)[-1]:
            got.setdefault(t.cluster, []).append((t.turn, t.strain - 100, t.covered, t.total, t.valid, round(t["cov"], 9), round(t.remain, 9), None if math.isnan(t.depth) else round(t.depth, 9)))
        for c, (x, y, o, n) in cases.items():
            want = [(f["strain"], f["covered"], f["total"], f["valid"], round(f["cov"], 9), round(f["remain"], 9), None if math.isnan(f["depth"]) else round(f["depth"], 9)) for f in psc.scan(x, y, o, n, cfg)]
            assert [t[1:] for t in sorted(got[c], key=lambda t: t[0])] == want, c


def test_sums_are_those_of_all_rows_and_halves(spark):
    """Sums by half equal those worked out k-mer by k-mer, and the coefficients those of the same halves; 3 : 1 comes out."""
    x, n, y = (t[mixture()[0].any(1)] for t in mixture())
    l2, counts, own, rows_, member, found = scanned(spark, {9: (x, y, y, n)}, dm.ScanConfig(least_new=100))
    pick = spark.createDataFrame([(9, 100), (9, 102)], "cluster long, strain long")
    got = {(r.kind, r.i, r.j): np.array(r.v) for r in dm.sums(rows_, member, pick).collect()}
    of = {r.kmer: r.h for r in counts.select("kmer", F.xxhash64("kmer").alias("h")).collect()}
    at = np.repeat(np.arange(len(x)), n)
    half = np.array([[1, *((of[k] >> i) & 1 for i in range(dm.SPLITS))] for k in range(len(at))], float)
    z, c = np.where(y <= 1, 0, y)[at].astype(float), x[at][:, [0, 2]].astype(float)
    gram, xy = np.einsum("kw,ki,kj->wij", half, c, c), np.einsum("kw,ki,k->wi", half, c, z)
    assert np.allclose(got["xx", 100, 102], gram[:, 0, 1]) and np.allclose(got["xx", 102, 102], gram[:, 1, 1]) and np.allclose(got["xy", 102, None], xy[:, 1])
    assert np.allclose(got["yy", None, None], half.T @ (z * z)) and np.allclose(got["n", None, None], half.sum(0))
    w = {r.strain: r.c for r in dm.coefficients(rows_, member, pick).collect()}
    want, _ = dm.net_of_sums(gram, xy, half.T @ (z * z), half.sum(0))
    assert np.allclose([w[100], w[102]], want, atol=1e-6) and abs(w[100] / sum(w.values()) - 0.75) < 0.05


def test_one_sigma():
    for mean, sd, chosen in (([9.0, 4.0, 3.0, 3.5], [1.0, 1.0, 1.2, 1.0], 1), ([9.0, 4.0, 3.0, 3.5], [1.0, 1.0, 0.1, 1.0], 2), ([2.0] * 3, [0.0] * 3, 0)):
        assert dm.one_sigma(np.array(mean), np.array(sd)) == chosen


def test_detect_by_cluster(spark):
    x, n, y = mixture()
    l2, counts, k = [], [], 0
    for p in range(40):
        for _ in range(n[p]):
            l2 += [(9, 100 + s, k) for s in range(6) if x[p, s]]
            counts.append((k, int(y[p])))
            k += 1
    c = spark.createDataFrame(counts, "kmer long, cnt long")
    out = dm.detect(spark.createDataFrame(l2, "cluster long, strain long, kmer long"), c, c, dm.ScanConfig(least_new=100)).collect()
    best = max(out, key=lambda r: r.abundance)
    assert best.strain == 100 and math.isclose(sum(r.abundance for r in out), 1)


def test_golden_report_arithmetic(spark):
    """Shares, depths and marks of two published reports."""
    one = spark.createDataFrame([(4, 0, 1.0, 3.8265, 53133 / 60414, 53133, 60414, 53133, 0.0)], dm.RESULT)
    r = rp.strain_report(one, spark.createDataFrame([(4, 3.8326)], "cluster long, cls_ab double")).first()
    assert round(r["cov"], 5) == 0.87948 and r.exist_evidence == "*" and r.final_depth == 3.8326
    two = spark.createDataFrame([(4, 0, 0.50627, 1.2744, 0.50198, 26893, 1, 26640, 0.5), (4, 1, 0.49373, 1.2428, 0.46827, 33395, 1, 33395, 0.4)], dm.RESULT)
    got = rp.strain_report(two, spark.createDataFrame([(4, 3.499)], "cluster long, cls_ab double")).orderBy("strain_rank").collect()
    assert [round(x.final_depth, 2) for x in got] == [1.77, 1.73] and all(x.exist_evidence is None for x in got)


# ---------------------------------------------------------------- whole runs
@pytest.fixture(scope="module")
def genomes(spark):
    r = random.Random(11)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    base = dna(4000)
    twin = base[:2000] + ("A" if base[2000] != "A" else "C") + base[2001:]
    return {1: base, 2: twin, 3: dna(4000), 4: dna(4000)}


CFG = ix.BuildConfig(mink=50, maxk=3000)


def reads_of(seq, depth, length=100):
    step = max(1, length // depth)
    return [(seq[i : i + length],) for i in range(0, len(seq) - length + 1, step)]


def test_build_write_load_identify(spark, genomes, tmp_path):
    g = spark.createDataFrame(list(genomes.items()), "strain long, seq string")
    index = ix.build_index(g, CFG)
    assert {tuple(sorted(x.strain for x in index.cluster.collect() if x.cluster == c)) for c in {r.cluster for r in index.cluster.collect()}} == {(1, 2), (3,), (4,)}
    index.write(str(tmp_path / "db"))
    index = ix.Index.load(spark, str(tmp_path / "db"))
    reads = spark.createDataFrame(reads_of(genomes[3], 10) + reads_of(genomes[4], 5), "seq string")
    out = ix.identify(index, reads).orderBy("id").collect()
    assert [r.strain for r in out] == [3, 4] and abs(out[0].relative_abundance - 2 / 3) < 0.05
    likely = ix.cluster_probabilities(index, ix.counts_of(reads, CFG)).collect()
    assert {r.cluster for r in likely} == {1, 3, 4} or not likely


def test_subsample_keeps_one_of_twins(spark, genomes):
    g = spark.createDataFrame(list(genomes.items()), "strain long, seq string")
    assert {r.rep for r in ix.subsample(g, CFG, 0.98).collect()} == {1, 3, 4}


def test_strain_kmers_caps_blocks_and_twins(spark, genomes):
    g = spark.createDataFrame([(1, genomes[1]), (2, genomes[2]), (3, genomes[1][:2500] + genomes[3][:1500])], "strain long, seq string")
    cluster = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "strain long, cluster long")
    own = ix.occurrences(g, CFG).distinct().join(cluster, "strain")
    of = {}
    for c, k in own.select("strain", "kmer").collect():
        of.setdefault(k, set()).add(c)
    l2, twin = ix.strain_kmers(g, own, cluster, ix.BuildConfig(recluster=0.0))
    assert {(r.strain, r.kmer) for r in l2.collect()} == {(s, k) for k, w in of.items() if len(w) < 3 for s in w} and twin.where("strain <> rep").isEmpty()
    few, _ = ix.strain_kmers(g, own, cluster, ix.BuildConfig(unique_cap=5, recluster=0.0))
    alone = [x for x in rows(few.select("strain", "kmer")) if len(of[x[1]]) == 1]
    assert alone == sorted((s, k) for s in (1, 2, 3) for k in sorted(k for k, w in of.items() if w == {s})[:5])
    # a partial block of strains 1 and 2 from 2400 on: k-mers within it that strain 3 has not
    blocks = spark.createDataFrame([("p", 1, "+", 2400, 4000), ("p", 2, "+", 2400, 4000), ("g", 1, "+", 0, 600), ("g", 2, "+", 0, 600), ("g", 3, "+", 0, 600)], "block string, strain long, strand string, start long, end long")
    inside = {x for x in S.codes_of(genomes[1][2400:].encode(), 31, "canonical").tolist() if of[x] == {1, 2}}
    for share, kept in ((1.0, inside), (0.0, set())):
        got, _ = ix.strain_kmers(g, own, cluster, ix.BuildConfig(unique_cap=0, share=share, recluster=0.0), blocks)
        assert {(r.strain, r.kmer) for r in got.collect()} == {(1, k) for k in kept}  # which do not tell 1 from 2


def test_memory_mode_halves_the_thresholds(spark):
    cfg = ix.BuildConfig(memory=True)
    assert (cfg.least, ix.BuildConfig().least) == (500, 1000)
    x = spark.createDataFrame([(499, True), (500, True), (1500, False)], "n long, leaf boolean")
    assert [r[0] for r in x.select(stats.category(F.col("n"), F.col("leaf"), F.lit(False), cfg.least, 3 * cfg.least, True)).collect()] == ["0", "1", "2"]


def test_two_related_strains_and_their_depths(spark, genomes):
    """Two clusters and, within one, two strains: depths come out within a tenth."""
    r = random.Random(5)
    base = genomes[1]
    other = "".join(c if r.random() > 0.02 else r.choice("ACGT") for c in base)
    g = spark.createDataFrame([(1, base), (2, other), (3, genomes[3])], "strain long, seq string")
    cfg = ix.BuildConfig(mink=50, similarity=0.3)
    index = ix.build_index(g, cfg)
    assert index.cluster.select("cluster").distinct().count() == 2
    ring = lambda x, depth: reads_of(x + x[:199], depth, 200)
    reads = spark.createDataFrame(ring(base, 20) + ring(other, 10) + ring(genomes[3], 10), "seq string")
    got = ix.report(index, reads, scan=dm.ScanConfig(least_new=100))
    depth = {x.strain: x.model_depth for x in got.strains.collect()}
    per_kmer = lambda d: d * (200 - 30) / 200
    assert math.isclose(depth[1], per_kmer(20), rel_tol=0.1) and math.isclose(depth[2], per_kmer(10), rel_tol=0.1)
    assert {x.strain for x in got.merged.collect()} == {1, 2, 3} and got.strains.where("total < covered or cov > 1").isEmpty()


def test_filtered_counts_are_the_counts_of_known_kmers(spark):
    r = random.Random(2)
    dna = lambda n: "".join(r.choice("ACGTN" if r.random() < 0.01 else "ACGT") for _ in range(n))
    own = dna(3000)
    reads = spark.createDataFrame([("a", own[i : i + 90]) for i in range(0, 2900, 50)] + [("a", dna(500)), ("b", dna(4000) + own[:60]), ("b", None), ("c", dna(20))], "sample string, seq string")
    cfg = ix.BuildConfig(k=21)
    known = ix.occurrences(spark.createDataFrame([(1, own)], "strain long, seq string"), cfg).select("kmer")
    every = ix.counts_of(reads, cfg)
    assert rows(ix.counts_of(reads, cfg, known)) == rows(every.join(known.distinct(), "kmer", "left_semi").select("sample", "kmer", "cnt"))
    keep = kf.kmer_filter(known.distinct())
    codes = np.array([x.kmer for x in known.collect()])
    assert keep(codes).all() and keep(np.random.default_rng(1).integers(0, 1 << 42, 100_000)).mean() < 0.2
    assert kf.width(1) == 1 << 16 and kf.width(10**8) == 1 << 30 and kf.width(2 * 10**9) is None
    assert rows(ix.counts_of(reads, ix.BuildConfig(k=35), ix.occurrences(spark.createDataFrame([(1, own)], "strain long, seq string"), ix.BuildConfig(k=35)).select("kmer")))
    assert not ix.counts_of(reads, cfg, known.limit(0)).collect()


def test_samples_are_reported_apart(spark, genomes):
    """Two samples at once give what each gives alone."""
    index = ix.build_index(spark.createDataFrame(list(genomes.items()), "strain long, seq string"), CFG)
    reads = {"x": reads_of(genomes[3], 10) + reads_of(genomes[4], 5), "y": reads_of(genomes[2], 6) + reads_of(genomes[4], 6)}
    both = ix.report(index, spark.createDataFrame([(k, *r) for k, x in reads.items() for r in x], "sample string, seq string"))
    assert both.merged.columns[:1] == ["sample"]
    for k, x in reads.items():
        one = ix.report(index, spark.createDataFrame(x, "seq string"))
        for a, b in ((both.merged, one.merged), (both.strains, one.strains), (both.singles, one.singles)):
            assert sorted(map(str, a.where(F.col("sample") == k).drop("sample").collect())) == sorted(map(str, b.collect()))


def test_a_plasmid_of_which_little_is_there(spark, genomes):
    """0.4 of a plasmid of strain 2 is in the reads: found, as its coverage has no floor in this mode."""
    r = random.Random(21)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    one, two, three = dna(1500), dna(1500), dna(1500)
    contigs = spark.createDataFrame([(1, genomes[1]), (2, genomes[1]), (1, one), (2, two), (2, three)], "strain long, seq string")
    index = ix.build_index(contigs.where(F.length("seq") > 2000), CFG)
    reads = spark.createDataFrame(reads_of(genomes[1], 10) + reads_of(two[:660], 10), "seq string")
    got = ix.plasmids(index, reads, contigs, below=2000, mink=50)
    assert [x.strain for x in got.merged.collect()] == [2]


def test_short_contigs(spark):
    g = spark.createDataFrame([(1, "A" * 10), (1, "A" * 200), (2, "A")], "strain long, seq string")
    assert ix.short_contigs(g, spark.createDataFrame([(1,)], "strain long"), 100).count() == 1


def test_streamed_counts_equal_batch(spark, tmp_path):
    from seqlake.streaming.counts import read_stream, streamed_counts

    data = [("ACGTACGTTG",), ("TTTTACGNAC",)]
    spark.createDataFrame(data, "seq string").write.parquet(str(tmp_path / "in"))
    q = streamed_counts(read_stream(spark, str(tmp_path / "in")), 4).writeStream.outputMode("complete").format("memory").queryName("kc").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert rows(spark.table("kc")) == rows(ix.counts_of(spark.createDataFrame(data, "seq string"), ix.BuildConfig(k=4)))


@pytest.mark.parametrize("k", [5, 31])
def test_fasta_slices_have_the_kmers_of_whole_records(spark, tmp_path, k):
    """Files in many splits, some of a few letters: long and short records, headers at borders, blank lines, text before the first."""
    r = random.Random(k)
    dna = lambda n: "".join(r.choice("ACGTN" if r.random() < 0.02 else "ACGT") for _ in range(n))
    lines = lambda x: "\n".join(x[j : j + 60] for j in range(0, len(x), 60))
    g = tmp_path / "g"
    g.mkdir()
    for name, sizes in {"a": [5000], "b": [0, 3, 40, 700, 29, 30, 31, 2000, 1], "c": [12] * 60, "d": []}.items():
        body = "".join(f">{name}{i} x\n" + lines(dna(n)) + ("\r\n\n" if i % 2 else "\n") for i, n in enumerate(sizes))
        (g / f"{name}.fna").write_text(("left out\n" if name != "a" else "") + body)
    with gzip.open(g / "e.fa.gz", "wt") as f:
        f.write(f">e\n{dna(300)}\n")
    (g / "notes.txt").write_text(">no\n" + dna(100))
    cfg = ix.BuildConfig(k=k, strand="given")
    count = lambda df: Counter(map(tuple, ix.occurrences(df.select("strain", "seq"), cfg).collect()))
    want = count(readers.read_genomes(spark, str(g)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most, size in (("64b", 100), ("500b", 64), ("128m", 1 << 20)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = readers.read_genome_slices(spark, str(g), k, size=size)
            assert count(got) == want
            assert most == "64b" or got.agg(F.max(F.length("seq"))).first()[0] <= max(2 * (size + k), 2 * k * 20)
            assert most != "500b" or got.select("strain").where("strain = 'a'").count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
