"""Every query with SQL equals it on the smallest tables; the others run and hold what they must."""

import functools
import operator
import os
from collections import Counter

import duckdb
import pytest

from seqlake.functions import sequence as S
from seqlake.plans import cases, search_cases
from seqlake.plans import queries as own
from seqlake.plans.queries import K
from seqlake.plans.views import SQL

QUERIES, ORACLE = own.QUERIES | cases.QUERIES | search_cases.QUERIES, own.ORACLE | cases.ORACLE | search_cases.ORACLE
D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return c


def plain(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got, "an empty result shows nothing"
    if name not in ORACLE:
        return
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert plain(got) == plain([tuple(r[i] for i in at) for r in rel.fetchall()])


@pytest.fixture(scope="module")
def genome(con):
    return dict(con.sql(f"WITH {SQL['genome']} SELECT strain, seq FROM genome").fetchall())


def test_all_kmers_are_encoded(spark, genome):
    got = {r.strain: r for r in QUERIES["p6_encode2bit"](spark, D).collect()}
    assert {i: r.n for i, r in got.items()} == {i: len(x) - K + 1 for i, x in genome.items() if len(x) >= K}
    assert all(r.n == r.n_back for r in got.values())
    for i, r in list(got.items())[:20]:
        codes = [int("".join(str("AGCT".index(c)) for c in genome[i][j : j + K]), 4) for j in range(r.n)]
        assert r.codes == functools.reduce(operator.xor, codes)


def snp(row, c):
    left, right = row[:c].replace("-", "").split("N")[-1], row[c + 1 :].replace("-", "").split("N")[0]
    n = min(len(left), K // 2 + max(0, K // 2 - len(right)))
    return left[len(left) - n :] + row[c] + right[: K - 1 - n] if n + len(right) >= K - 1 else None


def test_snp_kmers_of_all_columns(spark, genome):
    rows = {i: x.replace("AC", "A-").replace("TT", "TN")[:400] for i, x in list(genome.items())[:40]}
    rows |= {-1: "", -2: "-" * 90, -3: "AC-GT" * 20 + "-" * 70 + "ACGTA" * 8, -4: "N".join("ACG" * n for n in (5, 10, 11, 40)), -5: "ACGTACGTA-CGTACGTACGTACGTACGTAGG"}
    got = S.snp_kmers(spark.createDataFrame(list(rows.items()), "strain long, row string"), K).collect()
    assert sorted((r.strain, r.column, r.kmer or "") for r in got) == sorted((i, c, snp(x, c) or "") for i, x in rows.items() for c in range(len(x)) if x[c] not in "-N")


def strains_by_kmer(pairs):
    out = {}
    for i, k in pairs:
        out.setdefault(k, set()).add(i)
    return out


def test_unique_and_exclusive_kmers_of_all_genomes(spark, genome):
    of = strains_by_kmer((i, x[j : j + K]) for i, x in genome.items() for j in range(len(x) - K + 1))
    unique, exclusive, confined = {}, Counter(), Counter()
    for k, who in of.items():
        if len(who) == 1:
            unique.setdefault(min(who), []).append(k)
        if len({i % 2 for i in who}) == 1:
            exclusive.update(who)
        if len(who) > 1 and len({i % 3 for i in who}) == 1:
            confined[min(who) % 3, len(who)] += 1
    got = {name: QUERIES[name](spark, D).collect() for name in ("a5_whole_unique", "a6_whole_unique_cap", "a7_whole_partial_block", "j3_whole_anti")}
    assert {r.strain: r.n_kmers for r in got["a5_whole_unique"]} == {i: len(k) for i, k in unique.items()}
    code = lambda k: int("".join(str("AGCT".index(c)) for c in k), 4)
    assert sorted((r.strain, r.kmer) for r in got["a6_whole_unique_cap"]) == sorted((i, k) for i, ks in unique.items() for k in sorted(map(code, ks))[:20])
    assert {(r.block, r.n_strains): r.n_kmers for r in got["a7_whole_partial_block"]} == confined
    assert {r.strain: r.n_kmers for r in got["j3_whole_anti"]} == exclusive
