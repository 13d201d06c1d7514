"""The pipeline, stage by stage, against brute force; and the package without this subpackage."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import pii

from . import brute

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(6)
    v = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(v, k=n))
    passage, base = line(70), line(120)
    texts = [line(rng.randint(20, 120)) for _ in range(150)] + [line(30) + "\n" + passage + "\n" + line(30) for _ in range(4)]
    texts += [base, base, base + " end", "mail x.y@z.org " + line(60), None, ""]
    bad = [" ".join(w + "***" for w in rng.choices(v, k=40)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts + bad)]
    labels = [(i, 1, 0) for i in range(0, 150)] + [(len(texts) + i, 0, 0) for i in range(60)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, len(texts)


def test_stages(spark, sf, tmp_path):
    d, rows, good = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, {r[0]: r[1] for r in rows}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert docs.columns == columns, name
        now = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            assert len(set(range(good)) - set(now)) <= 2 and len(set(now) - set(range(good))) <= 2
        elif k == 1:
            comp = brute.components(list(before.items()), 5)
            assert set(now) == {i for i in before if comp[i] == i}
        elif k == 2:
            for (i, t), (w, gone) in zip(before.items(), brute.repeated(list(before.values()), 35), strict=True):
                assert brute.words(now[i].text) == [x for x, g in zip(w, gone, strict=True) if not g]
                assert now[i].text == t or any(gone)
        else:
            for i, t in before.items():
                assert now[i].text == t or pii.base_spans(t)
            assert any("<EMAIL>" in (r.text or "") for r in now.values())
        assert all(r.n_chars == len(r.text) for r in now.values() if r.text is not None)
        before = {i: r.text for i, r in sorted(now.items())}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


WIDE = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, key string, kept string, component_id string"


def test_stages_of_odd_tables(spark, sf, tmp_path):
    """No rows, null ids and texts, repeated rows and ids, a very long text, and columns named like those that operators make."""
    d = sf[0]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        assert f(spark, spark.createDataFrame([], WIDE), d).count() == 0, name
    v = [f"w{i}" for i in range(3000)]
    a, b, long = " ".join(v[:90]), " ".join(v[100:190]), " ".join(v[i * 7 % 3000] + str(i // 3000) for i in range(60_000))
    texts = [(1, a), (1, a), (2, b), (2, a), (None, a), (None, b), (None, " ".join(v[500:560])), (None, None), (None, None), (3, None), (3, None), (4, ""), (5, long), (6, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "s", "r", "k", "t", "c") for i, t in texts], WIDE)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, d)
    assert kept.columns == docs.columns
    order = lambda rows: sorted(rows, key=lambda r: (r[0] or 0, r[1] or ""))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((t or "")[:9] for _, t in got) == sorted(x[:9] for x in (a, b, " ".join(v[500:560]), "", "", "", "", "", long))
    assert (1, a) in got and (5, long) in got and (6, long) not in got and (4, "") in got
    for k in (0, 2, 3):
        out = corpus_pipeline.STAGES[k][1](spark, docs, d)
        assert out.columns == docs.columns and out.where("key <> 'k' or kept <> 't' or row <> 'r' or component_id <> 'c' or score <> 's'").isEmpty()
        rows = [(r.doc_id, r.text) for r in out.collect()]
        assert len(rows) == len(texts) or k == 0
        if k == 3:
            assert order(rows) == order(texts)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, d)
    assert pieces.where("doc_id is null").count() >= 5 and pieces.where("doc_id = 4").collect()[0].length == 1


def test_run(spark, sf):
    d, _, _ = sf
    assert corpus_pipeline.run(spark, d).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("seqlake", "__spark_entry__.py"):
        src = os.path.join(TOP, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    shutil.copy(os.path.join(TOP, "corpus_pipeline.py"), tmp_path)  # without what it stands on
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [k for k in q if k.startswith('op')] and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
