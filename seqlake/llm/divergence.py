r"""How the sources of a language differ in their words: wide term vectors, compared entry by entry.

Tasks count terms by (lang, source) in Arrow batches, and one aggregate, combined before its shuffle, sums them; a second puts each term of a language into an array
indexed by source. Array functions turn the array into probabilities (scaled, exact integers) and emit what the term adds to each
pair of sources; these contributions are summed where they arise, so a task sends on one row a pair, whatever its terms. An array has
as many entries as its language has sources, and the result has a row for every two of them, so sources, unlike terms and documents,
should be thousands at most.

Defined results: null text, lang and source are ''; a group whose documents have no kept term has counts of 0; a language without
kept terms has pairs of value 0 and no term rows; a language of one source has no pairs; equal values rank by item in UTF-8 order;
repeated rows are documents of their own. An empty table gives no rows. Other columns, doc_id included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import equal_spans, lanes, span_hash, stage, text_slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same by bytes of UTF-8.
_INSIDE = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
#: Bytes of text that are counted at once; a longer text is counted alone.
SLICE = 4 << 20


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs): occurrences of each term in these documents of a group, and how many of them have it.

    Terms are runs of bytes, as a character beyond ASCII is made of bytes that all count. None of the columns has nulls."""
    lang, source, text = lang.dictionary_encode(), source.dictionary_encode(), text.cast(pa.large_string())
    n = len(text)
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    buf = text.buffers()[2]
    d = np.frombuffer(buf, np.uint8, off[-1] - off[0], off[0]) if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    d = d + ((d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(32)
    inside = _INSIDE[d]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(d))]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    lane = lanes(d)
    h = span_hash(d, start, end, lane)
    at = np.argsort(h, kind="stable")
    at = at[np.argsort(group[doc][at], kind="stable")] if len(np.unique(group)) > 1 else at  # by group, hash and document
    start, end, doc, h = start[at], end[at], doc[at], h[at]
    g = group[doc]
    new = np.ones(len(h), bool)
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    # equal hashes of different words: they are told apart where they meet
    same[same] = equal_spans(d, lane, start[1:][same], (end - start)[1:][same], d, lane, start[:-1][same], (end - start)[:-1][same])
    new[1:] = ~same
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    size = (end - start)[first]
    take = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    spans = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(d[take]))
    of = lambda x, k: x.dictionary.take(pa.array(k)).cast(pa.string())
    many, with_it = (np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for x in (np.ones(len(h)), once))
    k = max(1, len(source.dictionary))
    return pa.record_batch([of(lang, g[first] // k), of(source, g[first] % k), spans.cast(pa.string()), pa.array(many), pa.array(with_it)], names=["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents: counts of one batch each, then summed by Spark before and after the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            b = b.sort_by([("lang", "ascending"), ("source", "ascending")])  # few slices for each group
            for i, text in text_slices(b.column("text"), SLICE):
                yield count_terms(b.column("lang").slice(i, len(text)), b.column("source").slice(i, len(text)), text)

    x = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return x.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_terms)) in exact arithmetic."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + 5 * n_terms).cast("decimal(19,0)"))


def wide_terms(docs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, term, counts): occurrences by source, in the order of groups.idx, of terms in at least `least` documents of a language."""
    n = counted(docs).join(groups.select("lang", "source", "idx", "n_sources"), ["lang", "source"])
    entries = F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("e")
    x = n.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.first("n_sources").alias("s"), entries).where(F.col("docs") >= least)
    zeros = lambda k: F.array_repeat(F.lit(0).cast("long"), k)
    # each entry after the zeros of the sources between it and the one before
    filled = F.flatten(F.transform("e", lambda e, k: F.concat(zeros(e["idx"] - F.when(k > 0, F.get("e", k - 1)["idx"]).otherwise(F.lit(-1)) - 1), F.array(e["n"]))))
    return x.select("lang", "term", F.concat(filled, zeros(F.col("s") - F.element_at("e", -1)["idx"] - 1)).alias("counts"))


def sources_of(docs: DataFrame) -> DataFrame:
    """(lang, source, idx, n_sources): every group that occurs, numbered within its language from 0."""
    w = Window.partitionBy("lang")
    g = docs.select("lang", "source").distinct()
    return g.select("lang", "source", (F.row_number().over(w.orderBy("source")) - 1).alias("idx"), F.count("*").over(w).cast("int").alias("n_sources"))


def totals(groups: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, v, all, n_sources, sources, n): kept terms, their occurrences, and both by source."""
    v = wide.groupBy("lang").agg(F.count("*").alias("v"))
    n = wide.select("lang", F.posexplode("counts").alias("idx", "c")).groupBy("lang", "idx").agg(F.sum("c").alias("n"))
    g = groups.join(n, ["lang", "idx"], "left").select("lang", F.struct("idx", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("g"))
    g = g.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("g"), F.sum("g.n").alias("all"), F.count("*").cast("int").alias("n_sources"))
    return g.join(v, "lang", "left").select("lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), "all", "n_sources", F.col("g.source").alias("sources"), F.col("g.n").alias("n"))


def _pairs(value) -> Column:
    """A row (i, j, value(i, j)) for every two sources of a language of n_sources."""
    i_to = lambda i: F.transform(F.sequence(i + 1, F.col("n_sources") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), value(i, j).alias("f")))
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_sources") - 2), i_to)))


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance from every other source of the language (part pair), and
    the terms that it uses more than the language does (part term), `top` of them at most."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = stage(sources_of(docs), "sources")
    wide = stage(wide_terms(docs, groups, least), "terms")
    langs = stage(totals(groups, wide), "languages")
    x = wide.join(langs, "lang").withColumn("p", F.transform("counts", lambda c, i: scaled(c, F.get("n", i), F.col("v"))))
    several = langs.where("n_sources > 1").select("lang", "n_sources")
    none = several.select("lang", _pairs(lambda i, j: F.lit(0).cast("long")).alias("x"))
    adds = x.where("n_sources > 1").select("lang", _pairs(lambda i, j: F.abs(F.get("p", i) - F.get("p", j))).alias("x"))
    s = none.unionByName(adds).groupBy("lang", F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    name = langs.select("lang", "sources")
    s = s.unionByName(s.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value")).join(name, "lang").select("lang", F.get("sources", F.col("i")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("j")).alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = s.withColumn("rank", F.row_number().over(order))
    q = scaled(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c), F.col("all"), F.col("v"))
    more = x.withColumn("q", q).select("lang", "term", "sources", F.posexplode(F.arrays_zip("counts", F.transform("p", lambda p: p - F.col("q")).alias("f"))).alias("i", "e")).where("e.counts > 0 and e.f > 0")
    more = more.select("lang", F.get("sources", F.col("i")).alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("e.f").alias("value"))
    return pairs.unionByName(more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::BIGINT) // (n + 5 * v) AS p FROM n JOIN v USING (lang) JOIN kept ON kept.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000 * (s + 5)) // (m + 5 * v) AS q FROM (SELECT lang, term, sum(c)::BIGINT AS s FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n)::BIGINT AS m FROM n GROUP BY 1) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(f, 0)::BIGINT AS value FROM pair LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 50"""
