"""Operator 4: document fingerprints by winnowing.

Hashes of all k-grams of code points; in each window of w hashes the smallest is chosen, the rightmost of equal ones, and its
position is kept. Any passage of at least w + k - 1 code points that two texts share leaves a common fingerprint in both.

Defined results: a text shorter than k is one gram, an empty or null one has no fingerprint; two texts without fingerprints
have likeness 1, one with and one without 0; repeated rows are each fingerprinted, and follow one another by text where keys
are equal; a null key sorts below all others; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, MULT_INV, U64, bucket_of, cached_powers, key_bounds, mix, n_parts

K, W = 16, 32


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of every k code points, from prefix sums modulo 2^64; a shorter text is one gram."""
    n = len(c)
    if not n:
        return np.zeros(0, U64)
    k = min(k, n)
    s = np.zeros(n + 1, U64)
    np.cumsum((c.astype(U64) + U64(1)) * cached_powers(MULT, n), out=s[1:])
    return mix((s[k:] - s[:-k]) * cached_powers(MULT_INV, n - k + 1) + U64(k))


def winnow(c: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing keeps, ascending by position."""
    h = gram_hashes(c, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    w = min(w, len(h))
    v, at, have = h, np.arange(len(h)), 1
    while have < w:  # minima of windows of `have`, the rightmost of equal ones, doubled until w
        step = min(have, w - have)
        right = v[step:] <= v[: len(v) - step]
        v = np.where(right, v[step:], v[: len(v) - step])
        at = np.where(right, at[step:], at[: len(at) - step])
        have += step
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep], v[keep]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Compact name of a fingerprint: how many hashes, and a hash over positions and hashes."""
    return f"{len(hashes)}:{hashlib.blake2b(positions.astype('<i8').tobytes() + hashes.astype('<u8').tobytes(), digest_size=16).hexdigest()}"


def edit(text: str, following: str) -> str:
    """text with its last half replaced by the beginning of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, key, text, guard), sorted so that the row before another in its bucket is the next in descending order.

    The text moves once, to ranges of keys. Each range also gets a copy (guard) of the last row of the range before it; the
    first range gets the last row of all. Which rows those are is one small aggregate over the keys.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = key_bounds(docs, "key", n_parts(docs.sparkSession))
    low = F.coalesce(F.col("key"), F.lit(-(1 << 63)))
    docs = docs.withColumn("bucket", bucket_of(bounds, "key"))
    last = {r.bucket: r.last for r in docs.groupBy("bucket").agg(F.max(low).alias("last")).collect()}  # one row a range
    order = sorted(last)
    # the last key of a range -> the range that follows (of the last range: the first)
    after = [(last[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    spark = docs.sparkSession
    edges = spark.createDataFrame(after, "k long, to int")
    guards = docs.withColumn("k", low).join(F.broadcast(edges), "k").select(F.col("to").alias("bucket"), "key", "text", F.lit(True).alias("guard"))
    # of rows with the last key only the last by text guards
    guards = guards.groupBy("bucket", "key").agg(F.max("text").alias("text"), F.lit(True).alias("guard")).select("bucket", "key", "text", "guard")
    rows = docs.select("bucket", "key", "text", F.lit(False).alias("guard")).unionByName(guards)
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("guard").desc(), F.col("key").asc_nulls_first(), "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes, positions, hashes of every
    document: with the last two, ascending by position, any common passage of w + k - 1 code points can be found and placed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before, before_set = None, "", np.zeros(0, U64)
        for b in it:
            out = []
            for at, i, t, guard in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "text", "guard")), strict=True):
                pos, h = winnow(code_points(t), k, w)
                own = np.unique(h)
                if not guard:
                    if at != bucket:  # every bucket begins with its guard
                        raise RuntimeError(f"bucket {at} has no guard")
                    changed = edit(t, before)
                    e_pos, e_h = (pos, h) if changed == t else winnow(code_points(changed), k, w)
                    out.append((i, len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(pos, h), digest(e_pos, e_h), likeness(own, np.unique(e_h)), likeness(own, before_set), len(h), pos, h.view(np.int64)))
                bucket, before, before_set = at, t, own
            c = list(zip(*out, strict=True)) or [[]] * 10
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), longs, longs)
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(c, kinds, strict=True)], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "positions", "hashes"])

    return with_next(docs, key, text).mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, positions array<long>, hashes array<long>".replace(key, "key", 1)).withColumnRenamed("key", key)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """key, positions, hashes: the whole fingerprint of every document, computed where the document is read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [winnow(code_points(t or ""), k, w) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"key": b.column("key"), "positions": pa.array([p for p, _ in got], pa.list_(pa.int64())), "hashes": pa.array([h.view(np.int64) for _, h in got], pa.list_(pa.int64()))})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, positions array<long>, hashes array<long>").withColumnRenamed("key", key)
