"""Operator 3: document quality, by logistic regression over hashed word n-grams.

A document's tokens are its words and its runs of punctuation; its features are the hashed unigrams and bigrams of tokens and
of token shapes (kind, case, length class), weighted by their share. Weights are learned with follow-the-regularised-leader
updates and L1, so most are zero; a score is the sparse dot product of shares and weights through the logistic function.

Learning reads at most `sample` labelled documents, those with the smallest hash of their key: a documented bound, equal at
every size of input. Scores cover every whole text.

Defined results: null and empty texts have no features and get the score of the intercept; a document with several labels
counts as the rounded mean; null labels are left out; without labelled documents every score is 0.5; repeated rows are scored
each; other columns never enter a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, span_hash, text_slices

BITS = 18
SAMPLE = 8_000
SCALE = 16.0

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 letter, 2 punctuation, 3 digit
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 3
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, share * SCALE) of every n-gram occurrence of a slice of a string column."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    lo, hi = int(off[0]), int(off[-1])
    d = np.frombuffer(text.buffers()[2], np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    off = off - lo
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = _CLASS[d]
    new = np.ones(len(d), bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = off[1:-1]
    new[inner[inner < len(d)]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(d))
    keep = kind[at] != 0
    at, end = at[keep], end[keep]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    doc = np.searchsorted(off, at, side="right") - 1
    lower = d + ((d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(32)
    h = span_hash(lower, at, end)
    upper = np.concatenate(([0], np.cumsum((d >= 65) & (d <= 90))))
    caps, length = upper[end] - upper[at], end - at
    case = np.where(caps == 0, 0, np.where(caps == length, 3, np.where((caps == 1) & (d[at] >= 65) & (d[at] <= 90), 1, 2)))
    k = kind[at].astype(np.int64)
    shape = mix((k * 64 + case * 16 + np.minimum(length, 40) // 4).astype(U64) + U64(1 << 40))
    shape = np.where(k == 2, h, shape)  # punctuation stands for itself
    pair = doc[1:] == doc[:-1]
    two = mix(h[:-1] * U64(3) + h[1:])[pair]
    same = (h[:-1] == h[1:]).astype(U64)  # a word said twice is a shape too
    shapes = mix(shape[:-1] * U64(5) + shape[1:] * (same + U64(1)) + same)[pair]
    f = np.concatenate((h, shape + U64(1), two, shapes))
    docs = np.concatenate((doc, doc, doc[1:][pair], doc[1:][pair]))
    f = (mix(f) & U64((1 << BITS) - 1)).astype(np.int64)
    share = SCALE / np.maximum(np.bincount(docs, minlength=n), 1)
    return docs, f, share[docs]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept) from rows of (label, features, values), by follow-the-regularised-leader updates."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, i, x = rows[r]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from labels (key, label) and the texts of docs, on one executor, from `sample` documents at most.

    Documents are scanned and their features taken where they lie; only those of the sample move to the task that learns."""
    spark = docs.sparkSession
    # two-step: the bounded choice is made on keys and labels alone, and only its texts are read on
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("label"))
    picked = spark.createDataFrame(picked.orderBy(F.xxhash64(key), key).limit(sample).collect(), f"{key} long, label int")
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).join(F.broadcast(picked), key)

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, y = b.column(key).to_pylist(), b.column("label").to_pylist()
            for first, part in text_slices(b.column("text")):
                docs_, f, x = features(part)
                order = np.argsort(docs_, kind="stable")
                cut = np.searchsorted(docs_[order], np.arange(len(part) + 1))
                out = []
                for j in range(len(part)):
                    o = order[cut[j] : cut[j + 1]]
                    u, inv = np.unique(f[o], return_inverse=True)
                    out.append({"key": keys[first + j], "label": y[first + j], "i": u.astype("<i4").tobytes(), "x": np.bincount(inv, x[o], len(u)).astype("<f4").tobytes()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("label", pa.int32()), ("i", pa.binary()), ("x", pa.binary())]))

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias = 1 << BITS
        got = sorted((r["key"], r["i"], r["label"], r["x"]) for b in it for r in b.to_pylist())
        rows = [(y, np.append(np.frombuffer(i, "<i4"), bias), np.append(np.frombuffer(x, "<f4"), 1.0)) for _, i, y, x in got]
        yield pa.record_batch({"w": pa.array([pickle.dumps(ftrl(rows))], pa.binary())})

    return pickle.loads(rows.mapInArrow(extract, "key long, label int, i binary, x binary").repartition(1).mapInArrow(learn, "w binary").first().w)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1, the higher the likelier label 1."""
    w = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS + 1 numbers, whatever the data

    @F.arrow_udf("double")
    def scored(t: pa.Array) -> pa.Array:
        out = np.empty(len(t))
        for first, part in text_slices(t):
            d, f, x = features(part)
            m = np.bincount(d, w.value[f] * x, len(part)) + w.value[-1]
            out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
        return pa.array(out)

    return docs.withColumn(name, scored(F.col(text)))


def held_out(key: str = "doc_id"):
    """True for documents that learning never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labelled documents that are not held out."""
    weights = fit(docs, labels.where(~held_out()).select("doc_id", "quality"))
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
