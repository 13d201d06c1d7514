"""Shared folder, ordered buckets and vectorised word hashing for the operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, scratch, stage, staged  # noqa: F401

U64 = np.uint64
# ---------------------------------------------------------------- shared folder
def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Schemes of Hadoop's connectors, and what pyarrow calls the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a folder or file that Python workers open themselves."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"{uri}: Python workers cannot open this store; name another in spark.checkpoint.dir") from e


# ---------------------------------------------------------------- ordered buckets
def key_bounds(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most n-1 ascending split points of an integer key, from one aggregate over that column alone."""
    if n < 2:
        return np.zeros(0, np.int64)
    row = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()
    return np.unique(np.array(row.q or [], np.int64))


def bucket_of(bounds: np.ndarray, key: str):
    """Column with the bucket of key: rows of bucket b come before those of b+1; null keys are in bucket 0."""

    @F.arrow_udf("int")
    def bucket(k: pa.Array) -> pa.Array:
        v = k.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, v, side="left").astype(np.int32))

    return bucket(F.col(key).cast("long"))


# ---------------------------------------------------------------- words and hashes
MULT = U64(0x9E3779B97F4A7C15)
#: Modular inverse of MULT, for hashes of substrings taken from prefix sums.
MULT_INV = U64(pow(int(MULT), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (multiply and xor-shift rounds)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def cached_powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        have = _POW[int(base)] = powers(base, max(1024, 2 * n if n < 1 << 22 else n))
    return have[:n]


class Words:
    """Words (runs of other bytes than space and \\t..\\r) of a slice of a string column, found in its UTF-8 bytes.

    doc: document of each word; start, end: byte offsets in data; hash: 64-bit hash of the (lower-cased) word;
    first, count: the words of each document. Nulls have no words. No word spans two documents.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        text = text.cast(pa.large_string()).fill_null("")
        n = len(text)
        off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
        lo, hi = int(off[0]), int(off[-1])
        buf = text.buffers()[2] if n else None
        self.data = np.frombuffer(buf, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        self.offsets = off - lo
        d = self.data
        if lower and len(d):
            d = d + ((d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(32)
        self.bytes = d
        space = (d == 32) | ((d >= 9) & (d <= 13))
        word = ~space
        begins = word.copy()
        begins[1:] &= space[:-1]
        ends = word.copy()
        ends[:-1] &= space[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(d))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets[:-1])
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = span_hash(d, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


#: Low bytes of a lane that belong to a span with so many bytes left.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Longer spans are hashed by BLAKE2b.
LANE_BYTES = 32


def lanes(d: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of d on, as one number."""
    p = np.zeros(len(d) + 8, np.uint8)
    p[: len(d)] = d
    return np.ndarray((len(d) + 1,), "<u8", p, 0, (1,))


def span_hash(d: np.ndarray, start: np.ndarray, end: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time through the finaliser, which depends on all before; long ones by BLAKE2b.

    Spans of equal length up to eight bytes have equal hashes only if they are equal.
    """
    n = end - start
    if not len(n):
        return np.zeros(0, U64)
    v = lanes(d) if view is None else view
    h = mix(mix(n.astype(U64) * MULT + U64(1)) ^ (v[start] & _LOW[np.minimum(n, 8)]))
    i, at = np.flatnonzero((n > 8) & (n <= LANE_BYTES)), 8
    while len(i):
        left = n[i] - at
        h[i] = mix(h[i] ^ (v[start[i] + at] & _LOW[np.minimum(left, 8)]))
        i, at = i[left > 8], at + 8
    for j in np.flatnonzero(n > LANE_BYTES).tolist():
        h[j] = int.from_bytes(hashlib.blake2b(d[start[j] : end[j]].tobytes(), digest_size=8).digest(), "little")
    return h


def equal_spans(d: np.ndarray, v: np.ndarray, start: np.ndarray, n: np.ndarray, e: np.ndarray, w: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which spans of d (n bytes from start) are those of e (m bytes from at), byte by byte, given that their hashes are equal. v, w: lanes."""
    same = n == m
    i = np.flatnonzero(same & (n > 8))
    for k in i[n[i] > 64].tolist():
        same[k] = d[start[k] : start[k] + n[k]].tobytes() == e[at[k] : at[k] + n[k]].tobytes()
    i, b = i[n[i] <= 64], 0
    while len(i):
        left = n[i] - b
        same[i] &= ((v[start[i] + b] ^ w[at[i] + b]) & _LOW[np.minimum(left, 8)]) == 0
        i, b = i[left > 8], b + 8
    return same


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (len(h)-k+1 of them; none if h is shorter)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    s = np.zeros(n + 1, U64)
    np.cumsum((h | U64(1)) * cached_powers(MULT, n), out=s[1:])
    return mix((s[k:] - s[:-k]) * cached_powers(MULT_INV, n - k + 1) + U64(k))


def text_slices(text: pa.Array, most: int = 1 << 20):
    """(first row, slice) pieces of a string column of about `most` bytes; a longer text is a piece of its own."""
    n = len(text)
    if not n:
        return
    size = np.cumsum(np.frombuffer(pa.compute.binary_length(text).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64))
    a = 0
    while a < n:
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + most, side="right")))
        yield a, text.slice(a, b - a)
        a = b


import pyarrow.compute  # noqa: E402,F401
