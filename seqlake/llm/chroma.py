"""Operator 6: chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (mono PCM samples) becomes frames of twelve pitch classes; rectangle filters over their integral image, each
quantised to two bits, give one packed 32-bit integer a position. Two recordings are aligned by a histogram of the offsets at
which their integers agree in the upper bits, and judged by the share of differing bits at the best offset.

The tables here hold no audio, so the query renders each embedding as a recording by a fixed rule (`render`); the operator
itself takes any column of samples.

Defined results: a null, empty or too short recording has an empty fingerprint, which matches nothing and has no class;
recordings with equal fingerprints are one class, named by its smallest key, and are compared once, `members` naming the class of
every row; null keys are left out of the search; repeated rows are members of their class; ties between offsets go to the
smallest absolute one, then the smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import in_pieces
from .common import n_parts, open_fs, scratch, staged
from .tokens import spread

RATE, FRAME, HOP = 5512, 1024, 256
WIDTH = 8  # positions that a filter spans at most
KEY_SHIFT = np.uint32(12)
#: Most bits (share) that may differ in a match, and the least positions that must overlap, and integers in common (one vote).
MOST_ERROR, LEAST_OVERLAP, LEAST_SHARED = 0.2, 16, 1
#: Votes or positions that are held at once; a recording with more votes is aligned pair by pair.
PIECE = 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, positions) of sixteen filters, by rule."""
    return [(i % 4, (5 * i) % 9, 2 + i % 3 if i % 4 else 3, 4 + 2 * (i % 3)) for i in range(16)]


def _pitch_bins() -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    for i, x in enumerate(f):
        if 60 <= x <= 2600:
            out[i, int(round(12 * np.log2(x / 440))) % 12] = 1
    return out


_BINS, _WINDOW = _pitch_bins(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch-class energies, each of length one (silence: zeros), smoothed over five frames."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(np.asarray(samples, float)), FRAME)[::HOP]
    c = (np.abs(np.fft.rfft(frames * _WINDOW)) ** 2) @ _BINS
    if len(c) >= 5:
        total = np.concatenate((np.zeros((1, 12)), np.cumsum(c, 0)))
        c = (total[5:] - total[:-5]) / 5
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return np.divide(c, size, out=np.zeros_like(c), where=size > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each position that all filters fit at."""
    c = chroma(samples)
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return (image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]) / max(1, (x1 - x0) * (y1 - y0))

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # the whole against the twelve
            v = area(0, w, y, y + h) - area(0, w, 0, 12)
        elif kind == 1:  # earlier against later
            v = area(0, w // 2, y, y + h) - area(w // 2, w, y, y + h)
        elif kind == 2:  # lower against upper
            v = area(0, w, y, y + h // 2) - area(0, w, y + h // 2, y + h)
        else:  # crosswise
            v = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h) - area(0, w // 2, y + h // 2, y + h) - area(w // 2, w, y, y + h // 2)
        level = np.digitize(v, (-0.08, 0.0, 0.08)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ in one bit
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset of a in b, positions that overlap, share of differing bits) at the offset most agree on; None without agreement."""
    ka, kb = a >> KEY_SHIFT, b >> KEY_SHIFT
    order = np.argsort(kb, kind="stable")
    lo, hi = np.searchsorted(kb[order], ka, "left"), np.searchsorted(kb[order], ka, "right")
    votes = np.zeros(len(a) + len(b), np.int64)
    for i in np.flatnonzero(hi > lo):
        votes[order[lo[i] : hi[i]] - i + len(a)] += 1
    if not votes.any():
        return None
    best = np.flatnonzero(votes == votes.max()) - len(a)
    off = int(best[np.lexsort((best, np.abs(best)))[0]])
    x, y = (a[: max(0, len(b) - off)], b[off:]) if off >= 0 else (a[-off:], b)
    n = min(len(x), len(y))
    return off, n, int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n) if n else 1.0


class Block:
    """Queries, all aligned with one recording at a time: the same results as `align`."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints, self.size = prints, np.array([len(p) for p in prints])
        self.flat, self.start, self.longest = np.concatenate(prints), np.cumsum(self.size) - self.size, int(self.size.max())
        keys = self.flat >> KEY_SHIFT
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], np.repeat(np.arange(len(prints)), self.size)[order]
        self.pos = order - self.start[self.of]

    def align(self, x: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, overlap, share of differing bits) of the queries with a vote that x matches."""
        lo, hi = (np.searchsorted(self.keys, x >> KEY_SHIFT, side) for side in ("left", "right"))
        n, least = hi - lo, min(LEAST_OVERLAP, len(x))
        if n.sum() > PIECE:
            ours = np.unique(np.concatenate([self.of[a:b] for a, b in set(zip(lo.tolist(), hi.tolist(), strict=True))]))
            got = ((int(j), align(self.prints[j], x)) for j in ours)
            return [(j, *m) for j, m in got if m[1] >= least and m[2] <= MOST_ERROR]
        at = spread(lo, n)
        width = self.longest + len(x)
        code, votes = np.unique(self.of[at] * width + np.repeat(np.arange(len(x)), n) - self.pos[at] + self.longest, return_counts=True)
        j, off = code // width, code % width - self.longest
        order = np.lexsort((off, np.abs(off), -votes, j))
        best = order[np.flatnonzero(np.diff(j[order], prepend=-1))]
        j, off = j[best], off[best]
        skip = np.maximum(0, -off)
        n = np.minimum(self.size[j] - skip, len(x) - np.maximum(0, off))
        j, off, skip, n = (v[n >= least] for v in (j, off, skip, n))
        out = []
        for p in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PIECE)) + 1):
            if len(p):
                bits = np.bitwise_count(self.flat[spread(self.start[j[p]] + skip[p], n[p])] ^ x[spread(np.maximum(0, off[p]), n[p])])
                error = np.add.reduceat(bits, np.cumsum(n[p]) - n[p], dtype=np.int64) / (32 * n[p])
                out += [(int(j[p[i]]), int(off[p[i]]), int(n[p[i]]), float(error[i])) for i in np.flatnonzero(error <= MOST_ERROR)]
        return out


def render(values: np.ndarray, step: int = 512) -> np.ndarray:
    """A recording made from a vector: one note for each component, as high as its value among three octaves, with an overtone."""
    v = np.nan_to_num(np.asarray(values, float))
    pitch = np.repeat(110 * 2 ** (np.round(18 + 12 * np.clip(v * np.sqrt(len(v) or 1), -1.5, 1.5)) / 12), step)
    phase = 2 * np.pi * np.cumsum(pitch) / RATE
    return np.sin(phase) + 0.4 * np.sin(2 * phase)


def fingerprints(media: DataFrame, key: str, samples: str, decode=None) -> DataFrame:
    """key, fingerprint (little-endian packed integers) of every recording; decode: cell -> samples."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [b"" if x is None else fingerprint(decode(np.array(x, float)) if decode else np.array(x, float)).astype("<u4").tobytes() for x in b.column("x").to_pylist()]
            yield pa.record_batch({"key": b.column("key"), "fingerprint": pa.array(got, pa.binary())})

    return media.select(F.col(key).cast("long").alias("key"), F.col(samples).alias("x")).mapInArrow(run, "key long, fingerprint binary")


def members(prints: DataFrame) -> DataFrame:
    """key, class_id, copies of every row with a key: the class that stands for it in `matches`, null where there is no fingerprint.

    Rows travel by the SHA-256 of their fingerprint, and a class is a row and not a list, so that its size has no bound.
    """
    rows = prints.where("key is not null").select("key", F.when(F.length("fingerprint") > 0, F.unhex(F.sha2("fingerprint", 256))).alias("digest"))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("key").alias("class_id"), F.count("*").alias("copies"))
    return rows.join(classes, "digest", "left").select("key", "class_id", "copies")


#: Recordings and positions of a file of queries, about.
BLOCK, BLOCK_POSITIONS = 4096, 1 << 19


def matches(prints: DataFrame, query, block: int = BLOCK) -> DataFrame:
    """query_id, match_id, copies, offset, overlap, bit_error: classes that a class with a row of the query set aligns with.

    Every pair with one vote, an integer whose upper bits are equal, is aligned and judged by its bits alone. The queries are
    a table of files in the shared folder, each of `block` rows or BLOCK_POSITIONS, as every class costs a call for each file; all classes, dealt over partitions, are streamed past the inverted index
    of one file after the other. So nothing is copied in a shuffle, a task holds one block and one batch, and only matches leave it.
    """
    spark = prints.sparkSession
    rows = prints.where("key is not null and length(fingerprint) > 0")
    classes, _ = staged(rows.groupBy("fingerprint").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.max(query(F.col("key"))).alias("asked")), "classes")
    folder = scratch(spark, "queries")
    asked = classes.where("asked").select("id", "fingerprint")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("fingerprint")).alias("bytes")).first()
    files = 1 + max(8 * size["n"] // (7 * block), (size["bytes"] or 0) // (4 * BLOCK_POSITIONS))
    asked.repartition(files).write.option("maxRecordsPerFile", block).parquet(folder)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.base_name.startswith("part-"))  # of the tasks that counted
        for batch in in_pieces(it, 1 << 20):
            ids, copies = batch.column("id").to_pylist(), batch.column("copies").to_pylist()
            ours = [np.frombuffer(f, "<u4") for f in batch.column("fingerprint").to_pylist()]
            for file in files:
                with fs.open_input_file(file) as f:
                    table = pq.ParquetFile(f).read(use_threads=False)
                if not table.num_rows:
                    continue
                names = table.column("id").to_pylist()
                index = Block([np.frombuffer(x, "<u4") for x in table.column("fingerprint").to_pylist()])
                out = [(names[j], i, n, *m) for i, n, x in zip(ids, copies, ours, strict=True) for j, *m in index.align(x)]
                c = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (*[pa.int64()] * 5, pa.float64())
                yield pa.record_batch([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], names=["query_id", "match_id", "copies", "offset", "overlap", "bit_error"])

    rows = classes.select("id", "copies", "fingerprint").repartition(n_parts(spark), "id")
    return rows.mapInArrow(run, "query_id long, match_id long, copies long, offset long, overlap long, bit_error double")
