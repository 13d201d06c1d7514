"""Operator 7: packing of documents into sequences, by Martello-Toth dominance and then best fit.

The plan depends on how many pieces there are of each length only, so it is made on a table of at most `capacity` counts: sets
that provably dominate every alternative are fixed, the instance shrinks, and best fit in decreasing order packs what is
left, whole runs of equal pieces at a time. Pieces then take their place by their rank among the pieces of their length.

Defined results: null text is empty, its only token is the end id; an empty table packs into nothing; repeated documents are
packed each on its own; other columns are not carried. Equal pieces may trade places between runs of the program.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged
from .tokens import encoder

#: A set of equal sequences: how many, and the (length, how many) in each.
Pattern = tuple[int, list[tuple[int, int]]]


def _fitting(sizes: list[int], room: int) -> int | None:
    """Largest of the ascending sizes that is at most room."""
    i = int(np.searchsorted(sizes, room, side="right")) - 1
    return sizes[i] if i >= 0 else None


def _dominated_triple(sizes: list[int], left: dict[int, int], big: int, room: int) -> tuple[int, int] | None:
    """(a, b) if big with a and b dominates every feasible set with big, where at most two more pieces fit; else None.

    a is the largest piece that fits and b the largest that fits beside it. Another set {x, y}, y <= x, is dominated if
    y <= b (as x <= a), or if x + y <= a. So all that must be shown is that no fitting pair has both above b and a sum above a.
    """
    a = _fitting(sizes, room)
    if a is None:
        return None
    rest = [s for s in sizes if s != a or left[s] > (2 if a == big else 1)]
    b = _fitting(rest, room - a)
    if b is None:
        return None
    for y in (s for s in sizes if b < s <= room // 2):
        x = _fitting(sizes, room - y)
        if x is not None and x >= y and x + y > a and (x != y or left[x] > 1):
            return None
    return a, b


def dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix dominating sets, taking their pieces out of counts, until the largest piece left has none."""
    done: list[Pattern] = []

    def fix(*pieces: int) -> None:
        need = {p: pieces.count(p) for p in pieces}
        n = min(counts[p] // k for p, k in need.items())
        for p, k in need.items():
            counts[p] -= n * k
            if not counts[p]:
                del counts[p]
        done.append((n, sorted(need.items(), reverse=True)))

    stuck: set[int] = set()
    while True:
        sizes = sorted(counts)
        big = next((s for s in reversed(sizes) if s not in stuck), None)
        if big is None:
            return done
        room = capacity - big
        others = [s for s in sizes if s != big or counts[s] > 1]
        mate = _fitting(others, room)
        if mate is None:  # nothing fits beside it
            fix(big)
            continue
        small = []  # the smallest three of the other pieces
        for s in sizes[:4]:
            small += [s] * min(3, counts[s] - (s == big))
        if mate == room or len(small) < 2 or small[0] + small[1] > room:  # it fills the sequence, or one more fits at most
            fix(big, mate)
            continue
        if len(small) < 3 or sum(small[:3]) > room:  # two more fit at most
            triple = _dominated_triple(others, counts, big, room)
            if triple and (n := [big, *triple]) and all(counts[p] >= n.count(p) for p in n):
                fix(big, *triple)
                continue
        stuck.add(big)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing order, over counts: each length goes to the fullest sequences that still hold it."""
    open_: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = next((r for r in sorted(rooms) if r >= size), None)
            if room is None:
                group: Pattern = (n, [])
                room = capacity
            else:
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.remove(room)
            m, inside = group
            q = room // size
            full = min(m, n // q)
            parts = [(full, q)] if full else []
            if not full or (full < m and room != capacity):
                if not full:
                    parts = [(1, n)]
                if room != capacity or inside:
                    rest = m - sum(p for p, _ in parts)
                    if rest:
                        open_[room].append((rest, inside))
                        if room not in rooms:
                            rooms.append(room)
            for p, k in parts:
                n -= p * k
                to = room - k * size
                open_[to].append((p, [*inside, (size, k)]))
                if to not in rooms:
                    rooms.append(to)
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    left = {int(k): int(v) for k, v in counts.items() if v}
    fixed = dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the sequence of each run's first piece, and the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seq = 0
    for n, inside in patterns:
        at = 0
        for size, k in inside:
            for _ in range(k):
                runs[size].append((n, seq, at))
                at += size
        seq += n
    out = {}
    for size, r in runs.items():
        n, s, o = np.array(r, np.int64).T
        out[size] = (np.concatenate(([0], np.cumsum(n)[:-1])), s, o)
    return out


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `capacity` but perhaps the first."""
    first = n_tokens % capacity if n_tokens > capacity else n_tokens
    at = [0, *range(first or capacity, n_tokens, capacity)]
    return [(a, b - a) for a, b in zip(at, [*at[1:], n_tokens], strict=True)]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece, with the task that made it and its rank among that task's pieces of its length."""
    end = struct.pack("<I", end_id)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for b in it:
            keys = b.column("key").to_pylist()
            for first, ids, off in enc.arrays(b.column("text")):
                raw, ends, rows = ids.astype("<u4").tobytes(), off.tolist(), []
                for j, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    own = raw[4 * x : 4 * y] + end
                    for i, (a, n) in enumerate(cut(y - x + 1, capacity)):
                        rows.append((keys[first + j], i, a, n, zlib.crc32(own[4 * a : 4 * (a + n)]), int(seen[n])))
                        seen[n] += 1
                c = list(zip(*rows, strict=True))
                yield pa.record_batch({"key": pa.array(c[0], pa.int64()), "piece": pa.array(c[1], pa.int32()), "start": pa.array(c[2], pa.int64()), "length": pa.array(c[3], pa.int64()), "ids_crc32": pa.array(c[4], pa.int64()), "task": pa.array(np.full(len(rows), task), pa.int64()), "rank": pa.array(c[5], pa.int64())})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def assign(pieces: DataFrame, capacity: int, planner: Callable[[dict[int, int], int], list[Pattern]] = plan) -> DataFrame:
    """sequence_id and offset for the rows of pieces_of, written before (a task's ranks must not change between reads)."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(slots(planner(counts, capacity)))  # its size follows capacity, not the data
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("base").to_numpy()
            seq, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                i = np.flatnonzero(size == s)
                first, sequence, offset = places.value[int(s)]
                j = np.searchsorted(first, rank[i], side="right") - 1
                seq[i] = sequence[j] + rank[i] - first[j]
                at[i] = offset[j]
            yield pa.record_batch([*(b.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(at)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = T.StructType([*(pieces.schema[c] for c in ("key", "piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.join(per_task, ["task", "length"]).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    pieces, _ = staged(pieces_of(docs, tokenizer, end_id, capacity, key, text), "pieces")
    return assign(pieces, capacity).withColumnRenamed("key", key)
