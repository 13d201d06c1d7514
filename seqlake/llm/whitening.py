"""Whitening of embeddings by an SVD that is merged up a tree, with every dimension kept.

A vector's entry c becomes the whole number floor(64 c) + 1000000 (any fixed shift cancels, so work is on floor(64 c)). A state is
what one SVD of centred rows leaves: their number, exact sums, all singular values and right vectors. Two states are merged by the
SVD of their scaled vectors stacked on one row for the difference of their means; nothing is cut, so the root's state is that of the
whole table. Tasks merge their batches, then groups of FAN states are merged in rounds, each a table of the shared folder; one state,
d x d numbers, reaches the driver at the end.

Defined results: rows whose vector is null, or holds a null, a value that is not finite or one whose floor(64 c) + 1000000 is no
long, are dropped. Of the lengths that the remaining vectors have, the one of most rows counts (of equals the longest); others are
dropped, as are vectors without entries. Repeated rows and ids, and null ids, are rows of their own. A component has variance:
directions in which the rows do not differ beyond rounding are none, so one row, or equal rows, give no result rows. An empty table
gives none. Where a deviation does not fit a long, `whiten` has it in full (decimal) if it fits 38 digits, else null.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

STEP = 64.0
SHIFT = 1_000_000
#: States that one merge takes.
FAN = 16
#: Rows that one SVD takes.
ROWS = 4096
#: Least singular value, as a share of the largest and for each dimension, that counts as variance.
EPS = float(np.finfo(float).eps)
STATE = "part long, d int, n long, sums array<string>, s binary, v binary"


class State:
    """n rows of dimension d: exact sums (Python integers), singular values s and right vectors v of the centred rows."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, v: np.ndarray):
        self.n, self.sums, self.s, self.v = n, sums, s, v

    @classmethod
    def of(cls, y: np.ndarray) -> State:
        """y: whole numbers as doubles; sums are exact, the mean is taken off before the SVD."""
        sums = exact_sums(y)
        _, s, v = np.linalg.svd(y - np.array([t / len(y) for t in sums]), full_matrices=False)
        return cls(len(y), sums, s, v)

    def merge(self, o: State) -> State:
        n = self.n + o.n
        # difference of the means from exact sums: no digits are lost where both are large
        gap = np.array([(a * o.n - b * self.n) / (self.n * o.n) for a, b in zip(self.sums, o.sums, strict=True)])
        rows = np.vstack([self.s[:, None] * self.v, o.s[:, None] * o.v, np.sqrt(self.n * o.n / n) * gap])
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return State(n, [a + b for a, b in zip(self.sums, o.sums, strict=True)], s, v)

    def row(self, part: int) -> dict:
        return {"part": part, "d": len(self.sums), "n": self.n, "sums": [str(t) for t in self.sums], "s": _packed(self.s), "v": _packed(self.v)}

    @classmethod
    def read(cls, r) -> State:
        return cls(int(r["n"]), [int(t) for t in r["sums"]], _unpacked(r["s"]), _unpacked(r["v"]))


def _packed(a: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def _unpacked(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(bytes(b)))


def exact_sums(y: np.ndarray) -> list[int]:
    """Column sums of whole numbers within long's range, as Python integers."""
    high = np.floor(y / 2.0**31)
    low = (y - high * 2.0**31).astype(np.int64)
    return [int(h) * 2**31 + int(x) for h, x in zip(high.astype(np.int64).sum(0), low.sum(0), strict=True)]


def grid(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, floor(64 c)) for each length of the vectors that count."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(STEP * c[first[rows][:, None] + np.arange(d)])
        good = (np.abs(y) < 2.0**63 - 2 * SHIFT).all(1)  # false for what is not finite
        if good.any():
            yield d, rows[good], y[good]


def states(vectors: DataFrame) -> DataFrame:
    """One state a task and length. vectors: one column of lists."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, State] = {}
        for b in it:
            for d, _, y in grid(b.column(0)):
                for i in range(0, len(y), ROWS):
                    s = State.of(y[i : i + ROWS])
                    have[d] = have[d].merge(s) if d in have else s
        rows = [s.row(TaskContext.get().partitionId()) for s in have.values()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("s", pa.binary()), ("v", pa.binary())]))

    return vectors.mapInArrow(run, STATE)


def _merge(g: pd.DataFrame) -> pd.DataFrame:
    out = None
    for r in g.sort_values("part").to_dict("records"):
        out = State.read(r) if out is None else out.merge(State.read(r))
    return pd.DataFrame([out.row(int(g["part"].min()) // FAN)])


def fit(vectors: DataFrame) -> State | None:
    """The state of the whole table: of the length that most rows have."""
    x = stage(states(vectors), "states")
    last = x.agg(F.max("part")).first()[0]
    while last:
        x = stage(x.groupBy("d", F.floor(F.col("part") / FAN).alias("_to")).applyInPandas(_merge, STATE), "states")
        last //= FAN
    rows = x.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return State.read(rows[0]) if rows else None


class Whitening:
    """Projection on the components: directions (k, d) and eigenvalues of the covariance, largest first, and their share of its trace."""

    def __init__(self, state: State, most: int = 32):
        real = state.s > EPS * len(state.sums) * max(state.s.max(initial=0.0), 1e-300) * 8
        k = min(most, int(real.sum()))
        self.n, self.sums, self.d = state.n, state.sums, len(state.sums)
        v = state.v[:k]
        self.v = v * np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None] if k else v
        self.e = state.s[:k] ** 2 / state.n
        self.explained = state.s[:k] ** 2 / (state.s**2).sum() if k else state.s[:0]

    def apply(self, y: np.ndarray) -> np.ndarray:
        mean = [divmod(t, self.n) for t in self.sums]  # whole part and rest: the difference keeps its digits
        return ((y - np.array([float(a) for a, _ in mean])) - np.array([b / self.n for _, b in mean])) @ self.v.T / np.sqrt(self.e)

    def deviation(self, y: np.ndarray) -> list[Decimal | None]:
        """Sum over dimensions of (n y - sums)^2, exact."""
        most = self.n * (float(np.abs(y).max(initial=0)) + 1) + float(max(map(abs, self.sums), default=0))
        if most * most * self.d < 2.0**62:
            return [Decimal(int(t)) for t in ((self.n * y.astype(np.int64) - np.array(self.sums, np.int64)) ** 2).sum(1)]
        out = [sum((self.n * int(t) - s) ** 2 for t, s in zip(r, self.sums, strict=True)) for r in y.tolist()]
        return [Decimal(t) if t < 10**38 else None for t in out]


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(w.e)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for b in it:
            for d, _, y in grid(b.column(0)):
                if d == w.d:
                    z = w.apply(y)
                    gram += z.T @ z
                    total += z.sum(0)
        i = np.arange(k * (k + 1))
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(np.concatenate([gram.ravel(), total]))], names=["i", "t"])

    # at most k (k + 1) = 1056 rows a task, summed by Spark
    t = {r.i: r.t for r in vectors.mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()}
    a = np.array([t.get(i, 0.0) for i in range(k * (k + 1))])
    mean = a[k * k :] / w.n
    return float(np.abs(a[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector that counts and each component."""
    vectors = table.select(F.col(vector).alias("_v"))
    kind = table.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, {RESULT}"
    state = fit(vectors)
    w = Whitening(state, most) if state else None
    if w is None or not len(w.e):
        return table.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, w), len(w.e)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, rows, y in grid(b.column(1)):
                for i in range(0, len(rows) if d == w.d else 0, ROWS):
                    at, part = rows[i : i + ROWS], y[i : i + ROWS]
                    m = len(at) * k
                    dev = pa.array(w.deviation(part), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k)))
                    columns = [b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(m, w.n))]
                    columns += [dev, pa.array(w.apply(part).ravel()), pa.array(np.tile(w.explained, len(at))), pa.array(np.full(m, error))]
                    yield pa.record_batch(columns, names=[key, *(c.split()[0] for c in RESULT.split(", "))])

    return table.select(key, vector).mapInArrow(run, schema)


import pyarrow.compute  # noqa: E402,F401
