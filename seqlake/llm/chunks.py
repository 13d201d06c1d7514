"""Documents in chunk files of the shared folder, and questions that chunks put to hash partitions.

Where a document's result needs facts about all documents (does this hash occur elsewhere, how often does this word occur), a
chunk sends each of its distinct hashes once, packed by partition, and gets the answers back in the same order. So texts never
move, a hash costs eight bytes a chunk however often it occurs there, and there are never more rows than hashes. Partitions are
as many as the bytes of all chunks ask for, so that what one of them holds at a time does not grow with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, n_parts, open_fs, scratch, stage

#: Bytes of Arrow data in a chunk, about; a larger partition becomes several chunks. And those for each hash partition.
CHUNK_BYTES, PART_BYTES = 16 << 20, 24 << 20


def in_pieces(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes."""
    for b in it:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class Chunks:
    """Chunk files: spark, files (chunk, path; a table of the shared folder), n (how many), parts (hash partitions), and the folder."""

    def __init__(self, docs: DataFrame, name: str, most: int = CHUNK_BYTES):
        spark = docs.sparkSession
        self.spark, self.folder, self.schema = spark, scratch(spark, name), docs.schema
        folder = self.folder
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)

        def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            fs, top = open_fs(folder)
            out = sink = None
            size, done, sizes = 0, [], []
            for b in in_pieces(it, most // 4):
                if b.num_rows:
                    if out is None:
                        path = f"chunk-{uuid.uuid4().hex}.arrow"
                        done.append(f"{folder}/{path}")
                        sizes.append(0)
                        sink = fs.open_output_stream(f"{top}/{path}")
                        out = pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    out.write_batch(b)
                    size += b.nbytes
                    sizes[-1] = size
                    if size >= most:
                        out.close(), sink.close()
                        out, size = None, 0
            if out is not None:
                out.close(), sink.close()
            task = np.full(len(done), TaskContext.get().partitionId())
            yield pa.record_batch({"task": pa.array(task, pa.int32()), "at": pa.array(np.arange(len(done)), pa.int32()), "path": pa.array(done, pa.string()), "size": pa.array(sizes, pa.int64())})

        # the list of files is a table too: those of the tasks that counted. The driver sees one row a task
        files = stage(docs.mapInArrow(write, "task int, at int, path string, size long"), name + "-files")
        tasks = sorted((r.task, r.n, r.size) for r in files.groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect())
        self.n = max(1, sum(n for _, n, _ in tasks))
        self.parts = max(n_parts(spark), -(-sum(size for *_, size in tasks) // PART_BYTES))
        first = spark.createDataFrame(list(zip([t for t, *_ in tasks], np.cumsum([0, *(n for _, n, _ in tasks)]).tolist(), strict=False)), "task int, first int")
        self.files = files.join(F.broadcast(first), "task").select((F.col("first") + F.col("at")).alias("chunk"), "path")  # a row a task

    def each(self, f: Callable[[int, str], Iterator[pa.RecordBatch]], schema) -> DataFrame:
        """f(chunk, path) of every chunk."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for chunk, path in zip(b.column("chunk").to_pylist(), b.column("path").to_pylist(), strict=True):
                    yield from f(chunk, path)

        return self.files.repartitionById(self.n, F.col("chunk")).mapInArrow(run, schema)

    def answered(self, answers: DataFrame, f: Callable[[int, str, list[bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
        """f(chunk, path, answers by ascending partition) of every chunk; answers: chunk, part, answer."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: list[bytes] = []
            for b in it:
                for chunk, path, answer in zip(*(b.column(c).to_pylist() for c in ("chunk", "path", "answer")), strict=True):
                    if path is None:
                        got.append(answer)
                    else:
                        yield from f(chunk, path, got)
                        got = []

        rows = answers.select("chunk", "part", F.lit(None).cast("string").alias("path"), "answer").unionByName(self.files.select("chunk", F.lit(2**31 - 1).alias("part"), "path", F.lit(None).cast("binary").alias("answer")))
        return rows.repartitionById(self.n, F.col("chunk")).sortWithinPartitions("chunk", "part").mapInArrow(run, schema)


def read_chunk(path: str) -> Iterator[pa.RecordBatch]:
    fs, p = open_fs(path)
    with fs.open_input_stream(p) as f:
        yield from pa.ipc.open_stream(f)


def dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes h dealt to partitions: (order, partitions that get some, bounds of their shares)."""
    p = (h % U64(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    some, at = np.unique(p[order], return_index=True)
    return order, some, np.append(at, len(h))


QUESTION = "chunk int, part int, hashes binary, extra binary"
ANSWER = "chunk int, part int, answer binary"


def questions(chunk: int, h: np.ndarray, parts: int, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each partition; extra: a value of each hash, of any fixed width."""
    order, some, at = dealt(h, parts)
    h, extra = h[order], extra[order]
    rows = [(chunk, int(p), h[a:b].tobytes(), extra[a:b].tobytes()) for p, a, b in zip(some, at[:-1], at[1:], strict=True)]
    c = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.record_batch({"chunk": pa.array(c[0], pa.int32()), "part": pa.array(c[1], pa.int32()), "hashes": pa.array(c[2], pa.binary()), "extra": pa.array(c[3], pa.binary())})


def ask(asked: DataFrame, parts: int, judge: Callable[[list[np.ndarray], list[bytes]], list[bytes]]) -> DataFrame:
    """judge(hashes, extras of all questions to a partition) -> the answer to each question."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in it for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "part", "hashes", "extra")), strict=True)]
        if rows:
            got = judge([np.frombuffer(r[2], U64) for r in rows], [r[3] for r in rows])
            yield pa.record_batch({"chunk": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "answer": pa.array(got, pa.binary())})

    return asked.repartitionById(parts, F.col("part")).mapInArrow(run, ANSWER)


def in_order(h: np.ndarray, parts: int, answers: list[bytes], dtype) -> np.ndarray:
    """Answers for ascending distinct hashes h, from the answers by ascending partition."""
    order, _, _ = dealt(h, parts)
    out = np.empty(len(h), dtype)
    out[order] = np.frombuffer(b"".join(answers), dtype)
    return out


def split(values: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    at = np.cumsum([0, *map(len, parts)])
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
