"""Operator 1: token ids in binary shards, each document compressed alone against a shared zstandard dictionary.

Shard file: header (magic, version, id width, 32-byte SHA-256 of the dictionary), the documents' zstandard frames one after
another, then the index (keys, token counts, frame offsets) and a footer with the index position. A document is read by its
index entry alone: no other frame is touched. The dictionary lies beside the shards in `dictionary-<hash>.bin`.

Defined results: null text is the empty text, whose ids are just the end id; an empty table writes no shard; rows with equal
keys are all kept, ordered by token count and frame; a null key sorts first; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, key_bounds, n_parts, open_fs, scratch
from .tokens import encoder, vocabulary

MAGIC = b"SLTOKEN1"
FOOTER = struct.Struct("<QQ8s")


def serialise(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def ids_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


class ShardWriter:
    """Streams frames to a file of its own name, which counts only once its row reaches the manifest."""

    def __init__(self, folder: str, shard: int, width: int, digest: bytes):
        self.fs, top = open_fs(folder)
        self.path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.bin"
        self.out = self.fs.open_output_stream(f"{top}/{self.path.rsplit('/', 1)[1]}")
        self.shard, self.width = shard, width
        self.out.write(MAGIC + struct.pack("<II", 1, width) + digest)
        self.at = len(MAGIC) + 8 + 32
        self.keys, self.counts, self.offsets = [], [], [self.at]

    def add(self, key: int | None, count: int, frame: bytes) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.keys.append(np.iinfo(np.int64).min if key is None else key)
        self.counts.append(count)
        self.offsets.append(self.at)

    def close(self) -> dict:
        n = len(self.keys)
        self.out.write(np.array(self.keys, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.at, n, MAGIC))
        self.out.close()
        return {"shard": self.shard, "path": self.path, "n_docs": n, "n_tokens": int(sum(self.counts))}


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, dictionary: bytes):
        fs, p = open_fs(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        head = self.file.read_at(48, 0)
        if head[:8] != MAGIC or head[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.width = struct.unpack("<II", head[8:16])[1]
        at, n, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: incomplete")
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.keys = np.frombuffer(index, "<i8", n)
        self.counts = np.frombuffer(index, "<u4", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 12 * n)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return ids_of(self.zstd.decompress(self.file.read_at(b - a, a)), self.width)


#: The dictionary learns from at most so many documents, and from so many bytes of each.
SAMPLE, SAMPLE_BYTES, SAMPLE_PIECE = 400, 1 << 16, 1 << 12


def samples(raw: bytes) -> list[bytes]:
    """Pieces of a document's ids for training: all of them, or as many as the bound allows, evenly from its beginning to its end."""
    n = max(1, -(-len(raw) // SAMPLE_PIECE))
    at = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_BYTES // SAMPLE_PIECE)).astype(np.int64))
    return [raw[i * SAMPLE_PIECE : (i + 1) * SAMPLE_PIECE] for i in at.tolist()]


def train_dictionary(docs: DataFrame, text: str, key: str, path: str, width: int, sample: int = SAMPLE, size: int = 65_536) -> bytes:
    """Shared dictionary from the documents with the smallest hashes of their keys, whatever the order of files; see SAMPLE.

    It only affects how well frames compress, never what they hold. Where zstandard can't make one (too little or too uniform
    a sample), frames have no dictionary.
    """
    spark = docs.sparkSession
    keys = docs.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(sample).collect()
    picked = docs.join(F.broadcast(spark.createDataFrame(keys, f"{key} long")), key).select(text).limit(sample)  # equal keys: any of them

    def ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch({"ids": pa.array([samples(serialise(x, width)) for x in encoder(path).encode(b.column(0).to_pylist())], pa.list_(pa.binary()))})

    got = [bytes(x) for r in picked.mapInArrow(ids, "ids array<binary>").collect() for x in r.ids if x]  # bounded by SAMPLE and SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(size, sorted(got)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", level: int = 3) -> tuple[DataFrame, bytes]:
    """Encode docs and write shards in ascending key order under folder; (manifest: shard, path, n_docs, n_tokens, start; dictionary).

    The text is read once and never shuffled: documents are encoded and compressed where they are read, and only their frames
    move to the range of keys that they belong to. A shard is written by one task; a task that is run again writes another
    file, and the manifest names those of the tasks that counted.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounds = key_bounds(docs, "key", n_parts(spark))
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, "text", "key", tokenizer, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary-{digest.hex()[:16]}.bin") as f:
        f.write(dictionary)
    end = struct.pack("<I", end_id)[:width]

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False) if dictionary else zstandard.ZstdCompressor(level=level)
        for b in it:
            keys = b.column("key")
            at = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            for lo, ids, off in enc.arrays(b.column("text")):
                raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
                n = len(off) - 1
                ends = (off * width).tolist()
                frames = [z.compress(raw[x:y] + end) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch({"bucket": pa.array(at[lo : lo + n]), "key": keys.slice(lo, n), "n_tokens": pa.array(np.diff(off) + 1, pa.int64()), "frame": pa.array(frames, pa.binary())})

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for whole in it:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for bucket, k, n, frame in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "n_tokens", "frame")), strict=True):
                    if now is None or now.shard != bucket:
                        done += [now.close()] if now else []
                        now = ShardWriter(folder, bucket, width, digest)
                    now.add(k, n, frame)
        done += [now.close()] if now else []
        yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    frames = docs.mapInArrow(encode, "bucket int, key long, n_tokens long, frame binary")
    rows = (
        frames.repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "n_tokens", "frame")
        .mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")
        .collect()  # one row for each shard
    )
    start, out = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        out.append((r.shard, r.path, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(out, "shard long, path string, n_docs long, n_tokens long, start long"), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes, key: str = "key", digest: bool = False) -> DataFrame:
    """key, start (ids before the document), ids (little-endian unsigned 32-bit) of every document, from the shard files.

    digest: n_tokens and ids_crc32 in place of the ids, taken by the worker that reads them.
    """

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = ShardReader(path, dictionary)
                starts = start + np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))[:-1]))
                for lo in range(0, len(shard), 512):
                    hi = min(len(shard), lo + 512)
                    keys = [None if k == np.iinfo(np.int64).min else k for k in shard.keys[lo:hi].tolist()]
                    ids = (shard.ids(i).tobytes() for i in range(lo, hi))
                    if digest:
                        n, crc = zip(*((len(x) // 4, zlib.crc32(x)) for x in ids), strict=True)
                        what = {"n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                    else:
                        what = {"ids": pa.array(list(ids), pa.binary())}
                    yield pa.record_batch({key: pa.array(keys, pa.int64()), "start": pa.array(starts[lo:hi], pa.int64()), **what})

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, f"{key} long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary"))


def token_binary(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write docs as token shards and return what reads back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    manifest, dictionary = write_tokens(docs, folder or scratch(spark, "tokens"), tokenizer, end_id)
    return read_tokens(manifest, dictionary, "doc_id", digest=True)
