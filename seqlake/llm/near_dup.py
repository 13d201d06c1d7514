"""Operator 9: near-duplicate documents, by one-permutation MinHash with optimal densification.

Every distinct shingle set is a class (equal sets are found by a hash of the whole set). A class' one-permutation signature of
BINS bins fills its empty bins from others by a fixed hash sequence; bands of ROWS bins make bucket keys. In each bucket all
members are joined to the smallest one only (a star), so candidates grow with the members and not with their square; they
are confirmed on the full sets and joined into components. What a star can miss is then looked for: in buckets that still
hold several components, the members outside the smallest one's component are compared with all, in blocks. Sets of up to SMALL
shingles are compared as they are (by 32 bits of each hash, which can only add pairs), larger ones by a longer signature;
pairs that pass are confirmed on the full sets. No bucket, group or candidate list has a cap.

What can be lost: a pair at the threshold itself shares no band with a probability of about 1e-6, and a pair of sets above SMALL
shingles falls below AGREE with less than that.

Defined results: null texts and texts without words have no shingles and are linked with nothing; a text shorter than a
shingle is one shingle; rows with equal keys are one document; a row with a null key is in the component of its class, or in
none (null) if all of its class have null keys; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, discard, mix, n_parts, stage, staged, text_slices, window_hash
from .components import components
from .tokens import spread

BINS, ROWS = 270, 6
#: Bins of the second signature, which only the comparison across components uses.
MORE_BINS = 512
#: Sets of up to so many shingles are compared whole. A set at the threshold of one above it has at least LEAST_LARGE.
SMALL, LEAST_LARGE = 400, 320
#: Of all 782 bins this many agree at least in a pair of larger sets at similarity 0.8. The mean is 626, the standard deviation
#: 10 at 1,000 shingles and 11.5 at 320, so this is 5.7 of them below it or more.
AGREE = 560
BLOCK = 512
#: Bits of the filter of candidate keys that readers of the texts get: 8 MB whatever the data. Where it fills up, sets of documents that
#: are no candidates are written too, and found by no join.
FILTER_BITS = 1 << 26
_TRIES = 1024


def tries(bins: int, of: np.ndarray, turn: int) -> np.ndarray:
    """The turn-th thousand bins that empty bins copy from, in order."""
    return (mix(of.astype(U64)[:, None] * U64(_TRIES) + np.arange(_TRIES, dtype=U64) + (U64(turn) << U64(32)) + U64(77)) % U64(bins)).astype(np.int64)


_FIRST = {n: tries(n, np.arange(n), 0) for n in (BINS, MORE_BINS)}


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text of a string column."""
    for _, part in text_slices(text):
        w = Words(part, lower=True)
        h = window_hash(w.hash, k)
        for a, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
            if n >= k:
                yield np.unique(h[a : a + n - k + 1])
            elif n:
                yield window_hash(w.hash[a : a + n], n) ^ U64(n)
            else:
                yield h[:0]


def in_small_batches(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what is made of a batch stays small."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def signature(s: np.ndarray, bins: int = BINS, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """One-permutation MinHash of a set: for each bin its smallest value; empty bins copy from others (optimal densification)."""
    g = mix(s ^ U64(salt))
    key = np.sort(((g % U64(bins)) << U64(54)) | (g >> U64(10)))
    at = np.searchsorted(key, np.arange(bins, dtype=U64) << U64(54))
    nxt = np.append(at[1:], len(key))
    full = at < nxt
    out = np.zeros(bins, U64)
    out[full] = key[at[full]] & U64((1 << 54) - 1)
    empty, turn = np.flatnonzero(~full), 0
    while len(empty) and len(s):
        look = _FIRST[bins][empty] if not turn else tries(bins, empty, turn)
        hit = full[look[:, :16]] if not turn else full[look]
        if not turn and not hit.any(1).all():
            hit = full[look]
        found = hit.any(1)
        out[empty[found]] = out[look[found, hit[found].argmax(1)]]
        empty, turn = empty[~found], turn + 1
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=U64) + U64(1)
    for r in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + rows[:, r])
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """key, n (shingles), set_id, keys (bucket keys), sig (a byte of each bin, then 32 bits of each key) of every row; null without shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_small_batches(it):
            n, ids, keys, sigs = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                if len(s):
                    g = signature(s)
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(bands(g))
                    sigs.append((g & U64(255)).astype(np.uint8).tobytes() + keys[-1].astype("<u4").tobytes())
                else:
                    ids.append(None), keys.append(None), sigs.append(None)
            yield pa.record_batch({"key": b.column("key"), "n": pa.array(n, pa.int64()), "set_id": pa.array(ids, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.binary())})

    return docs.mapInArrow(run, "key long, n long, set_id binary, keys array<long>, sig binary")


def key_filter(keys: DataFrame) -> DataFrame:
    """(part, bits): a filter of FILTER_BITS bits that knows every key, in rows of 4 KB."""
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("at")
    return keys.select(at).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))


def sets_of(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """key, set (ascending 64-bit hashes) of the documents whose key is among keys, and of few others."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_small_batches(it):
            yield pa.record_batch({"key": b.column("key"), "set": pa.array([s.tobytes() for s in shingle_sets(b.column("text"), k)], pa.binary())})

    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    held = docs.withColumn("_at", at).withColumn("part", F.floor(F.col("_at") / 32768)).join(F.broadcast(key_filter(keys)), "part")
    byte = F.conv(F.hex(F.expr("substring(bits, cast((_at % 32768) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = held.where(F.expr("_at is not null") & (F.call_function("getbit", byte, (F.col("_at") % 8).cast("int")) == 1))
    return held.select("key", "text").mapInArrow(run, "key long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have 100 * intersection >= percent * union.

    The set of each b goes to its a once. Of an a with many b they are dealt over parts, each of which gets a copy of a's set,
    and a part is read as a stream, so that no star has to fit in a task.
    """
    parts = n_parts(pairs.sparkSession)
    # an a with more than a quarter of a partition's share of all b: four a partition at most, few enough to broadcast
    hot = pairs.groupBy("a").agg(F.count("*").alias("many")).where(F.col("many") > max(1, pairs.count() // (4 * parts))).select("a", F.lit(True).alias("hot"))
    dealt = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(parts))).otherwise(F.lit(0).cast("long")).alias("part"))
    # rows with equal keys are one document, which has the links of each of its texts
    members = dealt.join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "set")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("key", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs_ = None, []
        for batch in in_small_batches(it):
            got = []
            for a, part, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "set")), strict=True):
                x = np.frombuffer(s, U64)
                if b is None:
                    hubs_ = [*hubs_, x] if at == (a, part) else [x]
                    at = a, part
                    continue
                for hub in hubs_ if at == (a, part) else ():
                    small, large = (x, hub) if len(x) <= len(hub) else (hub, x)
                    if 100 * len(small) >= percent * len(large):
                        i = np.searchsorted(large, small)
                        i[i == len(large)] = 0
                        both = int((large[i] == small).sum())
                        if 100 * both >= percent * (len(x) + len(hub) - both):
                            got.append((a, b))
            c = list(zip(*got, strict=True)) or [[], []]
            yield pa.record_batch({"a": pa.array(c[0], pa.int64()), "b": pa.array(c[1], pa.int64())})

    rows = members.unionByName(hubs).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def across(members: DataFrame, reps: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that may reach the similarity."""
    named = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "hub", "rep", F.coalesce("label", "rep").alias("comp"))
    main = named.where("rep = hub").select("bucket", F.col("comp").alias("main")).distinct()
    state = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    open_, at_open = staged(named.join(state.join(main, "bucket"), "bucket"), "open")
    wanted = open_.select(F.col("rep").alias("key")).distinct()

    def more(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_small_batches(it):
            small, large = [], []
            for raw in b.column("set").to_pylist():
                x = np.frombuffer(raw, U64)
                small.append(np.unique((mix(x) >> U64(32)).astype("<u4")).tobytes() if len(x) <= SMALL else b"")
                large.append((signature(x, MORE_BINS, 0x2545F4914F6CDD1D) & U64(255)).astype(np.uint8).tobytes() if len(x) >= LEAST_LARGE else b"")
            yield pa.record_batch({"rep": b.column("key"), "small": pa.array(small, pa.binary()), "more": pa.array(large, pa.binary())})

    second = sets.join(wanted, "key").select("key", "set").mapInArrow(more, "rep long, small binary, more binary").groupBy("rep").agg(F.min("small").alias("small"), F.min("more").alias("more"))
    first = F.expr(f"substring(sig, 1, {BINS})")
    known = reps.join(second, "rep").select("rep", F.col("n").alias("size"), F.expr(f"substring(sig, {BINS + 1}, {4 * (BINS // ROWS)})").alias("keys"), "small", F.when(F.length("more") > 0, F.concat(first, "more")).otherwise(F.col("more")).alias("large"))
    rows, at_rows = staged(open_.join(known, "rep").withColumn("minor", F.col("comp") != F.col("main")), "open")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("minor").select("bucket", F.col("block").alias("i"), every.alias("j"), F.lit(0).alias("side"), "rep", "comp", "size", "keys", "small", "large")
    right = rows.select("bucket", every.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "rep", "comp", "size", "keys", "small", "large")

    def compare(bucket: int, rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side = np.array([r[0] for r in rows])
        rep, comp, size = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        keys = np.frombuffer(b"".join(r[4] for r in rows), "<u4").reshape(len(rows), -1)
        band = int(np.flatnonzero(keys[0] == np.uint32(bucket & 0xFFFFFFFF))[0])
        y = np.flatnonzero(side == 1)
        sets = {i: np.frombuffer(rows[i][5], "<u4") for i in range(len(rows)) if rows[i][5]}
        inverted = Inverted([sets.get(i, _NO_SET) for i in y.tolist()])
        large = {i: np.frombuffer(rows[i][6], np.uint8) for i in range(len(rows)) if rows[i][6]}
        big = np.array([i for i in y.tolist() if i in large], np.int64)
        sigs = np.stack([large[i] for i in big.tolist()]) if len(big) else None
        for x in np.flatnonzero(side == 0).tolist():
            ok = np.zeros(len(rows), bool)
            if x in sets:
                both = inverted.common(sets[x])
                ok[y] = 100 * both >= percent * (len(sets[x]) + inverted.size - both)
                ok[y] &= inverted.size > 0
            if x in large and len(big):
                ok[big] |= ((size[big] > SMALL) | (size[x] > SMALL)) & ((sigs == large[x]).sum(1) >= AGREE)
            ok &= (comp != comp[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            i = np.flatnonzero(ok)
            i = i[~(keys[i, :band] == keys[x, :band]).any(1)]  # a pair is compared in its first common bucket only
            if len(i):
                yield np.minimum(rep[i], rep[x]), np.maximum(rep[i], rep[x])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def flush():
            pairs = list(compare(at[0], rows)) if rows else []
            if pairs:
                ab = np.unique(np.stack([np.concatenate(c) for c in zip(*pairs, strict=True)], 1), axis=0)
                yield pa.record_batch({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])})

        for batch in in_small_batches(it):
            for *where, side, rep, comp, size, keys, small, large in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "rep", "comp", "size", "keys", "small", "large")), strict=True):
                if where != at:
                    yield from flush()
                    at, rows = where, []
                rows.append((side, rep, comp, size, keys, small, large))
        yield from flush()

    rows = left.unionByName(right).repartition(n_parts(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    out = stage(rows.mapInArrow(run, "a long, b long").distinct(), "pairs")
    discard(members.sparkSession, at_open)
    discard(members.sparkSession, at_rows)
    return out


_NO_SET = np.zeros(0, np.uint32)


class Inverted:
    """Sets by their elements, to count what each has in common with another."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([*sets, _NO_SET])
        order = np.argsort(flat, kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.size)[order]
        self.value, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))

    def common(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.zeros(len(self.size), np.int64)
        i = np.searchsorted(self.value, x)
        i[i == len(self.value)] = 0
        i = i[self.value[i] == x]
        return np.bincount(self.of[spread(self.first[i], self.first[i + 1] - self.first[i])], minlength=len(self.size))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept of every row: components of documents with 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sigs, _ = staged(signatures(docs, k), "signatures")
    classes, at_classes = staged(sigs.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes")
    # one row a class; its smallest key has it. (set, key) is even over partitions however many copies a class has
    reps, at_reps = staged(sigs.join(classes, (sigs.set_id == classes.set_id) & (sigs.key == classes.rep)).select("rep", "n", "keys", "sig").dropDuplicates(["rep", "n", "sig"]), "classes")
    rows = reps.select(F.explode("keys").alias("bucket"), "rep")
    hubs = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("bucket", "hub")
    members, at_members = staged(rows.join(hubs, "bucket"), "members")
    wanted = members.select(F.col("rep").alias("key")).distinct()
    sets, at_sets = staged(sets_of(docs, wanted, k), "sets")
    # candidates are read several times: written once
    near, at_near = staged(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    star, at_star = staged(confirmed(near, sets, percent), "links")
    label = components(star)
    far = across(members, reps, sets, label, percent)
    rest, at_rest = staged(confirmed(far, sets, percent), "links")
    if not rest.isEmpty():  # components of the few labels that the rest joins
        named = lambda df, c: df.join(label.select(F.col("node").alias(c), F.col("label").alias("l" + c)), c, "left")
        few = named(named(rest, "a"), "b").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
        over, at_over = staged(components(few), "labels")
        ends = star.unionByName(rest).select(F.explode(F.array("a", "b")).alias("node")).distinct()
        label = ends.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        label = stage(label.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        discard(spark, at_over)
    for path in (at_reps, at_members, at_sets, at_near, at_star, at_rest):
        discard(spark, path)
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("set_id").alias("class"), "copies", F.coalesce("label", "rep").alias("comp"))
    # classes of many copies are dealt over all partitions. Those with more than their share of a quarter of a partition are
    # four a partition at most: few enough to broadcast
    parts = n_parts(spark)
    much = max(1, sigs.count() // (4 * parts))
    hot = classes.where(F.col("copies") > much).select(F.col("set_id").alias("hot"))
    salted = sigs.join(F.broadcast(hot), F.col("set_id") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.lit(0))).drop("hot")
    each = F.explode(F.when(F.col("copies") > much, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    named = named.select("class", "comp", each.alias("at"))
    out = salted.select("key", "n", "set_id", "salt").join(named, (F.col("set_id") == F.col("class")) & (F.col("salt") == F.col("at")), "left")
    comp = F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("comp"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("key") == comp, F.lit(False)).alias("kept"))
