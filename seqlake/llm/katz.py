"""Operator 5: language-model scores by Katz backoff over word bigrams.

Good-Turing discounts come from the counts of counts of the whole training corpus; the mass that they free in a context goes
to its unseen words, with a backoff weight that makes the context sum to one exactly. Unigrams are discounted the same way,
and their free mass belongs to the one unknown word. The counts lie in packed tables, partitioned by hashes of words and of
contexts. Chunks of documents put one question for each distinct word, and then for each distinct bigram, to the partition that
holds it, and evaluate the model token by token: the bigram if it was seen, else the weight of its context times the unigram.

A frequent context (the begin of a text, a common word) is dealt over all partitions by the word that follows; each sums its
part, and the sums of such contexts, at most four a partition, go to all chunks.

Defined results: null text is empty, its only token is the end; a null key counts as an empty one; with no training document
every token has the base probability of an unknown word, and so has the model; repeated rows are counted and scored each;
other columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks, dealt, read_chunk
from .common import U64, Words, mix, staged, text_slices

K = 5
#: Bytes of Arrow data in a chunk: its distinct bigrams take about ten times as much while it is worked on.
CHUNK = 14 << 20
END, BEGIN = U64(0x0E4D), U64(0xBE61)
ROWS = "kind string, chunk int, part int, answer binary"


def packed(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpacked(b: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", b)
    sizes = struct.unpack_from(f"<{n}Q", b, 4)
    raw, at, out = zstandard.ZstdDecompressor().decompress(b[4 + 8 * n :]), 0, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..K (of 0: 1) from n, how many have count 1..K+1; absolute discounts where they don't exist."""
    out = np.ones(K + 1)
    r = np.arange(1, K + 1)
    n = n.astype(float)
    if (n > 0).all():
        a = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - a) / (1 - a) if a < 1 else np.zeros(K)
        if ((d > 0) & (d < 1)).all():
            out[1:] = d
            return out
    out[1:] = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5)) / r
    return out


class Unigrams:
    """Discounted unigram probabilities of counts; count 0 is the unknown word."""

    def __init__(self, total: int, kinds: int, n: np.ndarray):
        self.total, self.kinds, self.d = total, kinds, discounts(n)
        if total:
            small = np.arange(1, K + 1) * n[:K]
            freed = float(((1 - self.d[1:]) * small).sum()) / total
            # without rare words nothing is freed: one more count makes room for the unknown word
            self.unknown, self.scale = (freed, 1 / total) if freed > 0 else (1 / (total + 1), 1 / (total + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.full(len(c), 1.0)
        return np.where(c == 0, self.unknown, self.d[np.minimum(c, K) * (c <= K)] * c * self.scale)


def context_weights(total: np.ndarray, n: np.ndarray, seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of discounted counts, backoff weight) of contexts: their counts, how many followers have count 1..K, and the
    unigram mass of the followers. A context without rare followers gets one more count as the room for unseen words."""
    freed = (n * np.arange(1, K + 1) * (1 - d[1:])).sum(1)
    none = freed <= 0
    size = total + none
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 / size, np.where(none, 1.0, freed) / size / (1 - seen)


class Tokens:
    """Words and ends of a slice: word number of each token among the slice's distinct words, and its document."""

    def __init__(self, text: pa.Array):
        w = Words(text, lower=True)
        n = len(w.count)
        at = np.arange(len(w)) + w.doc  # one end for each earlier document
        ends = w.first + w.count + np.arange(n)
        self.hash = np.empty(len(w) + n, U64)
        self.doc = np.empty(len(w) + n, np.int64)
        self.hash[at], self.doc[at] = w.hash, w.doc
        self.hash[ends], self.doc[ends] = END, np.arange(n)
        self.first = w.first + np.arange(n)


class Chunk:
    """Tokens of a chunk as numbers of its distinct words (ascending hashes), and its distinct bigrams."""

    def __init__(self, path: str, key: str, text: str, modulus: int, held: int, bigrams: bool):
        hashes, docs, firsts, keys, n, t = [], [], [], [], 0, 0
        for b in read_chunk(path):
            keys += b.column(key).to_pylist()
            for _, part in text_slices(b.column(text)):
                s = Tokens(part)
                hashes.append(s.hash), docs.append((s.doc + n).astype(np.int32)), firsts.append(s.first + t)
                n, t = n + len(part), t + len(s.hash)
        self.keys = keys
        self.held = np.array([zlib.crc32(b"" if k is None else str(k).encode()) % modulus == held for k in keys], bool)
        self.doc, first = np.concatenate(docs), np.concatenate(firsts)
        self.words, number = np.unique(np.concatenate(hashes), return_inverse=True)
        self.word = number.astype(np.uint32)
        train = ~self.held[self.doc]
        self.counts = np.bincount(self.word[train], minlength=len(self.words)).astype("<u8")
        if bigrams:
            before = np.empty(len(self.word), np.uint64)
            before[1:] = self.word[:-1]
            before[first] = len(self.words)  # the beginning
            self.pairs, number = np.unique((before << U64(32)) | self.word, return_inverse=True)
            self.pair = number.astype(np.uint32)
            self.pair_counts = np.bincount(self.pair[train], minlength=len(self.pairs)).astype("<u4")
            self.context = (self.pairs >> U64(32)).astype(np.int32)
            self.follower = (self.pairs & U64(0xFFFFFFFF)).astype(np.int32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "chunk", "part", "answer"])


def _judged(asked: DataFrame, parts: int, judge) -> DataFrame:
    """judge(rows of a partition: chunk, part, question) -> rows (kind, chunk, part, answer)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in it for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "part", "answer")), strict=True)]
        if rows:
            yield from map(_rows, judge(rows))

    return asked.repartitionById(parts, F.pmod("part", F.lit(parts))).mapInArrow(run, ROWS)


def histogram(c: np.ndarray) -> np.ndarray:
    """How many counts are 1..K+1, how many positive, and their sum."""
    return np.append(np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2], [(c > 0).sum(), c.sum()]).astype(np.int64)


def _stats(judged: DataFrame) -> np.ndarray:
    got = [np.frombuffer(r.answer, np.int64) for r in judged.where("kind = 'stats'").collect()]  # one short row a partition
    return np.sum(got, 0) if got else np.zeros(K + 3, np.int64)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from the documents whose crc32(key as text) modulo `modulus` is not `held`.
    """
    spark = docs.sparkSession
    chunks = Chunks(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), "corpus", CHUNK)
    parts = chunks.parts

    def load(path: str, bigrams: bool) -> Chunk:
        return Chunk(path, key, text, modulus, held, bigrams)

    # ---- unigrams
    def words_asked(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
        c = load(path, False)
        order, some, at = dealt(c.words, parts)
        yield _rows([("ask", chunk, int(p), packed(c.words[order[a:b]], c.counts[order[a:b]])) for p, a, b in zip(some, at[:-1], at[1:], strict=True)])

    def words_judged(rows: list[tuple]) -> Iterator[list[tuple]]:
        got = [unpacked(r[2], "<u8", "<u8") for r in rows]
        u, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, back, np.concatenate([g[1] for g in got]).astype(np.int64))
        yield [("stats", -1, rows[0][1], histogram(total).tobytes())]
        answers, i = total[back], 0
        for (chunk, p, _), g in zip(rows, got, strict=True):
            yield [("answer", chunk, p, packed(answers[i : i + len(g[0])]))]
            i += len(g[0])

    ones, _ = staged(_judged(chunks.each(words_asked, ROWS), parts, words_judged), "unigrams")
    n1 = _stats(ones)
    train_tokens, kinds = int(n1[-1]), int(n1[-2])
    uni = Unigrams(train_tokens, kinds, n1[: K + 1])

    def word_counts(c: Chunk, answers: list[bytes]) -> tuple[np.ndarray, int]:
        order, some, _ = dealt(c.words, parts)
        out = np.empty(len(c.words), np.int64)
        out[order] = np.concatenate([unpacked(a, "<i8")[0] for a in answers[: len(some)]])
        return out, len(some)

    # ---- bigrams
    # a context that occurs more often than a fourth of a partition's even share is dealt by its followers
    often = train_tokens // (4 * parts)

    def shares(c: Chunk, known: np.ndarray):
        """For each partition that gets some: (partition, its contexts, whether they are frequent, how many pairs of each, the pairs)."""
        h = np.append(c.words, BEGIN)
        much = np.append(known > often, True)
        part = (h % U64(parts)).astype(np.int32)[c.context]
        i = np.flatnonzero(much[c.context])
        part[i] = (mix(h[c.context[i]] * U64(3) + c.words[c.follower[i]]) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        some, at = np.unique(part[order], return_index=True)
        for p, a, b in zip(some.tolist(), at, np.append(at[1:], len(order)), strict=True):
            pairs = order[a:b]  # ascending, so by context
            context, size = np.unique(c.context[pairs], return_counts=True)
            yield p, h[context], much[context], size, pairs

    def pairs_asked(chunk: int, path: str, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        c = load(path, True)
        known, _ = word_counts(c, answers)
        for p, h, much, size, pairs in shares(c, known):
            f = c.follower[pairs]
            yield _rows([("ask", chunk, p + parts, packed(h, much.astype("u1"), size.astype("<u4"), c.words[f], c.pair_counts[pairs], np.minimum(known[f], 2**32 - 1).astype("<u4") if train_tokens < 2**32 else known[f]))])

    wide = "<u4" if train_tokens < 2**32 else "<i8"

    def pairs_judged(rows: list[tuple]) -> Iterator[list[tuple]]:
        got = [unpacked(r[2], "<u8", "u1", "<u4", "<u8", "<u4", wide) for r in rows]
        context = np.concatenate([np.repeat(g[0], g[2]) for g in got])
        much = np.concatenate([np.repeat(g[1], g[2]) for g in got]).astype(bool)
        word = np.concatenate([g[3] for g in got])
        count, known = np.concatenate([g[4] for g in got]).astype(np.int64), np.concatenate([g[5] for g in got]).astype(np.int64)
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        pair = np.add.reduceat(count[order], at)  # counts of the distinct bigrams
        own, mass = context[at], uni.p(known[order][at]) * (pair > 0)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        u = own[first]
        total, seen = np.add.reduceat(pair, first), np.add.reduceat(mass, first)
        small = np.stack([np.add.reduceat((pair == r).astype(np.int64), first) for r in range(1, K + 1)], 1)
        often_ = much[order][at][first]
        yield [("stats", -1, rows[0][1], histogram(pair).tobytes()), ("often", -1, rows[0][1], packed(u[often_], total[often_], small[often_], seen[often_]))]
        answers = np.empty(len(order), np.int64)
        answers[order] = pair[np.cumsum(new) - 1]
        i = 0
        for (chunk, p, _), g in zip(rows, got, strict=True):
            n = int(g[2].sum())
            j = np.searchsorted(u, g[0][g[1] == 0])
            yield [("answer", chunk, p, packed(answers[i : i + n], total[j], small[j], seen[j]))]
            i += n

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for raw in b.column("answer").to_pylist():
                u, total, small, seen = unpacked(raw, "<u8", "<i8", "<i8", "<f8")
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(total), pa.array(seen), *(pa.array(x) for x in np.ascontiguousarray(small.reshape(-1, K).T))], names=["context", "total", "seen", *(f"n{r}" for r in range(1, K + 1))])

    answer = lambda df: df.where("kind = 'answer'").select("chunk", "part", "answer")
    twos, _ = staged(_judged(chunks.answered(answer(ones), pairs_asked, ROWS), parts, pairs_judged), "bigrams")
    d = discounts(_stats(twos)[: K + 1])
    # four contexts a partition at most, and the begin
    names = ["total", "seen", *(f"n{r}" for r in range(1, K + 1))]
    frequent = twos.where("kind = 'often'").select("answer").mapInArrow(sums, "context long, total long, seen double, " + ", ".join(f"n{r} long" for r in range(1, K + 1)))
    rows = frequent.groupBy("context").agg(*(F.sum(c).alias(c) for c in names)).collect()
    table = np.array([r.context for r in rows], np.int64).view(U64)
    by = np.argsort(table)
    common = spark.sparkContext.broadcast((table[by], *(np.array([r[c] for r in rows], float if c == "seen" else np.int64)[by] for c in names)))

    # ---- scores
    def scored(chunk: int, path: str, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        c = load(path, True)
        known, used = word_counts(c, answers)
        n = len(c.keys)
        low = np.log10(uni.p(known)) if train_tokens else np.zeros(len(known))
        value = np.empty(len(c.pairs))
        words, all_total, all_seen, *all_small = common.value
        for (_, h, much, size, pairs), a in zip(shares(c, known), answers[used:], strict=True):
            count, some_total, some_small, some_seen = unpacked(a, "<i8", "<i8", "<i8", "<f8")
            total, seen, small = np.empty(len(h), np.int64), np.empty(len(h)), np.empty((len(h), K), np.int64)
            total[~much], seen[~much], small[~much] = some_total, some_seen, some_small.reshape(-1, K)
            j = np.searchsorted(words, h[much])
            total[much], seen[much], small[much] = all_total[j], all_seen[j], np.stack([x[j] for x in all_small], 1)
            scale, weight = context_weights(total, small, seen, d)
            of = np.repeat(np.arange(len(size)), size)
            with np.errstate(divide="ignore", invalid="ignore"):
                high = np.log10(d[np.minimum(count, K) * (count <= K)] * count * scale[of])
                back = np.where(total > 0, np.log10(weight), 0.0)[of] + low[c.follower[pairs]]
            value[pairs] = np.where(count > 0, high, back)
        base = np.log10((known + 1) / (train_tokens + kinds + 1))
        docs_ = c.doc
        sums = lambda x: np.bincount(docs_, x, n)
        yield pa.record_batch({key: pa.array(c.keys, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(np.bincount(docs_, minlength=n), pa.int64()), "n_known": pa.array(sums((known > 0)[c.word]).astype(np.int64)), "train_tokens": pa.array(np.full(n, train_tokens), pa.int64()), "base_score": pa.array(sums(base[c.word])), "score": pa.array(sums(value[c.pair]))})

    schema = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.answered(answer(ones).unionByName(answer(twos)), scored, schema)
