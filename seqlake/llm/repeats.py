"""Operator 8: removal of passages that recur, by repeated-phrase automata.

A window is `window` consecutive words. Recurring passages are confirmed in two rounds of questions between chunks of documents
and hash partitions: first the winnowed anchors (the smallest hash of the k-grams of each window, so that equal windows have
equal anchors), then the windows around anchors that recur. Confirmed passages are cut into phrases of a window's length, which
go to shards by their hash: a shard holds the distinct phrases, in their own words, of the whole corpus. Every chunk is given the
phrases of all shards that it may hold, compiles them into Aho-Corasick automata of at most SHARD phrases, and streams all its
documents through them; the words that occurrences cover, compared word by word, are removed.

Defined results: null text has no words and stays null; documents shorter than a window keep all; a window that recurs within
one document counts; of repeated rows all lose their windows; an empty table gives none; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import QUESTION, Chunks, ask, in_order, questions, read_chunk, split
from .common import U64, Words, text_slices, window_hash

GRAM = 10
#: Phrases in an automaton.
SHARD = 10_000


def anchors(h: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows, hash and place of each window's anchor): the smallest gram hash in the window, the last of equal ones."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    v, have, width = window_hash(h, gram), 1, window - gram + 1
    place = np.arange(len(v))
    while have < width:
        step = min(have, width - have)
        right = v[step:] <= v[: len(v) - step]
        v = np.where(right, v[step:], v[: len(v) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        have += step
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return at, v[at], place[at]


def _texts(path: str, text: str) -> Iterator[tuple[pa.RecordBatch, int, pa.Array]]:
    for b in read_chunk(path):
        col = b.column(text)
        for first, part in text_slices(col):
            yield b, first, part


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of parts, and whether each occurs more than once."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    u, c = np.unique(np.concatenate(parts), return_counts=True)
    return u, (c > 1).astype(np.uint8)


def _recur(hashes: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """Of each question's hashes: does the hash occur in another question, or more than once in its own chunk?"""
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= s[1:] == s[:-1]
    flag = np.frombuffer(b"".join(extras), np.uint8).astype(bool)
    flag[order] |= same
    return [np.packbits(x).tobytes() for x in split(flag, hashes)]


def _flags(h: np.ndarray, parts: int, answers: list[bytes]) -> np.ndarray:
    """The recurring ones of ascending distinct hashes h."""
    sizes = np.bincount((h % U64(parts)).astype(np.int64), minlength=parts)
    bits = [np.unpackbits(np.frombuffer(a, np.uint8), count=int(n)).tobytes() for a, n in zip(answers, sizes[sizes > 0], strict=True)]
    return h[in_order(h, parts, bits, np.uint8).astype(bool)]


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_, x)
    i[i == len(sorted_)] = 0
    return sorted_[i] == x


def phrase_starts(starts: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """First words of phrases that cover the passages whose windows begin at `starts`: one after the other, and the last window."""
    if not len(starts):
        return starts
    cut = np.flatnonzero((np.diff(starts) > 1) | (doc[starts[1:]] != doc[starts[:-1]])) + 1
    out = []
    for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(starts)), strict=True):
        lo, last = int(starts[a]), int(starts[b - 1])
        out += [*range(lo, last, window), last]
    return np.array(out, np.int64)


class Automata:
    """Phrases (words with single spaces) compiled over word numbers."""

    def __init__(self, phrases: list[bytes]):
        self.phrases, self.shards = phrases, []
        flat = b"\n".join(phrases)
        w = Words(pa.array([flat], pa.large_binary()).view(pa.large_string()))
        size = np.array([p.count(b" ") + 1 for p in phrases], np.int64)
        self.least = int(size.min()) if len(size) else 0
        self.gram = min(GRAM, self.least)
        of = np.repeat(np.arange(len(phrases)), size)
        grams = window_hash(w.hash, self.gram) if len(size) else np.zeros(0, U64)
        self.grams = np.unique(grams[of[: len(grams)] == of[len(of) - len(grams) :]])
        self.words, number = np.unique(w.hash, return_inverse=True)
        self.base = int(np.sqrt(len(self.words) + 1)) + 1
        letters, at = self.letters(number + 1), 0
        for i in range(0, len(phrases), SHARD):
            auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k in range(i, min(i + SHARD, len(phrases))):
                n = int(size[k])
                key = tuple(letters[2 * at : 2 * (at + n)])
                auto.add_word(key, (n, [*auto.get(key, (n, []))[1], k]))  # phrases whose words have equal hashes
                at += n
            auto.make_automaton()
            self.shards.append(auto)

    def letters(self, ids: np.ndarray) -> list[int]:
        """Two letters for each word number, of alphabets apart: a node then has few children, which the library searches one by one."""
        out = np.empty(2 * len(ids), np.int64)
        out[::2], out[1::2] = ids // self.base, self.base + 1 + ids % self.base
        return out.tolist()

    def stretches(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, words) of the parts of documents that can hold a phrase: all their grams are grams of phrases."""
        ok = member(self.grams, window_hash(words.hash, self.gram))
        ok &= words.doc[: len(ok)] == words.doc[self.gram - 1 :]
        of = np.concatenate(([0], np.where(ok, words.doc[: len(ok)] + 1, 0), [0]))
        edge = np.flatnonzero(np.diff(of))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if of[a + 1] and b - a >= self.least - self.gram + 1:
                yield a, b - a + self.gram - 1

    def locate(self, words: Words) -> np.ndarray:
        """Mask of the words in occurrences of the phrases."""
        cover = np.zeros(len(words) + 1, np.int64)
        if len(self.words) and len(words):
            i = np.searchsorted(self.words, words.hash)
            i[i == len(self.words)] = 0
            letters = self.letters(np.where(self.words[i] == words.hash, i + 1, 0))
            raw, start, end = words.data.tobytes(), words.start, words.end
            for f, n in self.stretches(words):
                text = tuple(letters[2 * f : 2 * (f + n)])
                for auto in self.shards:
                    for last, (size, which) in auto.iter(text):
                        a = f + last // 2 + 1 - size
                        if b" ".join(raw[start[a] : end[a + size - 1]].split()) in [self.phrases[k] for k in which]:
                            cover[a] += 1
                            cover[a + size] -= 1
        return np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, digest: bool = False, key: str = "doc_id") -> DataFrame:
    """docs without their recurring windows. digest: instead key, n_words, n_removed, kept_sha256 of every row.

    A changed text keeps the white space between words that stay side by side; removed stretches leave one space or line end.
    """
    if digest:
        docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    chunks = Chunks(docs, "repeats")
    parts = chunks.parts
    gram = min(GRAM, window)

    def anchor_questions(chunk: int, path: str) -> Iterator[pa.RecordBatch]:
        found = []
        for _, _, part in _texts(path, text):
            w = Words(part)
            _, a, place = anchors(w.hash, w.doc, window, gram)
            new = np.ones(len(a), bool)
            new[1:] = place[1:] != place[:-1]  # windows in a row often share an anchor
            found.append(a[new])
        yield from questions(chunk, *(lambda u, m: (u, parts, m))(*_counted(found)))

    def candidates(path: str, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows of the chunk whose anchor recurs, and whether they occur more than once in it."""
        seen = [anchors(w.hash, w.doc, window, gram)[1] for w in (Words(p) for _, _, p in _texts(path, text))]
        u = np.unique(np.concatenate(seen)) if seen else np.zeros(0, U64)
        good, found = _flags(u, parts, answers), []
        for (_, _, part), a in zip(_texts(path, text), seen, strict=True):
            if member(good, a).any():
                w = Words(part)
                at, a, _ = anchors(w.hash, w.doc, window, gram)
                found.append(window_hash(w.hash, window)[at[member(good, a)]])
        return _counted(found)

    def window_questions(chunk: int, path: str, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        u, many = candidates(path, answers)
        yield from questions(chunk, u, parts, many)

    def phrases_told(chunk: int, path: str, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The chunk's phrases to their shards; the answers hold the hashes of its windows that recur."""
        good = np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(r, U64) for r in answers)]))
        told: dict[int, dict[bytes, int]] = {}
        for _, _, part in _texts(path, text):
            w = Words(part)
            at, _, _ = anchors(w.hash, w.doc, window, gram)
            if len(at):
                win, raw = window_hash(w.hash, window), w.data.tobytes()
                for a in phrase_starts(at[member(good, win[at])], w.doc, window).tolist():
                    phrase = b" ".join(raw[w.start[a] : w.end[a + window - 1]].split())
                    told.setdefault(int(win[a] % U64(parts)), {})[phrase] = int(win[a])
        rows = [(chunk, p, np.array(list(x.values()), U64).tobytes(), _shut(list(x))) for p, x in told.items()]
        c = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch({"chunk": pa.array(c[0], pa.int32()), "part": pa.array(c[1], pa.int32()), "hashes": pa.array(c[2], pa.binary()), "extra": pa.array(c[3], pa.binary())})

    def located(chunk: int, path: str, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        automata = Automata(sorted({x for a in answers for x in _opened(a)}))
        for b, first, part in _texts(path, text):
            w = Words(part)
            gone = automata.locate(w)
            rows = b.slice(first, len(part))
            yield digests(rows, w, gone) if digest else rewritten(rows, w, gone)

    def digests(rows: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        raw, out = w.data.tobytes(), []
        for i, (f, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=True)):
            words = raw[w.offsets[i] : w.offsets[i + 1]].split()
            lost = gone[f : f + n]
            k = int(lost.sum())
            if k:
                words = [x for x, g in zip(words, lost.tolist(), strict=True) if not g]
            out.append((n, k, hashlib.sha256(b" ".join(words)).hexdigest()))
        c = list(zip(*out, strict=True))
        return pa.record_batch({key: rows.column(key), "n_words": pa.array(c[0], pa.int64()), "n_removed": pa.array(c[1], pa.int64()), "kept_sha256": pa.array(c[2], pa.string())})

    def rewritten(rows: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        texts, raw = rows.column(text).to_pylist(), w.data.tobytes()
        for i, (f, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=True)):
            lost = gone[f : f + n]
            if lost.any():
                stay = np.flatnonzero(~lost) + f
                cut = np.flatnonzero(np.diff(stay) > 1) + 1
                runs = [r for r in np.split(stay, cut) if len(r)]
                gap = [b"\n" if b"\n" in raw[w.end[x[-1]] : w.start[y[0]]] else b" " for x, y in zip(runs, runs[1:], strict=False)] + [b""] * bool(runs)
                texts[i] = b"".join(raw[w.start[r[0]] : w.end[r[-1]]] + g for r, g in zip(runs, gap, strict=True)).decode()
        k = rows.schema.get_field_index(text)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == k else rows.column(j) for j in range(rows.num_columns)], schema=rows.schema)

    recurring = ask(chunks.each(anchor_questions, QUESTION), parts, _recur)
    windows = ask(chunks.answered(recurring, window_questions, QUESTION), parts, _kept)
    schema = T.StructType([T.StructField(key, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType())]) if digest else docs.schema
    shards = ask(chunks.answered(windows, phrases_told, QUESTION), parts, _shard)
    return chunks.answered(shards, located, schema)


def _shut(phrases: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(phrases))


def _opened(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


def _shard(hashes: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """To each question the shard's phrases, of whatever chunk, that have its hashes."""
    held: dict[int, set[bytes]] = {}
    for h, x in zip(hashes, extras, strict=True):
        for i, phrase in zip(h.tolist(), _opened(x), strict=True):
            held.setdefault(i, set()).add(phrase)
    return [_shut([p for i in dict.fromkeys(h.tolist()) for p in held[i]]) for h in hashes]


def _kept(hashes: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """Of each question's hashes, those that recur."""
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for h, x in zip(hashes, _recur(hashes, extras), strict=True)]
    return [h[f].tobytes() for h, f in zip(hashes, flags, strict=True)]

