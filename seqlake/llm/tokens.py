"""Encoding with the tokenizers library, memoised by the pieces that its pre-tokenizer never crosses."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .common import U64, equal_spans, lanes, span_hash, text_slices

_LOADED: dict[str, "PieceEncoder"] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False


def letters(d: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the Latin-1 letters (C3 80-BF but for the signs C3 97 and C3 B7)."""
    out = _ASCII_LETTER[d]
    lead = np.flatnonzero(d[:-1] == 0xC3)
    lead = lead[(d[lead + 1] != 0x97) & (d[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


#: Bytes that the memo of a worker process may take; then it starts anew. Only speed depends on it.
MEMO_BYTES = 40 << 20
#: Longer pieces are encoded whenever they come.
MEMO_PIECE = 64


class Run:
    """Pieces in the order of their hashes: the bytes that they are known by, and their ids."""

    def __init__(self, hash_: np.ndarray, text_at: np.ndarray, text_size: np.ndarray, text: np.ndarray, ids_at: np.ndarray, ids_size: np.ndarray, ids: np.ndarray):
        self.hash, self.text_at, self.text_size, self.text = hash_, text_at, text_size, text
        self.ids_at, self.ids_size, self.ids = ids_at, ids_size, ids
        self.lanes = lanes(text)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.text_at, self.text_size, self.ids_at, self.ids_size, self.ids)) + 2 * len(self.text)

    def with_(self, o: Run) -> Run:
        h = np.concatenate((self.hash, o.hash))
        order = np.argsort(h, kind="stable")
        both = lambda a, b, shift=0: np.concatenate((a, b + shift))[order]
        return Run(h[order], both(self.text_at, o.text_at, np.uint32(len(self.text))), both(self.text_size, o.text_size), np.concatenate((self.text, o.text)), both(self.ids_at, o.ids_at, np.uint32(len(self.ids))), both(self.ids_size, o.ids_size), np.concatenate((self.ids, o.ids)))


class Memo:
    """Runs of pieces, each at least twice as long as the next, so that a piece is moved a few times only."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.runs = most, []

    def find(self, h: np.ndarray, d: np.ndarray, v: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, Run, np.ndarray, np.ndarray]]:
        """(indices of h, run, their places in it, whether the bytes are equal too) of the hashes that are known."""
        for r in self.runs:
            at = np.searchsorted(r.hash, h)
            at[at == len(r.hash)] = 0
            i = np.flatnonzero(r.hash[at] == h)
            if len(i):
                at = at[i]
                yield i, r, at, equal_spans(d, v, start[i], n[i], r.text, r.lanes, r.text_at[at].astype(np.int64), r.text_size[at].astype(np.int64))

    def add(self, run: Run) -> None:
        if len(run.hash):
            self.runs.append(run)
            while len(self.runs) > 1 and len(self.runs[-2].hash) < 2 * len(self.runs[-1].hash):
                last = self.runs.pop()
                self.runs[-1] = self.runs[-1].with_(last)
            if sum(r.nbytes for r in self.runs) > self.most:
                self.runs = []


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of n[i] numbers, one i after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class PieceEncoder:
    """ids of texts, equal to Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False).

    Texts are cut, in their UTF-8 bytes, where the tokenizer's own pattern always cuts: at ASCII white space, and between a
    certain letter and ASCII punctuation (not after an apostrophe, which may begin a contraction). Each distinct piece is
    encoded once by the library and kept in a memo, which finds it by its hash and knows it by its bytes. New words of letters
    go to the library many to a call, and their ids are told apart by the marks that begin or end a word in the vocabulary.
    Texts that hold the string of a special token, and all texts of tokenizers of other kinds, are encoded directly.

    plain_specials: strings of special tokens are ordinary text (the library's encode_special_tokens). threads: those that the
    library uses for a batch.
    """

    def __init__(self, path: str, most: int = MEMO_BYTES, plain_specials: bool = False, threads: int = 1):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self._start(Tokenizer.from_file(path), most, threads)
        self.tok.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t["content"].encode() for t in spec.get("added_tokens", [])]
        # a special token that is looked for in normalised text may be there where its string is not
        ordinary = plain_specials or not any(t["normalized"] for t in spec.get("added_tokens", []))
        pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        self.kind, ending = None, spec["model"].get("end_of_word_suffix")
        if ordinary and '"use_regex": true' in pre and '"add_prefix_space": false' in pre and norm == "null":
            self.kind = "bytes"
        elif ordinary and '"behavior": "Removed"' in pre and "Lowercase" in norm and "NFC" in norm and ending:
            self.kind = "words"
        # plain words in lower case pass the normaliser unchanged, and the pattern cuts them at the spaces alone
        self.usual = self.tok.normalizer, self.tok.pre_tokenizer
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lean = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])) if self.kind == "words" else None
        self.edge = np.zeros(self.vocab_size, bool)
        for t, i in spec["model"]["vocab"].items():
            self.edge[i] = t.endswith(ending) if self.kind == "words" else t.startswith("Ġ")

    def _start(self, tok, most: int, threads: int) -> None:
        self.tok, self.memo, self.threads, self.specials, self.lean = tok, Memo(most), threads, [], None
        self.vocab_size = tok.get_vocab_size(with_added_tokens=True)
        os.environ.setdefault("RAYON_NUM_THREADS", str(max(2, threads)))

    def _batch(self, texts: list[str]) -> list:
        # without threads of its own Spark's tasks are the parallelism
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.threads > 1 else "false"
        return self.tok.encode_batch_fast(texts, add_special_tokens=False)

    # ------------------------------------------------------------ cutting
    def _pieces(self, d: np.ndarray, starts: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pieces of the documents that begin at `starts`, in bytes."""
        n = len(d)
        if self.kind == "spaces":  # before the first space of a run
            begin = d == 32
            begin[1:] &= d[:-1] != 32
            begin[3:] &= ~((d[:-3] == 0xE2) & (d[1:-2] == 0x96) & (d[2:-1] == 0x81))  # nor after the marker itself
            begin[starts[starts < n]] = True
            at = np.flatnonzero(begin)
            return at, np.append(at[1:], n)
        space, punct = _SPACE[d], _PUNCT[d]
        begin = np.zeros(n, bool)
        begin[1:] = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:] & (d[:-1] != 39))
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first = first[:n]
        if self.kind == "words":
            begin[1:] |= space[:-1] & ~space[1:]
            begin |= first
            begin &= ~space
            at = np.flatnonzero(begin)
            stop = space.copy()
            stop |= begin
            stop |= first
            ends = np.flatnonzero(stop[1:]) + 1  # candidates: the next stop after a start
            return at, np.append(ends, n)[np.searchsorted(ends, at, side="right")]
        last = np.zeros(n, bool)  # last of a run of spaces that a word follows in the same document
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        begin[1:] |= (space[1:] & ~space[:-1]) | (~space[1:] & space[:-1] & (d[:-1] != 32))
        # other characters beyond ASCII may be spaces too: no cut beside them
        glue = (d >= 128) & ~letter
        last[:-1] &= ~glue[1:]
        begin |= last
        begin[1:] &= ~(glue[1:] | glue[:-1])
        begin |= first
        at = np.flatnonzero(begin)
        return at, np.append(at[1:], n)

    # ------------------------------------------------------------ new pieces
    def _joined(self, words: list[str], step: int = 1_000) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        parts = [words[i : i + step] for i in range(0, len(words), step)]
        for part, got in zip(parts, self._batch([(" " if self.kind == "words" else "").join(p) for p in parts]), strict=True):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(self.edge[ids]) + (self.kind == "words")
            if len(cut) == len(part) and (cut[-1] == len(ids) if self.kind == "words" else cut[0] == 0):
                bounds = [0, *cut.tolist()] if self.kind == "words" else [*cut.tolist(), len(ids)]
                out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            else:
                out += self._single(part)
        return out

    def _single(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._batch(pieces)]

    def _encode_new(self, pieces: list[str], plain: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        for which, f in ((np.flatnonzero(plain).tolist(), self._joined), (np.flatnonzero(~plain).tolist(), self._single)):
            if which:
                if self.lean and f == self._joined:
                    self.tok.normalizer, self.tok.pre_tokenizer = self.lean
                try:
                    got = f([pieces[i] for i in which])
                finally:
                    if self.lean:
                        self.tok.normalizer, self.tok.pre_tokenizer = self.usual
                for i, x in zip(which, got, strict=True):
                    out[i] = x
        return out

    def _new(self, d: np.ndarray, at: np.ndarray, end: np.ndarray, letter: np.ndarray) -> list[np.ndarray]:
        """ids of pieces, from the library."""
        raw, ok = d.tobytes(), np.concatenate(([0], np.cumsum(letter)))
        head = (d[at] == 32).astype(np.int64) if self.kind != "words" else np.zeros(len(at), np.int64)
        # bytes: without a space before it, a word would run into the one before
        plain = (ok[end] - ok[at] + head == end - at) & ((head == 1) & (end - at > 1) if self.kind != "words" else True)
        if self.kind == "words":  # capitals beyond ASCII go through the normaliser
            caps = np.zeros(len(d), bool)
            caps[1:] = (d[:-1] == 0xC3) & (d[1:] < 0x9F)
            caps = np.concatenate(([0], np.cumsum(caps)))
            plain &= caps[end] == caps[at]
        return self._encode_new([raw[x:y].decode() for x, y in zip(at.tolist(), end.tolist(), strict=True)], plain)

    # ------------------------------------------------------------ whole texts
    def arrays(self, text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of a string column: (first row, ids of all its texts, offsets of each text's ids); null: none."""
        for first, part in text_slices(text):
            yield (first, *self._slice(part))

    def _direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self._single(texts)
        return np.concatenate([*got, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, got)])

    def _slice(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind is None:
            return self._direct([t or "" for t in text.to_pylist()])
        text = text.cast(pa.large_string()).fill_null("")
        n = len(text)
        off = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
        lo, hi = int(off[0]), int(off[-1])
        if lo == hi:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        d, off = np.frombuffer(text.buffers()[2], np.uint8, hi - lo, lo), off - lo
        special = self._with_specials(d, off)
        if self.kind == "words":
            d = d + ((d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(32)
        ids, to = self._pieced(d, off)
        if len(special):  # those texts go to the library as they are
            parts = [ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
            for i, x in zip(special.tolist(), self._single([text[i].as_py() for i in special.tolist()]), strict=True):
                parts[i] = x
            ids, to = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, to

    def _with_specials(self, d: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that may hold the string of a special token."""
        raw, at = d.tobytes() if self.specials else b"", []
        for s in self.specials:
            i = raw.find(s)
            while i >= 0:
                at.append(i)
                i = raw.find(s, i + 1)
        return np.unique(np.searchsorted(off, np.array(at, np.int64), side="right") - 1)

    def _pieced(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter = letters(d)
        at, end = self._pieces(d, off[:-1], letter)
        size, v = end - at, lanes(d)
        h, where, back = np.unique(span_hash(d, at, end, v), return_index=True, return_inverse=True)
        # pieces whose hash is that of another piece, in this slice or in the memo, are encoded apart
        odd = ~equal_spans(d, v, at, size, d, v, at[where][back], size[where][back])
        parts, base = [], 0
        start, count, known = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        clash = np.zeros(len(h), bool)
        for i, run, j, same in self.memo.find(h, d, v, at[where], size[where]):
            known[i] = True
            clash[i] |= ~same
            start[i], count[i] = run.ids_at[j] + np.int64(base), run.ids_size[j]
            parts.append(run.ids)
            base += len(run.ids)
        new = np.flatnonzero(~known)
        if len(new):
            a, b = at[where[new]], end[where[new]]
            got = self._new(d, a, b, letter)
            count[new] = [len(x) for x in got]
            start[new] = base + np.cumsum(count[new]) - count[new]
            parts.append(np.concatenate(got))
            base += int(count[new].sum())
            keep = np.flatnonzero(b - a <= MEMO_PIECE)
            n = (b - a)[keep]
            ids = [got[k] for k in keep.tolist()]
            many = np.array([len(x) for x in ids], np.int64)
            self.memo.add(Run(h[new[keep]], (np.cumsum(n) - n).astype(np.uint32), n.astype(np.uint16), d[spread(a[keep], n)], (np.cumsum(many) - many).astype(np.uint32), many.astype(np.uint16), np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint16 if self.vocab_size <= 1 << 16 else np.uint32)))
        start, count = start[back], count[back]
        odd |= clash[back]
        if odd.any():
            i = np.flatnonzero(odd)
            got = self._new(d, at[i], end[i], letter)
            count[i] = [len(x) for x in got]
            start[i] = base + np.cumsum(count[i]) - count[i]
            parts.append(np.concatenate(got))
        # the ids of each part are read where they lie, so that none is copied whole
        bounds = np.cumsum([0, *map(len, parts)])
        to = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(to[-1], np.uint32)
        for k, part in enumerate(parts):
            i = np.flatnonzero((start >= bounds[k]) & (start < bounds[k + 1]) & (count > 0))
            out[spread(to[i], count[i])] = part[spread(start[i] - bounds[k], count[i])]
        return out, to[np.searchsorted(at, off)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes; null: none."""
        out: list[bytes] = []
        for _, ids, off in self.arrays(pa.array(texts, pa.string())):
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


@cache
def vocabulary(path: str) -> int:
    """How many ids a tokenizer file has, its special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
