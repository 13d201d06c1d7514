"""Operator 2: SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf; its normaliser, metaspace marker, pieces with their scores (unigram scores, or the merge
order that BPE scores stand for) and byte fallback are rebuilt as a tokenizer. Where no piece has a marker inside, texts are
cut before the spaces and each distinct piece is encoded once; new pieces go to the library in batches that its threads share. All
ids are held against those of the SentencePiece library.

Defined results: null and empty texts have no ids and decode to the empty text; a null key stays null; repeated rows are encoded
each; of pieces with equal scores the library's choice counts; an empty table gives none; other columns, whatever their names,
are not carried. Texts that hold characters outside the vocabulary fall back to bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import MEMO_BYTES, PieceEncoder

MARK = "▁"
#: Kinds of pieces, and of models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return out, i


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> Model:
        out = cls()
        for number, v in fields(open(path, "rb").read()):
            if number == 1:
                f = dict(fields(v))
                out.pieces.append(f[1].decode())
                out.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                out.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(fields(v))
                out.model_type, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(fields(v))
                out.charsmap, out.dummy_prefix = f.get(2, b""), bool(f.get(3, 1))
                out.remove_extra, out.escape = bool(f.get(4, 1)), bool(f.get(5, 1))
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, the best score first."""
        known = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        out = []
        for p, i in known.items():
            for c in range(1, len(p)):
                if p[:c] in known and p[c:] in known:
                    out.append((-self.scores[i], known[p[:c]], known[p[c:]], p[:c], p[c:]))
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self, prefix: bool | None = None):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), None)
        if self.model_type == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            tok = Tokenizer(models.BPE(vocab, self.merges(), unk_token=None if unknown is None else self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            tok = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unknown, self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix if prefix is None else prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        tok.normalizer = normalizers.Sequence(steps)
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return tok

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        return [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


class SentenceEncoder(PieceEncoder):
    """ids as the SentencePiece library gives them, on the tokenizers library."""

    def __init__(self, path: str, most: int = MEMO_BYTES, threads: int = 2):
        self.model = m = Model.read(path)
        inside = any(MARK in p[1:] and set(p) != {MARK} for p in m.pieces)
        # cut texts start with the prefix already
        self.kind = "spaces" if m.model_type == BPE and not inside and not m.charsmap and not m.remove_extra and m.escape else None
        self._start(m.tokenizer(prefix=False if self.kind else None), most, threads)
        self.vocab_size = len(m.pieces)
        self.edge = np.array([p.startswith(MARK) for p in m.pieces])
        self.table = m.bytes_of()

    def arrays(self, text: pa.Array):
        if self.kind and self.model.dummy_prefix:
            text = text.fill_null("")
            text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(" ", text, ""))
        return super().arrays(text)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_LOADED: dict[str, SentenceEncoder] = {}


def sentence_encoder(path: str) -> SentenceEncoder:
    if path not in _LOADED:
        _LOADED[path] = SentenceEncoder(path)
    return _LOADED[path]


_LIBRARY: dict[str, object] = {}


def parity(path: str, texts: list[str], ids: list[np.ndarray], threads: int) -> list[bool]:
    """Are the ids those of the SentencePiece library?"""
    if path not in _LIBRARY:
        import sentencepiece

        _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [np.array_equal(x, np.array(y, np.uint32)) for x, y in zip(ids, _LIBRARY[path].encode(texts, num_threads=threads), strict=True)]


def sentencepiece_ids(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, threads: int = 2) -> DataFrame:
    """key, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text back), parity (the ids are
    those of the SentencePiece library, which reads each text too), and the ids if asked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sentence_encoder(model)
        for b in it:
            keys, texts = b.column("key"), b.column("text")
            for first, ids, off in enc.arrays(texts):
                own = [ids[a:z] for a, z in zip(off[:-1], off[1:], strict=True)]
                read = [t or "" for t in texts.slice(first, len(own)).to_pylist()]
                same = [enc.decode(x) == t for x, t in zip(own, read, strict=True)]
                cols = {"key": keys.slice(first, len(own)), "n_tokens": pa.array(np.diff(off), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), "round_trip": pa.array(same), "parity": pa.array(parity(model, read, own, threads))}
                if with_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                yield pa.record_batch(cols)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)
