"""Nucleotide sequences: column expressions that stay in the JVM's generated code, and k-mers as strings or as two-bit codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nucleotide codes and their complements, in both cases.
CODES = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
# Two-bit digits of the bases.
BASES, DIGITS = "AGCT", "0123"


def revcomp(seq: Column) -> Column:
    """Reverse complement, with ambiguity codes and case kept."""
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


#: Letters of a slice. A substring is found by walking from the start, so k-mers are taken within short slices.
SLICE = 128


def slices(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows (first, part): pieces of seq whose k-mers, all pieces together, are those of seq; first is the place before a piece.

    One pass of a pattern cuts the sequence, and each piece takes the k - 1 letters that follow it: time is linear in the length.
    """
    size, rest = max(SLICE, k), [c for c in df.columns if c != seq]
    x = df.where(F.length(seq) >= k).select(*rest, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_p"))
    joined = F.transform("_p", lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(F.col("_p"), i + 1), 1, k - 1), F.lit(""))))
    x = x.select(*rest, F.posexplode(joined).alias("_i", "part"))
    return x.where(F.length("part") >= k).select(*rest, (F.col("_i").cast("long") * size).alias("first"), "part")


def kmers(df: DataFrame, k: int, seq: str = "seq", drop_last: bool = False, strand: str = "given") -> DataFrame:
    """A row (pos, kmer) for every position of seq (P2); drop_last leaves out the last one (P3). Shorter sequences have none.

    strand: given, both (a row more for each reverse complement, P4) or canonical (the smaller of the two, P5)."""
    rest = [c for c in df.columns if c != seq]
    if drop_last:
        df = df.withColumn(seq, F.substring(F.col(seq), F.lit(1), F.length(seq) - 1))
    x = slices(df, k, seq)
    n = F.length("part") - (k - 1)
    own = F.substring(F.col("part"), F.col("_j"), F.lit(k))
    if strand != "given":  # a slice is turned round once, and its k-mers are read from the other end
        x = x.withColumn("_back", revcomp(F.col("part")))
    x = x.select(*x.columns, F.explode(F.sequence(F.lit(1), n)).alias("_j"), n.alias("_n"))
    if strand != "given":
        other = F.substring(F.col("_back"), F.col("_n") + 1 - F.col("_j"), F.lit(k))
        own = F.least(own, other) if strand == "canonical" else F.explode(F.array(own, other))
    return x.select(*rest, (F.col("first") + F.col("_j")).alias("pos"), own.alias("kmer"))


#: Letters of a minimizer.
MINIMIZER = 11
#: Two-bit digits by byte (4: no base), and the largest k that fits a long.
_DIGIT = np.full(256, 4, np.uint8)
_DIGIT[np.frombuffer(BASES.encode(), np.uint8)] = _DIGIT[np.frombuffer(BASES.lower().encode(), np.uint8)] = range(4)
MOST_K = 31


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """x[i], ..., x[i + k - 1] as one number, for every i, by doubling."""
    n = len(x) - k + 1
    out, have, width = np.zeros(n, np.uint64), 0, 1
    power = x.astype(np.uint64)  # codes of `width` digits from each place
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            out = (out << np.uint64(2 * width)) | power[have : have + n]
            have += width
        if k >> bit + 1:
            power = (power[: len(power) - width] << np.uint64(2 * width)) | power[width:]
        width *= 2
    return out


def _clean(d: np.ndarray, k: int) -> np.ndarray:
    """Which k-mers are all ACGT."""
    bad = np.concatenate(([0], np.cumsum(d == 4)))
    return bad[k:] == bad[:-k]


def codes_of(text: bytes, k: int, strand: str = "given") -> np.ndarray:
    """Two-bit codes (`encode`) of the k-mers of text that are all ACGT; canonical is the one whose letters sort first."""
    d = _DIGIT[np.frombuffer(text, np.uint8)]
    if len(d) < k:
        return np.zeros(0, np.int64)
    good = np.flatnonzero(_clean(d, k))
    own = _windows(d & 3, k)
    if strand != "given":
        # digits A 0, G 1, C 2, T 3: the complement of x is 3 - x. Letters sort as A, C, G, T
        other = _windows((3 - (d & 3))[::-1], k)[::-1]
        if strand == "both":
            return np.concatenate((own[good], other[good])).astype(np.int64)
        swap = np.array([0, 2, 1, 3], np.uint8)
        first, second = _windows(swap[d & 3], k), _windows(swap[3 - (d & 3)][::-1], k)[::-1]
        own = np.where(first <= second, own, other)
    return own[good].astype(np.int64)


#: K-mers that a task holds at once, besides those of one sequence.
AT_ONCE = 1 << 18


def kmer_codes(df: DataFrame, k: int, seq: str = "seq", drop_last: bool = False, strand: str = "given", keep: Callable[[np.ndarray], np.ndarray] | None = None, back: bool = False) -> DataFrame:
    """A row (kmer) for every ACGT k-mer of seq, as a long (`encode`): eight bytes to shuffle in place of k. k up to 31.
    keep: which codes go on (a mask), asked before any leaves the task. back: one more column, whether the code decodes to the letters
    of its place (given strand, without keep).

    Codes of a whole sequence are computed at once, in time linear in its length, and leave it in bounded batches."""
    if k > MOST_K:
        raise ValueError(f"k-mers of more than {MOST_K} letters don't fit a long")
    rest = [c for c in df.columns if c != seq]
    fields = [f for f in df.schema.fields if f.name != seq]

    def returned(t: bytes, codes: np.ndarray) -> np.ndarray:
        d = np.frombuffer(t.upper(), np.uint8)
        if len(d) < k:
            return np.zeros(0, bool)
        seen = np.lib.stride_tricks.sliding_window_view(d, k)[_clean(_DIGIT[d], k)]
        return np.concatenate([(decoded(codes[i : i + 4096], k) == seen[i : i + 4096]).all(1) for i in range(0, max(1, len(codes)), 4096)])

    def packed(b: pa.RecordBatch, first: int, got: list[np.ndarray], same: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, row = np.concatenate(got), np.repeat(np.arange(first, first + len(got)), [len(x) for x in got])
        good = np.concatenate(same) if back else None
        for i in range(0, len(codes), AT_ONCE):
            part = pa.array(row[i : i + AT_ONCE])
            more = [pa.array(good[i : i + AT_ONCE])] if back else []
            yield pa.record_batch([*(b.column(c).take(part) for c in rest), pa.array(codes[i : i + AT_ONCE]), *more], names=[*rest, "kmer", *(["back"] if back else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got, same, held, first = [], [], 0, 0
            for j, t in enumerate(b.column(seq)):
                t = (t.as_py() or "").encode("latin-1", "replace")
                codes = codes_of(t[:-1] if drop_last else t, k, strand)
                got.append(codes[keep(codes)] if keep else codes)
                if back:
                    same.append(returned(t[:-1] if drop_last else t, codes))
                held += len(got[-1])
                if held >= AT_ONCE or j == b.num_rows - 1:  # not all of a batch: it has any number of k-mers
                    yield from packed(b, first, got, same)
                    got, same, held, first = [], [], 0, j + 1

    more = [T.StructField("back", T.BooleanType())] if back else []
    return df.select(*rest, F.col(seq)).mapInArrow(run, T.StructType([*fields, T.StructField("kmer", T.LongType()), *more]))


def runs_of(text: bytes, k: int, strand: str = "given") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, letters, group): runs of neighbouring ACGT k-mers with the same minimizer, the m-mer with the least hash in a k-mer.

    Equal k-mers have equal minimizers, those of both strands too unless strand is given; so a group has all places of its k-mers."""
    d, m = _DIGIT[np.frombuffer(text, np.uint8)], min(MINIMIZER, (k + 1) // 2)
    if len(d) < k:
        return (np.zeros(0, np.int64),) * 3
    h = _windows(d & 3, m)
    if strand != "given":
        h = np.minimum(h, _windows((3 - (d & 3))[::-1], m)[::-1])
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    least, width, need = h, 1, k - m + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(d) - k + 1
    least = np.minimum(least[:n], least[need - width : need - width + n])
    good = _clean(d, k)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (good[1:] != good[:-1])))
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    keep = good[start]
    return start[keep], (end - start + k - 1)[keep], (least[start][keep] >> np.uint64(20)).astype(np.int64)


def packed(letters: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parts of ACGT (their letters, and how many each has) as binary: four letters a byte, and a last byte that tells how many letters
    of the byte before count."""
    many, ends = (size + 3) // 4, np.cumsum(size)
    wide = np.zeros(4 * many.sum(), np.uint8)
    wide[np.arange(len(letters)) + np.repeat(4 * (np.cumsum(many) - many) - (ends - size), size)] = _DIGIT[letters]
    out, after = np.zeros(many.sum() + len(size), np.uint8), np.cumsum(many + 1)
    out[np.arange(many.sum()) + np.repeat(np.arange(len(size)), many)] = wide.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    out[after - 1] = (size - 1) % 4 + 1
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, after).astype(np.int32)), pa.py_buffer(out)])


def unpacked(parts: pa.Array) -> tuple[bytes, np.ndarray]:
    """(letters, how many each part has) of `packed` parts."""
    many = np.array(pa.compute.binary_length(parts), np.int64)
    flat = np.frombuffer(b"".join(parts.to_pylist()), np.uint8)
    after = np.cumsum(many)
    size = 4 * (many - 2) + flat[after - 1] if len(many) else many
    data = np.ones(len(flat), bool)
    data[after - 1] = False
    letters = np.frombuffer(BASES.encode(), np.uint8)[(flat[data][:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].ravel()
    wide = 4 * (many - 1)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(wide) - wide, wide)
    return letters[place < np.repeat(size, wide)].tobytes(), size


def kmer_runs(df: DataFrame, k: int, buckets: int, seq: str = "seq", strand: str = "given", pack: bool = False) -> DataFrame:
    """A row (bucket, part) for every run of neighbouring k-mers of seq with one minimizer: what is to be known of all places of a k-mer
    takes a shuffle of these, about four letters a k-mer, in place of k-mers. pack: parts are `packed`."""
    rest = [c for c in df.columns if c != seq]
    fields = [f for f in df.schema.fields if f.name != seq]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                texts = [(t or "").encode("latin-1", "replace") for t in some.column(seq).to_pylist()]
                got = [runs_of(t, k, strand) for t in texts]
                before = np.cumsum([0, *map(len, texts)])
                row = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
                start = np.concatenate([x[0] + o for x, o in zip(got, before)])
                size, group = (np.concatenate([x[j] for x in got]) for j in (1, 2))
                ends = np.cumsum(size)
                letters = np.frombuffer(b"".join(texts), np.uint8)[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
                part = packed(letters, size) if pack else pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(letters))
                yield pa.record_batch([*(some.column(c).take(pa.array(row)) for c in rest), pa.array((group % buckets).astype(np.int32)), part], names=[*rest, "bucket", "part"])

    return df.select(*rest, F.col(seq)).mapInArrow(run, T.StructType([*fields, T.StructField("bucket", T.IntegerType()), T.StructField("part", T.BinaryType() if pack else T.StringType())]))


def codes_of_parts(parts: pa.Array, k: int, strand: str = "given") -> tuple[np.ndarray, np.ndarray]:
    """(codes of the k-mers of all parts, the part of each), of `packed` parts, which are all ACGT."""
    joined, size = unpacked(parts)
    place = np.arange(len(joined) - k + 1) if len(joined) >= k else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)[: len(place)]
    inside = place + k <= ends[of] if len(place) else np.zeros(0, bool)
    return codes_of(joined, k, strand)[inside], of[inside]


def both_strands(df: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Each k-mer and its reverse complement."""
    return df.withColumn(kmer, F.explode(F.array(F.col(kmer), revcomp(F.col(kmer)))))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement (P5)."""
    return F.least(kmer, revcomp(kmer))


def encode(kmer: Column) -> Column:
    """Two bits a base, for k up to 31."""
    return F.conv(F.translate(kmer, BASES, DIGITS), 4, 10).cast("long")


def lettered(code: Column) -> Column:
    """A code of k-mers up to 31 as a number that sorts as the letters do, and back: G and C change places."""
    odd = F.lit(0x1555555555555555)
    return F.shiftleft(code.bitwiseAND(odd), 1).bitwiseOR(F.shiftright(code, 1).bitwiseAND(odd))


def decoded(codes: np.ndarray, k: int) -> np.ndarray:
    """Letters of codes, a row of k bytes each."""
    at = np.arange(2 * (k - 1), -1, -2)
    return np.frombuffer(BASES.encode(), np.uint8)[(codes[:, None] >> at) & 3]


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), DIGITS, BASES)


def block_sequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """seq from start (0-based) to end (exclusive), turned round on the minus strand."""
    part = F.substring(seq, start + F.lit(1), end - start)
    return F.when(strand == "-", revcomp(part)).otherwise(part)


def connect(df: DataFrame, by: str, order: str, seq: str = "seq", gap: int = 100) -> DataFrame:
    """One sequence for each `by`: its contigs in order with `gap` N between them."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(seq))))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda s: s[seq]), "N" * gap).alias(seq))


def strip_n(seq: Column) -> Column:
    """P15."""
    return F.regexp_replace(seq, "N", "")


def snp_kmer(row: Column, index: Column, k: int) -> Column:
    """k-mer round column `index` (0-based) of a gapped row (P14): gaps are skipped, an N ends a side, and where one side is
    short the other is longer. Null if there is no base at the column or the row has fewer than k."""
    half = (k - 1) // 2
    left = F.substring_index(F.regexp_replace(F.substring(row, F.lit(1), index), "-", ""), "N", -1)
    right = F.substring_index(F.regexp_replace(F.substring(row, index + F.lit(2), F.length(row)), "-", ""), "N", 1)
    n_left = F.least(F.length(left), half + F.greatest(F.lit(0), half - F.length(right)))
    n_right = F.lit(k - 1) - n_left
    mid = F.substring(row, index + F.lit(1), F.lit(1))
    out = F.concat(F.substring(left, F.length(left) - n_left + 1, n_left), mid, F.substring(right, F.lit(1), n_right))
    return F.when(~mid.isin("-", "N") & (F.length(out) == k), out)


def snp_kmers(df: DataFrame, k: int, row: str = "row") -> DataFrame:
    """A row (column, kmer) for every column of `row` without gap or N: what `snp_kmer` gives there.

    No side of a k-mer is longer than k - 1 bases, so each column reads that much of the row without its gaps, not all of it."""
    rest, at = [c for c in df.columns if c != row], F.greatest(F.col("pos") - F.lit(k - 1), F.lit(0))
    letters = F.split(F.col(row), "")
    bases = F.filter(F.sequence(F.lit(0), F.length(row) - 1), lambda c: F.get(F.col("letters"), c) != "-")
    x = df.where(F.length(row) > 0).select(*rest, F.replace(F.col(row), F.lit("-"), F.lit("")).alias("bases"), letters.alias("letters"), row)
    x = x.select(*rest, "bases", F.posexplode(bases).alias("pos", "column"))
    x = x.select(*rest, "column", F.substring(F.col("bases"), at + 1, F.lit(2 * k - 1)).alias("near"), (F.col("pos") - at).alias("mid"))
    return x.where(F.substring(F.col("near"), F.col("mid") + 1, F.lit(1)) != "N").select(*rest, "column", snp_kmer(F.col("near"), F.col("mid"), k).alias("kmer"))


def snp_codes_of(row: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, is_there) for every column of row without gap or N: the code of what `snp_kmer` gives there, if anything. Letters ACGT, N, -."""
    d = np.frombuffer(row, np.uint8)
    d = d[d != ord("-")]
    n, base = d == ord("N"), _DIGIT[d]
    if ((base == 4) & ~n).any():
        raise ValueError("a row of other letters than ACGT, N and -")
    place, half = np.arange(len(d)), (k - 1) // 2
    left = place - 1 - np.maximum.accumulate(np.where(n, place, -1))
    right = np.minimum.accumulate(np.where(n, place, len(d))[::-1])[::-1] - place - 1
    at = np.flatnonzero(~n)
    left, right = left[at], right[at]
    n_left = np.minimum(left, half + np.maximum(0, half - right))
    there = right >= k - 1 - n_left
    code = np.zeros(len(at), np.int64)
    if there.any():
        code[there] = _windows(base & 3, k).astype(np.int64)[(at - n_left)[there]]
    return code, there


def snp_codes(df: DataFrame, k: int, row: str = "row") -> DataFrame:
    """A row (kmer) for every column of `row` without gap or N: the code of `snp_kmers`' k-mer there, or null (P14). k odd and up to 31;
    rows of ACGT, N and gaps. Time is linear in the length of a row."""
    rest = [c for c in df.columns if c != row]
    fields = [f for f in df.schema.fields if f.name != row]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 64):
                some = b.slice(i, 64)
                got = [snp_codes_of((t or "").encode("latin-1", "replace"), k) for t in some.column(row).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]))
                code, there = (np.concatenate([x[j] for x in got]) for j in (0, 1))
                yield pa.record_batch([*(some.column(c).take(of) for c in rest), pa.array(code, mask=~there)], names=[*rest, "kmer"])

    return df.select(*rest, F.col(row)).mapInArrow(run, T.StructType([*fields, T.StructField("kmer", T.LongType())]))


def only_acgt(kmer: Column) -> Column:
    """F2; its negation is F3."""
    return kmer.rlike("^[ACGT]+$")


def no_n(kmer: Column) -> Column:
    """F1."""
    return ~kmer.contains("N")


def has_extension(name: Column, *extensions: str) -> Column:
    """F5."""
    return name.rlike(r"\.(" + "|".join(extensions) + ")$")
