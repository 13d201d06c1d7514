"""Operators against brute force, on small tables that hold nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqlake.llm import chroma, fingerprints, katz, near_dup, packing, pii, quality, repeats, tokens
from seqlake.llm import sentencepiece_ids as spi
from seqlake.llm import token_binary as tb
from seqlake.llm.common import Words, equal_spans, lanes, span_hash, window_hash

from . import brute

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key string, bucket int, part string, n long, score double"


def vocabulary(rng, n=300):
    return ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def table():
    """Texts with every hard case; ids are not in order."""
    rng = random.Random(3)
    v = vocabulary(rng)
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    base, passage = line(220), line(60)
    near = base.split()
    near[7], near[150] = "ZZ", "yy"
    texts = [None, "", " \n\t", "one", "Two words", base, base, " ".join(near), base.upper(), line(90) + "\n" + passage + " " + line(40), passage + "  " + line(50), line(5) + " " + passage]
    texts += ["la " * 120, "la la la", "x" * 5000, line(12_000), "Él está aquí, señor. ¿Qué tal? – naïve ﬁn   end", "mail a.b@c.org or +1 (312) 555-3490, ip 10.0.0.255", "it's  what we've\n\ngot!!"]
    texts += [line(rng.randint(1, 80)) for _ in range(25)]
    texts += [texts[5], texts[9]]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "p", 2, 0.5) for i, t in rows], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- words
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t., ́", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()), lower=True)
    raw = w.bytes.tobytes()
    got = [[raw[w.start[i] : w.end[i]].decode() for i in range(f, f + n)] for f, n in zip(w.first, w.count, strict=True)]
    assert got == [brute.words(t, True) for t in texts]
    names = {x: h for x, h in zip((y for g in got for y in g), w.hash.tolist(), strict=True)}
    assert len(set(names.values())) == len(names)


def test_window_hashes_are_equal_for_equal_windows():
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    x = window_hash(h, 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 4 and not len(window_hash(h, 8))


# ---------------------------------------------------------------- 1, 2
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_piece_encoder_gives_the_librarys_ids(path, table):
    enc = tokens.PieceEncoder(path, most=50)
    rng = random.Random(1)
    letters = list("abcéÉ ,.'!s1 \n\t") + [" ", "́", "€", "×", "Σ", "　", "<|endoftext|>", "İ"]
    texts = [t for _, t in table] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]


def test_token_shards_read_back(spark, table, tmp_path):
    docs = frame(spark, table)
    folder = f"file://{tmp_path}/t"
    manifest, dictionary = tb.write_tokens(docs, folder, WORD, 1)
    got = by_id(tb.read_tokens(manifest, dictionary, "doc_id", digest=True))
    whole = by_id(tb.read_tokens(manifest, dictionary), "key")
    enc, start = Tokenizer.from_file(WORD), 0
    for i, t in sorted(table):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert whole[i].ids == ids.tobytes() and whole[i].start == start
        start += len(ids)
    shard = tb.ShardReader(manifest.orderBy("shard").first().path, dictionary)
    first = sorted(table)[0][1]
    assert shard.ids(0).tolist() == [*enc.encode(first or "", add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        tb.ShardReader(manifest.first().path, dictionary + b"x")


def test_token_shards_of_nothing_repeats_and_null_keys(spark, tmp_path):
    assert tb.token_binary(frame(spark, []), WORD, 1).count() == 0
    rows = [(1, "b c"), (1, "b c"), (None, "a"), (2, None)]
    got = tb.token_binary(frame(spark, rows), WORD, 1).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2] and got[3].n_tokens == 1


def test_shared_dictionary_is_used(tmp_path):
    samples = [np.array([5, 6, 7, i % 9] * 30, "<u2").tobytes() for i in range(200)]
    d = zstandard.train_dictionary(2048, samples)
    assert len(zstandard.ZstdCompressor(dict_data=d).compress(samples[0])) < len(samples[0])


def test_sentencepiece_parity(spark, table):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    enc = spi.SentenceEncoder(PIECE)
    texts = [t or "" for _, t in table] + ["a ▁b", "<s> <0x0A>", "漢字 😀", "  two  spaces "]
    want = sp.encode(texts)
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == want
    assert [enc.decode(np.array(g, int)) for g in got] == sp.decode(want)
    assert [enc.model.tokenizer().encode(t, add_special_tokens=False).ids for t in texts[:20]] == want[:20]
    rows = by_id(spi.sentencepiece_ids(frame(spark, table), PIECE))
    assert all(rows[i].n_tokens == len(sp.encode(t or "")) and rows[i].round_trip for i, t in table)


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, value):
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path):
    """A model file of the unigram kind, written field by field: pieces with scores, byte fallback, no normalisation map."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁cab", "é", "▁the", "the", "t", "h", "e", "he"]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    out += field(3, field(1, b"identity") + field(2, b"") + field(3, 1) + field(4, 1) + field(5, 1))
    path.write_bytes(out)
    return str(path)


def test_unigram_models_have_the_librarys_ids(spark, tmp_path, table):
    import sentencepiece

    path = unigram_model(tmp_path / "u.model")
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=path), spi.SentenceEncoder(path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc thé😀") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "abcab the cab", "x  y", " a "]
    want = sp.encode(texts)
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == want and [enc.decode(np.array(g, int)) for g in got] == sp.decode(want)
    rows = by_id(spi.sentencepiece_ids(frame(spark, list(enumerate(texts))), path))
    assert all(rows[i].n_tokens == len(x) and rows[i].parity for i, x in enumerate(want))


def test_sentencepiece_of_nothing_nulls_and_clashing_names(spark):
    assert spi.sentencepiece_ids(frame(spark, []), PIECE).count() == 0
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, n_tokens int")
    got = spi.sentencepiece_ids(docs, PIECE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.parity) for r in got) == [(0, 2, True), (1, 0, True), (1, 0, True)]


# ---------------------------------------------------------------- 3
def test_quality_separates_and_handles_odd_rows(spark, table):
    rng = random.Random(5)
    v = vocabulary(rng)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        rows.append((i, " ".join(w + ("" if good else "***") for w in rng.choices(v, k=30))))
        labels.append((i, int(good)))
    docs = frame(spark, rows + [(1000 + i, t) for i, t in table])
    lab = spark.createDataFrame(labels + [(0, labels[0][1]), (5, None)], "doc_id long, quality int")
    out = by_id(quality.classify(docs, lab))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(rows) + len(table)


def test_quality_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(frame(spark, [(1, "a b")]), lab).collect()] == [0.5]


# ---------------------------------------------------------------- 4
def slow_winnow(text, k, w):
    c = fingerprints.code_points(text)
    h = fingerprints.gram_hashes(c, k).tolist()
    w = min(w, len(h))
    return sorted({max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)}) if h else []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé", max_size=60), st.integers(1, 5), st.integers(1, 8))
def test_winnowing_keeps_the_rightmost_minimum(text, k, w):
    pos, h = fingerprints.winnow(fingerprints.code_points(text), k, w)
    assert pos.tolist() == slow_winnow(text, k, w)
    assert h.tolist() == fingerprints.gram_hashes(fingerprints.code_points(text), k)[pos].tolist()


def test_winnowing_guarantee():
    rng = random.Random(2)
    a, b, shared = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (300, 300, fingerprints.K + fingerprints.W - 1))
    x = fingerprints.winnow(fingerprints.code_points(a + shared))[1]
    y = fingerprints.winnow(fingerprints.code_points(shared + b))[1]
    assert len(np.intersect1d(x, y))


def test_fingerprint_edits(spark, table):
    out = by_id(fingerprints.fingerprint_edits(frame(spark, table)))
    order = sorted(((i, t or "") for i, t in table), reverse=True)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == e) or t != e
        a, b, c = (np.unique(fingerprints.winnow(fingerprints.code_points(x))[1]) for x in (t, e, u))
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)


def test_fingerprint_edits_of_few_rows(spark):
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    (r,) = fingerprints.fingerprint_edits(frame(spark, [(4, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    assert fingerprints.fingerprint_edits(frame(spark, [(1, "a"), (1, "a"), (None, "b"), (1, "c")])).count() == 4


# ---------------------------------------------------------------- 5
def test_katz_equals_brute_force_and_sums_to_one(spark, table):
    docs = [(i, t) for i, t in table] + [(1000 + i, "the cat sat on the mat " * (i % 4) + f"w{i % 7} v{i % 3}") for i in range(60)]
    out = by_id(katz.lm_scores(frame(spark, docs)))
    x = [(i, [*brute.words(t, True), "\n"], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs]
    uni, two = Counter(), Counter()
    for _, w, held in x:
        if not held:
            uni.update(w), two.update(zip(["\t", *w], w, strict=False))
    n, v, top = sum(uni.values()), len(uni), katz.K
    of = lambda c: np.array([sum(y == r for y in c.values()) for r in range(1, top + 2)])
    du, dt = katz.discounts(of(uni)), katz.discounts(of(two))
    pu = {w: (du[c] if c <= top else 1) * c / n for w, c in uni.items()}
    unknown = 1 - sum(pu.values())
    ctx = defaultdict(dict)
    for (a, b), c in two.items():
        ctx[a][b] = c

    def p(a, b):
        if a not in ctx:
            return pu.get(b, unknown)
        f = ctx[a]
        free = sum((1 - dt[c]) * c for c in f.values() if c <= top)
        size = sum(f.values()) + (free <= 0)
        if b in f:
            return (dt[f[b]] if f[b] <= top else 1) * f[b] / size
        return (free if free > 0 else 1) / size / (1 - sum(pu[w] for w in f)) * pu.get(b, unknown)

    for i, w, held in x:
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(w), sum(y in uni for y in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[y] + 1) / (n + v + 1)) for y in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["\t", *w], w, strict=False)), rel_tol=1e-9)
    for a in [*list(ctx)[:30], "never"]:
        assert math.isclose(sum(p(a, b) for b in uni) + p(a, "\0"), 1, rel_tol=1e-9)


def test_katz_of_nothing(spark):
    assert katz.lm_scores(frame(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = katz.lm_scores(frame(spark, [(held, None)])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (1, 0, 0, 0.0)


# ---------------------------------------------------------------- 6
def test_chroma_aligns_shifted_and_noisy_recordings():
    rng = np.random.default_rng(1)
    a = chroma.render(rng.standard_normal(64) / 8)
    b = chroma.render(rng.standard_normal(64) / 8)
    fa = chroma.fingerprint(a)
    off, n, err = chroma.align(chroma.fingerprint(a[10 * chroma.HOP :] + 0.01 * rng.standard_normal(len(a) - 10 * chroma.HOP)), fa)
    assert off == 10 and n > 90 and err < 0.05
    m = chroma.align(chroma.fingerprint(b), fa)
    assert m is None or m[2] > chroma.MOST_ERROR
    assert not len(chroma.fingerprint(np.zeros(10))) and not chroma.chroma(np.zeros(5000)).any()


def test_chroma_search_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = [rng.standard_normal(64) / 8 for _ in range(6)]
    rows = [(i, (base[i % 6] if i < 12 else rng.standard_normal(64) / 8).tolist()) for i in range(20)] + [(20, None), (21, []), (None, [0.1] * 64)]
    media = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.match_id): r for r in chroma.matches(chroma.fingerprints(media, "vec_id", "embedding", chroma.render), lambda k: k % 5 == 0).collect()}
    prints = {}
    for i, x in rows:
        f = chroma.fingerprint(chroma.render(np.array(x))) if x and i is not None else np.zeros(0, np.uint32)
        if len(f):
            prints.setdefault(f.tobytes(), []).append(i)
    want = set()
    for fa, ia in prints.items():
        for fb, ib in prints.items():
            a, b = np.frombuffer(fa, np.uint32), np.frombuffer(fb, np.uint32)
            m = chroma.align(a, b)
            common = len(set((a >> chroma.KEY_SHIFT).tolist()) & set((b >> chroma.KEY_SHIFT).tolist()))
            if any(i % 5 == 0 for i in ia) and common >= chroma.LEAST_SHARED and m and m[1] >= chroma.LEAST_OVERLAP and m[2] <= chroma.MOST_ERROR:
                want.add((min(ia), min(ib)))
    assert set(got) == want and got[0, 0].copies == 2 and got[0, 0].bit_error == 0


def test_chroma_block_equals_align_of_every_pair(monkeypatch):
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 6, n).astype(np.uint32) << chroma.KEY_SHIFT | rng.integers(0, 8, n).astype(np.uint32)
    prints = [draw(n) for n in (1, 5, 15, 16, 17, 40, 90, 90)] + [np.full(60, 77, np.uint32)]
    prints += [prints[6][20:], np.concatenate((draw(9), prints[6]))]
    for piece in (chroma.PIECE, 300, 1):
        monkeypatch.setattr(chroma, "PIECE", piece)
        block = chroma.Block(prints)
        for x in prints:
            got = sorted(block.align(x))
            pairs = [(j, chroma.align(q, x)) for j, q in enumerate(prints)]
            assert got == [(j, *m) for j, m in pairs if m and m[1] >= min(chroma.LEAST_OVERLAP, len(x)) and m[2] <= chroma.MOST_ERROR]


def noisy(f, error, rng):
    bits = (rng.random((len(f), 32)) < error) @ (1 << np.arange(32, dtype=np.uint64))
    return f ^ bits.astype(np.uint32)


def judged_by_bits(a, b):
    """Whether some offset has enough overlap and few enough differing bits; votes are not asked."""
    for off in range(1 - len(a), len(b)):
        x, y = (a[: len(b) - off], b[off:]) if off >= 0 else (a[-off:], b)
        n = min(len(x), len(y))
        if n >= min(chroma.LEAST_OVERLAP, len(b)) and np.bitwise_count(x[:n] ^ y[:n]).sum() <= chroma.MOST_ERROR * 32 * n:
            return True
    return False


def test_chroma_recall_of_noisy_copies(spark):
    rng = np.random.default_rng(9)
    base = [chroma.fingerprint(chroma.render(rng.standard_normal(64) / 8)) for _ in range(40)]
    few = 0
    for error, least in ((0.05, 1.0), (0.1, 1.0), (0.15, 0.9)):
        prints = [(2 * i, f) for i, f in enumerate(base)] + [(2 * i + 1, noisy(f, error, rng)) for i, f in enumerate(base)]
        got = {(r.query_id, r.match_id) for r in chroma.matches(spark.createDataFrame([(i, f.astype("<u4").tobytes()) for i, f in prints], "key long, fingerprint binary"), lambda k: k % 2 == 0).collect()}
        want = {(i, j) for i, a in prints if i % 2 == 0 for j, b in prints if judged_by_bits(a, b)}
        assert got <= want and len(got) >= least * len(want)
        few += sum(0 < len(np.intersect1d(dict(prints)[i] >> chroma.KEY_SHIFT, dict(prints)[j] >> chroma.KEY_SHIFT)) < 4 for i, j in got)
    assert few  # found with fewer than four integers in common


def test_chroma_query_names_every_row(spark, tmp_path):
    from seqlake.llm import queries

    rng = np.random.default_rng(5)
    a, b, c = ((rng.standard_normal(64) / 8).tolist() for _ in range(3))
    rows = [(7, a), (50, a), (100, a), (8, b), (150, b), (150, b), (9, c), (200, None), (None, a)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op6_chroma_fingerprints(spark, str(tmp_path)).collect()
    classes = sorted((r.row_id, r.match_id, r.copies) for r in got if r.row_id not in (None, 200))
    assert classes == [(7, 7, 3), (8, 8, 3), (9, 9, 1), (50, 7, 3), (100, 7, 3), (150, 8, 3), (150, 8, 3)]
    assert [(r.match_id, r.copies) for r in got if r.row_id == 200] == [(None, None)]
    assert {(7, 7), (8, 8)} <= {(r.query_id, r.match_id) for r in got if r.query_id is not None}


# ---------------------------------------------------------------- 7
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=8))
def test_plan_packs_every_piece_once(counts):
    patterns = packing.plan(dict(counts), 20)
    used = Counter()
    for n, inside in patterns:
        assert n > 0 and sum(s * k for s, k in inside) <= 20
        for s, k in inside:
            used[s] += n * k
    assert used == Counter(counts)
    assert sum(n for n, _ in patterns) >= -(-sum(s * n for s, n in counts.items()) // 20)


def best(items, cap):
    """Fewest sequences, by search."""
    items = sorted(items, reverse=True)
    low = [len(items)]

    def go(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(items):
            low[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return low[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_dominance_never_costs_a_sequence(items):
    counts = dict(Counter(items))
    fixed = packing.dominance(counts, 12)
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + (best(rest, 12) if rest else 0) == (best(items, 12) if items else 0)


def test_packing_a_table(spark, table):
    got = packing.pack(frame(spark, table + [(7777, "again " * 900)]), BYTE, 2, 256).collect()
    enc, want = Tokenizer.from_file(BYTE), []
    for i, t in table + [(7777, "again " * 900)]:
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for x in room.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 256
    assert packing.pack(frame(spark, []), BYTE, 2).count() == 0


def test_cut_leaves_the_first_piece_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


# ---------------------------------------------------------------- 8
def test_repeats_equal_brute_force(spark, table):
    for window in (35, 8):
        out = by_id(repeats.remove_repeats(frame(spark, table), window=window, digest=True))
        for (i, _), (w, gone) in zip(table, brute.repeated([t for _, t in table], window), strict=True):
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_repeats_are_found_by_the_automata_alone():
    """What is removed is what automata of the phrases find, and an empty one finds nothing."""
    v = [f"w{i}" for i in range(400)]
    a, b = " ".join(v[:90]), " ".join(v[40:130])
    w = Words(pa.array([a + " x " + b, " ".join(v[300:380]), b]))
    phrases = [" ".join(v[i : i + 35]).encode() for i in (0, 35, 55, 95)]
    gone = repeats.Automata(phrases).locate(w)
    assert gone[:90].all() and not gone[90:106].any() and gone[106:141].all() and not gone[141:146].any() and gone[146:181].all() and not gone[181:261].any()
    assert not repeats.Automata([]).locate(w).any()
    odd = Words(pa.array(["p q r s"]))
    odd.hash[:] = 7  # words of equal hashes are told apart by their letters
    two = repeats.Automata([b"p q"])
    two.words, two.grams = np.array([7], np.uint64), window_hash(odd.hash, 2)[:1]
    two.shards[0] = repeats.ahocorasick.Automaton(repeats.ahocorasick.STORE_ANY, repeats.ahocorasick.KEY_SEQUENCE)
    two.base = 2
    two.shards[0].add_word(tuple(two.letters(np.array([1, 1]))), (2, [0]))
    two.shards[0].make_automaton()
    assert two.locate(odd).tolist() == [True, True, False, False]


def test_phrases_cover_passages():
    doc = np.zeros(200, int)
    starts = np.array([0, 1, 2, 50, 51, 120])
    assert repeats.phrase_starts(starts, doc, 35).tolist() == [0, 2, 50, 51, 120]
    assert repeats.phrase_starts(np.arange(80), doc, 35).tolist() == [0, 35, 70, 79] and not len(repeats.phrase_starts(starts[:0], doc, 35))


def test_repeats_keep_columns_and_clean_texts(spark, table):
    out = by_id(repeats.remove_repeats(frame(spark, table)))
    for (i, t), (w, gone) in zip(table, brute.repeated([t for _, t in table], 35), strict=True):
        assert out[i].bucket == 1 and out[i].part == "p"
        if any(gone):
            assert brute.words(out[i].text) == [x for x, g in zip(w, gone, strict=True) if not g]
        else:
            assert out[i].text == t
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 9
def test_near_duplicates_equal_brute_force(spark, table):
    rng = random.Random(8)
    v, rows = vocabulary(rng), [(i, t) for i, t in table]
    for g in range(6):
        doc = rng.choices(v, k=rng.choice((9, 60, 200)))
        for j in range(12):
            d = list(doc)
            for _ in range(rng.randint(0, max(1, len(d) // 40))):
                d[rng.randrange(len(d))] = rng.choice(v)
            rows.append((1000 + 100 * g + j, " ".join(d)))
    for k in (4, 5):
        got = by_id(near_dup.near_duplicates(frame(spark, rows), k=k))
        want = brute.components(rows, k)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (i == want[i]) and r.n_shingles == len(brute.shingles(dict(rows)[i], k)) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    got = near_dup.near_duplicates(frame(spark, [(3, "a b"), (3, "a b"), (None, "a b"), (2, None), (9, "A  b")]), k=4).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (2, 2), (3, 3), (3, 3), (9, 3)]


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = near_dup.signature(u[:500]), near_dup.signature(u[100:600])
    assert abs((a == b).mean() - 400 / 600) < 0.12
    assert (near_dup.signature(u[:3]) == near_dup.signature(u[:3])).all()


def test_signatures_of_large_sets_at_the_threshold_agree():
    """The cut of the comparison across components stays clear of pairs at similarity 0.8."""
    rng = np.random.default_rng(3)
    sig = lambda x: np.concatenate([near_dup.signature(np.unique(x), *a) & near_dup.U64(255) for a in ((), (near_dup.MORE_BINS, 0x9E3779B97F4A7C15))])
    for n in (320, 420, 1000):
        agree = []
        for _ in range(400):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            agree.append((sig(x[: n * 9 // 10]) == sig(np.concatenate((x[: n * 8 // 10], x[n * 9 // 10 :])))).sum())
        assert np.mean(agree) - 4.9 * np.std(agree) > near_dup.AGREE


def test_densification_ends_for_any_set():
    for n in (1, 2, 3):
        x = near_dup.signature(np.arange(n, dtype=np.uint64) * near_dup.U64(977))
        assert 1 <= len(set(x.tolist())) <= n
    assert not near_dup.signature(np.zeros(0, np.uint64)).any()


def test_inverted_sets_count_what_is_common():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint32) for n in (0, 5, 30, 80)]
    index = near_dup.Inverted(sets)
    for x in sets:
        assert index.common(x).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_key_filter_knows_every_key(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b c d") for i in [*range(-50, 3000), None]], "key long, text string")
    keys = spark.createDataFrame([(i,) for i in [*range(-50, 0), *range(5, 3000, 7)]], "key long")
    got = {r.key for r in near_dup.sets_of(docs, keys, 4).collect()}
    assert {r.key for r in keys.collect()} <= got and len(got) < 600 and None not in got


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs at similarity 0.8 to 0.82, of small and large sets, each in a crowd that shares its buckets: all are found."""
    rng = random.Random(12)
    rows, want = [], 0
    for g in range(120):
        n = rng.choice((30, 90, 200, 600))
        base = [f"g{g}w{i}" for i in range(n)]
        for j in range(4):
            d = list(base)
            d[j * 3 % n] = f"x{j}"  # 4 or fewer shingles are lost, each side
            cut = int(n * rng.uniform(0.02, 0.09))
            d[n - cut :] = [f"y{g}.{j}.{i}" for i in range(cut)]
            rows.append((1000 * g + j, " ".join(d)))
    want = brute.components(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), k=4).collect()}
    pairs = {i for i in want if want[i] != i}
    assert len(pairs) > 60 and got == want


# ---------------------------------------------------------------- 10
import re  # noqa: E402


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+0159 ()é", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == slow_base(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "a.b+c@x-y.co.uk", "@", "10.1.2.255.7", "+1 (312) 555-3490", "256.1.1.1", "00000000000000", " ", "x", "é"]), max_size=8))
def test_base_spans_of_mixtures(parts):
    assert pii.base_spans("".join(parts)) == slow_base("".join(parts))


def test_base_spans_take_no_quadratic_time():
    for text in ("1" * 200_000, "a." * 100_000, "a@" * 100_000, "+1" * 100_000, "+1" + " " * 200_000, "1." * 100_000):
        pii.base_spans(text)


def test_tagger_held_out_accuracy():
    p = pii.train()
    test = pii.labelled_spans(200, 4321)
    got = pii.tagged_spans([t for t, _ in test], p)
    hit = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, test, strict=True))
    assert hit / sum(len(b) for _, b in test) > 0.7 and hit / sum(map(len, got)) > 0.7
    sure = pii.tagged_spans([t for t, _ in test], p, accept=pii.ACCEPT)
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(sure, test, strict=True))
    assert right / sum(map(len, sure)) > 0.9 and right > 0.5 * hit


def test_decoding_equals_all_paths(monkeypatch):
    """Viterbi and certainty against every sequence of three tags; overlapping windows against one mean of their scores."""
    import itertools

    monkeypatch.setattr(pii, "TAGS", 3)
    rng = np.random.default_rng(2)
    for n in (1, 2, 6):
        s, tr = rng.standard_normal((n, 3)), rng.standard_normal((3, 3))
        paths = list(itertools.product(range(3), repeat=n))
        score = np.array([sum(s[i, y] for i, y in enumerate(x)) + sum(tr[a, b] for a, b in itertools.pairwise(x)) for x in paths])
        assert tuple(pii.viterbi(s, tr)) == paths[int(score.argmax())]
        share = np.exp(score) / np.exp(score).sum()
        want = min(sum(q for q, x in zip(share, paths, strict=True) if x[i] > 0) for i in range(n))
        assert math.isclose(pii.certainty(s, tr, [("email", 5, 5 + n)], 5)[0], want, rel_tol=1e-9)


def test_windows_are_reconciled_over_the_text():
    p, word = pii.train(), "lorem ipsum dolor sit "
    text = word * 4 + "call (312) 555-3490 now " + word * 9 + "card 4111.1111.1111.1111 or " + word * 3 + "ann at example dot com, " + word
    n = len(text)
    total, weight = np.zeros((n, pii.TAGS)), np.zeros((n, 1))
    for a in range(0, n, pii.STRIDE):
        ids = np.zeros((pii.WINDOW, 1), int)
        x = pii.char_ids(text)[a : a + pii.WINDOW]
        ids[: len(x), 0] = x
        s, m = pii.emissions(p, ids)[: len(x), 0], len(x)
        near = np.minimum(np.arange(pii.WINDOW) + 1, pii.WINDOW - np.arange(pii.WINDOW))[:m, None]
        total[a : a + m] += s * near
        weight[a : a + m] += near
    plain = pii.spans_of(pii.viterbi(total / weight, p["t"]), 0)
    got = pii.tagged_spans([text], p)[0]
    assert {s for s in got if s[0] != "email"} == {s for s in plain if s[0] != "email"} and len(got) >= 2


def test_pii_table_and_redaction(spark, table):
    docs = frame(spark, table + [(5000, "card 4111 1111 1111 1111 of x@y.org"), (5001, "call (312) 555-3490 now, said Ann " * 40)])
    out = by_id(pii.find_pii(docs))
    for i, t in table:
        base = slow_base(t or "")
        assert out[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.written(base).split(",")) <= set(out[i].spans.split(","))
    assert out[5001].n_added > 20
    red = by_id(pii.redact(docs))
    assert red[5000].text == "card <CARD> of <EMAIL>" and red[5000].bucket == 1
    assert all(red[i].text == t for i, t in table if not slow_base(t or "") and not out[i].spans)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    e, h = pii.EMBED, pii.HIDDEN
    p = {"e": rng.standard_normal((pii.N_CHARS, e)), "v": rng.standard_normal((2 * h, pii.TAGS)), "c": rng.standard_normal(pii.TAGS), "t": rng.standard_normal((pii.TAGS, pii.TAGS))}
    for d in "fb":
        p |= {f"w{d}": 0.3 * rng.standard_normal((e, 4 * h)), f"u{d}": 0.3 * rng.standard_normal((h, 4 * h)), f"b{d}": rng.standard_normal(4 * h)}
    ids, y, mask = rng.integers(0, 90, (7, 3)), rng.integers(0, pii.TAGS, (7, 3)), np.ones((7, 3))
    mask[5:, 1] = 0
    loss, g = pii._step(p, ids, y, mask)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        q = {a: b.copy() for a, b in p.items()}
        q[k][i] += 1e-5
        assert math.isclose((pii._step(q, ids, y, mask)[0] - loss) / 1e-5, g[k][i], rel_tol=1e-3)


def test_tagger_reads_every_window(monkeypatch):
    """Texts without a digit or an @ are read too, and from end to end."""
    seen, plain = [], pii.emissions
    monkeypatch.setattr(pii, "emissions", lambda p, ids: (seen.append(ids.shape[1]), plain(p, ids))[1])
    texts = ["lorem ipsum dolor sit amet " * 40, "a", "", "word " * 30 + "7" + " word" * 300]
    pii.all_spans(texts, pii.train())
    assert sum(seen) == sum(-(-len(t) // pii.STRIDE) for t in texts)


def test_short_decoding_equals_that_of_whole_texts(monkeypatch):
    """Only stretches that may be spans are decoded, and certainties are decided from few scores: with the results of whole texts."""
    p = pii.train()
    lines = [t for t, _ in pii.labelled_spans(60, 99)]
    texts = [" ".join(lines[i : i + 12]) for i in range(0, 60, 12)] + ["", "a", lines[0], "lorem ipsum dolor sit amet " * 60]
    scores, asked, plain, reads = [], [], pii.viterbi, pii.emissions
    monkeypatch.setattr(pii, "viterbi", lambda s, tr: (asked.append(len(s)), plain(s, tr))[1])
    pii.tagged_spans(texts[-1:], p)
    assert sum(asked) < len(texts[-1]) / 2
    got, sure = pii.tagged_spans(texts, p), pii.tagged_spans(texts, p, accept=pii.ACCEPT)
    for t in texts:
        total, weight = np.zeros((len(t) + pii.WINDOW, pii.TAGS)), np.zeros((len(t) + pii.WINDOW, 1))
        for a in range(0, len(t), pii.STRIDE):
            x = pii.char_ids(t)[a : a + pii.WINDOW]
            near = np.minimum(np.arange(pii.WINDOW) + 1, pii.WINDOW - np.arange(pii.WINDOW))[:, None]
            total[a : a + pii.WINDOW] += reads(p, np.pad(x, (0, pii.WINDOW - len(x)))[:, None].astype(int))[:, 0] * near
            weight[a : a + pii.WINDOW] += near
        scores.append((total[: len(t)] / weight[: len(t)]).astype(np.float32))
    want = [pii.spans_of(plain(s.astype(float), p["t"].astype(float)), 0) if len(s) else [] for s in scores]
    assert got == want and sum(map(len, want)) > 40
    some = [(s, x) for s, xs in zip(scores, want, strict=True) for x in xs]
    share = {i: pii.certainty(s, p["t"], [x], 0)[0] for i, (s, x) in enumerate(some)}
    for accept in (0.3, 0.7, pii.ACCEPT, 0.99):
        assert all(pii.is_certain(s, p["t"], x, accept) == (share[i] >= accept) for i, (s, x) in enumerate(some))
    assert sum(map(len, sure)) == sum(v >= pii.ACCEPT for v in share.values())


def test_emissions_are_those_of_the_trained_network():
    p, rng = pii.train(), np.random.default_rng(5)
    ids = rng.integers(0, pii.N_CHARS, (40, pii.LANE + 3))
    x = p["e"][ids]
    a, b = pii._lstm(x, p["wf"], p["uf"], p["bf"])[0], pii._lstm(x[::-1], p["wb"], p["ub"], p["bb"])[0]
    assert np.allclose(pii.emissions(p, ids), np.concatenate((a, b[::-1]), 2) @ p["v"] + p["c"], atol=1e-4)


def test_tagger_reads_a_text_little_more_than_once(monkeypatch):
    """Windows overlap by few of their characters and end with the text, and no character is left out."""
    p, plain, seen = pii.train(), pii.emissions, []
    monkeypatch.setattr(pii, "emissions", lambda p, ids: (seen.append(int((ids >= 0).sum())), plain(p, ids))[1])
    for texts in (["lorem ipsum dolor sit amet " * 2000], ["a word or two"] * 50, ["", "x" * 5000, "call 312-555-3490", ""]):
        seen.clear()
        pii.tagged_spans(texts, p)
        n = sum(map(len, texts))
        assert n <= sum(seen) <= 1.1 * n


def test_steps_after_the_end_change_no_score():
    p, rng = pii.train(), np.random.default_rng(6)
    ids, ends = rng.integers(0, pii.N_CHARS, (70, pii.LANE + 9)), rng.integers(0, 71, pii.LANE + 9)
    after = np.arange(70)[:, None] >= ends
    got, want = pii.emissions(p, np.where(after, -1, ids)), pii.emissions(p, np.where(after, 0, ids))
    assert np.allclose(got[~after], want[~after], atol=1e-3)


def test_many_stretches_are_decoded_as_each_alone():
    rng, n = np.random.default_rng(8), 400
    s, tr = 3 * rng.standard_normal((n, pii.TAGS)).astype(np.float32), rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    first = rng.integers(0, n, 60)
    last = np.minimum(first + rng.integers(0, 40, 60), n - 1)
    shut = rng.random((2, 60)) < 0.5
    for y, a, b, l, r in zip(pii.best_paths(s, tr, first, last, shut), first, last, *shut, strict=True):
        part = s[a : b + 1].copy()
        part[0, 1:], part[-1, 1:] = (-1e6 if l else part[0, 1:]), (-1e6 if r else part[-1, 1:])
        assert y.tolist() == pii.viterbi(part, tr).tolist()
    assert pii.best_paths(s, tr, first[:0], last[:0], shut[:, :0]) == []
    s[:, 0] += 2
    lo = np.repeat([0, 150, 150], 30)
    hi = np.where(lo, n, 150)
    a = lo + rng.integers(0, 140, 90)
    spans = [(pii.KINDS[i % 4], int(x), int(x) + i % 7 + 1) for i, x in enumerate(a)]
    want = [pii.certainty(s[x:y], tr, [span], int(x))[0] for span, x, y in zip(spans, lo, hi, strict=True)]
    for accept in (0.02, 0.2, 0.6):
        assert pii.are_certain(s, tr, spans, lo, hi, accept).tolist() == [w >= accept for w in want]
    assert pii.are_certain(s, tr, [], lo[:0], hi[:0], 0.5).tolist() == []


def test_queries_lie_in_few_files(spark, monkeypatch):
    """Each class costs a call for each file of queries, so that these are as few as their sizes allow (F1)."""
    from seqlake.llm import chroma

    rng = np.random.default_rng(2)
    prints = [(i, rng.integers(0, 1 << 32, 40, np.uint32)) for i in range(60)]
    prints += [(100 + i, p ^ np.uint32(1 << (i % 9))) for i, p in prints[:30]]
    table = spark.createDataFrame([(i, f.astype("<u4").tobytes()) for i, f in prints], "key long, fingerprint binary").repartition(8)
    seen, keep = [], chroma.scratch
    monkeypatch.setattr(chroma, "scratch", lambda s, name: seen.append(keep(s, name)) or seen[-1])
    got = []
    for positions in (1 << 19, 200):
        monkeypatch.setattr(chroma, "BLOCK_POSITIONS", positions, raising=False)
        got.append(sorted(map(tuple, chroma.matches(table, lambda k: k % 2 == 0).collect())))
    assert got[0] == got[1] and {(a, b) for a, b, *_ in got[0]} >= {(i, 100 + i) for i in range(0, 30, 2)}
    files = [spark.read.parquet(p).inputFiles() for p in seen if "queries" in p]
    assert len(files[0]) == 1 and len(files[1]) > 3
