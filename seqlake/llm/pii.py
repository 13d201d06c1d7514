"""Operator 10: personal data, by fixed patterns and by a character-level bidirectional LSTM (of hard gates) with CRF transitions.

The patterns give the base spans. The tagger, trained in numpy from labelled spans, reads overlapping windows over the whole
text; their scores are averaged (by how far a character is from the window's edge), and one Viterbi pass over each covered
stretch decodes them together. A span of its joins the base spans where it overlaps none of them and every one of its characters
is of its kind with a probability of ACCEPT at least, by forward and backward passes over the same scores; no pattern judges it.

Every window of every text is read, from end to end.

Defined results: null text is the empty text and has no spans; a null key stays null; texts of any length are read whole; repeated
rows give repeated results; an empty table gives none; other columns are not carried (redact keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- base patterns
# Each is written so that it is tried once per run of characters: no text takes quadratic time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_IP_FIRST = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass the kind's test."""
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if octet(_IP_FIRST.match(text, m.start())[0]) and all(map(octet, m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- labelled spans
def labelled_spans(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up lines with labelled spans: usual and written-out forms of the four kinds, among words, keys and numbers that are none."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(letters + "éüñö" * (rng.random() < 0.2)) for _ in range(int(rng.integers(1, 10))))

    def email() -> str:
        name, host, top = word() + pick(("", "." + word(), "." + digits(2), "_" + word())), pick((word(), word() + digits(1))), pick(("com", "org", "net", "de", "example.com"))
        at, dot = pick(("at", "at", "AT")), pick(("dot", "dot", "DOT"))
        return pick((f"{name}@{host}.{top}",) * 4 + (f"{name} [{at}] {host} [{dot}] {top}", f"{name} ({at}) {host}.{top}", f"{name} ({at}) {host} ({dot}) {top}", f"{name} {at} {host} {dot} {top}"))

    def ip() -> str:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card() -> str:
        d = pick("45") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+{pick('1349')} ({a}) {b}-{c}",) * 2 + (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{pick('1349')}{pick('23456789')} {a} {b}{c}"))

    def other() -> str:
        return pick((f"version {pick('123')}.{pick('0123')}", "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"password={''.join(pick('0123456789abcdef') for _ in range(18))}", f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', f"CC BY-NC {pick('1234')}.0.", f"{1900 + int(rng.integers(150))}", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(int(rng.integers(1, 6)))} {word()}", f"${digits(3)}.{digits(2)}", f"@{word()}", f"{word()} at {word()} of {word()}", f"{word()}{pick('#$%&*') * 3}", digits(16 + int(rng.integers(0, 9)))))

    def prose() -> str:
        """A sentence or two, with words that look like the written-out forms."""
        some = [pick(("at", "that", "what", "heat", "dot", "anecdot", word() + "at", "the", "de", "un")) if rng.random() < 0.3 else word() for _ in range(int(rng.integers(4, 14)))]
        cut = int(rng.integers(1, len(some)))
        out = [*some[: cut - 1], some[cut - 1] + pick((".", ".", ",", ";", "?", "###", "&&&", "%%%")), some[cut].capitalize(), *some[cut + 1 :]]
        return " ".join(out) + pick((".", "...", ""))

    makers = dict(zip(KINDS, (email, ip, card, phone), strict=True))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += (prose() if rng.random() < 0.4 else " ".join(word() for _ in range(int(rng.integers(0, 6))))) + pick((" ", " ", "\n", ", "))
            kind = pick((*KINDS, None, None))
            if kind:
                x = makers[kind]()
                spans.append((kind, len(text), len(text) + len(x)))
                text += x
            else:
                text += other()
            text += pick((" ", ". ", ", ", "\n"))
        text += word()
        out.append((text, spans))
    return out


# ---------------------------------------------------------------- tagger
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 12, 14
#: Windows overlap by 48 characters: in one of its windows each has 24 characters at least on either side, or the text's end.
WINDOW, STRIDE = 768, 720
BLOCK = math.gcd(WINDOW, STRIDE)
_CHARS = np.zeros(0x250, np.int32)
_CHARS[32:127] = np.arange(1, 96)
_CHARS[[9, 10, 11, 12, 13]] = 96
_CHARS[0xC0:0x250] = 97
N_CHARS = 99


def char_ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < len(_CHARS), _CHARS[np.minimum(c, len(_CHARS) - 1)], 98)


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, a, b in spans:
        t = 1 + 2 * KINDS.index(k)
        y[a:b] = t + 1
        y[a] = t
    return y


#: Slope of a gate where it is neither open nor closed.
SLOPE = 0.35


def _gate(x: np.ndarray) -> np.ndarray:
    """The hard sigmoid. New values and cells go through the hard tanh, from -1 to 1."""
    return np.clip(SLOPE * x + 0.5, 0, 1)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """x: time, batch, inputs -> hidden states of each time, and what the way back needs."""
    n_t, n_b, _ = x.shape
    n_h = u.shape[0]
    z = x @ w + b
    h = c = np.zeros((n_b, n_h), x.dtype)
    hs, past = np.empty((n_t, n_b, n_h), x.dtype), []
    for t in range(n_t):
        a = z[t] + h @ u
        s = _gate(a[:, : 3 * n_h])
        i, f, o, g = s[:, :n_h], s[:, n_h : 2 * n_h], s[:, 2 * n_h :], np.clip(a[:, 3 * n_h :], -1, 1)
        before, c = c, f * c + i * g
        tc = np.clip(c, -1, 1)
        if keep:
            past.append((i, f, o, g, before, tc, h))
        h = o * tc
        hs[t] = h
    return hs, past


def _lstm_back(x, w, u, past, dh_all):
    n_t, n_b, n_h = dh_all.shape
    dz = np.empty((n_t, n_b, 4 * n_h), x.dtype)
    dh, dc, du = np.zeros((n_b, n_h), x.dtype), np.zeros((n_b, n_h), x.dtype), np.zeros_like(u)
    for t in range(n_t - 1, -1, -1):
        i, f, o, g, before, tc, h0 = past[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (abs(tc) < 1)
        dz[t] = np.concatenate((SLOPE * dc * g * (i * (1 - i) > 0), SLOPE * dc * before * (f * (1 - f) > 0), SLOPE * dh * tc * (o * (1 - o) > 0), dc * i * (abs(g) < 1)), 1)
        du += h0.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * n_h)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


#: Windows that are read at once (and one without text): what is worked on lies in the cache.
LANE = 1007
TINY = np.float32(1e-10)


def _one_way(p: dict[str, np.ndarray], d: str, ids: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    """Adds the scores that come from one direction to out (time, tags, batch). ids: time, batch; ends: where the windows' texts end,
    falling, the first window being one without text. Steps after the end are left out: on the way back a window enters with the state of the first.

    The same as _lstm, in place and with a row for each unit. Slopes are in the weights, states and cells are kept by half, and the
    product that gives a step's gates gives the scores of the state before it too."""
    h, (n_t, n) = HIDDEN, ids.shape
    w = np.concatenate((2 * p["u" + d], p["w" + d], p["b" + d][None])) * np.where(np.arange(4 * h) < 3 * h, SLOPE, 0.5)
    w[-1] += 0.5
    v = np.zeros((len(w), TAGS))
    v[:h] = 2 * (p["v"][:h] if d == "f" else p["v"][h:])
    w = np.concatenate((w, v), 1).T.astype(np.float32).copy()
    e = np.concatenate((p["e"], np.ones((len(p["e"]), 1))), 1).T.astype(np.float32).copy()
    x, a, c, y = (np.zeros((m, n), np.float32) for m in (w.shape[1], len(w), h, h))
    steps, k = range(n_t) if d == "f" else range(n_t - 1, -1, -1), 0
    live = np.searchsorted(-ends, -np.arange(n_t) - (d == "b"), "right")  # on the way there one step more, which gives the last score
    for t in steps:
        if live[t] != k:
            if d == "b" and k:
                x[:h, k : live[t]], c[:, k : live[t]] = x[:h, :1], c[:, :1]
            k = int(live[t])
            if k == 1 and d == "f":
                return
            xk, ak, ck, yk = (m[:, :k] for m in (x, a, c, y))
            i, forget, o, new, z = (ak[m * h : (m + 1) * h] for m in range(5))
            gates, state = ak[: 4 * h], xk[:h]
        e.take(ids[t], 1, x[h:], "clip")
        np.matmul(w, xk, out=ak)
        if t != steps[0]:
            out[t - steps.step, :, :k] += z
        gates.clip(0, 1, gates)
        new -= 0.5
        new *= i
        ck *= forget
        ck += new
        if t % 4 == 0:  # what fades away becomes 0: denormal numbers take many times as long
            ck += TINY
            ck -= TINY
        ck.clip(-0.5, 0.5, yk)
        np.multiply(o, yk, out=state)
    out[steps[-1], :, :k] += w[4 * h :, :h] @ state


def emissions(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """ids: time, batch -> scores: time, batch, tags. -1 after a text's end reads as 0 does, and its scores are not worked out."""
    out = []
    for j in range(0, ids.shape[1], LANE):
        ends = (ids[:, j : j + LANE] >= 0).sum(0)
        order = np.argsort(-ends, kind="stable")
        some = np.zeros((len(ids), 1 + len(order)), np.intp)
        np.maximum(ids[:, j + order], 0, out=some[:, 1:])
        s = np.empty((len(ids), TAGS, some.shape[1]), np.float32)
        s[:] = p["c"][None, :, None]
        for d in "fb":
            _one_way(p, d, some, np.append(len(ids), ends[order]), s)
        out.append(s[:, :, 1:] if (np.diff(order) > 0).all() else s[:, :, 1 + np.argsort(order)])
    return (out[0] if len(out) == 1 else np.concatenate(out, 2)).transpose(0, 2, 1)


def _step(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of a batch under the CRF, and its gradients. ids, y, mask: time, batch."""
    x = p["e"][ids]
    hf, pf = _lstm(x, p["wf"], p["uf"], p["bf"], True)
    hb, pb = _lstm(x[::-1], p["wb"], p["ub"], p["bb"], True)
    h = np.concatenate((hf, hb[::-1]), 2)
    s = (h @ p["v"] + p["c"]) * mask[:, :, None]
    tr, n_t, n_b = p["t"], *ids.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, n_t):
        new = _logsum(alpha[t - 1][:, :, None] + tr[None], 1) + s[t]
        alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
    z = _logsum(alpha[-1], 1)
    for t in range(n_t - 2, -1, -1):
        new = _logsum(tr[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None] > 0, new, beta[t + 1])
    post = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    rows = np.arange(n_b)
    ds, dt, gold = post.copy(), np.zeros_like(tr), 0.0
    for t in range(n_t):
        m = mask[t] > 0
        ds[t, rows[m], y[t, m]] -= 1
        gold += s[t, rows[m], y[t, m]].sum()
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + tr[None] + (s[t] + beta[t])[:, None, :] - z[:, None, None]) * m[:, None, None]
            dt += pair.sum(0)
            np.subtract.at(dt, (y[t - 1, m], y[t, m]), 1)
            gold += tr[y[t - 1, m], y[t, m]].sum()
    g = {"t": dt, "v": h.reshape(-1, h.shape[2]).T @ ds.reshape(-1, TAGS), "c": ds.sum((0, 1))}
    dh = ds @ p["v"].T
    dxf, g["wf"], g["uf"], g["bf"] = _lstm_back(x, p["wf"], p["uf"], pf, dh[:, :, :HIDDEN])
    dxb, g["wb"], g["ub"], g["bb"] = _lstm_back(x[::-1], p["wb"], p["ub"], pb, dh[::-1][:, :, HIDDEN:])
    g["e"] = np.zeros_like(p["e"])
    np.add.at(g["e"], ids, dxf + dxb[::-1])
    return float(z.sum() - gold) / n_b, {k: v / n_b for k, v in g.items()}


#: What the learning rate is multiplied by after each pass.
DECAY = 0.85


@lru_cache(maxsize=4)
def train(n: int = 1600, epochs: int = 12, batch: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of the tagger, from n made-up labelled lines; the same for the same arguments."""
    data = labelled_spans(n, seed)
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
    p = {"e": rng.standard_normal((N_CHARS, EMBED)) * 0.3, "v": r(2 * HIDDEN, TAGS), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"w{d}": r(EMBED, 4 * HIDDEN), f"u{d}": r(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 16)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for gi in rng.permutation(len(groups)):
            part = [data[i] for i in groups[gi]]
            n_t = max(len(t) for t, _ in part)
            ids, y, mask = np.zeros((n_t, len(part)), np.int64), np.zeros((n_t, len(part)), np.int64), np.zeros((n_t, len(part)))
            for j, (t, spans) in enumerate(part):
                ids[: len(t), j], y[: len(t), j], mask[: len(t), j] = char_ids(t), tags_of(len(t), spans), 1
            _, g = _step(p, ids, y, mask)
            step += 1
            rate = 0.012 * DECAY**epoch
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def viterbi(s: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best tags for scores s (time, tags)."""
    n = len(s)
    back, v = np.zeros((n, TAGS), np.int8), s[0]
    for t in range(1, n):
        m = v[:, None] + tr
        back[t] = m.argmax(0)
        v = m.max(0) + s[t]
    y = np.empty(n, np.int64)
    y[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        y[t - 1] = back[t, y[t]]
    return y


def best_paths(scores: np.ndarray, tr: np.ndarray, first: np.ndarray, last: np.ndarray, shut: np.ndarray) -> list[np.ndarray]:
    """Best tags for each stretch of scores (time, tags), first to last; where shut (first, last; stretches) they are outside there. As viterbi, for many at once."""
    order = np.argsort(first - last, kind="stable")
    rows, size = first[order], (last - first)[order] + 1
    vs: list[np.ndarray] = []
    live = np.searchsorted(-size, -np.arange(size.max(initial=0)))  # the first of them have a character at that time
    for t, k in enumerate(live.tolist()):
        s = scores[rows[:k] + t].T.copy()
        if not t:
            s[1:, shut[0][order]] = -1e6
        ends = np.flatnonzero(size[:k] == t + 1)
        s[1:, ends[shut[1][order[ends]]]] = -1e6
        vs.append((vs[-1][:, None, :k] + tr[:, :, None]).max(0) + s if t else s)
    ys = np.empty((len(live), len(order)), np.int8)
    for t in range(len(live) - 1, -1, -1):
        k, after = int(live[t]), int(live[t + 1]) if t + 1 < len(live) else 0
        v = vs.pop()
        v[:, :after] += tr[:, ys[t + 1, :after]] if after else 0
        ys[t, :k] = v.argmax(0)
    out = [ys[:0, 0]] * len(order) if len(order) else []
    for j, i in enumerate(order.tolist()):
        out[i] = ys[: size[j], j]
    return out


def spans_of(y: np.ndarray, at: int) -> list[Span]:
    out, a = [], None
    for i, t in enumerate([*y.tolist(), 0]):
        if a is not None and (t == 0 or t % 2 == 1 or (t - 1) // 2 != kind):
            out.append((KINDS[kind], at + a, at + i))
            a = None
        if t and a is None:
            a, kind = i, (t - 1) // 2
    return out


#: Probability from which on a tagged span counts.
ACCEPT = 0.9


def certainty(s: np.ndarray, tr: np.ndarray, spans: list[Span], at: int) -> list[float]:
    """For each span of scores s (time, tags) the least probability of a character to be of the span's kind."""
    if not spans:
        return []
    s, tr = s.astype(float), tr.astype(float)
    a, b = np.empty_like(s), np.zeros_like(s)
    a[0] = s[0]
    for t in range(1, len(s)):
        a[t] = _logsum(a[t - 1][:, None] + tr, 0) + s[t]
    for t in range(len(s) - 2, -1, -1):
        b[t] = _logsum(tr + (s[t + 1] + b[t + 1])[None, :], 1)
    p = np.exp(a + b - _logsum(a[-1], 0))
    return [float(p[x - at : y - at, 1 + 2 * KINDS.index(k) :][:, :2].sum(1).min()) for k, x, y in spans]


def _gains(s: np.ndarray, tr: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, float]:
    """(g, e): characters of spans, x to y, that follow and precede characters outside add at most sum(g[x..y]) + e to the score of the
    path that has x to y outside. first, last: where texts begin and end; there no transition leads in or out."""
    inner, into, out_of, stay = tr[1:, 1:].max(), tr[0, 1:].max(), tr[1:, 0].max(), tr[0, 0]
    best = s[:, 1].copy()
    for k in range(2, s.shape[1]):
        np.maximum(best, s[:, k], out=best)
    g = (best - s[:, 0]).astype(float) + float(inner - stay)
    g[first] += max(0.0, float(stay - into))
    g[last] += max(0.0, float(stay - out_of))
    return g, float(into + out_of - inner - stay)


def _may_be_inside(g: np.ndarray, e: float) -> np.ndarray:
    """Mask of the characters that lie in a stretch whose gain is not below 0: on no best path are others in a span."""
    c = np.concatenate(([0.0], np.cumsum(g)))
    upto = c[1:] - np.minimum.accumulate(c)[:-1]  # the best stretch that ends here
    since = np.maximum.accumulate(c[::-1])[::-1][1:] - c[:-1]
    return upto + since - g >= -e - 1e-3


def are_certain(s: np.ndarray, tr: np.ndarray, spans: list[Span], lo: np.ndarray, hi: np.ndarray, accept: float) -> np.ndarray:
    """Whether certainty() of each span of scores s (time, tags), whose text is from lo to hi, is accept at least, from as few scores as decide it.

    What lies beyond an extent only weighs the tags of the extent's first and last character. So the probabilities lie between the least
    and the largest for any two tags there; where accept is between them, a larger extent is taken, at last all scores."""
    out = np.zeros(len(spans), bool)
    kind, a, b = (np.array(x, np.int64) for x in zip(*((1 + 2 * KINDS.index(k), x, y) for k, x, y in spans), strict=True)) if spans else np.zeros((3, 0), np.int64)
    m, left = np.exp(tr.astype(float)), np.argsort(b - a, kind="stable")
    for side in (8, 48, 192):
        open_ = []
        for j in range(0, len(left), TRIED):
            own = left[j : j + TRIED]
            least, most = _bounds(s, m, kind[own], a[own], b[own], np.maximum(lo[own], a[own] - side), np.minimum(hi[own], b[own] + side), lo[own], hi[own])
            out[own] = least >= accept
            open_.append(own[(least < accept) & (most >= accept)])
        left = np.concatenate(open_) if open_ else left
    for i in left.tolist():
        out[i] = certainty(s[lo[i] : hi[i]], tr, [spans[i]], int(lo[i]))[0] >= accept
    return out


def is_certain(s: np.ndarray, tr: np.ndarray, span: Span, accept: float) -> bool:
    """are_certain() for a span of the scores of one text."""
    return bool(are_certain(s, tr, [span], np.zeros(1, np.int64), np.array([len(s)]), accept)[0])


#: Spans whose certainty is bounded at once.
TRIED = 64


def _bounds(s, m, kind, a, b, x, y, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Between what the certainty of spans of a kind, from a to b, lies by the scores from x to y alone."""
    n, tags = len(a), m.shape[0]
    weight = lambda q: np.exp((s[q] - s[q].max(1, keepdims=True)).astype(float))[:, None, :]
    f, g = np.tile(np.eye(tags), (n, 1, 1)), np.tile(np.eye(tags), (n, 1, 1))
    f[x == lo] = weight(x[x == lo])
    g[y == hi] = 1
    at = np.zeros((n, int((b - a).max()), tags, tags))
    for i in range(int((b - x).max())):
        k = np.flatnonzero(b - x > i)
        if i:
            step = (f[k].reshape(-1, tags) @ m).reshape(-1, tags, tags) * weight(x[k] + i)
            f[k] = step / step.max((1, 2), keepdims=True) if i % 8 == 0 else step
        k = k[x[k] + i >= a[k]]
        at[k, x[k] + i - a[k]] = f[k]
    least, most, of_kind = np.ones(n), np.ones(n), np.zeros((n, 1, tags))
    of_kind[np.arange(n), 0, kind] = of_kind[np.arange(n), 0, kind + 1] = 1
    for i in range(int((y - a).max())):
        k = np.flatnonzero(y - a > i)
        if i:
            step = ((g[k] * weight(y[k] - i)).reshape(-1, tags) @ m.T).reshape(-1, tags, tags)
            g[k] = step / step.max((1, 2), keepdims=True) if i % 8 == 0 else step
        k = k[y[k] - 1 - i < b[k]]
        if len(k):
            there, back = at[k, y[k] - 1 - i - a[k]], g[k].transpose(0, 2, 1)
            p = (there * of_kind[k]) @ back / (there @ back)
            least[k], most[k] = np.minimum(least[k], p.min((1, 2))), np.minimum(most[k], p.max((1, 2)))
    return least, most


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \n\t,;":
        a += 1
    while a < b and text[b - 1] in " \n\t,;.":
        b -= 1
    return a, b


def tagged_spans(texts: list[str], p: dict[str, np.ndarray], step: int = LANE, accept: float = 0.0, base: list[list[Span]] | None = None) -> list[list[Span]]:
    """Spans of the tagger alone, in whole texts, of a certainty of `accept` at least; without those that, trimmed, overlap a span of base.

    Scores of all texts lie one after the other, in blocks of BLOCK characters. Only stretches that a best path may have in a span are
    decoded, between characters that it has outside (_gains)."""
    size = np.array([len(t) for t in texts], np.int64)
    n_windows, blocks = -(-size // STRIDE), -(-size // BLOCK)
    at = np.cumsum(blocks) - blocks  # a text's first block
    chars = np.zeros((int(blocks.sum()), BLOCK), np.int32)
    for t, k in zip(texts, at.tolist(), strict=True):
        chars.reshape(-1)[k * BLOCK : k * BLOCK + len(t)] = char_ids(t)
    nth = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start, length = np.repeat(at, n_windows) + nth * (STRIDE // BLOCK), np.minimum(np.repeat(size, n_windows) - nth * STRIDE, WINDOW)
    longest = np.argsort(-length, kind="stable")
    start, length = start[longest], length[longest]
    near = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32).reshape(-1, 1, BLOCK, 1)
    scores, weight = np.zeros((len(chars), BLOCK, TAGS), np.float32), np.zeros((len(chars), BLOCK, 1), np.float32)
    alone = range(len(near) - STRIDE // BLOCK, STRIDE // BLOCK)  # blocks of a window that are in no other
    for j in range(0, len(start), step):
        own, end = start[j : j + step], length[j : j + step]
        ids = chars.reshape(-1)[np.minimum(own * BLOCK + np.arange(WINDOW)[:, None], chars.size - 1)]
        ids[np.arange(WINDOW)[:, None] >= end] = -1
        s = emissions(p, ids).reshape(len(near), BLOCK, len(own), TAGS)
        for k, far in enumerate(near):
            n = np.searchsorted(-end, -k * BLOCK)  # windows that have text there
            if k in alone:
                scores[own[:n] + k] = s[k, :, :n].transpose(1, 0, 2)
            else:
                scores[own[:n] + k] += s[k, :, :n].transpose(1, 0, 2) * far
                weight[own[:n] + k] += far
    shared = np.flatnonzero(weight[:, 0, 0])
    scores[shared] /= weight[shared]
    scores = scores.reshape(-1, TAGS)
    inside = np.arange(len(scores)) - np.repeat(at * BLOCK, blocks * BLOCK) < np.repeat(size, blocks * BLOCK)
    scores[~inside, 1:] = scores[~inside, :1] - 1000  # no text
    some = size > 0
    lo, hi = at * BLOCK, at * BLOCK + size
    tr = p["t"]
    gain, e = _gains(scores, tr, lo[some], hi[some] - 1)
    may = np.concatenate(([0], (_may_be_inside(gain, e) & inside).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(may)).reshape(-1, 2)
    out: list[list[Span]] = [[] for _ in texts]
    of = np.searchsorted(hi, edges[:, 0], "right")
    left, right = np.maximum(lo[of], edges[:, 0] - 1), np.minimum(hi[of], edges[:, 1] + 1)
    found: list[tuple[int, Span]] = []
    for y, i, x in zip(best_paths(scores, tr, left, right - 1, np.array((left < edges[:, 0], right > edges[:, 1]))), of.tolist(), left.tolist(), strict=True):
        for k, c, d in spans_of(y, x - int(lo[i])) if y.any() else ():
            if base is not None:
                c1, d1 = trimmed(texts[i], c, d)
                if c1 >= d1 or any(c1 < f and u < d1 for _, u, f in base[i]):
                    continue
            found.append((i, (k, c, d)))
    doc = np.array([i for i, _ in found], np.int64)
    sure = are_certain(scores, tr, [(k, c + int(lo[i]), d + int(lo[i])) for i, (k, c, d) in found], lo[doc], hi[doc], accept) if accept else np.ones(len(found), bool)
    for (i, span), counts in zip(found, sure.tolist(), strict=True):
        if counts:
            out[i].append(span)
    return out


def all_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and tagger's spans) of each text, each by start and kind."""
    base = [base_spans(t) for t in texts]
    out, tags, at = [], [], 0
    while at < len(texts):  # some texts at a time, or a long one: as many windows as are read at once
        end, size = at, 0
        while end < len(texts) and (end == at or size - (-len(texts[end]) // STRIDE) <= LANE):
            size -= -len(texts[end]) // STRIDE
            end += 1
        tags += tagged_spans(texts[at:end], p, accept=ACCEPT, base=base[at:end])
        at = end
    for t, own, tagged in zip(texts, base, tags, strict=True):
        more = own + [(k, *trimmed(t, a, b)) for k, a, b in tagged]
        out.append((own, sorted(more, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added (the tagger's own)."""
    p = train()
    empty = hashlib.sha256(b"").hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            rows = [(0, 0, 0, 0, empty, "", 0)] * len(texts)
            for i, (base, full) in zip(some, all_spans([texts[i] for i in some], p), strict=True):
                kinds = [k for k, _, _ in base]
                rows[i] = (*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(full), len(full) - len(base))
            c = list(zip(*rows, strict=True)) or [[]] * 7
            n = pa.int64()
            yield pa.record_batch([b.column("key"), *(pa.array(x, kind) for x, kind in zip(c, (n, n, n, n, pa.string(), pa.string(), n), strict=True))], names=["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by <KIND>; other columns as they are."""
    p = train()

    @F.arrow_udf("string")
    def cover(t: pa.Array) -> pa.Array:
        texts = t.to_pylist()
        some = [i for i, x in enumerate(texts) if x]
        for i, (_, full) in zip(some, all_spans([texts[i] for i in some], p), strict=True):
            out, at = [], 0
            for k, a, b in full:
                if b > at:
                    out += [texts[i][at : max(at, a)], f"<{k.upper()}>"] if a >= at else []
                    at = b
            texts[i] = "".join([*out, texts[i][at:]])
        return pa.array(texts, pa.string())

    return docs.withColumn(text, cover(F.col(text)))
