"""3. Personal data: a character-level bidirectional LSTM with CRF transitions.

Four kinds are found: email, ip, card, phone. The base detector takes the
leftmost, non-overlapping matches of one pattern per kind and drops those that
fail a check (address parts, digit counts, Luhn). The tagger adds spans that
the patterns miss: accented local parts, other separators, a card number with
more digits behind it, a phone number without its plus sign.

* **Training.** Labelled spans are those of the base detector. A bounded
  sample of distinct windows (``SAMPLE`` with spans, at least a quarter of that
  of each kind, as far as there are, and a third of it without) is taken by
  hash over all documents; half of the windows with spans get
  the span rewritten to a variant of its kind. Embeddings, both LSTMs and the
  CRF are trained on it in numpy with Adam.
* **Regions.** Every kind holds a digit or an at sign, so only the run of
  non-blank characters around such a character, with ``MARGIN`` on both sides,
  can hold a span; they are found in the whole text, whatever its length.
* **Windows.** A region is read in overlapping windows; each position takes
  its emission scores from the window in which it lies most central, and one
  Viterbi pass with the CRF transitions runs over the whole region. A span is
  added when its mean posterior reaches ``SURE``, it meets the definition of
  its kind, it does not touch a letter or digit outside, and overlaps no base
  span but one of its kind that it widens.

Offsets count code points; ends are exclusive. Rows: null text is the empty
text and has no spans; repeated rows get equal results; other columns stay in
``redact`` (``n_chars``, where present, is counted anew).

An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text
from cloudsift.session import staged

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 600
MARGIN, LENGTH, STEP = 32, 96, 48
#: Code points of a region that are decoded at a time, and what they see on both
#: sides: whole steps, so the windows are those of the whole region.
STRETCH, CONTEXT = 340 * STEP, 21 * STEP
SURE = 0.5

# --- base detector -----------------------------------------------------------

#: The patterns of the kinds. Possessive forms match the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ANCHOR = re.compile("[0-9@]")
_SPACE = re.compile(r"\s")
_NAME = re.compile(r"[\w.%+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _part(p: str) -> bool:
    """At most 255, whatever the leading zeros."""
    p = p.lstrip("0") or "0"
    return len(p) <= 3 and int(p) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > pos and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- tagger --------------------------------------------------------------------

_MARKS = "@.-+()_%:/,=\"'#*$&!;"
_PAD, _ANY, _LOW, _UP, _WIDE, _NUM, _BLANK, _LINE = range(8)
_SYMBOLS = 8 + len(_MARKS)
TAGS = 1 + 2 * len(KINDS)                   # outside, then begin and inside of each kind


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _table()[np.minimum(cp, 0x3000)]


_symbol_table: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _symbol_table:
        t = np.full(0x3001, _ANY, np.int64)
        for c in range(0x3000):
            s = chr(c)
            t[c] = (_LINE if c == 10 else _BLANK if s.isspace() else _NUM if "0" <= s <= "9" else
                    _LOW if "a" <= s <= "z" else _UP if "A" <= s <= "Z" else 8 + _MARKS.index(s) if s in _MARKS else _WIDE if s.isalpha() else _ANY)
        t[0x3000] = _WIDE
        _symbol_table.append(t)
    return _symbol_table[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def allowed() -> np.ndarray:
    """0 where a tag may follow another, a large negative value elsewhere:
    inside follows begin or inside of its own kind only."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


@dataclass
class Tagger:
    """Parameters by name."""
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(d: int = 12, h: int = 20, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.3, (_SYMBOLS, d)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        p["bias"][0] = 2.0
        for s in "fb":
            p["w" + s] = rng.normal(0, 0.3, (d, 4 * h))
            p["u" + s] = rng.normal(0, 0.2, (h, 4 * h))
            p["c" + s] = np.zeros(4 * h)
            p["c" + s][h:2 * h] = 1.0
        return Tagger(p)

    def _run(self, x: np.ndarray, side: str, tape: list | None) -> np.ndarray:
        """Hidden states (N, L, h) of one direction."""
        w, u, c0 = (self.p[k + side] for k in "wuc")
        n, length, _ = x.shape
        size = u.shape[0]
        z_all = x @ w + c0
        h, c = np.zeros((n, size)), np.zeros((n, size))
        out = np.empty((n, length, size))
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = z_all[:, t] + h @ u
            gate = _sigmoid(z[:, :3 * size])
            i, f, o = gate[:, :size], gate[:, size:2 * size], gate[:, 2 * size:]
            g = np.tanh(z[:, 3 * size:])
            new = f * c + i * g
            th = np.tanh(new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            out[:, t] = h
        return out

    def emissions(self, ids: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        x = self.p["emb"][ids]
        hidden = []
        for s in "fb":
            tape = [] if tapes is not None else None
            hidden.append(self._run(x, s, tape))
            if tapes is not None:
                tapes[s] = tape
        both = np.concatenate(hidden, 2)
        if tapes is not None:
            tapes["x"], tapes["both"] = x, both
        return both @ self.p["out"] + self.p["bias"]

    def transitions(self) -> np.ndarray:
        return self.p["trans"] + allowed()

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        tapes: dict = {}
        e = self.emissions(ids, tapes)
        n, length, _ = e.shape
        tr = self.transitions()
        alpha, beta = forward_backward(e, np.full(n, length), tr)
        z = _lse(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(n)[:, None]
        gold = np.zeros_like(e)
        gold[rows, np.arange(length), tags] = 1
        de = (post - gold) / n
        dtr = np.zeros_like(tr)
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + tr + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            dtr += pair.sum(0)
        np.add.at(dtr, (tags[:, :-1], tags[:, 1:]), -1)
        score = e[rows, np.arange(length), tags].sum() + tr[tags[:, :-1], tags[:, 1:]].sum()
        grad = {"trans": dtr / n, "out": np.einsum("nlh,nlt->ht", tapes["both"], de), "bias": de.sum((0, 1))}
        dboth = de @ self.p["out"].T
        size = dboth.shape[2] // 2
        dx = np.zeros_like(tapes["x"])
        for s, part in (("f", dboth[:, :, :size]), ("b", dboth[:, :, size:])):
            dw, du, dc0, dx_s = self._back(tapes["x"], part, tapes[s], s)
            grad |= {"w" + s: dw, "u" + s: du, "c" + s: dc0}
            dx += dx_s
        demb = np.zeros_like(self.p["emb"])
        np.add.at(demb, ids, dx)
        grad["emb"] = demb
        return float((z.sum() - score) / n), grad

    def _back(self, x, dh_all, tape, side):
        w, u = self.p["w" + side], self.p["u" + side]
        size = u.shape[0]
        dz_all = np.zeros((*x.shape[:2], 4 * size))
        du = np.zeros_like(u)
        dh = np.zeros((len(x), size))
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, th in reversed(tape):
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            du += h.T @ dz
            dh = dz @ u.T
            dc = dc * f
        return np.einsum("nld,nlk->dk", x, dz_all), du, dz_all.sum((0, 1)), dz_all @ w.T


def forward_backward(e: np.ndarray, size: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log forward and backward scores (N, L, T) of sequences of ``size``
    positions; an inside tag cannot come first."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + tr[0] * (tr[0] < -1e3)
    for t in range(1, length):
        alpha[:, t] = np.where((t < size)[:, None], _lse(alpha[:, t - 1, :, None] + tr, 1) + e[:, t], alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        beta[:, t] = np.where((t + 1 < size)[:, None], _lse(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
    return alpha, beta


def viterbi(e: np.ndarray, size: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best tags (N, L); positions from a sequence's end on are outside."""
    n, length, k = e.shape
    best = e[:, 0] + tr[0] * (tr[0] < -1e3)
    back = np.zeros((n, length, k), np.int8)
    for t in range(1, length):
        s = best[:, :, None] + tr
        live = (t < size)[:, None]
        back[:, t] = np.where(live, s.argmax(1), np.arange(k))
        best = np.where(live, s.max(1) + e[:, t], best)
    out = np.zeros((n, length), np.int64)
    at = best.argmax(1)
    for t in range(length - 1, -1, -1):
        out[:, t] = np.where(t < size, at, 0)
        at = back[np.arange(n), t, at]
    return out


def fit(windows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 250, batch: int = 96, rate: float = 0.03, seed: int = 11) -> Tagger:
    """Train on windows with their spans (offsets in the window)."""
    model, rng = Tagger.fresh(), np.random.default_rng(seed)
    if not windows:
        return model
    ids, tags = np.full((len(windows), LENGTH), _PAD), np.zeros((len(windows), LENGTH), np.int64)
    for r, (text, spans) in enumerate(windows):
        s = symbols(text[:LENGTH])
        ids[r, :len(s)] = s
        for kind, a, b in spans:
            if b <= LENGTH:
                tags[r, a:b] = 2 + 2 * KINDS.index(kind)
                tags[r, a] -= 1
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(ids))
        pick, order = order[:batch], order[batch:]
        _, grad = model.gradient(ids[pick], tags[pick])
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        lr = rate * (1 - (step - 1) / steps)
        for k, g in grad.items():
            g = g / max(1.0, norm / 5)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            model.p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


# --- finding ---------------------------------------------------------------------

def surroundings(text: str) -> list[tuple[int, int]]:
    """Surroundings of digits and at signs, merged."""
    return _merged(text, ((m.start(), m.end()) for m in _ANCHOR.finditer(text)))


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of non-blank characters that hold a digit or an at sign, with their
    surroundings, merged."""
    return _merged(text, _runs(text))


def _runs(text: str):
    """The runs of non-blank characters around digits and at signs."""
    end = 0
    m = _ANCHOR.search(text)
    while m:
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        blank = _SPACE.search(text, m.end())
        end = blank.start() if blank else len(text)
        yield a, end
        m = _ANCHOR.search(text, end)


def _merged(text: str, spots) -> list[tuple[int, int]]:
    """The spots with MARGIN on both sides."""
    out: list[tuple[int, int]] = []
    for a, b in spots:
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def meets(kind: str, s: str) -> bool:
    """Whether a span has what its kind needs."""
    d = _digits(s)
    if kind == "email":
        name, _, host = s.partition("@")
        return bool(name) and "@" not in host and "." in host.strip(".") and not re.search(r"\s", s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9.\s]", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 .-]", s)
    return 9 <= len(d) <= 15 and len(s) > len(d) and not re.search(r"[^0-9 ().+-]", s)


def _inner_card(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The longest run of a tagged span's digit groups that is a card number,
    else the span as it is."""
    groups = [(m.start() + lo, m.end() + lo) for m in re.finditer("[0-9]+", text[lo:hi])]
    most, found = 0, (lo, hi)
    for i, (a, _) in enumerate(groups):
        digits = 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 13 and j - i >= most and meets("card", text[a:groups[j][1]]):
                most, found = j - i + 1, (a, groups[j][1])
    return found


def _whole_email(text: str, lo: int, hi: int) -> tuple[int, int]:
    """A tagged address with the rest of its name and host, which may reach
    beyond the windows that see its at sign, and without marks at its end; a
    span that is no part of an address as it is."""
    at = text.find("@", lo, hi)
    if at < 0:                                          # in what follows, or before
        at = text.find("@", hi)
        if at < 0 or _NAME.match(text, hi, at).end() < at:
            at = text.rfind("@", 0, lo)
            if at < 0 or _NAME.match(text, at + 1, lo).end() < lo:
                return lo, hi
    lo = min(lo, at)
    while lo and _NAME.match(text, lo - 1, lo).end() == lo:
        lo -= 1
    host = _DOMAIN.match(text, at + 1)
    hi = max(hi, host.end() if host else hi)
    while hi > at + 1 and not text[hi - 1].isalnum():
        hi -= 1
    return lo, hi


def stretches(a: int, b: int):
    """(start, end, own start, own end) of the parts in which a region is
    decoded: the whole region, or beyond STRETCH code points parts of that
    size with CONTEXT more on both sides. A part yields the spans that begin in
    its own code points, so memory does not grow with the region; a span of
    more than CONTEXT code points may be cut."""
    if b - a <= STRETCH + 2 * CONTEXT:
        yield a, b, a, b
        return
    for lo in range(a, b, STRETCH):
        hi = min(b, lo + STRETCH)
        yield max(a, lo - CONTEXT), min(b, hi + CONTEXT), lo, hi


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each text, before base spans are looked at."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo = sorted((b - a, r, a, b, lo, hi) for r, t in enumerate(texts) for region in regions(t) for a, b, lo, hi in stretches(*region))
    i = 0
    while i < len(todo):
        j = i + 1
        while j < len(todo) and (j + 1 - i) * todo[j][0] <= 100_000:
            j += 1
        _decode(model, texts, todo[i:j], out)
        i = j
    return [sorted(x, key=lambda s: (KINDS.index(s[0]), s[1])) for x in out]


def _decode(model: Tagger, texts: list[str], some: list, out: list) -> None:
    """One batch of regions: windows, emissions, one path per region."""
    size = np.array([x[0] for x in some])
    count = np.maximum(1, -(-(size - LENGTH) // STEP) + 1)
    ids = np.full((int(count.sum()), LENGTH), _PAD)
    first = np.cumsum(count) - count
    for k, (_, r, a, b, *_) in enumerate(some):
        s = symbols(texts[r][a:b])
        for c in range(int(count[k])):
            part = s[c * STEP:c * STEP + LENGTH]
            ids[first[k] + c, :len(part)] = part
    e_win = np.concatenate([model.emissions(ids[i:i + 500]) for i in range(0, len(ids), 500)])
    top = int(size.max())
    pos = np.arange(top)
    own = np.clip((pos[None, :] - (LENGTH - STEP) // 2) // STEP, 0, count[:, None] - 1)
    inside = np.clip(pos[None, :] - own * STEP, 0, LENGTH - 1)
    e = e_win[first[:, None] + own, inside]
    tr = model.transitions()
    path = viterbi(e, size, tr)
    if not path.any():
        return
    hit = np.flatnonzero(path.any(1))
    alpha, beta = forward_backward(e[hit], size[hit], tr)
    post = np.exp(alpha + beta - _lse(alpha[:, -1], 1)[:, None, None])
    for k, row, sure in zip(hit.tolist(), path[hit], post):
        _, r, a, b, own_lo, own_hi = some[k]
        text = texts[r]
        begin = np.flatnonzero(row % 2 == 1)
        for s in begin.tolist():
            if not own_lo <= a + s < own_hi:
                continue
            end = s + 1
            while end < b - a and row[end] == row[s] + 1:
                end += 1
            lo, hi = a + s, a + end
            kind = KINDS[(int(row[s]) - 1) // 2]
            if kind == "card" and not meets(kind, text[lo:hi]):
                lo, hi = _inner_card(text, lo, hi)
            elif kind == "email":
                lo, hi = _whole_email(text, lo, hi)
            alone = not (lo and text[lo - 1].isalnum()) and not (hi < len(text) and text[hi].isalnum())
            if alone and sure[np.arange(s, end), row[s:end]].mean() >= SURE and meets(kind, text[lo:hi]):
                out[r].append((kind, lo, hi))


def _widens(text: str, s: tuple, o: tuple) -> bool:
    """Whether a span contains another of its kind and adds letters or digits
    to it (such as the accented start of an address)."""
    more = text[s[1]:o[1]] + text[o[2]:s[2]]
    return s[0] == o[0] and s[1] <= o[1] and o[2] <= s[2] and any(c.isalnum() for c in more)


class _Spans:
    """Spans by kind and start, with the longest of each kind: what a span
    meets is found without looking at all."""

    def __init__(self, spans: list):
        self.by_kind: dict[str, tuple[list, list, list]] = {k: ([], [], [0]) for k in KINDS}
        for s in spans:
            self.add(s)

    def add(self, s: tuple) -> None:
        starts, spans, longest = self.by_kind[s[0]]
        at = bisect.bisect_right(starts, s[1])
        starts.insert(at, s[1])
        spans.insert(at, s)
        longest[0] = max(longest[0], s[2] - s[1])

    def met(self, s: tuple):
        for starts, spans, longest in self.by_kind.values():
            for o in spans[bisect.bisect_left(starts, s[1] - longest[0]):bisect.bisect_left(starts, s[2])]:
                if s[1] < o[2]:
                    yield o


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, tagged(model, texts)):
        base, extra = base_spans(text), []
        known = _Spans(base)
        for s in more:
            if all(_widens(text, s, o) for o in known.met(s)):
                extra.append(s)
                known.add(s)
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


# --- Spark -------------------------------------------------------------------------

def _texts(col: pa.Array):
    for i, j in _text.spans(_text.utf8(col)[1]):
        yield i, j, [x or "" for x in col[i:j].to_pylist()]


def _windows(docs: DataFrame) -> DataFrame:
    """Distinct windows (piece, spans as text) around base spans, and around
    anchors that lie in none."""
    def run(batches):
        for b in batches:
            for _, _, texts in _texts(b.column(0)):
                rows = []
                for t in texts:
                    base = base_spans(t)
                    spots = [(a, z) for _, a, z in base] + [x for x in surroundings(t) if not any(x[0] < z and a < x[1] for _, a, z in base)]
                    for a, z in spots:
                        lo = max(0, (a + z - LENGTH) // 2)
                        inside = [(k, s - lo, e - lo) for k, s, e in base if s >= lo and e <= lo + LENGTH]
                        rows.append((t[lo:lo + LENGTH], ",".join(f"{k}:{s}:{e}" for k, s, e in inside)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["piece", "spans"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "piece string, spans string").distinct()


def _varied(piece: str, spans: list, rng) -> tuple[str, list]:
    """The window with its first span rewritten to a variant of the kind."""
    if len(spans) != 1:
        return piece, spans
    kind, a, b = spans[0]
    s = piece[a:b]
    if kind == "email":
        at = [i for i, c in enumerate(s) if c in "aeiou"]
        if at:
            i = at[rng.integers(len(at))]
            s = s[:i] + "áéíóú"["aeiou".index(s[i])] + s[i + 1:]
    elif kind == "phone":
        s = s[1:] if rng.random() < 0.5 else s.replace(") ", ")-").replace(" ", ".")
    elif kind == "card":
        d = _digits(s)
        sep = [".", " ", "-"][rng.integers(3)]
        s = sep.join(d[i:i + 4] for i in range(0, len(d), 4))
    else:
        s = s.replace(".", " . ")
    shift = len(s) - (b - a)
    return (piece[:a] + s + piece[b:])[:LENGTH], [(kind, a, b + shift)] if b + shift <= LENGTH else []


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger from a bounded sample of the documents' windows: ``sample``
    with spans, more of a kind that has less than a quarter of that among them,
    and a third of it without."""
    w = staged(_windows(docs), "pii-windows")
    key = F.xxhash64("piece", "spans")
    first = lambda cond, n: w.filter(cond).orderBy(key, "piece").limit(n).collect()
    rows = first("spans <> ''", sample)
    for kind in KINDS:
        holds = lambda r: f"{kind}:" in r.spans  # noqa: B023, E731
        if len(rows) == sample and sum(map(holds, rows)) < sample // 4:
            rows += sorted(set(first(f"contains(spans, '{kind}:')", sample // 4)) - set(rows))
    rows += first("spans = ''", sample // 3)
    rng = np.random.default_rng(5)
    windows = []
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        windows.append((r.piece, spans))
        if spans and rng.random() < 0.5:
            windows.append(_varied(r.piece, spans, rng))
    return fit(windows)


def _shown(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, number of all spans of each kind among the base ones, digest of
    the base spans, all spans, and the number of added ones."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        for b in batches:
            for i, j, texts in _texts(b.column(1)):
                rows = []
                for base, every in find_spans(bc.value, texts):
                    kinds = [k for k, _, _ in base]
                    rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every), len(every) - len(base)))
                cols = [pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cols], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, spans: list) -> str:
    """The text with each span replaced by its kind's mark; spans that overlap
    (a phone in a longer match of another kind) are replaced as one."""
    out, pos = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= pos:
            out += [text[pos:a], f"<{kind.upper()}>"]
        pos = max(pos, b)
    return "".join([*out, text[pos:]])


def redact(docs: DataFrame, model: Tagger) -> DataFrame:
    """``docs`` with all spans of ``text`` masked; other columns stay."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None
    kind = docs.schema["n_chars"].dataType.simpleString() if size is not None else None

    def run(batches):
        for b in batches:
            for i, j, texts in _texts(b.column(at)):
                new = [masked(t, every) for t, (_, every) in zip(texts, find_spans(bc.value, texts))]
                cols = [c[i:j] for c in b.columns]
                nulls = cols[at].is_null().to_pylist()
                cols[at] = pa.array([None if n else t for t, n in zip(new, nulls)], pa.string())
                if kind in ("bigint", "int"):
                    old = cols[size].to_pylist()
                    cols[size] = pa.array([o if n or o is None else len(t) for t, n, o in zip(new, nulls, old)], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
