"""9. Quality rules: line-first cleaning.

Every line of a text is judged by itself; lines that fail are removed, and a
document that loses too much of its text goes.

* **Punctuation.** A line fails when it carries more than one sign of
  ``[#*$%&|<>]`` per two words, or more than one exclamation mark per two
  words, or is a fragment: fewer than ``open_words`` words and no closing
  punctuation at its end. (A long line that breaks off is text.)
* **Navigation.** A line fails when two or more of its words, and at least a
  fifth of them, are bare separators (``|``, ``>``, ``»``, ``·``, ``/``).
* **Boilerplate.** A line fails when it holds one of ``BOILERPLATE``, or when
  it repeats an earlier line of the text.

A document is rejected when ``base`` rules on the whole text fail (too few
words, too many repeated ones) or when the failed lines hold more than
``max_lost`` of the code points in words.

Rows: null text has no words and fails the base rules; repeated rows are
judged alike; other columns stay untouched in ``clean``.

An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text

#: Phrases (lower case) of lines that are not content.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript",
    "licensed under", "lorem ipsum", "permission is hereby granted", "privacy policy", "sign up for our newsletter",
    "skip to content", "spdx-license-identifier", "subscribe to our", "terms of service", "terms of use",
]
MIN_WORDS, MAX_REPEAT = 50, 50
MAX_LOST, OPEN_WORDS = 0.5, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ".!?:;\"')]}"]] = True
#: Closing punctuation outside ASCII, as the last two or three bytes.
_CLOSE_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "»›”’…。！？」』"])
_SEPARATORS = [s.encode() for s in ("|", ">", "»", "·", "/", "||", ">>")]


def _sum(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0], np.cumsum(flags)])
    return acc[end] - acc[start]


class Judged:
    """The lines of a chunk and the rules' results. Lines are the pieces
    between newlines that hold a word."""

    def __init__(self, b: np.ndarray, offs: np.ndarray, open_words: int = OPEN_WORDS):
        n = len(offs) - 1
        self.w = w = _text.Words(b, offs)
        lead = (b & 0xC0) != 0x80
        word_byte = ~_text._space[b]
        self.word_chars = _sum(lead & word_byte, offs[:-1], offs[1:])
        symbol = _SYMBOL[b]
        self.symbols = _sum(symbol, offs[:-1], offs[1:])
        # lines
        stop = np.flatnonzero(b == 10)
        edges = np.unique(np.concatenate([offs, stop, stop + 1]))
        start, end = edges[:-1], edges[1:]
        row = np.searchsorted(offs, start, "right") - 1
        first, after = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        full = after > first
        self.start, self.end, self.row, first, after = (x[full] for x in (start, end, row, first, after))
        self.words = after - first
        self.chars = _sum(lead & word_byte, self.start, self.end)
        h = _text.run_hash(_text._byte_code[b], self.start, self.end)
        order = np.lexsort((np.arange(len(h)), h, self.row))
        again = np.zeros(len(h), bool)
        if len(h):
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])
        self.dup_lines = np.bincount(self.row[again], minlength=n)
        # words in repeated windows of three
        wh, wr = w.hash, w.row
        covered = np.zeros(len(wh), bool)
        if len(wh) >= 3:
            with np.errstate(over="ignore"):
                c = _text.seeds(3, salt=2) | np.uint64(1)
                win = _text.mix64(wh[:-2] * c[0] + wh[1:-1] * c[1] + wh[2:] * c[2])
            at = np.flatnonzero(wr[:-2] == wr[2:])
            o = at[np.lexsort((win[at], wr[at]))]
            same = np.zeros(len(o) + 1, bool)
            same[1:-1] = (win[o[1:]] == win[o[:-1]]) & (wr[o[1:]] == wr[o[:-1]])
            hit = o[same[1:] | same[:-1]]
            for k in range(3):
                covered[hit + k] = True
        self.repeat_words = np.bincount(wr[covered], minlength=n)
        # the rules
        self.punctuation = self._punctuation(b, symbol, first, after, open_words)
        bare = np.isin(w.hash, self._separator_hashes())
        bars = _sum(bare, first, after)
        self.navigation = (bars >= 2) & (5 * bars >= self.words)
        self.boilerplate = again | self._boilerplate(b)
        self.failed = self.punctuation | self.navigation | self.boilerplate
        self.lost = np.bincount(self.row[self.failed], weights=self.chars[self.failed], minlength=n)

    @staticmethod
    def _separator_hashes() -> np.ndarray:
        size = np.array([len(s) for s in _SEPARATORS])
        end = np.cumsum(size)
        return _text.run_hash(_text._byte_code[np.frombuffer(b"".join(_SEPARATORS), np.uint8)], end - size, end)

    def _punctuation(self, b, symbol, first, after, open_words) -> np.ndarray:
        if not len(first):
            return np.zeros(0, bool)
        w = self.w
        last = w.end[after - 1]                     # end of the line's last word
        closed = _CLOSE[b[last - 1]]
        wide = np.flatnonzero(b[last - 1] >= 0x80)
        x = last[wide]
        two = b[x - 2].astype(np.int64) << 8 | b[x - 1]
        three = b[np.maximum(x - 3, 0)].astype(np.int64) << 16 | two
        closed[wide] = np.isin(two, _CLOSE_WIDE) | np.isin(three, _CLOSE_WIDE)
        signs = _sum(symbol, self.start, self.end)
        shouts = _sum(b == 0x21, self.start, self.end)
        return (2 * signs > self.words) | (2 * shouts > self.words) & (shouts > 1) | ~closed & (self.words < open_words)

    def _boilerplate(self, b) -> np.ndarray:
        out = np.zeros(len(self.start), bool)
        text = _text.lower_ascii(b).tobytes()
        for phrase in BOILERPLATE:
            p = phrase.encode()
            at = text.find(p)
            while at >= 0:
                k = int(np.searchsorted(self.start, at, "right")) - 1
                if k >= 0 and at + len(p) <= self.end[k]:
                    out[k] = True
                at = text.find(p, at + len(p))
        return out


def judge(docs: DataFrame, max_lost: float = MAX_LOST, open_words: int = OPEN_WORDS) -> DataFrame:
    """doc_id, the counts over the whole text, how many word code points the
    failed lines of each rule hold, and the verdicts."""
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
              " base_failed boolean, kept boolean, n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, lost_chars long")

    def run(batches):
        for b in batches:
            for i, j, raw, offs in _text.chunks(b.column(1)):
                g, n = Judged(raw, offs, open_words), j - i
                words = g.w.count
                failed = (words < MIN_WORDS) | (100 * g.repeat_words > MAX_REPEAT * words)
                kept = ~failed & (g.lost <= max_lost * g.word_chars)
                cols = [words, g.word_chars, g.symbols, g.dup_lines, g.repeat_words, failed, kept, np.bincount(g.row, minlength=n)]
                cols += [np.bincount(g.row[x], minlength=n) for x in (g.punctuation, g.navigation, g.boilerplate)] + [g.lost.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *[pa.array(c) for c in cols]], names=[c.split()[0] for c in schema.split(",")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, max_lost: float = MAX_LOST, open_words: int = OPEN_WORDS) -> DataFrame:
    """``docs`` without rejected documents, and without the failed lines of
    the others (a line goes with its newline). All columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            for i, j, raw, offs in _text.chunks(b.column(at)):
                g = Judged(raw, offs, open_words)
                words = g.w.count
                keep = (words >= MIN_WORDS) & (100 * g.repeat_words <= MAX_REPEAT * words) & (g.lost <= max_lost * g.word_chars)
                body, texts = raw.tobytes(), [None] * (j - i)
                bad = np.flatnonzero(g.failed)
                lo, hi = np.searchsorted(g.row[bad], [np.arange(j - i), np.arange(1, j - i + 1)])
                for r in np.flatnonzero(keep).tolist():
                    parts, pos = [], int(offs[r])
                    for k in bad[lo[r]:hi[r]].tolist():
                        parts.append(body[pos:g.start[k]])
                        pos = int(g.end[k])
                        pos += pos < offs[r + 1] and body[pos] == 10
                    texts[r] = b"".join([*parts, body[pos:offs[r + 1]]]).decode()
                cols = [pa.array(texts, pa.string()) if k == at else c[i:j] for k, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
