"""5. Language ID with language-bitmask n-gram filters.

Letters are lower-cased, everything else is one space; the n-grams are the
windows of ``SIZES`` code points of that. A language contains an n-gram when
the n-gram's share of the language's n-grams reaches ``RATE`` and a quarter of
the highest share it has in any language. So a language keeps at most
1 / RATE n-grams of a size, whatever the corpus, and that bounds what the
driver collects and broadcasts.

The filters of all languages are one bit-sliced Bloom filter: a slot holds a
bitmask with a bit per language. The AND of an n-gram's ``HASHES`` slots gives
all languages that contain it, in one look. Per text and language the hits are
counted, and the count is corrected for the filter's false positives, whose
rate follows from the share of its bits that are set. The highest corrected
count decides; the score is its share of the sum over all languages.

Learning counts the n-grams of all training documents, in each task and then
in Spark. Only the text is an input of a prediction.

Rows: null text, and text without a letter, is ``und`` with score 0; a text
whose n-grams no language contains gets the language with most training
n-grams, with score 0; ties go to the first language in alphabetical order;
repeated rows are predicted alike; with no training rows every text is
``und``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text
from cloudsift.session import staged

SIZES = (3, 4)
RATE = 1e-5
HASHES = 3
UNKNOWN = "und"
_HELD = 1 << 20             # n-grams of all languages that a task holds before it adds them up


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 32 for all other code points."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


def ngrams(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams of a chunk of UTF-8 texts, rows in order,
    and whether each row has a letter."""
    n = len(offs) - 1
    cp = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    at = lead[offs]                                     # offsets in code points
    # a space before each text keeps the texts apart
    size = np.diff(at)
    low = np.full(len(cp) + n, 32, np.uint32)
    row = np.repeat(np.arange(n), size + 1)
    begin = at[:-1] + np.arange(n)
    inside = np.ones(len(low), bool)
    inside[begin] = False
    low[inside] = _letters()[cp]
    letter = low != 32
    some = np.bincount(row[letter], minlength=n) > 0
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1]                             # the first space of a run
    keep[begin] = True
    low, row = low[keep].astype(np.uint64), row[keep]
    rows, hashes = [], []
    with np.errstate(over="ignore"):
        for k in SIZES:
            m = len(low) - k + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for i in range(k):
                h = (h << np.uint64(15)) + h + low[i:m + i] * np.uint64(_text._BASE)
            same = row[:m] == row[k - 1:]
            rows.append(row[:m][same])
            hashes.append(_text.mix64(h[same] + np.uint64(k)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), some
    row, h = np.concatenate(rows), np.concatenate(hashes)
    return row, h, some


@dataclass
class Filters:
    """The learned languages, most frequent one, and the bit-sliced filter:
    ``slots`` x words of 64 languages."""
    languages: list[str]
    usual: int
    slots: np.ndarray
    fill: np.ndarray

    def places(self, h: np.ndarray):
        mask = np.uint64(len(self.slots) - 1)
        for i in range(HASHES):
            yield ((h >> np.uint64(20 * i)) & mask).astype(np.int64)

    def predict(self, b: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        return self.judge(b, offs)[:2]

    def judge(self, b: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, share of the text's own n-grams that the language
        holds) of each text. The share does not depend on how many languages
        there are."""
        n = len(offs) - 1
        row, h, some = ngrams(b, offs)
        hits = np.zeros((n, len(self.languages)))
        masks = [functools.reduce(np.bitwise_and, (self.slots[p, w] for p in self.places(h))) for w in range(self.slots.shape[1])]
        total = np.bincount(row, minlength=n)
        for k in range(len(self.languages)):
            bit = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits[:, k] = np.bincount(row, weights=bit, minlength=n)
        wrong = self.fill ** HASHES                     # false positive rate per language
        hits = np.maximum(0, (hits - wrong * total[:, None]) / (1 - wrong))
        best = hits.argmax(1)
        of = hits.sum(1)
        best[of == 0] = self.usual
        score = np.where((of > 0) & some, hits[np.arange(n), best] / np.maximum(of, 1e-300), 0.0)
        share = np.where(some, hits[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return [self.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist())], score, share


def _build(rows: list, totals: dict[str, int]) -> Filters | None:
    languages = sorted(totals)
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    usual = max(languages, key=lambda x: (totals[x], -number[x]))
    bits = max(12, (8 * HASHES * max(1, len(rows)) // len(languages)).bit_length())
    f = Filters(languages, number[usual], np.zeros((1 << min(bits, 20), (len(languages) + 63) // 64), np.uint64), np.zeros(0))
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    k = np.array([number[r.lang] for r in rows], np.int64)
    bit = np.uint64(1) << (k % 64).astype(np.uint64)
    for p in f.places(h):
        np.bitwise_or.at(f.slots, (p, k // 64), bit)
    f.fill = np.array([((f.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return f


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of (n-grams, counts) pairs, with summed counts."""
    u, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate([m for _, m in parts]), minlength=len(u)).astype(np.int64)


def learn(train: DataFrame) -> Filters | None:
    """Filters from all rows of ``train`` (text, lang); rows with null lang or
    text are left out. None without training rows."""
    known = train.filter("lang is not null and text is not null")

    def count(batches):
        """N-gram counts of a task, added up before the shuffle."""
        held: dict[str, list] = {}
        size = 0

        def out():
            for name, parts in held.items():
                for u, m in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(m)], names=["lang", "h", "n"])

        for b in batches:
            langs = b.column(1).to_pylist()
            for i, j, raw, offs in _text.chunks(b.column(0)):
                row, h, _ = ngrams(raw, offs)
                names = sorted(set(langs[i:j]))
                number = {x: c for c, x in enumerate(names)}
                code = np.array([number[x] for x in langs[i:j]])
                k = code[row] if len(row) else np.zeros(0, np.int64)
                for c, name in enumerate(names):
                    u, m = np.unique(h[k == c], return_counts=True)
                    held.setdefault(name, []).append((u, m))
                    size += len(u)
                if size >= _HELD:
                    held = {name: [_added(parts)] for name, parts in held.items()}
                    size = sum(len(u) for parts in held.values() for u, _ in parts)
                    if size >= _HELD // 2:
                        yield from out()
                        held, size = {}, 0
        held = {name: [_added(parts)] for name, parts in held.items()}
        yield from out()

    counts = known.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, h long, n long")
    summed = counts.groupBy("lang", "h").agg(F.sum("n").alias("n"))
    summed = staged(summed, "langid-counts")
    totals = {r.lang: r.n for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}     # one row per language
    if not totals:
        return None
    size_of = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])
    rate = summed.withColumn("rate", F.col("n") / size_of[F.col("lang")])
    often = rate.filter(F.col("rate") >= RATE)           # at most 1 / RATE rows per language
    top = rate.groupBy("h").agg(F.max("rate").alias("top"))
    rows = often.join(top, "h").filter(4 * F.col("rate") >= F.col("top")).select("lang", "h").collect()
    return _build(rows, totals)


def training(docs: DataFrame) -> DataFrame:
    """(text, lang) of the documents to learn from: crc32 of the id's text,
    modulo 5, is not 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return docs.filter(fold != 0).select("text", "lang", "doc_id")


def predict(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    bc = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = bc.value
        for b in batches:
            for i, j, raw, offs in _text.chunks(b.column(1)):
                langs, score = f.predict(raw, offs) if f else ([UNKNOWN] * (j - i), np.zeros(j - i))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def select_known(docs: DataFrame, filters: Filters | None, least: float = 0.0) -> DataFrame:
    """``docs`` whose best language holds at least the share ``least`` of their
    n-grams; all columns stay. Without filters every document stays."""
    bc = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def run(batches):
        f = bc.value
        for b in batches:
            keep = [np.zeros(0, bool)]
            for i, j, raw, offs in _text.chunks(b.column(at)):
                if f:
                    langs, _, share = f.judge(raw, offs)
                    keep.append((np.array(langs) != UNKNOWN) & (share >= least))
                else:
                    keep.append(np.ones(j - i, bool))
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
