"""12. Spelling variant grouping by Bloom-guided neighbourhoods.

Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` (A-Z lower-cased; one occurrence
in ``NOISE`` loses a code point, chosen by the crc32 of ``<doc_id>:<run>``) of
at least ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times.

* **Counts.** Distinct words per half megabyte of text leave the Python task;
  Spark adds them up (partial sums, no hot word).
* **Probing.** Every word generates its deletions and replacements. Each edit's
  hash follows from the word's prefix sums and is looked up in a broadcast
  Bloom filter that has a shard per word length. (An insertion is a deletion of
  the other word, so it needs no probe.)
* **Exact join.** Only edits the filter may hold are shuffled, and joined with
  the vocabulary by their text, which removes the false positives. The filter
  is at most 64 MB however large the vocabulary; a fuller one says yes more
  often and changes no result.
* **Forms and roots.** The form of a word is its near word of largest n, if
  that is ``RATIO`` times its own; forms grow by that factor, so a chain is
  logarithmic and doubling steps (root of root) end after a number of joins
  known from the largest n.

Rows: null and empty texts have no words; runs of any length are taken whole;
repeated rows count again; ties go to the smallest word in code-point order;
a null doc_id stands as an empty one in the noise. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _filter
from cloudsift.llm._text import chunks, lower_ascii, mix64, run_hash, seeds
from cloudsift.session import staged

NOISE, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of this length or more share a filter shard.
LONGEST_SHARD = 64
#: Probes of a task are made for so many words at a time.
WORDS = 2000

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_byte_codes = seeds(256, salt=31)
_LEAD = 0xC3                                            # first byte of U+00C0 .. U+00FF


# ------------------------------------------------------------------ counts

@functools.lru_cache(1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@functools.lru_cache(1)
def _advance(longest: int = 64) -> np.ndarray:
    """[length, byte, value]: what a crc becomes when ``length`` bytes follow
    (the crc of the whole is that, xor the crc of those bytes)."""
    table, state = _crc_table(), np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    value = np.arange(256)
    for length in range(longest + 1):
        for k in range(4):
            for bit in range(8):
                out[length, k] ^= np.where(value >> bit & 1, state[8 * k + bit], 0).astype(np.uint32)
        state = table[state & np.uint32(255)] ^ state >> np.uint32(8)
    return out


def runs(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, byte start, byte end, code points) of the runs of a chunk."""
    lead = b == _LEAD
    member = _letter[b] | lead
    member[1:] |= lead[:-1]
    cut = np.zeros(len(b) + 1, bool)
    cut[offs] = True
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | cut[1:-1]
    last[:-1] &= ~member[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return np.searchsorted(offs, start, "right") - 1, start, end, end - start - (leads[end] - leads[start])


def crcs(prefix: np.ndarray, words: list[bytes], of: np.ndarray, prefixes: list[bytes], row: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word for each occurrence (``of``: its word, ``row``:
    its prefix); ``prefix`` holds the prefixes' crcs."""
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    length = np.array([len(w) for w in words])[of]
    table, p = _advance(), prefix[row]
    at = np.minimum(length, table.shape[0] - 1)
    out = own[of]
    for k in range(4):
        out = out ^ table[at, k, p >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(length >= table.shape[0]):
        out[i] = zlib.crc32(words[of[i]], zlib.crc32(prefixes[row[i]]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each chunk, the noise applied."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, j, b, offs in chunks(batch.column(1)):
            b = lower_ascii(b)
            row, start, end, length = runs(b, offs)
            long = length >= LEAST_LENGTH                     # the noise only shortens
            row, start, end, length = row[long], start[long], end[long], length[long]
            _, at, of = np.unique(run_hash(_byte_codes[b], start, end), return_index=True, return_inverse=True)
            words = [b[start[k]:end[k]].tobytes() for k in at]
            prefixes = [b"%s:" % (b"" if v is None else str(v).encode()) for v in ids[i:j]]
            if not words:
                continue
            h = crcs(np.array([zlib.crc32(p) for p in prefixes], np.uint32), words, of, prefixes, row)
            hit = h % NOISE == 0
            n = np.bincount(of[~hit], minlength=len(words))
            texts, counts = [w.decode() for w in words], n.tolist()
            for k in np.flatnonzero(hit):
                if length[k] > LEAST_LENGTH:
                    drop = int(h[k]) % int(length[k])
                    word = texts[of[k]]
                    texts.append(word[:drop] + word[drop + 1:])
                    counts.append(1)
            keep = np.array(counts) > 0
            yield pa.RecordBatch.from_arrays([pa.array(texts).filter(pa.array(keep)), pa.array(counts, pa.int64()).filter(pa.array(keep))], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n, length, hash of the word; staged."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return staged(counted.mapInArrow(_hashed, "word string, n bigint, length int, hash bigint"), "vocabulary")


# ------------------------------------------------------------------ probing

_BASE = 0x9E3779B97F4A7C15                              # any odd constant
_INVERSE = pow(_BASE, -1, 1 << 64)


def _codes(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(points.astype(np.uint64) + np.uint64(0x51ED27))


def _power(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def _sums(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first code point of each word, position inside its word of
    each, running sums of code * base^position)."""
    length = np.array([len(w) for w in words])
    first = np.cumsum(length) - length
    points = _points(words)
    place = np.arange(len(points)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        terms = _codes(points) * _power(int(length.max(initial=0)))[place]
        return points, first, place, np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])


def word_hashes(words: list[str]) -> np.ndarray:
    """Polynomial hash of each word over its code points."""
    length = np.array([len(w) for w in words], np.int64)
    _, first, _, acc = _sums(words)
    with np.errstate(over="ignore"):
        return mix64(acc[first + length] - acc[first])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(0).to_pylist()
        if words:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int32()),
                                              pa.array(word_hashes(words).view(np.int64))], names=["word", "n", "length", "hash"])


def edits(words: list[str], alphabet: np.ndarray, asked) -> Iterator[tuple[int, str]]:
    """(word's index, edit) of the deletions and replacements that ``asked``
    (hashes, lengths → bool) may hold. A replacement puts in a greater code
    point than it takes out: the other direction is the other word's edit."""
    points, first, place, acc = _sums(words)
    length = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), length)
    power = _power(int(length.max(initial=0)))[place]
    start, whole = acc[first][owner], (acc[first + length] - acc[first])[owner]
    with np.errstate(over="ignore"):
        left = acc[:-1] - start
        gone = left + (whole - (acc[1:] - start)) * np.uint64(_INVERSE)
        twice = np.zeros(len(points), bool)                                # of equal neighbours one is deleted
        twice[1:] = (points[1:] == points[:-1]) & (owner[1:] == owner[:-1])
        for i in np.flatnonzero(asked(mix64(gone), length[owner] - 1) & ~twice):
            w, k = words[owner[i]], place[i]
            yield int(owner[i]), w[:k] + w[k + 1:]
        own = whole - _codes(points) * power
        for c, code in zip(alphabet.tolist(), _codes(alphabet)):
            for i in np.flatnonzero((points < c) & asked(mix64(own + code * power), length[owner])):
                w, k = words[owner[i]], place[i]
                yield int(owner[i]), w[:k] + chr(c) + w[k + 1:]


def _probed(shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, size, alphabet = shards.value

        def asked(h: np.ndarray, length: np.ndarray) -> np.ndarray:
            shard = np.minimum(length, LONGEST_SHARD)
            full = size[shard] > 0
            return full & _filter.holds(words, h, first[shard], size[shard])

        for b in batches:
            for at in range(0, b.num_rows, WORDS):
                part = b.slice(at, WORDS)
                mine = part.column(0).to_pylist()
                of, found = [], []
                for i, e in edits(mine, alphabet, asked):
                    of.append(i)
                    found.append(e)
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(found, pa.string())], names=["word", "n", "near"])

    return run


def filter_shards(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(filter words, first word and size of each length's shard, alphabet)."""
    shard = F.least(F.col("length"), F.lit(LONGEST_SHARD))
    counts = {r.shard: r.n for r in vocab.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}      # at most 64
    total = sum(counts.values())
    share = min(1.0, _filter.MAX_WORDS * 64 / (_filter.BITS_PER_HASH * max(1, total)))
    size = np.zeros(LONGEST_SHARD + 1, np.int64)
    for k, n in counts.items():
        size[k] = max(1, int(n * _filter.BITS_PER_HASH * share / 64))
    first = np.cumsum(size) - size
    array = lambda v: F.array(*(F.lit(int(x)).cast("bigint") for x in v))
    placed = vocab.select("hash", F.get(array(first), shard).alias("first"), F.get(array(size), shard).alias("size"))
    words = _filter.build(placed, "hash", int(size.sum()), F.col("first"), F.col("size"))
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()      # at most 90 code points
    return words, first, size, np.array(sorted(ord(r.c) for r in letters if r.c), np.uint32)


def near_words(vocab: DataFrame) -> DataFrame:
    """Every pair of near words once in each direction: word, n, near, near_n.
    Staged."""
    spark = vocab.sparkSession
    shards = spark.sparkContext.broadcast(filter_shards(vocab))
    probed = vocab.select("word", "n").mapInArrow(_probed(shards), "word string, n bigint, near string")
    pairs = staged(probed.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"), "near-words")
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select("word", "n", "near", "near_n").unionAll(back)


# ------------------------------------------------------------------ forms and roots

def roots(forms: DataFrame, largest: int) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word along the forms.
    A chain has at most log5(largest n) steps, and each join doubles what is
    behind a word, so the number of joins is known beforehand."""
    steps = math.ceil(math.log(max(RATIO, largest), RATIO)) + 1
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = staged(at.join(on, "root").select("word", F.col("further").alias("root")), "roots")
    return forms.join(at, "word")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    vocab = vocabulary(docs)
    largest = vocab.agg(F.max("n")).first()[0] or 0
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    known = vocab.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    forms = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    return roots(forms, largest).select("word", "form", "root", "n", "n_near", "form_n")
