"""13. Substring dedup: seeds from winnowed anchors, extended to maximal repeats.

A passage of ``LENGTH`` (13) words or more that also stands in a document with
a smaller doc_id is a repeat; its words go.

* **Seeds.** The anchor of a 13-word window is its least 5-word hash, the
  rightmost on ties. It depends on the window alone, so two documents with a
  common window have its anchor in common. Anchors are a fifth of the words;
  Spark keeps those that stand in two documents (partial minimum and maximum
  of the doc_id, no pairs).
* **Extension.** A seed is extended to all windows that chose it, up to eight
  words to either side: its region. Regions of equal words are one class, and
  an occurrence behind the class's first document is a repeat as a whole. The
  first occurrences of a class may still share some windows with another class
  of the same seed (where a match ends); only these are joined window by
  window, on 96 bits of their words, with the first document that holds them.
  Consecutive repeated windows make one maximal repeat.
* **Copies.** Documents with equal words are one class: all but the smallest
  doc_id go whole, only that one is searched.

Bounded Bloom filters (documents to search, shared anchors, classes) spare
work; a yes is always followed by an exact step, and when they are full
everything is joined. The texts are read again rather than rows of every word
kept on disk. Hot passages: every sum is a partial aggregate, and the joins are
plain equi-joins with one row per key on one side, which AQE may split.

Rows: null and empty texts have no words. Fewer than 13 words: nothing is
removed. Rows with a null doc_id are returned, but neither cut nor a source.
Rows with equal doc_id are judged each on its own text; they are no source for
each other. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _filter
from cloudsift.llm._text import Words, chunks, mix64, ragged, seeds, utf8
from cloudsift.session import staged

LENGTH = 13
ANCHOR = 5
ROWS = 256
_SEED_COEF = seeds(ANCHOR, salt=21) | np.uint64(1)
_WINDOW_COEF = seeds(LENGTH, salt=22) | np.uint64(1), seeds(LENGTH, salt=23) | np.uint64(1)


def _sliding(h: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Hash of every run of len(coef) word hashes."""
    n = len(h) - len(coef) + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(coef):
            out += h[i:i + n] * c
        return mix64(out)


def rightmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive values stands, the
    rightmost on ties (runs of doubling length)."""
    at, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(h[right] <= h[left], right, left)
        size += step
    return at


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor position of each, anchor hashes by position)."""
    if len(w.hash) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _sliding(w.hash, _SEED_COEF)
    start = np.flatnonzero(w.row[:len(w.row) - LENGTH + 1] == w.row[LENGTH - 1:])
    return start, rightmost_minimum(h, LENGTH - ANCHOR + 1)[start], h


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = utf8(b.column(1))
        counts, digests = np.zeros(b.num_rows, np.int64), []
        for r in range(b.num_rows):
            words = data[offs[r]:offs[r + 1]].tobytes().split()          # splits at \x20 and \x09-\x0D
            counts[r] = len(words)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts), pa.array(digests), pa.array(mix64(ids.astype(np.int64).view(np.uint64)).view(np.int64))],
                                         names=["doc_id", "text_hash", "n_words", "sha256", "id_hash"])


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, hash of the text, number of words, SHA-256 of the words
    joined by one space, hash of the doc_id; staged."""
    return staged(_numbered(docs).mapInArrow(_digests, "doc_id bigint, text_hash bigint, n_words bigint, sha256 string, id_hash bigint"), "digests")


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time: what is copied of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _searched(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(doc_id, text hash, words) of each chunk of the rows that may be searched."""
    for b in _parts(batches):
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yes = _filter.holds(wanted.value, mix64(ids.view(np.uint64)))
        b, ids = b.filter(pa.array(yes)), ids[yes]
        hashes = b.column(2).to_numpy(zero_copy_only=False)
        for i, j, text, offs in chunks(b.column(1)):
            yield ids[i:j], hashes[i:j], Words(text, offs)


def _seeds(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, w in _searched(batches, wanted):
            _, at, h = anchors(w)
            at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[w.row[at]])], names=["h", "doc_id"])

    return run


class Regions:
    """The regions of a chunk whose anchor may be shared: first window, number
    of windows, class (hash of all words, 32 bits of the anchor), row."""

    def __init__(self, w: Words, shared: np.ndarray):
        start, at, h = anchors(w)
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else at
        count = np.diff(np.r_[head, len(at)])
        yes = _filter.holds(shared, h[at[head]])
        self.start, self.count, h = start[head][yes], count[yes], h[at[head]][yes]
        self.one = _sliding(w.hash, _WINDOW_COEF[0])
        with np.errstate(over="ignore"):                          # two windows that hold all words between them
            self.words = mix64(self.one[self.start] + np.uint64(3) * self.one[self.start + self.count - 1] + self.count.astype(np.uint64)) if len(h) else h
        self.anchor = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.row = w.row[self.start]


def _first_key(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hash of (class, document)."""
    with np.errstate(over="ignore"):
        return mix64(words + mix64(ids.view(np.uint64)))


def _regions(wanted, shared, useful=None):
    """Rows of the regions; with ``useful`` those of classes it may hold, with
    their text and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, w in _searched(batches, wanted):
            r = Regions(w, shared.value)
            keep = np.ones(len(r.row), bool) if useful is None else _filter.holds(useful.value, r.words)
            row = r.row[keep]
            cols = {"words": r.words[keep].view(np.int64), "anchor": r.anchor[keep], "doc_id": ids[row]}
            if useful is not None:
                cols |= {"text_hash": hashes[row], "start": (r.start[keep] - w.first[row]).astype(np.int32), "n": r.count[keep].astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))

    return run


def _windows(wanted, shared, firsts):
    """Rows of every window of the regions that are first of their class and
    not the only class of their anchor (or that the filter takes for such)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, w in _searched(batches, wanted):
            r = Regions(w, shared.value)
            keep = _filter.holds(firsts.value, _first_key(r.words, ids[r.row]))
            start = ragged(r.start[keep], r.count[keep])
            two = _sliding(w.hash, _WINDOW_COEF[1])[start] if len(start) else start.astype(np.uint64)
            row = w.row[start]
            yield pa.RecordBatch.from_arrays([
                pa.array(r.one[start].view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                pa.array(ids[row]), pa.array(hashes[row]), pa.array((start - w.first[row]).astype(np.int32))], names=["w", "v", "doc_id", "text_hash", "start"])

    return run


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(_first_key(words.view(np.uint64), ids).view(np.int64))], names=["k"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive windows become one passage [begin, end)."""
    for b in batches:
        begins, ends = [], []
        for places in b.column(2):
            start, n = (places.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            s = np.unique(ragged(start, n))
            cut = np.flatnonzero(np.diff(s) > 1)
            begins.append(s[np.r_[0, cut + 1]])
            ends.append(s[np.r_[cut, len(s) - 1]] + LENGTH)
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(begins, ints), pa.array(ends, ints)], names=["doc_id", "text_hash", "begins", "ends"])


def find_repeats(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The maximal repeats of the documents that are no whole copies: doc_id,
    hash of the text, ``begins`` and ``ends`` (word positions, end exclusive). Whole copies of a
    document with a smaller doc_id are told by ``first_copies``."""
    spark = docs.sparkSession
    known = digests(docs) if known is None else known
    leaders = known.where((F.col("n_words") >= LENGTH) & F.col("doc_id").isNotNull()).groupBy("sha256").agg(F.min_by("id_hash", "doc_id").alias("id_hash"))
    leaders = staged(leaders.select("id_hash"), "leaders")
    wanted = spark.sparkContext.broadcast(_filter.build(leaders, "id_hash", _filter.words_for(leaders.count())))
    texts = _numbered(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    seen = texts.mapInArrow(_seeds(wanted), "h bigint, doc_id bigint").groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = staged(seen.where("first < last").select("h"), "shared-anchors")
    spread = lambda table, column: spark.sparkContext.broadcast(_filter.build(table, column, _filter.words_for(table.count())))
    anchors_ = spread(shared, "h")
    classes = staged(texts.mapInArrow(_regions(wanted, anchors_), "words bigint, anchor int, doc_id bigint").groupBy("words", "anchor")
                     .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "regions")
    repeated = classes.where("first < last").select("words", "anchor", "first")
    found = texts.mapInArrow(_regions(wanted, anchors_, spread(repeated, "words")), "words bigint, anchor int, doc_id bigint, text_hash bigint, start int, n int")
    whole = found.join(repeated, ["words", "anchor"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "text_hash", "start", "n")
    # where one anchor has several classes, their first documents are compared window by window
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("anchor")
    edges = staged(classes.join(several, "anchor", "left_semi").select("words", "first").mapInArrow(_first_keys, "k bigint"), "region-edges")
    rows = "w bigint, v int, doc_id bigint, text_hash bigint, start int"
    windows = texts.mapInArrow(_windows(wanted, anchors_, spread(edges, "k")), rows)
    firsts = windows.groupBy("w", "v").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "v", "first")
    parts = windows.join(firsts, ["w", "v"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "text_hash", "start", F.lit(1).alias("n"))
    later = whole.unionAll(parts).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    return staged(later.mapInArrow(_runs, "doc_id bigint, text_hash bigint, begins array<int>, ends array<int>"), "repeats")


def first_copies(known: DataFrame) -> DataFrame:
    """Per word sequence of at least 13 words: sha256, the smallest doc_id."""
    return known.where((F.col("n_words") >= LENGTH) & F.col("doc_id").isNotNull()).groupBy("sha256").agg(F.min("doc_id").alias("first"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        data, offs = utf8(b.column(1))
        kept, gone = [], []
        begins, ends = b.column(3), b.column(4)
        for r in range(b.num_rows):
            words = np.array(data[offs[r]:offs[r + 1]].tobytes().split(), object)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, begins[r].values.to_numpy(zero_copy_only=False), 1)
            np.add.at(edge, ends[r].values.to_numpy(zero_copy_only=False), -1)
            left = words[np.cumsum(edge)[:-1] == 0]
            kept.append(b" ".join(left.tolist()).decode())
            gone.append(len(words) - len(left))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(kept, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text_hash", "kept", "n_removed"])


def cut(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows that hold repeats without them: doc_id, hash of the text,
    ``kept`` (words joined by one space), ``n_removed``."""
    spark = docs.sparkSession
    ids = staged(repeats.select("doc_id").mapInArrow(_id_hashes, "id_hash bigint"), "touched")
    touched = spark.sparkContext.broadcast(_filter.build(ids, "id_hash", _filter.words_for(ids.count())))
    texts = _numbered(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(_maybe(touched), "doc_id bigint, text string, text_hash bigint")
    both = texts.join(repeats, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "begins", "ends")
    return both.mapInArrow(_cut, "doc_id bigint, text_hash bigint, kept string, n_removed bigint")


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix64(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))], names=["id_hash"])


def _maybe(wanted):
    """The rows whose doc_id may be wanted: most texts stay where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield b.filter(pa.array(_filter.holds(wanted.value, mix64(ids.view(np.uint64)))))

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space). The texts themselves: ``cut``."""
    known = digests(docs)
    done = cut(docs, find_repeats(docs, known)).select("doc_id", "text_hash", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "text_hash"])
    copies = known.join(first_copies(known), "sha256", "left")
    gone = F.col("doc_id") > F.col("first")
    return copies.join(done, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))
