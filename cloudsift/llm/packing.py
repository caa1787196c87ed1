"""1. Packing: concatenate and cut.

Pass one encodes every text once and writes, per input partition, the ids of
each document with its offset inside the partition. The partition totals (one
row per partition) are summed up in order; that gives every partition, and so
every document, its offset in one global token stream. Pass two cuts the
stream into windows of ``length`` tokens: a document that crosses a window
boundary gives one piece per window. Only the last sequence is not full, so
padding is below one window for the whole table.

Rows: every row is a document, repeated rows too; null text is the empty text
and gives the end token alone; a null doc_id is carried as null. Texts of any
length are cut, never dropped. An empty table gives no pieces. Other columns
of the input are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import bpe
from cloudsift.session import staged

LENGTH = 4096
END = 2

_STAGED = "part int, doc_id long, at long, n_ids long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Words that a worker remembers the ids of; it keeps them for later tasks of
#: pass one.
WORDS = 300_000


def token_rows(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """(part, doc_id, at, n_ids, ids): ids as little-endian unsigned 32-bit
    values with the end token, ``at`` their offset in the partition's stream.
    Staged in the shared folder, so the numbering is fixed from here on."""
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task's core does the work; threads would each keep memory
        part, at = TaskContext.get().partitionId(), 0
        odd = lambda x: np.array(bpe.library(spec.value).encode(x, add_special_tokens=False).ids, np.int32)
        for b in batches:
            for i, j, texts in bpe.text_chunks(b.column(1)):
                ids, n = bpe.id_rows(texts, bpe.library_words(spec.value, WORDS), odd)
                flat = np.full(len(ids) + len(n), end, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n = n + 1
                stop = np.cumsum(n)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], stop * 4]).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0)[i:j], pa.array(at + stop - n), pa.array(n), blob], names=["part", "doc_id", "at", "n_ids", "ids"])
                at += int(stop[-1])

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STAGED), "packing")


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Cut ``token_rows`` into pieces: document, start in it, length, the
    sequence and the offset there, and the piece's ids."""
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()   # one row per partition
    begin, at = {}, 0
    for row in totals:
        begin[row.part] = at
        at += row.n

    def run(batches):
        bpe.forget()                                        # the tokenizer's words are not needed any more
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(3).to_numpy()
            at = b.column(2).to_numpy() + np.array([begin[p] for p in b.column(0).to_pylist()], np.int64)
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = at[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(at[row], seq * length)
            hi = np.minimum(at[row] + n[row], (seq + 1) * length)
            size = hi - lo
            # the pieces of a batch follow one another in its ids
            data = b.column(4)
            offs = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
            first = int(offs[0])
            cut = np.concatenate([[0], np.cumsum(size * 4)]) + first
            blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cut.astype(np.int32)), data.buffers()[2]])
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(row)), pa.array(lo - at[row]), pa.array(size), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length), blob],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.select("part", "doc_id", "at", "n_ids", "ids").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Both passes: the pieces of all documents."""
    return pieces(token_rows(docs, vocabulary, end), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The padded training sequences: (sequence_id, ids, n_tokens). A group is
    one window, at most ``length`` pieces. A last window whose length is a
    power of two is left as it is, else it is padded."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))

    def run(batches):
        for b in batches:
            rows = []
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(b"".join(q["ids"] for q in p), "<u4").astype(np.int64)
                rows.append(x if n & (n - 1) == 0 else np.pad(x, (0, length - n), constant_values=pad))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64())), b.column(2)], names=["sequence_id", "ids", "n_tokens"])

    return joined.select("sequence_id", "p", "n_tokens").mapInArrow(run, "sequence_id long, ids array<long>, n_tokens long")
