"""Bounded blocked Bloom filters of 64-bit hashes, shared by the llm operators.

A block is one 64-bit word: a hash picks its word by its upper half and sets
``PROBES`` bits in it by its lower half. Spark builds the words (``bit_or`` per
word, a partial aggregation); the driver holds at most ``MAX_WORDS`` of them,
however many hashes there are. A fuller filter only says yes more often, so
every use must follow up a yes by an exact step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 5
BITS_PER_HASH = 12
MAX_WORDS = 1 << 23          # 64 MB


def words_for(n: int, most: int = MAX_WORDS) -> int:
    """Words of a filter of n hashes."""
    return int(min(most, max(16, n * BITS_PER_HASH // 64)))


def _word(h: Column, first, size) -> Column:
    """floor(upper half * size / 2^32) + first."""
    up = F.shiftrightunsigned(h, 32) * size
    return F.shiftrightunsigned(up, 32) + first


def bits(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    out = None
    for i in range(PROBES):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def build(hashes: DataFrame, column: str, n_words: int, first=0, size=None) -> np.ndarray:
    """The filter of all values of ``column`` (bigint; nulls are left out), as
    an array of ``n_words`` words. ``first`` and ``size`` (numbers or Columns)
    place each hash in a shard of its own."""
    h = F.col(column)
    num = lambda v: F.lit(v).cast("bigint") if isinstance(v, int) else v
    words = (hashes.where(h.isNotNull()).select(_word(h, num(first), num(n_words if size is None else size)).alias("w"), bits(h).alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(n_words, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, h: np.ndarray, first=0, size=None) -> np.ndarray:
    """Whether each hash may be in the filter (never no for one that is)."""
    size = len(words) if size is None else size
    at = ((h >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)) + np.asarray(first, np.uint64)
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return words[at.astype(np.int64)] & mask == mask
