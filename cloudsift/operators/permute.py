"""A keyed bijection of row positions (W1 for inputs whose rows are numbered).

Where every row already has a dense number 0 .. n-1 (raw text after W1b), a
seeded permutation needs no sort, no bucket counts and no window: ``row_idx``
is a function of the number alone. The function is a Feistel network on the
grid a x b (a, b about the square root of n, a * b >= n): number = l * b + r,
and each half round adds a keyed function of one half to the other, modulo a
or b, which can be undone and so is a bijection of the grid. The fewer than
a + 1 cells beyond n are walked on (the network is applied again until the
result is below n), which keeps it a bijection of 0 .. n-1.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_ROUNDS = 8
#: Two primes below 2**31: products of a half and a key stay below 2**62.
P, Q = 2_147_483_647, 2_147_483_629


@functools.lru_cache(64)
class Permutation:
    """The seeded permutation of 0 .. n-1 (n at most 2**60)."""

    def __init__(self, n: int, seed: int = 42):
        self.n, self.seed = n, seed
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        # per half round: an addend and two factors, from md5 of seed and round
        words = [hashlib.md5(f"{seed}:{i}".encode()).digest() for i in range(HALF_ROUNDS)]
        self.keys = [tuple(int.from_bytes(w[k:k + 4], "big") % (Q - 1) + 1 for k in (0, 4, 8)) for w in words]
        self.walk = self._longest_walk()

    def network(self, x, div=np.floor_divide, num=np.int64):
        """All half rounds on a Column or an array; ``num`` makes constants,
        ``div`` divides whole numbers. The round function uses its half once,
        so nested Column expressions stay small."""
        a, b, p, q = map(num, (self.a, self.b, P, Q))
        left, right = div(x, b), x % b
        for i, key in enumerate(self.keys):
            add, first, second = map(num, key)
            half = right if i % 2 == 0 else left
            mixed = (half + add) % p * first % p * second % q
            left, right = ((left + mixed) % a, right) if i % 2 == 0 else (left, (right + mixed) % b)
        return left * b + right

    def _longest_walk(self) -> int:
        """Most applications that a number can need after the first, exactly:
        the cells beyond n (fewer than a + 1) are followed until all are out."""
        at, steps = np.arange(self.n, self.a * self.b if self.n else 0, dtype=np.int64), 0
        while len(at):
            at = self.network(at)
            at, steps = at[at >= self.n], steps + 1
        return steps

    def column(self, number: Column) -> Column:
        """Permuted ``number`` (bigint, 0 .. n-1)."""
        num = lambda k: F.lit(k).cast("bigint")
        once = lambda x: self.network(x, lambda p, q: F.call_function("div", p, q), num)
        n = num(self.n)
        first = once(number.cast("bigint"))
        if not self.walk:
            return first
        # only the few numbers that leave 0 .. n-1 come to the second branch
        on = F.aggregate(F.sequence(F.lit(1), F.lit(self.walk)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
        return F.when(first < n, first).otherwise(on)


def permute_rows(df: DataFrame, number: str, n_rows: int, seed: int = 42, out: str = "row_idx") -> DataFrame:
    """W1 on rows numbered 0 .. ``n_rows`` - 1 by ``number``: ``out`` is the
    seeded permutation of that number. No exchange. The same (n_rows, seed)
    gives the same permutation on any partitioning; a null number stays null,
    and no rows give no rows."""
    return df.withColumn(out, Permutation(n_rows, seed).column(F.col(number)))


def by_ranges(df: DataFrame, n_rows: int, rows_per_task: int, idx: str = "row_idx") -> DataFrame:
    """Rows moved once so that a task holds one contiguous range of the dense
    index ``idx``, about ``rows_per_task`` rows (or as many tasks as cores):
    the ranges follow from arithmetic, nothing is sampled."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / rows_per_task))
    width = max(1, math.ceil(n_rows / tasks))
    return df.repartitionById(tasks, F.call_function("div", F.col(idx), F.lit(width).cast("bigint")).cast("int"))
