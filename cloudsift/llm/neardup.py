"""7. Near-duplicate detection with SetSketch registers.

A document's set holds its distinct runs of ``k`` words (lower-cased A-Z); a
document with fewer words has its whole sequence as one element. Two documents
are linked when the Jaccard similarity of their sets reaches ``percent``.

* **Registers.** Register i of a set keeps the least of the set's exponential
  hash values, truncated to powers of b: ``floor(1 - log_b(min))``. Registers
  of a union are the maximum of the parts' registers (``merge``). With
  b = 1.001 two registers agree about as often as the sets' similarity.
* **Classes.** Documents with equal sets form one class; only its smallest
  doc_id goes on, so thousands of copies cost one row.
* **Candidates.** Bands of four registers are keys. Inside a key no pairs are
  listed up. First every member is compared with the key's hub, the member that
  meets most others over all its keys: near copies of one text are usually
  connected by then. Members that are connected are not compared again, and a
  key leaves the work once all members not yet compared are connected. Of the
  keys left, those with at most ``FEW`` unconnected pairs per member compare
  them at once. The members of the others (texts that share much, but less than the threshold)
  get finer keys: two sets can only reach the threshold if they share one of
  their rarest elements, as many as the set sizes leave room for (the prefix
  filter, which loses no pair). In these keys the hub comes first again; in
  what is still large, members have random levels (halving in number from
  level to level), and round after round the members of the next level are
  compared with the rest. So every candidate pair that could still join two
  components is compared or cannot be linked: nothing is capped.
* **Estimate, verify.** For each candidate pair the similarity is estimated
  from how many registers are larger, smaller and equal, by maximum likelihood
  (set sizes are known); pairs more than five standard deviations below the
  threshold go. The rest is confirmed on the full sets.
* **Components** by alternating large-star and small-star steps on staged
  edges.

There are as many bands as make a pair at the threshold share no key with a
probability of at most ``MISS`` (19 bands for 0.85).

Rows: null or wordless text is an empty set, linked with nothing. Rows with
one doc_id are one document. A null doc_id cannot be named in a result: such a
row keeps null as its component and is kept. Other columns are not read.

An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text
from cloudsift.session import staged

WORDS, PERCENT = 3, 85
ROWS = 4                                # registers in a band
FEW = 16                                # unconnected pairs per member that a key may compare at once
MISS = 1e-6                             # chance that a pair at the threshold shares no key
B, A, TOP = 1.001, 20.0, 65535          # base, rate and largest value of registers

_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, regs binary"


def bands(percent: int) -> int:
    """Number of bands for a threshold."""
    t = (percent / 100) ** ROWS
    return 1 if t >= 1 else math.ceil(math.log(MISS) / math.log(1 - t))


def registers(row: np.ndarray, h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Registers (rows x m, unsigned 16 bit) of the sets whose distinct hashes
    h begin at ``starts``. Sets must not be empty."""
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    factor, flip = (_text.seeds(m, salt=7).astype(np.uint32) | np.uint32(1)), _text.seeds(m, salt=8).astype(np.uint32)
    least = np.empty((len(starts), m), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(m):
            least[:, i] = np.minimum.reduceat(((low if i % 2 else high) ^ flip[i]) * factor[i], starts)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likeliest(more: np.ndarray, less: np.ndarray, same: np.ndarray, n1: np.ndarray, n2: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood similarity from the numbers of registers in which
    the first set is larger, smaller and equal, given the set sizes."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    most = np.minimum(n1, n2) / np.maximum(n1, n2)
    grid = np.linspace(0, 1, steps + 1)[None, :] * most[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    like = more[:, None] * safe(up) + less[:, None] * safe(down) + same[:, None] * safe(1 - up - down)
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def _sets(b: pa.RecordBatch, k: int):
    """(first row, end row, row, hash) of the distinct shingles, by chunk."""
    for i, j, raw, offs in _text.chunks(b.column(1)):
        row, h = _text.distinct_per_row(*_text.shingles(_text.Words(_text.lower_ascii(raw), offs), k))
        yield i, j, row, h


def sketches(docs: DataFrame, k: int = WORDS, m: int = ROWS * 19) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, regs): the set's size, its 128-bit
    signature and its registers."""
    def run(batches):
        for b in batches:
            for i, j, row, h in _sets(b, k):
                n = np.bincount(row, minlength=j - i)
                full = np.flatnonzero(n)
                sig, regs = np.zeros((2, j - i), np.uint64), [None] * (j - i)
                if len(full):
                    starts = _text.run_ends(row, j - i)[full]
                    with np.errstate(over="ignore"):
                        sig[0, full] = np.add.reduceat(_text.mix64(h), starts)
                        sig[1, full] = np.add.reduceat(_text.mix64(h ^ _text._GOLD), starts)
                    for r, x in zip(full.tolist(), registers(row, h, starts, m)):
                        regs[r] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], pa.array(n.astype(np.int64)), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), pa.array(regs, pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "regs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _keys(classes: DataFrame) -> DataFrame:
    """One row per class and band: (key, rep, n)."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                n = regs.shape[1]
                key = _text.mix64(regs ^ _text.seeds(n, salt=9)[None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n))],
                    names=["key", "rep", "n"])

    return classes.select("rep", "n", "regs").mapInArrow(run, "key long, rep long, n long")


def _level():
    return F.expr("cast(least(60D, floor(-log2((xxhash64(rep) & 9223372036854775807) / 9.3e18D + 1e-18D))) as int)").alias("level")


def members(rows: DataFrame) -> DataFrame:
    """Members (key, rep, n, side) of all keys that two or more share, with
    their level, the key's highest level (``top``) and ``hub`` (the member
    with most neighbours). Members of sides -1 and 1 are only compared with
    the other side."""
    rows = rows.select("key", "rep", "n", "side", _level())
    top = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("level").alias("top"), F.min("rep").alias("a"), F.max("rep").alias("z"),
                                  F.min("side").alias("low"), F.max("side").alias("high"))
    shared = staged(rows.join(top.filter(_OPEN).select("key", "top", "size"), "key"), "neardup-shared")
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("rep").alias("flip"))).alias("h"))   # ties: smallest id
    out = ranked.join(hubs, "key").withColumn("hub", F.col("rep") == F.bitwise_not("h.flip"))
    return out.select("key", "rep", "n", "side", "level", "top", "hub")


#: A key whose members differ and, if it has sides, has both of them.
_OPEN = "a <> z and (low = 0 or low <> high)"


def _open(rows: DataFrame) -> DataFrame:
    """Members (with ``comp``) of the keys that still have unconnected ones,
    with the component that most members have (``main``) and ``few``: the key
    has at most FEW unconnected pairs per member, so all are compared next."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("side").alias("low"), F.max("side").alias("high"),
                                          F.count_if(F.col("side") < 0).alias("lower"), F.count_if(F.col("side") > 0).alias("upper"))
    keys = per.groupBy("key").agg(
        F.min("comp").alias("a"), F.max("comp").alias("z"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("c").alias("size"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.max(F.struct("c", "comp")).alias("most"))
    few = F.col("size") * F.col("size") - F.col("inside") <= 2 * FEW * F.col("size")
    few = few | (F.col("lower") * F.col("upper") <= FEW * F.col("size")) & (F.col("low") < 0)
    return rows.join(keys.filter(_OPEN).select("key", few.alias("few"), F.col("most.comp").alias("main")), "key")


STEP = 1.02             # ratio of neighbouring size classes
SLOTS = 1 << 24         # counters of the order of elements: 16 MB, whatever the data
_BLOCKS = 256
KEYS = 1 << 17          # finer keys that a task holds before it hands them on


def _slot(items: np.ndarray) -> np.ndarray:
    return (_text.mix64(items ^ _text._GOLD) >> np.uint64(40)).astype(np.int64)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many sets (255 at most) have an element in each of SLOTS hash
    slots. Tasks count batch by batch, Spark adds up per slot; then the at most
    ``size`` sums of a block of slots become an array."""
    size = SLOTS // _BLOCKS

    def count(batches):
        for b in batches:
            slot, n = np.unique(_slot(b.column(0).flatten().to_numpy().view(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    def pack(t: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint8)
        counts[t.column("slot").to_numpy() % size] = t.column("n").to_numpy()
        return pa.table({"block": pa.array([t.column("slot")[0].as_py() // size], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = sets.select("items").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit(255)).alias("n"))
    blocks = parts.groupBy(F.floor(F.col("slot") / size).alias("b")).applyInArrow(pack, "block int, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in blocks.collect():                                           # SLOTS bytes
        out[r.block * size:(r.block + 1) * size] = np.frombuffer(r.counts, np.uint8)
    return out


def _size_class(n: str):
    return F.floor(F.log(F.col(n).cast("double")) / math.log(STEP) + 1e-9).cast("int")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """Finer keys (key, rep, n, side) of sets (rep, items, own, classes): an
    element among the rarest ones of a set, together with the size classes of
    the two sets of a pair (``own``, and ``classes`` of the sets it may meet). Sets of n and m elements at the threshold t have at least
    t / (1 + t) * (n + m) in common, so they share one of the first
    n - that + 1 elements of each in any common order. The order here is by
    the counters of ``_rarity``; an element whose counter is one is in no other
    set and needs no key. ``side`` tells the smaller class from the larger."""
    t = percent / 100
    bc = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def rows(keys, reps, ns, sides):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(reps)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(sides))],
                                          names=["key", "rep", "n", "side"])

    def run(batches):
        rare = bc.value
        for b in batches:
            items, offs = b.column(1).flatten().to_numpy().view(np.uint64), b.column(1).value_lengths().to_numpy()
            end = np.cumsum(offs)
            keys, reps, ns, sides, held = [], [], [], [], 0
            for rep, hi, n, c, others in zip(b.column(0).to_pylist(), end.tolist(), offs.tolist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                mine = items[hi - n:hi]
                count = rare[_slot(mine)]
                order = np.lexsort((mine, count))
                classes = np.array(sorted(others), np.int64)
                smallest = np.floor(STEP ** classes.astype(float) * (1 - 1e-6))
                room = n - np.ceil(t / (1 + t) * (n + np.maximum(smallest, math.floor(n * t) - 1)) - 1e-6).astype(np.int64) + 1
                for d, m in zip(classes.tolist(), room.tolist()):
                    if m > 0 and (n * t - 1) / STEP <= STEP ** d <= (n / t + 1) * STEP:
                        first = order[:m]
                        first = mine[first[count[first] > 1]]
                        pair = np.uint64((min(c, d) << 20) + max(c, d))
                        keys.append(_text.mix64(first ^ _text.mix64(np.full(1, pair, np.uint64))))
                        reps.append(np.full(len(first), rep))
                        ns.append(np.full(len(first), n))
                        sides.append(np.full(len(first), (c > d) - (c < d), np.int32))
                        held += len(first)
                if held >= KEYS:
                    yield rows(keys, reps, ns, sides)
                    keys, reps, ns, sides, held = [], [], [], [], 0
            if keys:
                yield rows(keys, reps, ns, sides)

    return sets.select("rep", "items", "own", "classes").mapInArrow(run, "key long, rep long, n long, side int")


def full_sets(docs: DataFrame, reps: DataFrame, k: int = WORDS) -> DataFrame:
    """(rep, items): the full sets, as sorted hashes, of the documents named
    in ``reps``."""
    def run(batches):
        for b in batches:
            for i, j, row, h in _sets(b, k):
                offs = _text.run_ends(row, j - i).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(offs), pa.array(h.view(np.int64)))], names=["rep", "items"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(reps.hint("merge"), "rep", "left_semi")
    found = chosen.mapInArrow(run, "rep long, items array<long>")
    return found.groupBy("rep", F.xxhash64("items").alias("sig")).agg(F.first("items").alias("items")).drop("sig")


def _candidates(active: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (x, p) of round ``turn``: pivots of each key against members that
    are not connected with them. Pivots of a key with few pairs are all members
    outside its main component; else the hub in round 0, later the members of
    the next highest level."""
    at = F.col("top") - (turn - 1)
    outside = F.col("comp") != F.col("main")
    pivot = F.when(F.col("few"), outside).otherwise(F.col("hub") if turn == 0 else F.col("level") == at)
    other = F.col("few") | (~F.col("hub") if turn == 0 else F.col("level") <= at)
    both = F.when(F.col("few"), outside).otherwise(F.lit(False) if turn == 0 else F.col("level") == at)
    pivots = active.filter(pivot).select("key", F.col("rep").alias("p"), F.col("n").alias("pn"), (-F.col("side")).alias("side"), F.col("comp").alias("pcomp"))
    pairs = active.filter(other).join(pivots, ["key", "side"]).filter(
        (F.col("comp") != F.col("pcomp")) & (~both | (F.col("rep") < F.col("p")))
        & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
    return pairs.select(F.col("rep").alias("x"), "p").distinct()


def _left(active: DataFrame, turn: int, labels: DataFrame) -> DataFrame:
    """Members whose pairs are not all compared after round ``turn``, with
    their components, in keys where these differ."""
    done = F.col("few") | (F.col("hub") if turn == 0 else F.col("level") >= F.col("top") - (turn - 1))
    rest = active.filter(~done).drop("comp", "few", "main").join(labels, "rep", "left")
    return _open(rest.withColumn("comp", F.coalesce("comp", "rep"))).select(*active.columns)


def _refined(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is left after the hubs: keys with few pairs as they are, the
    members of the others under finer keys."""
    rows = left.filter(~F.col("few")).withColumn("own", _size_class("n"))
    met = rows.groupBy("key").agg(F.collect_set("own").alias("met"))                    # at most a thousand classes
    crowd = rows.join(met, "key").groupBy("rep", "comp", "own").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("classes"))   # a rep has as many keys as bands
    crowd = staged(sets.join(crowd, "rep"), "neardup-crowd")
    fine = members(prefix_keys(crowd, percent)).join(crowd.select("rep", "comp").distinct(), "rep")
    return left.filter("few").unionByName(_open(fine).select(*left.columns))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity may reach the threshold."""
    t = percent / 100
    low = t - 5 * (t * (1 - t) / (bands(percent) * ROWS)) ** 0.5

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r1, r2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (3, 5))
            n1, n2 = b.column(2).to_numpy().astype(float), b.column(4).to_numpy().astype(float)
            keep = np.zeros(b.num_rows, bool)
            for i in range(0, b.num_rows, 1000):
                s = slice(i, i + 1000)
                keep[s] = likeliest((r1[s] > r2[s]).sum(1), (r1[s] < r2[s]).sum(1), (r1[s] == r2[s]).sum(1), n1[s], n2[s]) >= low
            yield b.select(["x", "p"]).filter(pa.array(keep))

    c = classes.select("rep", "n", "regs")
    both = pairs.join(c.toDF("x", "nx", "rx"), "x").join(c.toDF("p", "np", "rp"), "p")
    return both.select("x", "p", "nx", "rx", "np", "rp").mapInArrow(run, "x long, p long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs confirmed on the full sets, as edges from the larger id."""
    both = pairs.join(sets.toDF("x", "sx").hint("merge"), "x").join(sets.toDF("p", "sp").hint("merge"), "p")
    both = both.select("x", "p", (F.size("sx") + F.size("sp")).alias("total"), F.size(F.array_intersect("sx", "sp")).alias("common"))
    ok = both.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
    return ok.select(F.greatest("x", "p").alias("a"), F.least("x", "p").alias("b")).filter("a <> b").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none."""
    role = e.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
    per = role.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp) for every node with an edge (a > b): comp is the smallest
    node reachable. Large-star and small-star steps until only stars around
    their smallest nodes are left."""
    e = staged(edges.distinct(), "neardup-edges")
    while not _stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low)
        e = staged(small.distinct(), "neardup-edges")
    nodes = e.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    return nodes.union(nodes.select("comp", "comp").distinct())


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links), kept (the document stands for its group)."""
    sk = staged(sketches(docs, k, ROWS * bands(percent)), "neardup-sketch")
    filled = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(filled.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "neardup-classes")
    first = staged(members(_keys(classes).withColumn("side", F.lit(0))), "neardup-members")
    sets = staged(full_sets(docs, first.select("rep").distinct(), k), "neardup-sets")

    labels = None

    def compared(active: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Labels after one round, and what is left."""
        found = _linked(_likely(staged(_candidates(active, turn, percent), "neardup-pairs"), classes, percent), sets, percent)
        if labels is not None:      # the stars of the components so far
            found = found.union(labels.filter("rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b")))
        now = components(found)
        return now, staged(_left(active, turn, now), "neardup-active")

    labels, active = compared(first.withColumns({"comp": F.col("rep"), "few": F.lit(False), "main": F.col("rep")}), 0)
    if not active.isEmpty():
        active = staged(_refined(active, sets, percent), "neardup-active")
    turn = 0
    while not active.isEmpty():
        labels, active = compared(active, turn)
        turn += 1

    rep = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "rep").join(labels, "rep", "left")
    rep = rep.select("h1", "h2", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    out = sk.select("doc_id", "n_shingles", "h1", "h2").join(rep, ["h1", "h2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near copies; of repeated
    rows with one doc_id, one stays. Rows without doc_id all stay."""
    kept = near_duplicates(docs, k, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # of rows with one doc_id the smallest text stays, whatever task comes first
    one = named.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(rows, F.struct("text", F.xxhash64(rows))).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter("doc_id is null"))
