"""8. LM scoring by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides of it, itself left out;
the sum of the conditional log-probabilities scores the document. A token's
probability has two factors, both given the window: its class, from a network,
and the token in its class, from a second one. The most frequent tokens are
classes of their own; the others share classes of about equal weight.

* **Counts** of all tokens of all documents, added up per task and then in
  Spark; the driver gets one row per vocabulary entry.
* **Network.** One table per window offset adds up to a hidden layer (tanh),
  a softmax over classes follows. It is trained in numpy where the tokens are:
  in every round each task starts from the same weights, takes Adam steps over
  its share of its partition's tokens, and Spark averages the tasks' weights,
  weighted by their numbers of tokens. A round takes every ``ROUNDS``-th token
  of a document, each round another one, so every token is a target once.
* **Tokens in their classes.** The tokens of a shared class are the leaves of
  a Huffman tree over their counts; a path multiplies the probabilities of its
  turns (a hierarchical softmax), so they add up to one over the class. Every
  inner node has a vector and a bias, every token of the vocabulary a vector as
  a neighbour. The biases start at the counts' shares. Each task takes Adagrad
  steps over all its tokens; Spark averages a vector's change over the tasks
  that changed it, weighted by their numbers of steps on it.
* **Scores** run over all tokens of all documents.

Token ids are staged once in the shared folder. Rows: null text and text
without tokens have n_tokens 0, score 0 and mean 0; positions outside a text
are a class of their own; repeated rows score alike; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text, bpe
from cloudsift.session import staged

OFFSETS = (-2, -1, 1, 2)
CLASSES, SHARED, HIDDEN = 128, 32, 24
#: Words that a worker remembers the ids of.
WORDS = 300_000
ROUNDS, BATCH, RATE = 2, 2048, 0.02
#: Entries of a neighbour's vector in the second network, and its rate.
WIDE, STEP = 15, 0.1
SLICE = 1 << 10             # vectors in a row on their way to the driver
_BLOCK = 1 << 8             # positions whose class scores stay in the cache


def tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit values,
    staged."""
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task's core does the work; threads would each keep memory
        odd = lambda x: np.array(bpe.library(spec.value).encode(x, add_special_tokens=False).ids, np.int32)
        for b in batches:
            for i, j, texts in bpe.text_chunks(b.column(1)):
                ids, n = bpe.id_rows(texts, bpe.library_words(spec.value, WORDS), odd)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], blob], names=["doc_id", "ids"])

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary"), "lm-tokens")


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, offsets of the rows)."""
    if not len(col):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view("<u4"), (offs - offs[0]) // 4


def _blocks(offs: np.ndarray, size: int = 1 << 20):
    """Row ranges of about ``size`` tokens."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
        yield i, j
        i = j


@dataclass
class Classes:
    """Class of each token id, and the log-probability of it in its class."""
    of: np.ndarray
    log_share: np.ndarray


def classes(counts: np.ndarray) -> Classes:
    """Own classes for the most frequent tokens, shared ones of about equal
    count for the rest. Unseen tokens count one."""
    n = counts.astype(float) + 1
    order = np.argsort(-n, kind="stable")
    own = CLASSES - SHARED
    of = np.empty(len(n), np.int32)
    of[order[:own]] = np.arange(min(own, len(n)))
    rest = order[own:]
    mass = np.cumsum(n[rest])
    if len(rest):
        of[rest] = own + np.minimum(SHARED - 1, (mass - n[rest]) * SHARED // mass[-1]).astype(np.int32)
    total = np.bincount(of, weights=n, minlength=CLASSES)
    return Classes(of, np.log(n / total[of]))


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "table": rng.normal(0, 0.1, (len(OFFSETS), CLASSES + 1, HIDDEN)).astype(np.float32),
        "hidden": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
        "bias": np.zeros(CLASSES, np.float32),
    }


def windows(c: np.ndarray, offs: np.ndarray, outside: int = CLASSES) -> np.ndarray:
    """Classes (or tokens) at the window's offsets of every position
    (offsets x n); ``outside`` stands outside the row."""
    begin, end = offs[:-1, None], offs[1:, None]
    out = np.full((len(OFFSETS), len(c)), outside, np.int32)
    for k, d in enumerate(OFFSETS):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        if abs(d) < len(c):
            out[k, a] = c[b]
        edge = begin + np.arange(-d) if d < 0 else end - 1 - np.arange(d)
        out[k, edge[(edge >= begin) & (edge < end)]] = outside
    return out


def _bounded(p: dict) -> bool:
    """Whether no class score can leave the range of exp: the hidden layer is
    in [-1, 1], so the weights bound them."""
    return bool((np.abs(p["out"]).sum(0) + np.abs(p["bias"])).max() < 80)


def _hidden(tables: list[tuple[np.ndarray, np.ndarray]], hidden: np.ndarray) -> np.ndarray:
    """The hidden layer of positions, from tables and the rows of them."""
    z = np.take(*tables[0], 0)
    more = np.empty_like(z)
    for table, at in tables[1:]:
        z += np.take(table, at, 0, out=more, mode="clip")       # no row is clipped; the other modes copy once more
    z += hidden
    return np.tanh(z, out=z)


def _class_scores(p: dict, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of positions with the hidden layer ``h``, its last column of ones: the
    exponentials of all class scores and their sum, all up to one factor; the
    own class's score on that scale, and its place among the exponentials."""
    rows = np.concatenate([p["out"], p["bias"][None, :]])
    e, own = np.empty((len(c), CLASSES), h.dtype), np.empty(len(c), h.dtype)
    at = np.arange(0, e.size, CLASSES) + c
    tame = _bounded(p)
    for i in range(0, len(c), _BLOCK):
        x = np.matmul(h[i:i + _BLOCK], rows, out=e[i:i + _BLOCK])
        if not tame:
            x -= x.max(1, keepdims=True)
        np.take(e, at[i:i + _BLOCK], out=own[i:i + _BLOCK], mode="clip")
        np.exp(x, out=x)
    return e, e @ np.ones(CLASSES, h.dtype), own, at


def log_probs(p: dict, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log P(class | window) of every position."""
    out = np.empty(len(c), np.float32)
    h = np.ones((BATCH, HIDDEN + 1), np.float32)            # the last entry meets the bias
    for i in range(0, len(c), BATCH):
        s = slice(i, i + BATCH)
        part = h[:len(c[s])]
        part[:, :HIDDEN] = _hidden([(t, w[k, s]) for k, t in enumerate(p["table"])], p["hidden"])
        _, total, own, _ = _class_scores(p, part, c[s])
        out[s] = own - np.log(total)
    return out


def gradient(p: dict, w: np.ndarray, c: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood and its gradient."""
    tanh = _hidden([(t, w[k]) for k, t in enumerate(p["table"])], p["hidden"])
    h = np.ones((len(c), HIDDEN + 1), tanh.dtype)           # the last entry meets the bias
    h[:, :HIDDEN] = tanh
    e, total, own, at = _class_scores(p, h, c)
    loss = float((np.log(total) - own).mean())
    e.reshape(-1)[at] -= total                              # probabilities less the targets, times the total
    scale = (1 / (total * len(c)))[:, None]
    h *= scale
    back, out, dz = np.ascontiguousarray(p["out"].T), np.zeros((HIDDEN + 1, CLASSES), e.dtype), np.empty_like(tanh)
    for i in range(0, len(c), _BLOCK):
        x = e[i:i + _BLOCK]
        np.matmul(x, back, out=dz[i:i + _BLOCK])
        out += h[i:i + _BLOCK].T @ x
    dz *= scale
    dz *= 1 - tanh * tanh
    table = np.zeros_like(p["table"])
    rows, _, g = _gathered((w + (np.arange(len(OFFSETS)) * (CLASSES + 1))[:, None]).ravel(), dz)
    table.reshape(-1, HIDDEN)[rows] = g
    return loss, {"table": table, "hidden": np.ones(len(dz), dz.dtype) @ dz, "out": out[:-1], "bias": out[-1]}


class Adam:
    def __init__(self, p: dict, rate: float = RATE):
        self.p, self.rate, self.step = {k: v.copy() for k, v in p.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def take(self, grad: dict) -> None:
        self.step += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.step)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.step)) + 1e-8)


@dataclass
class Tokens:
    """The tokens of the shared classes given the window. ``node`` and ``turn``
    (1 or -1) list the paths one after the other, token t's from ``first[t]``,
    ``depth[t]`` long; a token alone in its class has none."""
    first: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    turn: np.ndarray
    near: np.ndarray            # a vector per token as neighbour, and for the outside
    at: np.ndarray              # a vector per inner node, its bias last


@dataclass
class Model:
    classes: Classes
    weights: dict[str, np.ndarray]
    tokens: Tokens | None = None        # without: a token's share of its class's count


def trees(of: np.ndarray, counts: np.ndarray, seed: int = 5) -> Tokens:
    """A Huffman tree per class; every path's probability is the token's share
    of its class until trained."""
    mass = counts.astype(float) + 1
    paths: list[list[tuple[int, int]]] = [[] for _ in mass]
    bias: list[float] = []
    for c in np.unique(of):
        # (mass, a number that no two share, the tokens below or the two sides)
        heap = [(mass[i], int(i), int(i)) for i in np.flatnonzero(of == c)]
        heapq.heapify(heap)
        made = len(mass)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], made, (a, b)))
            made += 1
        todo = [(heap[0], [])]
        while todo:
            (_, _, x), way = todo.pop()
            if isinstance(x, int):
                paths[x] = way
                continue
            k = len(bias)
            bias.append(float(np.log(x[0][0] / x[1][0])))
            todo += [(x[0], [*way, (k, 1)]), (x[1], [*way, (k, -1)])]
    depth = np.array([len(w) for w in paths], np.int64)
    flat = np.array([s for w in paths for s in w], np.int32).reshape(-1, 2)
    at = np.zeros((len(bias), WIDE + 1), np.float32)
    at[:, WIDE] = bias
    near = np.random.default_rng(seed).normal(0, 0.3, (len(mass) + 1, WIDE)).astype(np.float32)
    return Tokens(np.cumsum(depth) - depth, depth, flat[:, 0].copy(), flat[:, 1].astype(np.float32), near, at)


def _gathered(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows of ``x`` by key: the keys, their numbers of rows, sums.
    With more keys than rows, the rows are taken again from the first."""
    both = np.sort((key.astype(np.int64) << 32) + np.arange(len(key)))      # faster than to sort places by key
    s = both >> 32
    both &= 0xFFFFFFFF
    begin = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=begin[1:])
    first = np.flatnonzero(begin)
    return s[first], np.diff(first, append=len(s)), np.add.reduceat(np.take(x, both, 0, mode="wrap"), first)


@functools.cache
def _turning(kind: np.dtype) -> np.ndarray:
    """A window's vectors of neighbours side by side, times this: their sum
    (and a place for the bias), each as its offset sees it, turned by some
    places, so that the offsets differ."""
    out = np.zeros((len(OFFSETS), WIDE, WIDE + 1), kind)
    at = np.arange(WIDE)
    for k in range(len(OFFSETS)):
        out[k, at, (at + k * WIDE // len(OFFSETS)) % WIDE] = 1
    return out.reshape(-1, WIDE + 1)


def _turns(m: Tokens, w: np.ndarray, t: np.ndarray):
    """Of tokens that have a path, by falling depth, given their neighbours
    ``w``: the ends of the levels (a level has the turns of all tokens so
    deep), and of all turns, level by level, the nodes, the turns, the vectors
    of window and node and the log-odds of the turn taken."""
    h = np.take(m.near, w.T.ravel(), 0).reshape(len(t), -1) @ _turning(m.near.dtype)
    h[:, WIDE] = 1                                         # meets the bias
    first, size = m.first[t], np.cumsum(np.bincount(m.depth[t])[:0:-1])[::-1]
    step = np.concatenate([first[:n] + k for k, n in enumerate(size)])
    node, turn = m.node[step], m.turn[step]
    hs, vs = np.concatenate([h[:n] for n in size]), np.take(m.at, node, 0)
    return np.cumsum(size), node, turn, hs, vs, turn * np.einsum("ij,ij->i", hs, vs)


def _by_token(ends: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sums over each token's levels."""
    out = x[:ends[0]].copy()
    for i, j in zip(ends[:-1], ends[1:]):
        out[:j - i] += x[i:j]
    return out


def _deep_first(m: Tokens, t: np.ndarray) -> np.ndarray:
    return np.argsort((-m.depth[t]).astype(np.int16), kind="stable")


def token_log_probs(m: Tokens, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log P(token | its class, window) of every position."""
    out = np.zeros(len(t), np.float32)
    some = np.flatnonzero(m.depth[t])
    for i in range(0, len(some), 2 * BATCH):
        at = some[i:i + 2 * BATCH]
        at = at[_deep_first(m, t[at])]
        ends, *_, odds = _turns(m, np.take(w, at, 1), t[at])
        out[at] = _by_token(ends, np.minimum(odds, 0) - np.log(1 + np.exp(-np.abs(odds))))
    return out


def token_gradient(m: Tokens, w: np.ndarray, t: np.ndarray):
    """Of the summed log-likelihood of tokens that have a path: (rows, numbers
    of terms, gradient) of ``near`` and of ``at``."""
    deep = _deep_first(m, t)
    w = np.take(w, deep, 1)
    ends, node, turn, hs, vs, odds = _turns(m, w, t[deep])
    g = (turn / (1 + np.exp(np.minimum(odds, 80))))[:, None]
    vs *= g
    hs *= g
    near = _gathered(w.T.ravel(), (_by_token(ends, vs) @ _turning(vs.dtype).T).reshape(-1, WIDE))
    return near, _gathered(node, hs)


def refine(ids: DataFrame, model: Model, counts: np.ndarray) -> Model:
    """``model`` with the tokens of its classes learned from their windows."""
    start = replace(model, tokens=trees(model.classes.of, counts))
    bc = ids.sparkSession.sparkContext.broadcast(start.tokens)
    size = len(counts)

    def run(batches):
        bpe.forget()
        m = replace(bc.value, near=bc.value.near.copy(), at=bc.value.at.copy())
        parts = {"near": m.near, "at": m.at}
        power, terms = ({k: np.zeros(len(v), np.float32) for k, v in parts.items()} for _ in range(2))
        for b in batches:
            flat, offs = _rows(b.column(0))
            for i, j in _blocks(offs):
                t = flat[offs[i]:offs[j]]
                w = windows(t, offs[i:j + 1] - offs[i], size)
                some = np.flatnonzero(m.depth[t])
                for k in range(0, len(some), BATCH):
                    at = some[k:k + BATCH]
                    for name, (rows, n, g) in zip(parts, token_gradient(m, w[:, at], t[at])):
                        power[name][rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
                        parts[name][rows] += STEP * g / np.sqrt(power[name][rows] + 1e-6)[:, None]
                        terms[name][rows] += n
        for name, v in parts.items():
            change = np.concatenate([(v - getattr(bc.value, name)) * terms[name][:, None], terms[name][:, None]], 1)
            for i in range(0, len(v), SLICE):
                if terms[name][i:i + SLICE].any():
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}:{i}"]), pa.array([change[i:i + SLICE].astype("<f4").tobytes()])], names=["slice", "v"])

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[key] = total.get(key, 0) + np.frombuffer(v, "<f4").astype(float)
        for key, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([v.astype("<f4").tobytes()])], names=["slice", "v"])

    changed = ids.select("ids").mapInArrow(run, "slice string, v binary").repartition(8, "slice").mapInArrow(add, "slice string, v binary")
    for r in changed.collect():                         # one row per SLICE vectors of the vocabulary
        name, i = r.slice.split(":")
        into = getattr(start.tokens, name)[int(i):int(i) + SLICE]
        v = np.frombuffer(r.v, "<f4").reshape(len(into), -1)
        into += v[:, :-1] / np.maximum(v[:, -1:], 1)
    return start


def _count(ids: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            flat, _ = _rows(b.column(0))
            total += np.bincount(flat, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.id] = r.n                               # at most one row per vocabulary entry
    return out


def targets(offs: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The positions of rows that a round trains on: every ``rounds``-th of a
    row, another one in every round."""
    place = np.arange(offs[-1]) - np.repeat(offs[:-1], np.diff(offs))
    return np.flatnonzero(place % rounds == turn)


def _round(ids: DataFrame, model: Model, turn: int, rounds: int) -> dict[str, np.ndarray]:
    """One round of training: the average of the tasks' weights."""
    bc = ids.sparkSession.sparkContext.broadcast(model)
    shapes = {k: v.shape for k, v in model.weights.items()}

    def run(batches):
        bpe.forget()                                        # the tokenizer's words are not needed any more
        m = bc.value
        adam, seen = Adam(m.weights, RATE / (1 + turn)), 0
        held_w, held_c, held = [], [], 0
        def step():
            w, c = np.concatenate(held_w, 1), np.concatenate(held_c)
            ends = np.linspace(0, len(c), max(1, round(len(c) / BATCH)) + 1).astype(int)
            for i, j in zip(ends[:-1], ends[1:]):         # all of them, in about equal batches
                adam.take(gradient(adam.p, w[:, i:j], c[i:j])[1])
        for b in batches:
            flat, offs = _rows(b.column(0))
            for i, j in _blocks(offs):
                c = m.classes.of[flat[offs[i]:offs[j]]]
                local = offs[i:j + 1] - offs[i]
                w = windows(c, local)
                pick = targets(local, turn, rounds)
                held_w.append(w[:, pick])
                held_c.append(c[pick])
                held += len(held_c[-1])
                seen += len(c)
                if held >= 8 * BATCH:
                    step()
                    held_w, held_c, held = [], [], 0
        if held:
            step()
        if seen:
            flat = np.concatenate([v.ravel() for v in adam.p.values()]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], names=["at", "v", "n"])

    mean = ids.select("ids").mapInArrow(run, "at int, v double, n long").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v"))
    got = mean.collect()                              # one row per weight
    if not got:
        return model.weights
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
    for r in got:
        flat[r.at] = r.v
    out, pos = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = flat[pos:pos + n].reshape(s)
        pos += n
    return out


def train(ids: DataFrame, size: int, rounds: int = ROUNDS) -> Model:
    """A model of the staged token ids of a vocabulary of ``size`` entries."""
    return _train(ids, _count(ids, size), rounds)


def _train(ids: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    model = Model(classes(counts), fresh())
    own = np.bincount(model.classes.of, weights=counts + 1.0, minlength=CLASSES)
    model.weights["bias"] = np.log(np.maximum(own, 1e-9) / own.sum()).astype(np.float32)      # small vocabularies leave classes empty
    for turn in range(rounds):
        model = Model(model.classes, _round(ids, model, turn, rounds))
    return model


def score_ids(model: Model, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Summed conditional log-probabilities of each row."""
    out = np.zeros(len(offs) - 1)
    of = np.append(model.classes.of, np.int32(CLASSES))     # the outside's class last
    for i, j in _blocks(offs, 1 << 17):
        ids = flat[offs[i]:offs[j]]
        if not len(ids):
            continue
        local = offs[i:j + 1] - offs[i]
        c, w = of[ids], windows(ids, local, len(of) - 1)
        lp = log_probs(model.weights, of[w], c)
        if model.tokens is None:
            lp = lp + model.classes.log_share[ids]
        else:
            lp += token_log_probs(model.tokens, w, ids)
        acc = np.concatenate([[0.0], np.cumsum(lp, dtype=float)])
        out[i:j] = acc[local[1:]] - acc[local[:-1]]
    return out


def score(ids: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, score (summed log-probability), mean of staged
    ids."""
    bc = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            flat, offs = _rows(b.column(1))
            # to four places: single precision gives a text's last digits by its place in a block
            n, s = np.diff(offs), np.round(score_ids(bc.value, flat, offs), 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1))], names=["doc_id", "n_tokens", "score", "mean"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, score double, mean double")


def score_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Train on ``docs`` and score every row of it."""
    ids = tokens(docs, vocabulary)
    counts = _count(ids, vocabulary_size(vocabulary))
    return score(ids, refine(ids, _train(ids, counts), counts))


def vocabulary_size(vocabulary: str) -> int:
    """One more than the largest id."""
    j = json.loads(bpe.read_spec(vocabulary))
    return 1 + max([*j["model"]["vocab"].values(), *(a["id"] for a in j["added_tokens"])])
