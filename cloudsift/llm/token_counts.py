"""2. Token counts that follow edits.

A text is split into pre-tokens; the tokenizer never merges across them, so
the text's token count is the sum over its pre-tokens. Per document a balanced
tree keeps the pre-tokens in order: a leaf holds a short run of them (their
lengths and token counts), an inner node the sums over its subtree. An edit
replaces code points [start, end) by new text:

* pre-tokens that end before the edit, with the two code points behind them
  that the splitter may look at (a run of blanks, a contraction), stay;
* splitting starts again behind the last of those and goes on until, behind
  the edit, it reaches a boundary of the old split. From there on the old
  pre-tokens hold, since the splitter only looks ahead;
* the tree is cut at these two places, the new pre-tokens go between, and only
  the sums on the cut paths are computed anew.

The split is that of the byte-level vocabularies (``public_tokenizers.PATTERN``
with their file, read as a parameter); special tokens are ordinary text.

Rows: null text is the empty text; edits beyond the end are moved to the end;
documents without edits keep their count; repeated rows are counted alike.

An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.llm import _text, bpe

LEAF = 64
_MEMORY = 500_000           # pre-tokens remembered per Python worker


class Node:
    """A leaf (lengths and counts) or an inner node over two subtrees."""
    __slots__ = ("left", "right", "lengths", "counts", "chars", "tokens", "height")

    def __init__(self, left=None, right=None, lengths=None, counts=None):
        self.left, self.right, self.lengths, self.counts = left, right, lengths, counts
        if left is None:
            self.chars, self.tokens, self.height = sum(lengths), sum(counts), 0
        else:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.height = 1 + max(left.height, right.height)


def _build(lengths: list[int], counts: list[int]) -> Node | None:
    nodes = [Node(lengths=lengths[i:i + LEAF], counts=counts[i:i + LEAF]) for i in range(0, len(lengths), LEAF)]
    while len(nodes) > 1:
        nodes = [Node(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else None


def _rebalanced(a: Node, b: Node) -> Node:
    """A node over a and b, whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def join(a: Node | None, b: Node | None) -> Node | None:
    """The pre-tokens of a, then those of b."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _rebalanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _rebalanced(join(a, b.left), b.right)
    if a.left is None and b.left is None and len(a.lengths) + len(b.lengths) <= LEAF:
        return Node(lengths=a.lengths + b.lengths, counts=a.counts + b.counts)
    return Node(a, b)


def split(t: Node | None, keep: Callable[[int], bool], at: int = 0) -> tuple[Node | None, Node | None]:
    """The pre-tokens whose end offset satisfies ``keep`` (a condition that
    holds up to some offset), and the rest."""
    if t is None:
        return None, None
    if t.left is None:
        n = 0
        for size in t.lengths:
            at += size
            if not keep(at):
                break
            n += 1
        make = lambda s: Node(lengths=t.lengths[s], counts=t.counts[s]) if t.lengths[s] else None
        return make(slice(0, n)), make(slice(n, None))
    middle = at + t.left.chars
    if keep(middle):
        a, b = split(t.right, keep, middle)
        return join(t.left, a), b
    a, b = split(t.left, keep, at)
    return a, join(b, t.right)


def boundary(t: Node | None, at: int) -> bool:
    """Whether a pre-token of the tree begins or ends at offset ``at``."""
    while t is not None:
        if at in (0, t.chars):
            return True
        if t.left is None:
            for size in t.lengths:
                at -= size
                if at <= 0:
                    return at == 0
        t, at = (t.left, at) if at <= t.left.chars else (t.right, at - t.left.chars)
    return at == 0


class Counter:
    """Splitter and token counts of a byte-level vocabulary."""

    def __init__(self, spec: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.library = bpe.library(spec)
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) > _MEMORY:
                self.known.clear()
                new = list(dict.fromkeys(words))
            alphabet = bpe.byte_letters()
            model = self.library.model
            self.known.update((w, len(model.tokenize("".join([alphabet[b] for b in w.encode()])))) for w in new)
        return list(map(self.known.__getitem__, words))

    def tree(self, text: str) -> Node | None:
        words = self.pattern.findall(text)
        return _build(list(map(len, words)), self.counts(words))

    def edit(self, tree: Node | None, text: str, start: int, end: int, new: str) -> tuple[Node | None, str, int]:
        """(tree, text, re-split code points) after one edit."""
        start, end = min(start, len(text)), min(max(start, end), len(text))
        out = text[:start] + new + text[end:]
        head, rest = split(tree, lambda e: e < start - 1)
        at = head.chars if head else 0
        shift = len(new) - (end - start)
        first, words = at, []
        for m in self.pattern.finditer(out, at):
            if at >= start + len(new) and boundary(rest, at - shift - first):
                break
            words.append(m.group())
            at = m.end()
        _, tail = split(rest, lambda e: e <= at - shift - first)
        middle = _build(list(map(len, words)), self.counts(words))
        return join(join(head, middle), tail), out, at - first


def _counter(spec: str, pattern: str) -> Counter:
    return bpe._per_worker("counter" + pattern, spec, lambda s: Counter(s, pattern))


def count_edits(docs: DataFrame, vocabulary: str, pattern: str, edits: Column) -> DataFrame:
    """Counts before and after a document's edits, applied in order.

    ``edits`` is an array<struct<start: int, end: int, new: string>> in code
    points of the text as the earlier edits left it. Result: doc_id, n_tokens,
    n_pretokens, n_edits, n_tokens_edited, n_resplit (code points that were
    split again) and edited (the text)."""
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))
    schema = "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_resplit long, edited string"

    def run(batches):
        for b in batches:
            c = _counter(spec.value, pattern)
            for i, j in _text.spans(_text.utf8(b.column(1))[1]):
                rows = []
                for text, todo in zip(b.column(1)[i:j].to_pylist(), b.column(2)[i:j].to_pylist()):
                    text = text or ""
                    tree = c.tree(text)
                    before, pieces, again = tree.tokens if tree else 0, _leaves(tree), 0
                    for e in todo or []:
                        tree, text, n = c.edit(tree, text, e["start"], e["end"], e["new"] or "")
                        again += n
                    rows.append((before, pieces, len(todo or []), tree.tokens if tree else 0, again, text))
                cols = [pa.array(x, pa.string() if k == 5 else pa.int64()) for k, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cols], names=[x.split()[0] for x in schema.split(", ")])

    todo = edits.cast("array<struct<start:int,end:int,new:string>>")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), todo.alias("edits")).mapInArrow(run, schema)


def _leaves(t: Node | None) -> int:
    return 0 if t is None else len(t.lengths) if t.left is None else _leaves(t.left) + _leaves(t.right)


def count(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every text."""
    none = F.array().cast("array<struct<start:int,end:int,new:string>>")
    return count_edits(docs, vocabulary, pattern, none).select("doc_id", "n_tokens")
