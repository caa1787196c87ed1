"""6. BPE encoding and decoding with a tokenization automaton.

The automaton reads *token labels*: its states say which tokens may come next
in a correct tokenization. It starts with one state that loops over all base
symbols. Merge i, (u, v) -> w, applies one gadget:

* the state behind u is split: the new state lacks the arc v, so u then v can
  no longer be read (an entry (u, v): i of ``removed``);
* wherever u could be read and v after it, an arc w is added that leads where
  v led at that time (``left[w] = u``, ``right[w] = v``, ``born[w] = i``).

By induction every arc labelled t leads to one state, so a state is named by
its last token, and it shares all arcs with the state it was split from. Arc w
exists behind t unless some gadget removed it: a pair (a, b), with a on the
right spine of t and b on the left spine of w, was removed before the gadget
that put a into its parent there, and not after the one that did so for b.
Rows of the transition table are materialised when a text first needs them.

Encoding runs the transitions from the left: the tokenization of every prefix
of a word is unique, so each position has one state (its last token) and one
arc leads into it. All distinct words of a batch advance together. Decoding
writes the labels of the arcs.

Texts: null is the empty text. The strings of the vocabulary's special tokens
are tokens of their own, as in the library's default.

Repeated rows are encoded alike, extra columns stay or are ignored, and an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudsift.llm import _text

_INF = 1 << 30
_MASK = (1 << 64) - 1
_LONG = 64                  # bytes; longer words go one by one
_WORDS = 800_000            # distinct words remembered per Python worker
_LINE = 256                 # words that the library encodes as one text


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes are themselves, the others count up
    from U+0100."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    rest = {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in own)}
    return [chr(rest.get(c, c)) for c in range(256)]


class Automaton:
    """The merges of a vocabulary file, compiled by successive gadgets."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.labels = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = s
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.born = np.full(n, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        u = np.array([vocab[a] for a, _ in pairs], np.int64)
        v = np.array([vocab[b] for _, b in pairs], np.int64)
        w = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left[w], self.right[w], self.born[w] = u, v, np.arange(len(w))
        self.removed = _text.HashIndex()
        self.removed.add(self._pair(u, v), np.arange(len(u), dtype=np.int32))
        self.arcs = _text.HashIndex()
        # tokens as bytes; final ones end a word
        of = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        final, raw = [], []
        for s, _ in vocab.items():
            final.append(bool(self.suffix) and s.endswith(self.suffix))
            raw.append(b"".join(of[c] for c in (s[:-len(self.suffix)] if final[-1] else s)))
        ids = np.array(list(vocab.values()))
        made = self.born[ids] >= 0
        live = np.ones(n, bool)
        at = ids[made]
        live[at] = self._open(self.left[at], self.right[at], self.born[at])
        self.token = {(b, f): i for b, f, i in zip(raw, final, ids.tolist()) if live[i]}
        self.longest = max(map(len, raw))
        size = np.array([len(b) for b in raw])
        end = np.cumsum(size)
        h = _text.run_hash(_text._byte_code[np.frombuffer(b"".join(raw), np.uint8)], end - size, end)
        final = np.array(final)
        self.find = []
        for f in (False, True):
            index, pick = _text.HashIndex(), (final == f) & live[ids]
            index.add(h[pick], ids[pick].astype(np.int32))
            self.find.append(index)
        self.ends = bool(self.suffix)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _text.mix64((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1))

    def _open(self, t: np.ndarray, w: np.ndarray, before: np.ndarray | int = _INF) -> np.ndarray:
        """Whether the arc w leaves the state behind t, counting only gadgets
        earlier than ``before``."""
        ok = np.ones(len(t), bool)
        a, up = t.copy(), np.full(len(t), _INF)
        while (a >= 0).any():
            b, over = w.copy(), np.full(len(t), _INF)
            while (b >= 0).any():
                at = np.flatnonzero((a >= 0) & (b >= 0))
                r = self.removed.find(self._pair(a[at], b[at]))
                limit = before if np.isscalar(before) else before[at]
                ok[at[(r >= 0) & (r < up[at]) & (r <= over[at]) & (r < limit)]] = False
                over = np.where(b >= 0, self.born[b], over)
                b = np.where(b >= 0, self.left[b], -1)
            up = np.where(a >= 0, self.born[a], up)
            a = np.where(a >= 0, self.right[a], -1)
        return ok

    def step(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The transition table at (state, label): True where the arc exists.
        State -1 is the start of a word."""
        out = t < 0
        at = np.flatnonzero(~out)
        if not len(at):
            return out
        key = self._pair(t[at], w[at])
        got = self.arcs.find(key)
        new = np.flatnonzero(got < 0)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            new = new[first]
            ok = self._open(t[at[new]].astype(np.int64), w[at[new]].astype(np.int64))
            if self.arcs.used > 4_000_000:
                self.arcs = _text.HashIndex()
                got = self.arcs.find(key)
                new = np.unique(key, return_index=True)[1]
                ok = self._open(t[at[new]].astype(np.int64), w[at[new]].astype(np.int64))
            self.arcs.add(key[new], ok.astype(np.int32))
            got = self.arcs.find(key)
        out[at] = got == 1
        return out

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (UTF-8 bytes, not empty)."""
        out: list[np.ndarray] = [None] * len(words)
        short = [i for i, x in enumerate(words) if len(x) <= _LONG]
        for i, x in enumerate(words):
            if len(x) > _LONG:
                out[i] = self._encode_long(x)
        short.sort(key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in short], np.int64)
        if not len(size):
            return out
        code = _text._byte_code[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        up = np.uint64(_text._BASE)
        base = np.cumsum(size) - size
        state = np.full((int(size[0]) + 1, len(size)), -1, np.int32)
        took = np.zeros(state.shape, np.int8)
        for i in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -i, "right"))        # words of i bytes or more
            left, poly = np.arange(live), np.zeros(live, np.uint64)
            last = int(np.searchsorted(-size[:live], -i, "left")) if self.ends else live
            for n in range(1, min(i, self.longest) + 1):
                poly = code[base[left] + i - n] + poly * up
                h = _text.mix64(poly + np.uint64(n * int(_text._GOLD) & _MASK))
                ends = int(np.searchsorted(left, last))                # from here on the word ends at i
                w = np.concatenate([self.find[0].find(h[:ends]), self.find[1].find(h[ends:])])
                can = np.flatnonzero(w >= 0)
                can = can[self.step(state[i - n, left[can]], w[can])]
                state[i, left[can]], took[i, left[can]] = w[can], n
                keep = np.ones(len(left), bool)
                keep[can] = False
                left, poly = left[keep], poly[keep]
                if not len(left):
                    break
            assert not len(left), "a symbol is not in the vocabulary"
        at, back, cols = size.copy(), [], np.arange(len(size))
        while len(cols):
            back.append((cols, state[at[cols], cols]))
            at[cols] -= took[at[cols], cols]
            cols = cols[at[cols] > 0]
        col = np.concatenate([c for c, _ in back])
        ids = np.concatenate([t for _, t in back])
        depth = np.concatenate([np.full(len(c), k) for k, (c, _) in enumerate(back)])
        order = np.lexsort((-depth, col))
        ids = ids[order]
        cut = np.cumsum(np.bincount(col, minlength=len(size))).tolist()
        for k, (lo, hi) in enumerate(zip([0, *cut], cut)):
            out[short[k]] = ids[lo:hi]
        return out

    def _encode_long(self, x: bytes) -> np.ndarray:
        state, took = [-1], [0]
        for i in range(1, len(x) + 1):
            for n in range(1, min(i, self.longest) + 1):
                w = self.token.get((x[i - n:i], self.ends and i == len(x)))
                if w is not None and self._arc(state[i - n], w):
                    state.append(w)
                    took.append(n)
                    break
        ids, i = [], len(x)
        while i:
            ids.append(state[i])
            i -= took[i]
        return np.array(ids[::-1], np.int32)

    @functools.lru_cache(200_000)  # noqa: B019  one automaton per worker
    def _arc(self, t: int, w: int) -> bool:
        return bool(self.step(np.array([t]), np.array([w]))[0])


# --- splitting texts into words --------------------------------------------

_TOP = 0x250                # below: classes are fixed by old Unicode versions
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code point, class, hash code) of the code points below
    _TOP; the last row stands for all others."""
    lower, kind = np.arange(_TOP + 1, dtype=np.uint32), np.full(_TOP + 1, _OTHER, np.uint8)
    for c in range(_TOP):
        low = chr(c).lower()
        if len(low) > 1 or ord(low) >= _TOP:
            kind[c] = _ODD
            continue
        lower[c] = ord(low)
        cat = unicodedata.category(low)[0]
        kind[c] = _LETTER if cat == "L" else _NUMBER if cat == "N" else _SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _OTHER
    kind[_TOP] = _ODD
    return lower, kind, _text.seeds(_TOP + 1, salt=3)


class Split:
    """The words of a list of texts, as the vocabulary's normaliser and
    splitter give them (lower case; contractions, letter runs, single number
    signs, runs of other signs). Rows with code points from U+0250, special
    tokens or the like are in ``odd``, without words here."""

    def __init__(self, texts: list[str]):
        lower, kind, code = _tables()
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        cp = np.minimum(cp, _TOP)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        k = kind[cp]
        odd = k == _ODD
        if len(cp) > 1:
            odd[:-1] |= (cp[:-1] == 0x3C) & (cp[1:] == 0x7C)       # "<|"
        at = np.flatnonzero(odd)
        self.odd = np.unique(np.searchsorted(begin, at, "right") - 1)
        for r in self.odd:
            k[begin[r]:begin[r] + size[r]] = _SPACE
        self.low = lower[cp]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (k[1:] == _NUMBER)
        quote = np.flatnonzero((self.low[:-2] == 0x27) & (k[:-2] == _OTHER) & (k[1:-1] == _LETTER)) if len(k) > 2 else np.zeros(0, np.int64)
        if len(k) >= 2 and self.low[-2] == 0x27 and k[-2] == _OTHER:
            quote = np.append(quote, len(k) - 2)
        if len(quote):
            quote = quote[first[quote]]
            x = self.low[quote + 1]
            y = self.low[np.minimum(quote + 2, len(k) - 1)]
            y = np.where(quote + 2 < len(k), y, 0)
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            for q, n in ((quote[one], 2), (quote[two & ~one], 3)):
                first[q + 1] = False
                after = q + n
                after = after[after < len(k)]
                first[after] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(k))
        word = k[starts] != _SPACE
        self.start, self.end = starts[word], ends[word]
        self.first = np.searchsorted(self.start, np.append(begin, len(cp) + 1))
        self.hash = _text.run_hash(code[np.minimum(self.low, _TOP)], self.start, self.end)

    def strings(self, which: np.ndarray) -> list[str]:
        s = self.low.astype("<u4").tobytes().decode("utf-32-le")
        return [s[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


class WordTable:
    """Token ids of the distinct words seen by this worker. Beyond ``limit``
    words only those stay that came up again since the last time (none if these
    are over half of the limit). ``encode`` gives each word's ids, or the ids of
    all words in a row and their numbers."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int = _WORDS):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _text.HashIndex(16)
        self.ids, self.end = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.hash, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)

    def _prune(self) -> None:
        keep = np.flatnonzero(self.again)
        hashes, (ids, n) = self.hash[keep], self.flat(keep)
        self._clear()
        if len(keep) and 2 * len(keep) <= self.limit:
            self.index.add(hashes, np.arange(len(keep), dtype=np.int32))
            self.ids, self.end = ids, np.concatenate([[0], np.cumsum(n)])
            self.hash, self.again = hashes, np.zeros(len(keep), bool)

    def look_up(self, words: Split) -> np.ndarray:
        """Entry number of each word; valid until the next call."""
        if self.index.used > self.limit:
            self._prune()
        at = self.index.find(words.hash)
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        if len(new):
            _, one = np.unique(words.hash[new], return_index=True)
            one = new[one]
            got = self.encode(words.strings(one))
            ids, size = got if isinstance(got, tuple) else (np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))
            self.index.add(words.hash[one], np.arange(len(self.end) - 1, len(self.end) - 1 + len(one), dtype=np.int32))
            self.hash = np.concatenate([self.hash, words.hash[one]])
            self.again = np.concatenate([self.again, np.zeros(len(one), bool)])
            self.ids = np.concatenate([self.ids, ids])
            self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(size)])
            at[new] = self.index.find(words.hash[new])
        return at

    def flat(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries in a row, number of ids of each entry)."""
        n = self.end[entry + 1] - self.end[entry]
        return self.ids[_text.ragged(self.end[entry], n)], n


_loaded: dict[tuple[str, str], object] = {}


def _per_worker(kind: str, spec: str, make: Callable[[str], object]):
    """One object per Python worker and vocabulary."""
    key = (kind, str(hash(spec)))
    if key not in _loaded:
        _loaded[key] = make(spec)
    return _loaded[key]


def library(spec: str):
    def make(text: str):
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(text)
        t.no_truncation()
        t.no_padding()
        return t
    return _per_worker("library", spec, make)


def automaton(spec: str) -> Automaton:
    return _per_worker("automaton", spec, Automaton)


def forget() -> None:
    """Drop what a worker has loaded: for work after the texts are encoded."""
    _loaded.clear()


def library_words(spec: str, limit: int = _WORDS) -> WordTable:
    """Words encoded by the tokenizers library; a worker's first call sets how
    many it remembers."""
    def make(text: str):
        t = library(text)
        model = json.loads(text)["model"]
        suffix = model.get("end_of_word_suffix")
        last = np.zeros(2 + max(model["vocab"].values()), bool)     # ids that end a word; other tokens' ids are cut to the last entry
        last[[i for label, i in model["vocab"].items() if suffix and label.endswith(suffix)]] = True

        def encode(words: list[str]):
            """Many words as one text, cut after the ids that end a word; one
            by one where these are not as many as the words."""
            if suffix:
                lines = [" ".join(words[i:i + _LINE]) for i in range(0, len(words), _LINE)]
                ids = np.concatenate([np.array(e.ids, np.int32) for e in t.encode_batch_fast(lines, add_special_tokens=False)])
                end = np.flatnonzero(last[np.minimum(ids, len(last) - 1)]) + 1
                if len(end) == len(words) and end[-1] == len(ids):
                    return ids, np.diff(end, prepend=0)
            return [np.array(e.ids, np.int32) for e in t.encode_batch_fast(words, add_special_tokens=False)]

        return WordTable(encode, limit)
    return _per_worker("library words", spec, make)


def automaton_words(spec: str) -> WordTable:
    """Words encoded by the automaton's transitions."""
    def make(text: str):
        a = automaton(text)
        return WordTable(lambda words: a.encode([w.encode() for w in words]))
    return _per_worker("automaton words", spec, make)


def encode_odd(spec: str, text: str) -> np.ndarray:
    """Ids of any text through the automaton: special tokens, then the
    vocabulary's own normaliser and splitter, then the transitions."""
    a, t = automaton(spec), library(spec)
    of = {c: i for i, c in enumerate(byte_letters())}
    out: list[np.ndarray] = [np.zeros(0, np.int32)]
    names = sorted(a.special, key=len, reverse=True)
    parts = re.split("(" + "|".join(map(re.escape, names)) + ")", text) if names else [text]
    for k, part in enumerate(parts):
        if k % 2:
            out.append(np.array([a.special[part]], np.int32))
        elif part:
            words = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))
            out += a.encode([bytes(of[c] for c in w) for w, _ in words])
    return np.concatenate(out)


def id_rows(texts: list[str], table: WordTable, odd: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text)."""
    s = Split(texts)
    entry = table.look_up(s)
    ids, n = table.flat(entry)
    end = np.concatenate([[0], np.cumsum(n)])
    bound = end[s.first]
    count = np.diff(bound)
    if len(s.odd):
        own = {int(r): odd(texts[r]) for r in s.odd}
        rows = [own.get(r, ids[bound[r]:bound[r + 1]]) for r in range(len(texts))]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
    return ids, count


def text_chunks(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of bounded chunks; null is empty."""
    _, offs = _text.utf8(col)
    for i, j in _text.spans(offs):
        yield i, j, [x or "" for x in col[i:j].to_pylist()]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


# --- DataFrame operators ----------------------------------------------------

def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in ``out``. The
    vocabulary file (bounded, about 3 MB) is read on the driver and
    broadcast. Works per row: repeated rows and other columns stay."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            parts = []
            for i, j, texts in text_chunks(b.column(keep.index(text))):
                ids, n = id_rows(texts, automaton_words(spec.value), lambda x: encode_odd(spec.value, x))
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32())))
            if parts:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(parts)], names=[*keep, out])

    return docs.select(*[_q(c) for c in keep]).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the labels of ``ids``, joined as the library does for this
    vocabulary (it has no decoder: one space between labels, special tokens
    kept). Null ids give an empty text."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            labels = automaton(spec.value).labels
            rows = [" ".join([labels[i] for i in x]) if x else "" for x in b.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.string())], names=[*keep, out])

    return df.select(*[_q(c) for c in keep]).mapInArrow(run, schema)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids in decimal and of the decoded
    text: encode and decode in one pass over each chunk."""
    import hashlib
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        for b in batches:
            out = []
            a, table = automaton(spec.value), automaton_words(spec.value)
            shown, said = _shown(spec.value)
            for i, j, texts in text_chunks(b.column(1)):
                s = Split(texts)
                entry = table.look_up(s)
                _extend(a, table, shown, said)
                odd = set(s.odd.tolist())
                number, words = table.end[entry + 1] - table.end[entry], entry.tolist()
                total = np.concatenate([[0], np.cumsum(number)])
                for r, x in enumerate(texts):
                    if r in odd:
                        ids = encode_odd(spec.value, x).tolist()
                        n, num, lab = len(ids), " ".join(map(str, ids)).encode(), " ".join([a.labels[t] for t in ids]).encode()
                    else:
                        lo, hi = s.first[r], s.first[r + 1]
                        n, own = int(total[hi] - total[lo]), words[lo:hi]
                        num, lab = b" ".join([shown[w] for w in own]), b" ".join([said[w] for w in own])
                    out.append((n, hashlib.sha256(num).hexdigest(), hashlib.sha256(lab).hexdigest()))
            n, h, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _shown(spec: str) -> tuple[list[bytes], list[bytes]]:
    return _per_worker("shown", spec, lambda _: ([], []))


def _extend(a: Automaton, table: WordTable, shown: list[bytes], said: list[bytes]) -> None:
    """The decimal ids and the labels of the table's new entries."""
    if getattr(table, "rendered", None) is not table.index:     # the table began anew
        shown.clear()
        said.clear()
        table.rendered = table.index
    ends = table.end[len(shown):].tolist()
    for lo, hi in zip(ends, ends[1:]):
        x = table.ids[lo:hi].tolist()
        shown.append(" ".join(map(str, x)).encode())
        said.append(" ".join([a.labels[t] for t in x]).encode())
