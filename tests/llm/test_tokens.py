"""Packing, token counts and BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudsift.llm import bpe, packing, queries, token_counts

from .conftest import EDGES, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_automaton_equals_library_on_random_text(library):
    rng = random.Random(7)
    spec = bpe.read_spec(queries.vocabulary())
    texts = ["", "a" * 300, "ab" * 400, "'s 's's it's we'll '' ''s 5's", "½x²3µªº", "Ⱥx", "x" * 70 + "'s", "!" * 500, "l'", "a're"]
    texts += ["".join(rng.choice("aeinrst'hlvdmg !.,0ABé\n<|-\u0085\x1c") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    ids, n = bpe.id_rows(texts, bpe.automaton_words(spec), lambda x: bpe.encode_odd(spec, x))
    end = np.cumsum(n)
    for text, hi, size in zip(texts, end, n):
        assert ids[hi - size:hi].tolist() == ids_of(library, text), text


def test_bpe_digests(spark, library, tiny):
    got = queries.op6_bpe(spark, SF).collect()
    assert len(got) == len(tiny)
    for r in got:
        ids = ids_of(library, tiny[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges_and_round_trip(edges, empty, library):
    rows = bpe.decode(bpe.encode(edges, queries.vocabulary()), queries.vocabulary()).select("doc_id", "text", "ids", "decoded", "start").collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.ids == ids_of(library, r.text) and r.start == "clash"
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(empty, queries.vocabulary()).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.digests(edges, queries.vocabulary()).collect()}[1] == 0


def test_word_table_starts_anew(library):
    spec = bpe.read_spec(queries.vocabulary())
    a = bpe.automaton(spec)
    small = bpe.WordTable(lambda words: a.encode([w.encode() for w in words]), limit=3)
    for text in ("one two three four five", "six one seven", "one one"):
        ids, _ = bpe.id_rows([text], small, lambda x: bpe.encode_odd(spec, x))
        assert ids.tolist() == ids_of(library, text)


def check_packing(pieces, want, length):
    by_seq, by_doc = {}, {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, rows in by_doc.items():
        ids = np.array(want[d], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, rows in by_seq.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or (s == max(by_seq) and at <= length)


def test_packing(spark, library, tiny):
    want = {d: [*ids_of(library, t), packing.END] for d, t in tiny.items()}
    check_packing(queries.op1_packing(spark, SF).collect(), want, packing.LENGTH)


@pytest.mark.parametrize("length", [1, 7, 64])
def test_packing_short_windows_and_edges(spark, library, length):
    rows = [(i, t, None) for i, (_, t, _) in enumerate(EDGES) if t is None or len(t) < 10_000]
    got = packing.pack(table(spark, rows), queries.vocabulary(), length)
    want = {i: [*ids_of(library, t), packing.END] for i, t, _ in rows}
    got = got.withColumn("ids_crc32", F.crc32("ids"))
    check_packing(got.collect(), want, length)
    seqs = packing.sequences(got, length, pad=0).collect()
    total = sum(map(len, want.values()))
    assert sum(r.n_tokens for r in seqs) == total and len(seqs) == -(-total // length)
    assert all(len(r.ids) == length or r.n_tokens & (r.n_tokens - 1) == 0 for r in seqs)


def test_packing_repeated_null_and_empty(edges, empty, spark):
    got = packing.pack(edges, queries.vocabulary())
    assert got.filter("doc_id is null").count() >= 1
    assert got.filter("doc_id = 8").count() >= 2
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_edit_aware_counts_equal_counting_anew():
    import public_tokenizers
    spec = bpe.read_spec(queries.vocabulary("byte_bpe_50k.json"))
    lib = Tokenizer.from_str(spec)
    lib.encode_special_tokens = True
    c = token_counts.Counter(spec, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for k in range(400):
        text = "".join(rng.choice("ab'sl 12\n\t !é<|re") for _ in range(rng.randint(0, 400 if k % 5 == 0 else 40)))
        tree = c.tree(text)
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 3, 30])
            new = "".join(rng.choice("ab's \n1!ére") for _ in range(rng.choice([0, 1, 4, 100])))
            tree, after, again = c.edit(tree, text, a, b, new)
            assert after == text[:a] + new + text[b:]
            text = after
            assert (tree.tokens if tree else 0) == len(lib.encode(text, add_special_tokens=False).ids)


def test_edit_touches_little():
    import public_tokenizers
    c = token_counts.Counter(bpe.read_spec(queries.vocabulary("byte_bpe_50k.json")), public_tokenizers.PATTERN)
    text = "some words in a row " * 5000
    tree = c.tree(text)
    tree, _, again = c.edit(tree, text, 50_000, 50_004, "other")
    assert again < 60 and tree.height < 30


def test_token_count_query(spark, tiny):
    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    got = queries.op2_token_counts(spark, SF).collect()
    assert len(got) == len(tiny)
    for r in got:
        t = tiny[r.doc_id] or ""
        q = len(t) // 4
        e = t[:q] + t[q + 20:]
        e = e[:len(e) // 2] + e[:0] + t[:12] + e[len(e) // 2:]
        e = e[:max(0, len(e) - 10)] + t[-10:].upper()
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), r.doc_id
        assert r.n_tokens == len(lib.encode(t).ids) and r.n_tokens_edited == len(lib.encode(e).ids)
        assert r.n_resplit <= 200 or len(max(t.split() or [""], key=len)) > 50


def test_token_count_edges(edges, empty):
    import public_tokenizers
    v = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(v)
    lib.encode_special_tokens = True
    rows = token_counts.count(edges, v, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(EDGES)
    want = {i: len(lib.encode(t or "").ids) for i, t, _ in EDGES}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert token_counts.count(empty, v, public_tokenizers.PATTERN).count() == 0


def test_recurring_words_stay_when_the_table_is_full():
    spec = bpe.read_spec(queries.vocabulary())
    lib = bpe.library(spec)
    asked = []

    def encode(words):
        asked.extend(words)
        return [np.array(e.ids, np.int32) for e in lib.encode_batch_fast(words, add_special_tokens=False)]

    odd = lambda x: np.array(lib.encode(x, add_special_tokens=False).ids, np.int32)
    t = bpe.WordTable(encode, limit=100)
    for k in range(12):
        text = "always here " + " ".join(f"{'abcdefghijkl'[k]}{a}{b}" for a in "qwert" for b in "asdfgh")
        ids, n = bpe.id_rows([text, "", "here always"], t, odd)
        assert ids.tolist() == odd(text).tolist() + odd("here always").tolist() and n[1] == 0
    assert sum("always" in w for w in asked) <= 2 and sum("here" in w for w in asked) <= 2     # at a text's begin and inside it
    full = bpe.WordTable(encode, limit=2)
    for _ in range(3):
        assert bpe.id_rows(["one two three four"], full, odd)[0].tolist() == odd("one two three four").tolist()


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    """One text a line of words, not one a word; a word that is no single one
    to the library sends all of them one by one."""
    spec = bpe.read_spec(queries.vocabulary())
    lib, asked = bpe.library(spec), []

    class Asked:
        def encode_batch_fast(self, texts, **kw):
            asked.append(len(texts))
            return lib.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(bpe, "_loaded", {})
    monkeypatch.setattr(bpe, "library", lambda _: Asked())
    odd = lambda x: np.array(lib.encode(x, add_special_tokens=False).ids, np.int32)
    table = bpe.library_words(spec)
    texts = ["It's 1 \u00fcber-long w\u00f6rd... 'tis <b>", "", " ".join(f"{a}{b}{c}x" for a in "qwertzu" for b in "asdfgh" for c in "yxcvbnm"), "can't 've ''s !!'ll"]
    ids, n = bpe.id_rows(texts, table, odd)
    assert ids.tolist() == [i for x in texts for i in odd(x)] and n.tolist() == [len(odd(x)) for x in texts]
    assert sum(asked) == 2                                  # 294 words and some, 256 a text
    got = table.encode(["one", "two three", "four"])
    assert [x.tolist() for x in got] == [odd(x).tolist() for x in ("one", "two three", "four")]
