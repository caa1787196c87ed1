"""Whitening, spelling variants and substring dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudsift.llm import _filter, queries, repeats, spelling, whitening
from cloudsift.llm._text import Words, mix64, seeds
from cloudsift.session import show_package

from .conftest import EDGES, LONG, table

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ op11

def vectors(spark, rows):
    show_package(spark)
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()),
                         T.StructField("n", T.StringType()), T.StructField("component", T.StringType())])
    return spark.createDataFrame([(i, v, "x", "n", "c") for i, v in rows], kind).repartition(3)


def brute_whitening(rows):
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    cov = (n * u - s).astype(float).T @ (n * u - s) / n / n / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:4], axes[:, ::-1][:, :4]
    return {i: (n, int((((n * v - s)) ** 2).sum()), (v - s / n) @ axes / np.sqrt(e)) for (i, _), v in zip(good, x)}, e / np.trace(cov)


def check_whitening(got, rows):
    want, told = brute_whitening(rows)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert set(by) == set(want) and all(set(c) == {1, 2, 3, 4} for c in by.values())
    signs = np.sign([[by[i][k + 1].whitened * want[i][2][k] for k in range(4)] for i in by]) * (np.abs([want[i][2] for i in by]) > 1e-9)
    assert all(len(set(c) - {0.0}) == 1 for c in signs.T)                     # one sign for all rows
    for i, c in by.items():
        n, dev, white = want[i]
        for k in range(4):
            assert (c[k + 1].n, c[k + 1].deviation, c[k + 1].deviation_text) == (n, dev, str(dev))
            assert abs(abs(c[k + 1].whitened) - abs(white[k])) < 1e-8 and abs(c[k + 1].explained - told[k]) < 1e-9
            assert c[k + 1].identity_error < 1e-9


def test_scatter_is_exact():
    r = np.random.default_rng(0)
    for lo, hi, shape in ((-300, 300, (4096, 16)), (-2**40, 2**40, (100, 3)), (0, 1, (70, 3)), (-2**61, 2**61, (65, 2)), (5, 6, (1, 1)), (-3, 3, (129, 5))):
        x = r.integers(lo, hi, shape)
        n, sums, cross = whitening.scatter(x)
        o = x.astype(object)
        assert (n, sums, cross) == (shape[0], list(o.sum(axis=0)), np.triu(o.T @ o).tolist())


def test_whitening_with_copies_and_broken_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]                        # a third of the rows are one vector
    broken = [(901, None), (902, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (903, [NAN] * 6), (904, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (905, []), (906, [1.0, 2.0]), (907, [1e30] + [0.0] * 5)]
    check_whitening(whitening.whiten(vectors(spark, rows + broken)).collect(), rows)


def test_whitening_query(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), rows)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, [NAN])])).collect() == [] == whitening.whiten(vectors(spark, [])).collect()
    same = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 3
    line = whitening.whiten(vectors(spark, [(i, [float(i), 0.0]) for i in range(5)])).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in line] == [False, True] * 5 and abs(line[0].explained - 1) < 1e-12
    far = whitening.whiten(vectors(spark, [(0, [2.0**50]), (1, [-2.0**50])])).collect()      # beyond a long
    assert {(r.deviation, int(r.deviation_text)) for r in far} == {(None, (2 * 2**58) ** 2)}


# ------------------------------------------------------------------ op12

def brute_variants(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    c = {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}
    near = collections.defaultdict(set)
    shape = collections.defaultdict(set)
    for w in c:
        for k in range(len(w)):
            shape[k, w[:k] + w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in c:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in shape.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in c.items():
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best and c[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), c.get(form[w])) for w, n in c.items()}


def test_variants_query(spark, tiny):
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(tiny.items())


def test_variants_chains_ties_and_letters(spark):
    """A chain of forms, ties in n, letters beyond A-Z, repeated rows, very
    long runs; one word holds a third of all occurrences."""
    r = random.Random(3)
    words = {"planet": 6500, "planets": 1200, "planetts": 200, "plannetts": 36, "plannettts": 6, "größere": 300, "grössere": 40, "grossere": 7,
             "aaaaaa": 50, "aaaaaaa": 50, "aaaaaab": 5, "ÀÉÎÕÜß": 30, "ÀÉÎÕÜ÷": 6, "abcdef": 25, "abcdeg": 25, "abcdeh": 5, "z" * 90: 40, "z" * 89: 6, "z" * 200: 9}
    bag = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(bag)
    rows = [(i, " ".join(bag[i::60]) + ".", "en") for i in range(60)]
    rows += [(3, "Planet planet PLANET", "en")] * 2 + EDGES
    got = [tuple(x) for x in spelling.group_variants(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants([x[:2] for x in rows])
    root = {x[0]: x[2] for x in got}
    assert root["plannettts"] == "planet"


def test_variants_of_a_full_filter(spark, monkeypatch, tiny):
    """A filter far too small for the vocabulary changes no row."""
    monkeypatch.setattr(_filter, "MAX_WORDS", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {tuple(r) for r in spelling.group_variants(docs).collect()} == brute_variants(tiny.items())


def test_variants_edges(spark, edges, empty):
    assert spelling.group_variants(empty).collect() == []
    assert {tuple(r) for r in spelling.group_variants(edges).collect()} == brute_variants([x[:2] for x in EDGES])


def test_crc_of_prefix_and_word():
    r = random.Random(4)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 5, 30, 63, 64, 65, 300)]
    prefixes = [b"%d:" % r.randrange(10**12) for _ in range(9)]
    of, row = np.divmod(np.arange(72), 9)
    got = spelling.crcs(np.array([zlib.crc32(p) for p in prefixes], np.uint32), words, of, prefixes, row)
    assert got.tolist() == [zlib.crc32(prefixes[b] + words[a]) for a, b in zip(of, row)]


def test_filter_never_says_no_wrongly(spark):
    show_package(spark)
    h = seeds(5000, salt=77)
    df = spark.createDataFrame([(int(v),) for v in h.view(np.int64)] + [(None,)], "h bigint")
    for size in (_filter.words_for(5000), 16):
        words = _filter.build(df, "h", size)
        assert _filter.holds(words, h).all()
    words = _filter.build(df, "h", _filter.words_for(5000))
    assert _filter.holds(words, seeds(20000, salt=78)).mean() < 0.05


# ------------------------------------------------------------------ op13

def brute_repeats(rows, length=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - length + 1 if i is not None else 0):
            k = tuple(w[s:s + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[s:s + length])] < i:
                gone[s:s + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_query(spark, tiny):
    got = sorted(map(tuple, queries.op13_substring_dedup(spark, SF).collect()), key=str)
    assert got == brute_repeats(tiny.items()) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("most", [1 << 21, 16])
def test_repeats_of_every_length_and_place(spark, monkeypatch, most):
    """Passages of 12 to 40 words at any place, overlapping, inside one
    document, in a third of all documents, of one word; copies; full filters."""
    monkeypatch.setattr(_filter, "MAX_WORDS", most)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 40)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = passage[4]
        for _ in range(r.randrange(3)):
            p = r.choice(passage)
            a = r.randrange(len(p))
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a // 2:]
        rows.append((200 - 2 * i, r.choice([" ", "\n", "\t ", "  "]).join(w), "en"))
    rows += [(301, " ".join(passage[4]), "en"), (302, " ".join(passage[4]), "en"), (302, "\t".join(passage[4]), "en"), (302, "an other text", "en"),
             (303, "same " * 30, "en"), (304, "same " * 13, "en"), (305, "same " * 12, "en"), (None, " ".join(passage[3] + passage[4]), "en"),
             (306, " ".join(passage[2] * 3), "en"), (306, " ".join(passage[2] * 3), "en")] + EDGES
    got = sorted(map(tuple, repeats.without_repeats(table(spark, rows)).collect()), key=str)
    assert got == brute_repeats([x[:2] for x in rows])


def test_repeats_edges(spark, edges, empty):
    assert repeats.without_repeats(empty).collect() == []
    got = sorted(map(tuple, repeats.without_repeats(edges).collect()), key=str)
    assert got == brute_repeats([x[:2] for x in EDGES])


def test_repeats_are_maximal_and_texts_are_cut(spark):
    shared = [f"s{i}" for i in range(30)]
    one, two = ["a1", "a2", *shared, "a3"], ["b1", *shared[:20], "b2", *shared[15:], "b3"]
    docs = table(spark, [(1, " ".join(one), "en"), (2, " ".join(two), "en"), (3, LONG, "en")])
    found = repeats.find_repeats(docs).collect()
    assert [(r.doc_id, r.begins, r.ends) for r in found] == [(2, [1, 22], [21, 37])]
    kept = repeats.cut(docs, repeats.find_repeats(docs)).collect()
    assert [(r.doc_id, r.kept, r.n_removed) for r in kept] == [(2, "b1 b2 b3", 35)]


def test_anchors_are_chosen_by_the_window_alone():
    r = random.Random(6)
    for width in range(1, 12):
        h = np.array([r.randrange(5) for _ in range(60)], np.uint64)
        got = repeats.rightmost_minimum(h, width)
        want = [max(range(s, s + width), key=lambda k: (-int(h[k]), k)) for s in range(60 - width + 1)]
        assert got.tolist() == want
    text = b" ".join(b"w%d" % r.randrange(50) for _ in range(400))
    b = np.frombuffer(text, np.uint8)
    start, at, _ = repeats.anchors(Words(b, np.array([0, len(b)])))
    assert (at >= start).all() and (at <= start + repeats.LENGTH - repeats.ANCHOR).all() and len(start) == 388
    assert mix64(np.array([0], np.uint64))[0] == 0


def test_new_operators_ignore_extra_columns(spark, tiny):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({c: F.lit("clash") for c in ("word", "n", "hash", "text_hash", "sha256", "first", "start", "h", "w", "v", "near")})
    assert {tuple(r) for r in spelling.group_variants(clash).collect()} == brute_variants(tiny.items())
    assert sorted(map(tuple, repeats.without_repeats(clash).collect()), key=str) == brute_repeats(tiny.items())
