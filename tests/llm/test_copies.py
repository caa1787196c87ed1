"""Near copies and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from cloudsift.llm import fingerprints, neardup, queries

from .conftest import EDGES, LONG, table

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    head = {i: i for i in sets}

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    head[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(got, want):
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicate_query(spark, tiny):
    got = queries.op7_near_duplicates(spark, SF).collect()
    assert len(got) == len(tiny)
    check(got, brute(tiny, 3, 85))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_planted_groups(spark, k, percent):
    """Copies, chains of near copies whose ends are unlike, and many documents
    that share half their text but are not linked."""
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    base = [word() for _ in range(120)]
    for _ in range(30):                          # exact copies
        rows.append((i := i + 1, " ".join(base).upper(), None))
    for _ in range(40):                          # near copies of one text
        w = list(base)
        w[rng.randrange(120)] = word()
        rows.append((i := i + 1, " ".join(w), None))
    w = [word() for _ in range(150)]
    for _ in range(25):                          # a chain: each step changes a little more
        w = list(w)
        w[rng.randrange(150)] = word()
        rows.append((i := i + 1, " ".join(w), None))
    half = [word() for _ in range(60)]
    for _ in range(40):                          # a template, not linked
        rows.append((i := i + 1, " ".join(half + [word() for _ in range(rng.randint(10, 30))]), None))
    texts = {r[0]: r[1] for r in rows}
    want = brute(texts, k, percent)
    assert len({c for _, c in want.values()}) > 10
    check(neardup.near_duplicates(table(spark, rows), k, percent).collect(), want)
    kept = neardup.deduplicate(table(spark, rows), k, percent)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    assert kept.columns == table(spark, rows).columns


def test_near_duplicate_edges(edges, empty):
    got = neardup.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    want = brute({i: t for i, t, _ in EDGES if i is not None}, 3, 85)
    check([r for r in got if r.doc_id is not None], want)
    (none,) = [r for r in got if r.doc_id is None]
    assert none.component_id is None and none.kept
    kept = [r.doc_id for r in neardup.deduplicate(edges).collect()]
    assert sorted(kept, key=str) == sorted({*(i for i, _, _ in EDGES)}, key=str)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 900, dtype=np.uint64) for _ in range(2))
    b[:720] = a[:720]                            # 720 of 1080 in common
    reg = lambda h: neardup.registers(None, np.unique(h), np.array([0]), 2000)[0]
    ra, rb = reg(a), reg(b)
    assert (neardup.merge(ra, rb) == reg(np.concatenate([a, b]))).all()
    est = neardup.likeliest(*(np.array([x.sum()]) for x in (ra > rb, ra < rb, ra == rb)), np.array([900.0]), np.array([900.0]))
    assert abs(est[0] - 720 / 1080) < 0.06


def naive_winnow(h, w):
    out, w = [], min(w, len(h))
    for i in range(len(h) - w + 1):
        low = min(h[i:i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


def test_winnowing_equals_naive():
    rng = random.Random(2)
    for text in ["ab" * 80, "x" * 300, LONG[:700], "".join(rng.choice("ab ") for _ in range(900)), "é" * 24, "y" * 87]:
        cp = fingerprints._points(text)
        h = fingerprints.hashes(cp)
        assert len(h) == len(cp) - fingerprints.K + 1
        assert all(fingerprints.hashes(cp[i:i + fingerprints.K])[0] == h[i] for i in range(0, len(h), 13))
        got, pos = fingerprints.winnow(cp)
        assert list(zip(got.tolist(), pos.tolist())) == naive_winnow(h.tolist(), fingerprints.W)


def test_shared_passages_share_a_hash():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefg ") for _ in range(fingerprints.K + fingerprints.W - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice("hijklm ") for _ in range(rng.randint(0, 300))) for _ in range(2))
        (ha, pa_), (hb, pb) = (fingerprints.winnow(fingerprints._points(x + passage + x)) for x in (a, b))
        assert any((u, p - len(a)) in {(v, q - len(b)) for v, q in zip(hb.tolist(), pb.tolist())} for u, p in zip(ha.tolist(), pa_.tolist()))


def neighbours_brute(rows):
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        yield i, t, t[:len(t) - cut] + nxt[:cut], nxt


def check_neighbours(got, rows):
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints._hex(fingerprints.winnow(fingerprints._points(t))[0]))
                  for i, t, e, _ in neighbours_brute(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


@pytest.mark.parametrize("chars", [500, 20_000, 4_000_000])
def test_fingerprint_query(spark, tiny, monkeypatch, chars):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", chars)
    check_neighbours(queries.op4_fingerprints(spark, SF).collect(), list(tiny.items()))


def test_fingerprint_edges(spark, edges, empty, monkeypatch):
    for chars in (100, 4_000_000):
        monkeypatch.setattr(fingerprints, "RANGE_CHARS", chars)
        check_neighbours(fingerprints.neighbours(edges).collect(), EDGES)
        check_neighbours(fingerprints.neighbours(table(spark, EDGES[3:4])).collect(), EDGES[3:4])
    assert fingerprints.neighbours(empty).count() == 0
    assert fingerprints.fingerprints(edges).count() == len(EDGES)
