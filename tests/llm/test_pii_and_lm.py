"""Personal data tagger and LM scores."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from cloudsift.llm import lm, pii, queries

from .conftest import EDGES, table

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.1"


def plain_spans(t):
    """The contract's patterns with Python's re, as written."""
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("0123459ab.@-+ ()_é%") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ["0000255.1.2.3 300.1.1.1", "x@y.zz_d@e.f", "4111 1111 1111 1111", "a" * 5000 + "@" + "b" * 5000, "9" * 5000]:
        assert pii.base_spans(t) == plain_spans(t)


def test_gradient_of_the_tagger():
    m, rng = pii.Tagger.fresh(4, 3), np.random.default_rng(0)
    ids, tags = rng.integers(0, pii._SYMBOLS, (3, 7)), np.zeros((3, 7), int)
    tags[0, 2:4], tags[1, 5] = (1, 2), 3
    _, g = m.gradient(ids, tags)
    for k in m.p:
        i = (0, 1) if k == "trans" else (int(ids[0, 0]), 1) if k == "emb" else tuple(rng.integers(0, s) for s in m.p[k].shape)
        old, e = m.p[k][i], 1e-5
        m.p[k][i] = old + e
        up = m.gradient(ids, tags)[0]
        m.p[k][i] = old - e
        down = m.gradient(ids, tags)[0]
        m.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], abs=1e-6)


def test_viterbi_equals_enumeration():
    import itertools
    rng = np.random.default_rng(1)
    tr = pii.Tagger.fresh().transitions() + rng.normal(0, 1, (pii.TAGS, pii.TAGS)) * 0.5
    e = rng.normal(0, 2, (2, 4, pii.TAGS))
    size = np.array([4, 3])
    got = pii.viterbi(e, size, tr)
    alpha, _ = pii.forward_backward(e, size, tr)
    for r in range(2):
        paths = {p: e[r, 0, p[0]] + tr[0, p[0]] * (tr[0, p[0]] < -1e3) + sum(tr[p[t - 1], p[t]] + e[r, t, p[t]] for t in range(1, size[r])) for p in itertools.product(range(pii.TAGS), repeat=int(size[r]))}
        assert tuple(got[r, :size[r]]) == max(paths, key=paths.get) and not got[r, size[r]:].any()
        assert pii._lse(alpha[r:r + 1, -1], 1)[0] == pytest.approx(np.logaddexp.reduce(list(paths.values())))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(queries._documents(spark, SF_MORE))


def test_tagger_finds_what_patterns_miss(model):
    text = "Please write to josé.gómez42@mail7.example.com today. " + "Word and word again. " * 20 + "Or call 1 (415) 555-2671 now, says he."
    (got,) = pii.find_spans(model, [text])
    assert ("email", 16, 46) in got[1] and any(k == "phone" for k, _, _ in got[1])
    clean = ["The year 1999 was good, page 12 of 300.", 'token = "9233a8ecf7c5b09fe5949719b6b82bc439"', "no digits at all", ""]
    assert pii.find_spans(model, clean) == [([], [])] * 4


@pytest.mark.parametrize("address", [
    "josé@mail.research-department-of-the-university.example.org",
    "josé@" + "x.example-" * 200 + "y.org",
    "pérez.de.la.fuente.y.gonzalez.maria.del.carmen@mail.example.com",
    "sánchez.with.a.very.long.local.part.that.goes.on.and.on.and.on.for.ever.and.ever.until.it.ends.here@mail.example.com",
    "é" + "abc." * 300 + "z@mail.example.org",
])
def test_long_addresses_are_whole(model, address):
    """However far an address that the tagger sees reaches from its at sign."""
    text = "Please write to " + address + " today."
    ((_, got),) = pii.find_spans(model, [text])
    assert ("email", 16, 16 + len(address)) in got
    assert pii.masked(text, got) == "Please write to <EMAIL> today."


def test_regions_hold_whole_runs():
    t = "ab cd " + "é" * 100 + "@" + "x.y" * 50 + " " + "no " * 40 + "1" + "z" * 70 + " " + "w" * 100
    (a, b), (c, d) = pii.regions(t)
    assert t[a:b].startswith("ab cd é") and b == t.index(" no") + pii.MARGIN
    assert c == t.index("1z") - pii.MARGIN and d == t.index(" www") + pii.MARGIN
    assert pii.regions("") == pii.regions("no such characters") == [] and pii.regions("@") == [(0, 1)]


def test_card_inside_a_long_span():
    """The longest run of groups with the first place, as a search of all runs
    finds it, however many groups stand before it."""
    card = "4111 1111 1111 1111"
    for n in (0, 3, 40, 500):
        text = "00000000000000000007 " * n + card + " 00000000000000000007" * n
        a = text.index(card)
        assert pii._inner_card(text, 0, len(text)) == (a, a + len(card))
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("0123456789012345678901234567 -.x") for _ in range(rng.randint(0, 60)))
        g = [m.span() for m in re.finditer("[0-9]+", t)]
        runs = [(j - i, -g[i][0], g[i][0], g[j][1]) for i in range(len(g)) for j in range(i, len(g)) if pii.meets("card", t[g[i][0]:g[j][1]])]
        assert pii._inner_card(t, 0, len(t)) == (max(runs)[2:] if runs else (0, len(t)))


def test_windows_of_a_long_region_agree(spark, model):
    """A region of many overlapping windows gives nearly the spans that its
    parts give alone."""
    texts = [r.text for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").filter("text like '%@%'").limit(40).collect()]
    parts = [t[max(0, a - 12):b + 12].replace("\n", " ") for t in texts for k, a, b in pii.base_spans(t) if k == "email"]
    whole = " ".join(parts)
    assert len(parts) > 20 and len(pii.regions(whole)) == 1
    (got,) = pii.tagged(model, [whole])
    want, at = set(), 0
    for part, found in zip(parts, pii.tagged(model, parts)):
        want |= {(k, a + at, b + at) for k, a, b in found}
        at += len(part) + 1
    assert len(want) > 20 and len(want ^ set(got)) <= len(want) // 10


def test_personal_data_query(spark, tiny):
    got = queries.op3_personal_data(spark, SF).collect()
    assert len(got) == len(tiny)
    for r in got:
        base = plain_spans(tiny[r.doc_id] or "")
        kinds = [k for k, _, _ in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii._shown(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert {pii._shown([s]) for s in base} <= set(every) and len(every) == len(base) + r.n_added


def test_personal_data_edges(spark, model, edges, empty):
    assert pii.find(edges, model).count() == len(EDGES) and pii.find(empty, model).count() == 0
    rows = [(1, None, None), (2, "mail a.b@c.de or +1 (415) 555-2671!", "en"), (2, "mail a.b@c.de or +1 (415) 555-2671!", "en"), (3, "", None), (4, "x" * 300_000 + " a@b.cd", None)]
    got = pii.redact(table(spark, rows), model)
    assert got.columns == table(spark, rows).columns
    out = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.doc_id != 1)
    assert out[0] == out[1] == (2, "mail <EMAIL> or <PHONE>!", 24) and out[2] == (3, "", 0)
    assert out[3] == (4, "x" * 300_000 + " <EMAIL>", 300_008)
    (null,) = got.filter("doc_id = 1").collect()
    assert null.text is None and null.n_chars is None and null.start == "clash"


def test_training_has_each_kind(spark, monkeypatch):
    """A rare kind is trained on, however many windows hold another."""
    rows = [(i, f"mail user{i}@host{i}.example.com", "en") for i in range(20_000)] + [(-i, f"call +1 (415) 555-26{i} now", "en") for i in range(10, 13)]
    seen = []
    monkeypatch.setattr(pii, "fit", seen.extend)
    pii.train(table(spark, rows))
    phones = {t for t, spans in seen if any(k == "phone" for k, _, _ in spans) and "+" in t}
    assert {t for _, t, _ in rows[-3:]} <= phones and len(seen) <= 2 * (pii.SAMPLE + len(pii.KINDS) * pii.SAMPLE // 4) + pii.SAMPLE // 3


def test_training_without_windows(spark, empty):
    m = pii.train(empty)
    assert pii.find_spans(m, ["no digits"]) == [([], [])]


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in lm.fresh().items()}
    w, c = rng.integers(0, lm.CLASSES + 1, (4, 9)), rng.integers(0, lm.CLASSES, 9)
    _, g = lm.gradient(p, w, c)
    for k in p:
        i = (1, w[1, 0], 2) if k == "table" else tuple(rng.integers(0, s) for s in p[k].shape)
        old, e = p[k][i], 1e-5
        p[k][i] = old + e
        up = lm.gradient(p, w, c)[0]
        p[k][i] = old - e
        down = lm.gradient(p, w, c)[0]
        p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], abs=1e-6)


def test_scores_equal_a_loop(spark, tiny):
    docs = queries._documents(spark, SF)
    ids = lm.tokens(docs, queries.vocabulary())
    size = lm.vocabulary_size(queries.vocabulary())
    flat, trained = lm.train(ids, size, 0), lm.train(ids, size)
    got = {r.doc_id: r for r in lm.score(ids, trained).collect()}
    assert len(got) == len(tiny)
    before = sum(r.score for r in lm.score(ids, flat).collect())
    assert sum(r.score for r in got.values()) > before           # it learns
    m = trained
    for r in ids.filter("length(ids) > 0").limit(5).collect():
        t = np.frombuffer(r.ids, "<u4")
        c, total = m.classes.of[t], 0.0
        for i in range(len(t)):
            z = m.weights["hidden"].astype(float).copy()
            for k, o in enumerate(lm.OFFSETS):
                z += m.weights["table"][k][c[i + o] if 0 <= i + o < len(t) else lm.CLASSES]
            x = np.tanh(z) @ m.weights["out"].astype(float) + m.weights["bias"]
            total += x[c[i]] - np.logaddexp.reduce(x) + m.classes.log_share[t[i]]
        assert got[r.doc_id].score == pytest.approx(total, rel=1e-4) and got[r.doc_id].n_tokens == len(t)
    probs = np.exp(m.classes.log_share)
    assert np.bincount(m.classes.of, weights=probs) == pytest.approx(np.ones(lm.CLASSES))


def test_every_position_is_trained_on(spark):
    """Each token of a row of 32 follows from its neighbours; all are learned,
    wherever in the row they stand."""
    row = np.arange(32, dtype="<u4")
    ids = spark.createDataFrame([(i, bytearray(row.tobytes())) for i in range(10_000)], "doc_id long, ids binary").coalesce(1)
    m = lm.train(ids, 32)
    c = m.classes.of[row]
    assert lm.log_probs(m.weights, lm.windows(c, np.array([0, 32])), c).min() > -0.5


def test_rounds_take_each_position_once():
    offs = np.array([0, 0, 1, 6, 6, 13])
    for rounds in (1, 2, 3):
        parts = [lm.targets(offs, t, rounds) for t in range(rounds)]
        assert sorted(np.concatenate(parts).tolist()) == list(range(13))


def _bent(seed=1, size=300):
    """Classes and trees of a small vocabulary with trained-looking vectors."""
    rng = np.random.default_rng(seed)
    counts = (10_000 / np.arange(1, size + 1)).astype(int)
    c = lm.classes(counts)
    m = lm.trees(c.of, counts)
    m.at[:, :lm.WIDE] = rng.normal(0, 0.5, (len(m.at), lm.WIDE))
    return c, m, rng


def test_rows_are_added_up_by_key():
    rng = np.random.default_rng(2)
    for n, times in ((1, 1), (7, 4), (500, 4)):
        key, x = rng.integers(0, 20, n * times), rng.normal(size=(n, 3))
        rows, count, got = lm._gathered(key, x)
        assert rows.tolist() == sorted(set(key.tolist())) and count.tolist() == [int((key == r).sum()) for r in rows]
        assert got == pytest.approx(np.array([np.tile(x, (times, 1))[key == r].sum(0) for r in rows]))


def test_windows_stay_in_their_rows():
    rng = np.random.default_rng(4)
    for _ in range(50):
        offs = np.concatenate([[0], np.cumsum(rng.integers(0, 5, rng.integers(0, 8)))])
        c = rng.integers(0, 9, offs[-1])
        want = [[c[i + o] if a <= i + o < b else 9 for a, b in zip(offs[:-1], offs[1:]) for i in range(a, b)] for o in lm.OFFSETS]
        assert lm.windows(c, offs, 9).tolist() == want


def test_tokens_of_a_class_given_the_window_add_up_to_one():
    c, m, rng = _bent()
    t = np.arange(300)
    w = np.repeat(rng.integers(0, 301, (4, 1)), 300, 1)
    p = np.exp(lm.token_log_probs(m, w, t))
    assert np.bincount(c.of, weights=p) == pytest.approx(np.ones(c.of.max() + 1), rel=1e-4)
    start = lm.trees(c.of, (10_000 / np.arange(1, 301)).astype(int))
    assert lm.token_log_probs(start, w, t) == pytest.approx(c.log_share, abs=1e-4)      # untrained: the shares
    assert abs(lm.token_log_probs(m, w, t) - c.log_share).max() > 0.1
    for i in (120, 299):                                    # a loop
        h = sum(np.roll(m.near[w[k, i]], k * lm.WIDE // 4) for k in range(4))
        path = range(m.first[i], m.first[i] + m.depth[i])
        assert np.log(p[i]) == pytest.approx(-sum(np.logaddexp(0, -m.turn[s] * (m.at[m.node[s], :-1] @ h + m.at[m.node[s], -1])) for s in path), rel=1e-3)


def test_gradient_of_the_tokens():
    c, m, rng = _bent()
    m = lm.replace(m, near=m.near.astype(float), at=m.at.astype(float))
    t, w = np.flatnonzero(m.depth)[rng.integers(0, 200, 20)], rng.integers(0, 301, (4, 20))
    near, at = lm.token_gradient(m, w, t)
    assert near[1].sum() == 80 and at[1].sum() == m.depth[t].sum()
    for table, (rows, _, g) in ((m.near, near), (m.at, at)):
        for r in rng.integers(0, len(rows), 5):
            k, e = int(rng.integers(0, table.shape[1])), 1e-2
            old = table[rows[r], k]
            table[rows[r], k] = old + e
            up = lm.token_log_probs(m, w, t).astype(float).sum()
            table[rows[r], k] = old - e
            down = lm.token_log_probs(m, w, t).astype(float).sum()
            table[rows[r], k] = old
            assert (up - down) / (2 * e) == pytest.approx(g[r, k], abs=2e-2)


def test_rare_tokens_are_predicted_from_their_window(spark):
    """Two rare tokens of one class and count, each with its own neighbours:
    exchanged, they score lower."""
    size, common = 400, np.arange(200)
    counts = np.where(np.arange(size) < 200, 5000, 1)
    of = lm.classes(counts).of
    a, b = next((i, j) for i in range(200, size) for j in range(i + 1, size) if of[i] == of[j])
    rows = [np.array([x, y, r, x, y], "<u4") for r, x, y in ((a, 3, 5), (b, 7, 9))]
    mixed = [np.array([x, y, r, x, y], "<u4") for r, x, y in ((b, 3, 5), (a, 7, 9))]
    df = lambda rs: spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(rs)], "doc_id long, ids binary")
    ids = df(rows * 8000 + [common.astype("<u4")] * 20).coalesce(2)
    m = lm.refine(ids, lm._train(ids, counts, 0), counts)
    right, wrong = ({r.doc_id: r.score for r in lm.score(df(x), m).collect()} for x in (rows, mixed))
    assert right[0] > wrong[0] + 0.5 and right[1] > wrong[1] + 0.5


def test_lm_edges(edges, empty):
    got = lm.score_documents(edges, queries.vocabulary()).collect()
    assert len(got) == len(EDGES)
    assert all(r.score == 0 and r.mean == 0 for r in got if r.n_tokens == 0) and sum(r.n_tokens == 0 for r in got) == 3
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    assert lm.score_documents(empty, queries.vocabulary()).count() == 0


def _unspaced(n, seed=5):
    """Text without a blank: letters and digits, Chinese, addresses."""
    rng = random.Random(seed)
    parts = ["a1", "x=3;", "中文字符", "10.1.2.3", "+4912345678", "joe@mail.example.org", "{", "}", "4111111111111111", "é"]
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(parts))
    return "".join(out)


def test_stretches_agree_with_the_whole(model, monkeypatch):
    """Decoding in stretches gives the spans of the unbounded pass."""
    texts = [_unspaced(n, n) for n in (100, 900, 3000, 6000)] + ["write to josé@mail.example.org, " * 60]
    want = [pii.find_spans(model, [t]) for t in texts]
    for steps in (5, 10, 40):
        monkeypatch.setattr(pii, "STRETCH", steps * pii.STEP)
        monkeypatch.setattr(pii, "CONTEXT", 4 * pii.STEP)
        assert [pii.find_spans(model, [t]) for t in texts] == want
    cover = [(lo, hi) for a, b, lo, hi in pii.stretches(7, 5007)]
    assert cover[0][0] == 7 and cover[-1][1] == 5007 and all(x[1] == y[0] for x, y in zip(cover, cover[1:]))


def test_memory_of_a_text_without_blanks_is_bounded():
    """Peak memory is that of a stretch: it hardly grows from 60 000 code
    points to 240 000."""
    import tracemalloc
    untrained, peak = pii.Tagger.fresh(), []
    for n in (60_000, 240_000):
        text = "a1" * (n // 2)
        tracemalloc.start()
        pii.tagged(untrained, [text])
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 128 << 20 and peak[1] < 1.3 * peak[0], peak


def test_many_spans_are_looked_up():
    """Spans that meet, as a search of all spans finds them."""
    rng = random.Random(8)
    base, last = [], dict.fromkeys(pii.KINDS, 0)
    for _ in range(300):
        k = rng.choice(pii.KINDS)
        a = last[k] + rng.randint(0, 9)
        last[k] = a + rng.randint(1, 30)
        base.append((k, a, last[k]))
    known = pii._Spans(base)
    for _ in range(300):
        a = rng.randint(0, max(last.values()))
        s = ("ip", a, a + rng.randint(1, 50))
        assert sorted(known.met(s)) == sorted(o for o in base if s[1] < o[2] and o[1] < s[2])
