"""Quality rules, quality classifier and language ID."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudsift.llm import langid, quality_clf, quality_rules, queries

from .conftest import EDGES, table

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.1"


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def check_counts(got, texts):
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in texts[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)


def test_rule_counts(spark, tiny, edges, empty):
    got = queries.op9_quality_rules(spark, SF).collect()
    assert len(got) == len(tiny)
    check_counts(got, {i: [counts(t)] for i, t in tiny.items()})
    more = quality_rules.judge(edges).collect()
    assert len(more) == len(EDGES)
    want = {}
    for i, t, _ in EDGES:
        want.setdefault(i, []).append(counts(t))
    check_counts(more, want)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.clean(empty).count() == 0


def test_line_rules_and_cleaning(spark):
    body = [" ".join(f"word{i}{c}" for c in "abcdefghijklmnop") + ".\n" for i in range(6)]
    good = "".join(body)
    rows = [
        (1, good, None),
        (2, good + "Home | News | About | Contact | Help\nAll rights reserved 2020.\n" + body[0], None),
        (3, good.replace(" ", " ### "), None),
        (4, good.replace(" ", "!! "), None),
        (5, "Home | News | About | Contact\n" * 1 + "\n".join(f"Menu{i} | More{i} | Shop{i} | Login{i} | Site{i}" for i in range(20)), None),
        (6, good[:-3], None),
        (7, "Short head\n" + good, None),
    ]
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 2, 6, 7}
    assert (got[2].n_navigation, got[2].n_boilerplate) == (1, 2) and got[7].n_punctuation == 1
    text = {r.doc_id: r.text for r in quality_rules.clean(table(spark, rows)).collect()}
    assert text == {1: good, 2: good, 6: good[:-3], 7: good}


def test_rule_verdicts_follow_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    got = [r for r in queries.op9_quality_rules(spark, SF_MORE).select("doc_id", "base_failed", "kept").collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in got]) > 0.99


def test_classifier_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    got = queries.op10_quality_classifier(spark, SF_MORE).collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.99


def test_moments_give_the_density():
    """The score is the logistic value of the log-density difference."""
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))]
    m = quality_clf.fit_moments(np.array([200.0, 300.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]))
    pooled = (200 * np.cov(x[0].T, bias=True) + 300 * np.cov(x[1].T, bias=True)) / 500
    a, b = quality_clf.SHRINK_POOLED, quality_clf.SHRINK_IDENTITY
    q = np.array([[0.3, -1.0, 2.0]])
    dens = []
    for v, prior in zip(x, (0.4, 0.6)):
        c = (1 - a - b) * np.cov(v.T, bias=True) + a * pooled + b * np.trace(pooled) / 3 * np.eye(3)
        d = q[0] - v.mean(0)
        dens.append(np.log(prior) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d))
    assert np.isclose(m.score(q)[0], 1 / (1 + np.exp(dens[0] - dens[1])))


def test_classifier_edges(spark, edges, empty):
    schema = "doc_id long, quality int, toxic int"
    no = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(6, 1, 0), (None, 0, 0), (8, None, 1), (777, 0, 0)], schema)
    for labels in (no, one):
        got = quality_clf.score(edges, labels).collect()
        assert len(got) == len(EDGES) and {r.score for r in got} == {0.5}
    two = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 4, 5, 6, 8, 9, 10)], schema)
    got = quality_clf.score(edges, two).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 8}) == 1
    assert quality_clf.score(empty, two).count() == 0
    assert quality_clf.select_good(edges, None).count() == len(EDGES)


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    got = queries.op5_language_id(spark, SF_MORE).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.99


def test_language_edges(spark, edges, empty):
    train = table(spark, [(i, f"the cat sat on the mat {i} and looked", "en") for i in range(40)] + [(100 + i, f"der hund lag auf dem sofa {i} und schlief", "de") for i in range(40)])
    f = langid.learn(langid.training(train))
    assert f.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(table(spark, [(1, None, None), (2, "123 !", None), (3, "the mat", None), (4, "DER HUND", None), (5, "中文", None), (6, "x", None)]), f).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["und", "und", "en", "de", f.languages[f.usual], f.languages[f.usual]]
    assert got[5].score == 0 and got[3].score > 0.9
    assert langid.predict(edges, f).count() == len(EDGES) and langid.predict(empty, f).count() == 0
    none = langid.learn(langid.training(empty))
    assert none is None and {r.lang_pred for r in langid.predict(edges, none).collect()} == {"und"}
    kept = langid.select_known(edges, f)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {i for i, t, _ in EDGES if t and re.search(r"[^\W\d_]", t)}


def test_language_with_one_document_is_learned(spark):
    """In a table of any size, and with the counts that a loop gives."""
    many = spark.range(200_000).selectExpr("id as doc_id", "'the cat and the mat' as text", "'en' as lang")
    rare = spark.createDataFrame([(-1, "ytterst sällsynt språk", "sv"), (-2, None, "no")], "doc_id long, text string, lang string")
    f = langid.learn(many.union(rare))
    assert f.languages == ["en", "sv"] and f.languages[f.usual] == "en"
    (got,) = langid.predict(rare.filter("text is not null"), f).collect()
    assert got.lang_pred == "sv" and got.score > 0.9


def test_counts_are_added_up(monkeypatch, spark):
    """Filters do not depend on how often a task adds its counts up."""
    docs = langid.training(spark.read.parquet(f"{SF}/documents.parquet"))
    whole = langid.learn(docs)
    monkeypatch.setattr(langid, "_HELD", 1000)
    parts = langid.learn(docs)
    assert whole.languages == parts.languages and (whole.slots == parts.slots).all()


def test_filter_bits_equal_sets():
    """A filter returns every language that contains an n-gram, and its false
    positives stay near the rate it is corrected for."""
    rng = np.random.default_rng(4)
    row = lambda lang, h: type("R", (), {"lang": lang, "h": int(np.int64(np.uint64(h)))})()
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = {"a": h[:2000], "b": h[1000:], "c": h[500:600]}
    f = langid._build([row(k, x) for k, v in sets.items() for x in v], {"a": 5, "b": 9, "c": 1})
    mask = np.bitwise_and.reduce([f.slots[p, 0] for p in f.places(h)])
    for k, name in enumerate(f.languages):
        assert ((mask >> np.uint64(k)) & np.uint64(1))[np.isin(h, sets[name])].all()
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    mask = np.bitwise_and.reduce([f.slots[p, 0] for p in f.places(other)])
    for k in range(3):
        rate = ((mask >> np.uint64(k)) & np.uint64(1)).mean()
        assert rate == pytest.approx(f.fill[k] ** langid.HASHES, abs=0.01)


def _ngrams(text):
    """The n-grams of a text as strings, by plain code."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    low = re.sub(" +", " ", " " + low)
    return [low[i:i + k] for k in langid.SIZES for i in range(len(low) - k + 1)]


def test_language_query_equals_exact_sets(spark):
    """The whole query against exact n-gram sets: the same language wherever
    the two best are apart, scores within the filters' false positives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    seen = {}
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen.setdefault(r.lang, Counter()).update(_ngrams(r.text))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in seen.items()}
    top = Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    sets = {k: {g for g, x in s.items() if x >= langid.RATE and 4 * x >= top[g]} for k, s in share.items()}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(got) == len(docs) and len(sets) > 1
    clear = 0
    for r in docs:
        told = got[r.doc_id]
        assert told.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not any(c.isalpha() for c in r.text or ""):
            assert (told.lang_pred, told.score) == ("und", 0.0)
            continue
        grams = _ngrams(r.text)
        hits = sorted(((sum(g in s for g in grams), k) for k, s in sets.items()), reverse=True)
        if hits[0][0] > 1.1 * hits[1][0] + 3:
            clear += 1
            assert told.lang_pred == hits[0][1]
            assert abs(told.score - hits[0][0] / sum(n for n, _ in hits)) < 0.05
    assert clear > 0.9 * len(docs)


def _plain_statistics(text):
    """The statistics of a text by plain string code."""
    text = text or ""
    raw, w = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, again, _ = counts(text)
    closing = {chr(c) for c in range(256) if quality_rules._CLOSE[c]} | {int(x).to_bytes(3, "big").lstrip(b"\0").decode() for x in quality_rules._CLOSE_WIDE}
    bars = {s.decode() for s in quality_rules._SEPARATORS}
    lines = lost = 0
    for line in text.split("\n"):
        x = re.findall(r"[^\x20\x09-\x0D]+", line)
        if x:
            lines += 1
            signs, shouts = len(re.findall(r"[#*$%&|<>]", line)), line.count("!")
            marks = sum(y in bars for y in x)
            bad = 2 * signs > len(x) or (2 * shouts > len(x) and shouts > 1) or (x[-1][-1] not in closing and len(x) < quality_rules.OPEN_WORDS)
            lost += len(x) if bad or (marks >= 2 and 5 * marks >= len(x)) else 0
    few = lambda v, of: np.log((v + 1) / (of + 10))
    share = lambda ok: sum(map(ok, raw)) / max(len(raw), 1)
    often = Counter(w)
    return [np.log1p(n), np.log(max(chars, 1) / max(n, 1)), few(symbols, n), np.log(share(lambda c: 65 <= c <= 90) + 1e-3),
            np.log(share(lambda c: 48 <= c <= 57) + 1e-3), np.log(share(lambda c: c == 33) + 1e-3), np.sqrt(share(lambda c: c in (44, 46))),
            np.log(share(lambda c: c >= 0xC0) + 1e-3), few(again, n), few(dup, lines), np.log(max(len(often), 1)) / np.log(max(n, 1) + 1),
            few(max(often.values(), default=0), n), np.log(max(n, 1) / max(lines, 1)), few(lost, n),
            few(sum(len(x.encode()) > 20 for x in w), n), few(sum(a == b for a, b in zip(w, w[1:])), n)]


def test_classifier_query_equals_plain_code(spark):
    """The whole query against statistics by plain string code and densities
    from numpy's determinants and solutions, all scores of all documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    x = {r.doc_id: np.array(_plain_statistics(r.text)) for r in docs}
    train = [(x[r.doc_id], r.quality) for r in labels if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    groups = [np.array([v for v, y in train if y == k]) for k in (0, 1)]
    cov = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, cov)) / len(train)
    cov = [0.65 * c + 0.3 * pooled + 0.05 * np.trace(pooled) / 16 * np.eye(16) for c in cov]

    def density(v, k):
        off = v - groups[k].mean(axis=0)
        return np.log(len(groups[k]) / len(train)) - 0.5 * np.linalg.slogdet(cov[k])[1] - 0.5 * off @ np.linalg.solve(cov[k], off)

    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs) and min(map(len, groups)) > 5
    for r in docs:
        want = 1 / (1 + np.exp(np.clip(density(x[r.doc_id], 0) - density(x[r.doc_id], 1), -500, 500)))
        told = got[r.doc_id]
        assert abs(told.score - want) < 1e-6, (r.doc_id, told.score, want)
        assert told.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and told.predicted == (told.score >= 0.5)


def test_clean_documents_stay_among_many_close_languages(spark):
    """Twenty languages that share most of their words: the share of a text's
    own n-grams that its language holds stays high, though the share of all
    hits falls; text of no language goes."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))
    common = [word() for _ in range(300)]
    own = [[word() for _ in range(60)] for _ in range(20)]
    text = lambda k: " ".join(rng.choice(common + own[k], 120))
    rows = [(i, text(i % 20), f"l{i % 20:02d}") for i in range(200)]
    noise = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20000, 300))
    docs = table(spark, rows + [(900, noise, None)])
    filters = langid.learn(docs.select("text", "lang"))
    assert len(filters.languages) == 20
    kept = {r.doc_id for r in langid.select_known(docs, filters, 0.2).collect()}
    assert kept == set(range(200))
    score = [r.score for r in langid.predict(docs, filters).collect()]
    assert max(score) < 0.3                               # what a cut on the score would have thrown away
