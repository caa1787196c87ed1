"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from cloudsift.llm.neardup import PERCENT
from cloudsift.llm.quality_rules import _CLOSE, _CLOSE_WIDE, _SEPARATORS, BOILERPLATE, MAX_LOST, MAX_REPEAT, MIN_WORDS, OPEN_WORDS
from cloudsift.llm.repeats import LENGTH

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates() -> str:
    """op7: all pairs that share a shingle, then what each document reaches."""
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


def substring_dedup() -> str:
    """op13: every window of 13 words, the first document that holds it, and
    the words that no later window covers."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {LENGTH - 2})) AS i,
    unnest(list_transform(range(1, len(ws) - {LENGTH - 2}), lambda i: array_to_string(ws[i:i + {LENGTH - 1}], ' '))) AS seq FROM d WHERE len(ws) >= {LENGTH}),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first_id FROM win) f WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
marked AS (SELECT w.doc_id, w.i, word, max(l.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_rules() -> str:
    """op9: counts over the whole text, then the rules line by line."""
    closing = [chr(c) for c in range(256) if _CLOSE[c]] + [int(x).to_bytes(3, "big").lstrip(b"\0").decode() for x in _CLOSE_WIDE]
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) AS sh FROM d WHERE len(ws) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, sh) AS n FROM win) t WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) q GROUP BY doc_id),
pieces AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM pieces),
full_ AS (SELECT doc_id, k, line, regexp_extract_all(line, {_WORD}) AS ws, translate(line, '{_UPPER}', '{_LOWER}') AS low FROM lines),
kept_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again, len(ws) AS nw,
    length(array_to_string(ws, '')) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS signs, length(regexp_replace(line, '[^!]', '', 'g')) AS shouts,
    right(ws[len(ws)], 1) IN ({_strings(closing)}) AS closed,
    len(list_filter(ws, lambda x: x IN ({_strings(s.decode() for s in _SEPARATORS)}))) AS bars
  FROM full_ WHERE len(ws) > 0),
judged AS (SELECT *, (2 * signs > nw OR (2 * shouts > nw AND shouts > 1) OR (NOT closed AND nw < {OPEN_WORDS})) AS punctuation,
    (bars >= 2 AND 5 * bars >= nw) AS navigation, (again OR {phrases}) AS boilerplate FROM kept_),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE punctuation) AS n_punctuation,
    count(*) FILTER (WHERE navigation) AS n_navigation, count(*) FILTER (WHERE boilerplate) AS n_boilerplate,
    coalesce(sum(chars) FILTER (WHERE punctuation OR navigation OR boilerplate), 0) AS lost FROM judged GROUP BY doc_id),
c AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation,
    coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(lost, 0) AS lost_chars
  FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= {MAX_LOST} * word_chars AS kept, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(n_punctuation AS BIGINT) AS n_punctuation, CAST(n_navigation AS BIGINT) AS n_navigation,
  CAST(n_boilerplate AS BIGINT) AS n_boilerplate, CAST(lost_chars AS BIGINT) AS lost_chars FROM b"""
