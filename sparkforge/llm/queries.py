"""The queries of this subpackage and, where SQL can express them, the same results in DuckDB's SQL."""

from __future__ import annotations

import importlib

MODULES = ("op01_mixing", "op02_html_wrappers", "op03_warc", "op04_substring_dedup", "op05_quality_classifier", "op06_quality_rules", "op07_token_planes", "op08_decontamination", "op09_token_counts", "op10_minhash_dedup")

W = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, regexp_extract_all(t, '{W}') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM l),
v AS (SELECT doc_id, pos, w, concat_ws(' ', w, {", ".join(f"lead(w, {i}) OVER o" for i in range(1, 8))}) AS win, lead(w, 7) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, w, CASE WHEN whole AND count(*) FILTER (WHERE whole) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS twice FROM v),
c AS (SELECT doc_id, w, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rep FROM f),
g AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(rep) AS n_repeat_words FROM c GROUP BY doc_id),
h AS (SELECT d.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[!-/:-@\[-`\{{-~]', '', 'g')) AS n_marks, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN g USING (doc_id)),
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM h),
s AS (SELECT *, CASE WHEN word_chars > 0 THEN least(10000, n_marks * 10000 // word_chars) ELSE 0 END AS marks, CASE WHEN word_chars > 0 THEN least(10000, n_capitals * 10000 // word_chars) ELSE 0 END AS capitals,
    CASE WHEN n_lines > 0 THEN least(10000, n_dup_lines * 1000 // n_lines) ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN least(10000, word_chars * 100 // n_words) ELSE 0 END AS word_length FROM b),
x AS (SELECT lang, source, unnest(['marks', 'capitals', 'dup_lines', 'word_length']) AS score, unnest([marks, capitals, dup_lines, word_length]) AS bin FROM s WHERE NOT base_failed),
k AS (SELECT 0 AS level, lang, source, score, bin, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 1, lang, NULL, score, bin, count(*) FROM x GROUP BY lang, score, bin UNION ALL SELECT 2, NULL, NULL, score, bin, count(*) FROM x GROUP BY score, bin),
q AS (SELECT level, lang, source, score, bin, sum(n) OVER (PARTITION BY level, lang, source, score ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, score) AS total FROM k),
r AS (SELECT level, lang, source, score, total, min(bin) FILTER (WHERE seen * 4 >= total) AS q1, min(bin) FILTER (WHERE seen * 4 >= total * 3) AS q3 FROM q GROUP BY ALL),
e AS (SELECT level, lang, source, score, q1 - 6 * (q3 - q1) AS low, q3 + 6 * (q3 - q1) AS high FROM r WHERE total >= 30 AND q3 > q1),
u AS (SELECT o.lang, o.source, o.score, coalesce(e0.low, e1.low, e2.low) AS low, coalesce(e0.high, e1.high, e2.high) AS high FROM (SELECT DISTINCT lang, source, score FROM x) o
  LEFT JOIN e e0 ON e0.level = 0 AND e0.score = o.score AND e0.lang IS NOT DISTINCT FROM o.lang AND e0.source IS NOT DISTINCT FROM o.source
  LEFT JOIN e e1 ON e1.level = 1 AND e1.score = o.score AND e1.lang IS NOT DISTINCT FROM o.lang
  LEFT JOIN e e2 ON e2.level = 2 AND e2.score = o.score),
p AS (SELECT lang, source, max(high) FILTER (WHERE score = 'marks') AS f1, max(high) FILTER (WHERE score = 'capitals') AS f2, max(high) FILTER (WHERE score = 'dup_lines') AS f3, max(low) FILTER (WHERE score = 'word_length') AS f4, max(high) FILTER (WHERE score = 'word_length') AS f5 FROM u GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(marks > f1 AND (n_marks::DOUBLE * 10000 - f1 * word_chars) ** 2 > 4.0 * 10000 * f1 * word_chars, false)
    OR coalesce(capitals > f2 AND (n_capitals::DOUBLE * 10000 - f2 * word_chars) ** 2 > 4.0 * 10000 * f2 * word_chars, false)
    OR coalesce(dup_lines > f3 AND (n_dup_lines::DOUBLE * 1000 - f3 * n_lines) ** 2 > 4.0 * 1000 * f3 * n_lines, false) OR coalesce(word_length < f4 OR word_length > f5, false)) AS kept
FROM s LEFT JOIN p ON s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS st FROM w),
n AS (SELECT doc_id, len(st)::BIGINT AS n_shingles, st FROM s),
x AS (SELECT doc_id, n_shingles, unnest(st) AS sh FROM n),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n_shingles) + any_value(b.n_shingles) - count(*) AS u, count(*) AS i FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles) GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 100 * i >= 80 * u),
y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc, a AS other FROM y UNION SELECT r.doc, y.b FROM r JOIN y ON r.other = y.a),
m AS (SELECT doc, min(other) AS low FROM r GROUP BY doc)
SELECT doc_id, n_shingles, coalesce(low, doc_id) AS component_id, doc_id = coalesce(low, doc_id) AS kept FROM n LEFT JOIN m ON doc_id = doc"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM d"""

ORACLES = {"op3_warc": WARC, "op6_quality_rules": QUALITY, "op10_minhash_dedup": NEAR}


def queries() -> dict:
    out = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        out |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit() and callable(v)}
    return out


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
