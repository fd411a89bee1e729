"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quarry.llm import lines, quality

_METRIC = {m: f"{num} * {scale} // greatest({den}, 1)" for m, (num, den, scale, *_) in quality.METRICS.items()}


def _quality() -> str:
    each = " UNION ALL ".join(f"SELECT lang_k, source_k, '{m}' AS metric, {e} AS v FROM scored WHERE NOT base_failed" for m, e in _METRIC.items())
    low, up, fence = ("CASE metric " + " ".join(f"WHEN '{m}' THEN {x[k]}" for m, x in quality.METRICS.items()) + " END" for k in (3, 4, 5))
    sides = [f"{m}_{s}" for m in quality.METRICS for s in ("lo", "hi")]
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}" for m in quality.METRICS for s in ("lo", "hi"))
    pick = ", ".join(f"CASE WHEN o.docs >= {quality.LEAST_DOCS} THEN o.{c} WHEN l.docs >= {quality.LEAST_DOCS} THEN l.{c} ELSE a.{c} END AS {c}" for c in sides)
    inside = " AND ".join(f"{_METRIC[m]} <= {m}_hi" + (f" AND {_METRIC[m]} >= {m}_lo" if x[6] else "") for m, x in quality.METRICS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang_k, coalesce(source, '') AS source_k FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(CASE WHEN len(ws) >= 8 THEN range(1, len(ws) - 6) ELSE [] END) AS u(i)),
dup AS (SELECT r, unnest(list(i)) AS i FROM win GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(0, 8) AS o(k) GROUP BY r),
m AS (SELECT w.r, doc_id, lang_k, source_k, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r),
scored AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS ({each}),
b AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS q FROM v),
s AS (SELECT 0 AS level, lang_k, source_k, metric, q, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang_k, '', metric, q, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, '', '', metric, q, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang_k, source_k, metric ORDER BY q) AS upto, sum(n) OVER (PARTITION BY level, lang_k, source_k, metric) AS total FROM s),
f AS (SELECT level, lang_k, source_k, metric, max(total) AS total, min(CASE WHEN 1000 * upto >= {low} * total THEN q END) AS lq, min(CASE WHEN 1000 * upto >= {up} * total THEN q END) AS uq FROM c GROUP BY ALL),
g AS (SELECT level, lang_k, source_k, metric, total, lq - {fence} * (uq - lq) AS lo, uq + (1 << greatest(length(bin(uq)) - 6, 0)) - 1 + {fence} * (uq - lq) AS hi FROM f),
wide AS (SELECT level, lang_k, source_k, max(total) AS docs, {wide} FROM g GROUP BY ALL),
cut AS (SELECT o.lang_k, o.source_k, {pick} FROM wide o LEFT JOIN wide l ON l.level = 1 AND l.lang_k = o.lang_k JOIN wide a ON a.level = 2 WHERE o.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {inside}, FALSE) AS kept
FROM scored LEFT JOIN cut USING (lang_k, source_k)"""


def _lines(min_sites: int = lines.MIN_SITES) -> str:
    trim = "regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
    word = "regexp_matches(x, '[^\\x20\\x09-\\x0D]')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT r, doc_id, site, i, x, {word} AS word, {trim} AS k FROM (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
boil AS (SELECT k, min(doc_id) AS first FROM l WHERE word GROUP BY k HAVING count(DISTINCT site) >= {min_sites}),
f AS (SELECT l.*, word AND boil.k IS NOT NULL AND doc_id IS DISTINCT FROM boil.first AS gone FROM l LEFT JOIN boil ON l.k = boil.k),
a AS (SELECT r, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM d LEFT JOIN a USING (r)"""


def _contamination(window: int = 10) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), {window}) AS n, list_slice(ws, i, i + least(len(ws), {window}) - 1) AS g FROM b, unnest(range(1, greatest(len(ws) - {window - 1}, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n.n, list_slice(ws, i, i + n.n - 1) AS g FROM d, n, unnest(CASE WHEN len(ws) >= n.n THEN range(1, (len(ws) - n.n + 2)::BIGINT) ELSE [] END) AS u(i)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, range(0, {window}) AS o(k) WHERE k < n GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality(), "op4_line_dedup": _lines(), "op10_decontamination": _contamination()}
