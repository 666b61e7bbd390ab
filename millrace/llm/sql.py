"""DuckDB SQL for the queries that SQL can express, written for the whole tables."""

from __future__ import annotations

import string

from millrace.llm.sql_features import FEATURES, VARIANTS

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Windows of the items and of the documents meet by their words.
LEAKS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(k)),
hits AS (SELECT r, k, n, item_id FROM dw JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

#: Rules, then rates shrunk from host to domain to suffix to the whole.
URLS = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '@UPPER@', '@LOWER@') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
o AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(host, '([^@]*)$', 1), '([^:]):[0-9]*$', '\1'), '\.$', '') AS site FROM h),
k AS (
  SELECT *, regexp_matches(site, '^([0-9]+\.){3}[0-9]+$|^\[') AS address,
         regexp_matches(site, '(^|\.)(ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org)\.[a-z]{2}$') AS two, string_split(site, '.') AS parts FROM s),
hosts AS (
  SELECT host, n, bad,
         CASE WHEN address THEN '(address)' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
         CASE WHEN address THEN site WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM k),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
root AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS overall FROM suffixes),
moments AS (
  SELECT level, count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mean, sum(n * n) AS nn, sum(bad * bad / n) AS bb
  FROM (SELECT 'host' AS level, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad FROM hosts
        UNION ALL SELECT 'domain', n, bad FROM domains UNION ALL SELECT 'suffix', n, bad FROM suffixes)
  WHERE n > 0 GROUP BY level),
strengths AS (
  SELECT level, CASE WHEN k < 2 OR mean * (1 - mean) <= 0 OR n - nn / n <= 0 THEN 200.0
    ELSE least(greatest(1 / least(greatest((bb - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n) / (mean * (1 - mean)), 1e-6), 0.999) - 1, 2.0), 200.0) END AS s
  FROM moments),
st AS (
  SELECT coalesce(max(s) FILTER (WHERE level = 'host'), 200.0) AS sh, coalesce(max(s) FILTER (WHERE level = 'domain'), 200.0) AS sd,
         coalesce(max(s) FILTER (WHERE level = 'suffix'), 200.0) AS ss FROM strengths),
sm AS (SELECT suffix, (overall * ss + bad) / (ss + n) AS m FROM suffixes, root, st),
dm AS (SELECT domain, suffix, (m * sd + bad) / (sd + n) AS m FROM domains JOIN sm USING (suffix), st),
rep AS (
  SELECT host, (m * sh + bad) / (sh + n) AS rate, n + sh + 1 AS weight, least(0.5, 2.0 * overall) AS top
  FROM hosts JOIN dm USING (domain, suffix), st, root),
judged AS (
  SELECT page_id, host, path, rate, greatest(rate - 1.645 * sqrt(rate * (1 - rate) / weight), 0.0) AS low, top,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN rep USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > top THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate, round(low, 6) AS bad_rate_low
FROM judged
""".replace("@UPPER@", UPPER).replace("@LOWER@", LOWER)

#: Equal payloads by their digest.
ARCHIVE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

#: Every 50-byte string of every text, by its first document.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
w AS (
  SELECT r, doc_id, k, md5_number(raw[k:k + 49]) AS s
  FROM d, unnest(range(1, greatest(octet_length(raw) - 48, 1))) AS t(k)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, k FROM w JOIN f USING (s) WHERE first < doc_id),
edge AS (SELECT r, k, k - coalesce(lag(k) OVER (PARTITION BY r ORDER BY k), -1000) > 50 AS opens FROM hit),
part AS (SELECT r, k, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS g FROM edge),
span AS (SELECT r, g, min(k) AS a, max(k) + 49 AS b FROM part GROUP BY r, g),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
kept AS (
  SELECT r, string_agg(hex(raw[before + 1:a - 1]), '' ORDER BY a) AS head, max(b) AS last, sum(b - a + 1) AS gone, count(*) AS spans
  FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN gone IS NULL THEN raw ELSE unhex(head || hex(raw[last + 1:octet_length(raw)])) END) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SQL: dict[str, str] = {
    "op2_decontamination": LEAKS,
    "op5_url_filters": URLS,
    "op8_warc": ARCHIVE,
    "op10_run_index_dedup": REPEATS,
    "op11_spelling_variants": VARIANTS,
    "op12_feature_table": FEATURES,
}
