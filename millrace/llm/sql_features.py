"""DuckDB SQL of the newer queries; crc32 is spelt out, as DuckDB has none."""

from __future__ import annotations

#: 256 entries by the rule of the reflected polynomial.
CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc(codes: str) -> str:
    """crc32 of a list of byte values, with the table as crc.t."""
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


DIGITS = "list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"

#: Each ask against all rows of its client.
FEATURES = f"""
WITH crc AS (SELECT {CRC_TABLE} AS t),
s AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS us, epoch_us(arrived_at) + 14400000000 AS arrived, coalesce(CAST(floor(total * 100 + 0.5) AS BIGINT), 0) AS cents
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
q AS (
  SELECT sale_id, client_id, us + ({crc(DIGITS)} % 259200) * 1000000 AS t_us, row_number() OVER () AS r FROM s, crc WHERE sale_id IS NOT NULL),
c AS (
  SELECT client_id, click_id, kind, epoch_us(ts) AS us, epoch_us(arrived_at) + 14400000000 AS arrived, coalesce(CAST(floor(value * 100 + 0.5) AS BIGINT), 0) AS cents
  FROM (SELECT DISTINCT * FROM clicks)),
w AS (SELECT unnest([2, 14]) AS d),
labels AS (SELECT r, count(*) > 0 AS label FROM q JOIN s ON q.client_id = s.client_id AND s.us > t_us AND s.us <= t_us + 604800000000 GROUP BY r),
clicked AS (
  SELECT r, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(cents) AS click_cents,
         arg_max(click_id, (us, click_id)) AS last_click_id
  FROM q JOIN c ON q.client_id = c.client_id AND c.us <= t_us AND c.arrived <= t_us JOIN w ON c.us > t_us - d * 86400000000 GROUP BY r, d),
bought AS (
  SELECT r, d, t_us, s.sale_id, cents FROM q JOIN s ON q.client_id = s.client_id AND s.us <= t_us AND s.arrived <= t_us JOIN w ON s.us > t_us - d * 86400000000),
sold AS (SELECT r, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM bought GROUP BY r, d),
lined AS (
  SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(CAST(floor(amount * 100 + 0.5) AS BIGINT), 0)) AS line_cents
  FROM bought JOIN sale_lines l ON l.sale_id = bought.sale_id AND epoch_us(shipped_at) <= t_us GROUP BY r, d)
SELECT sale_id, CAST(d AS INTEGER) AS d, t_us, coalesce(label, FALSE) AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases,
       CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents, last_click_id
FROM q CROSS JOIN w LEFT JOIN labels USING (r) LEFT JOIN clicked USING (r, d) LEFT JOIN sold USING (r, d) LEFT JOIN lined USING (r, d)
"""

RUN_BYTES = "flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END))"
ID_BYTES = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda x: CAST(ord(x) AS BIGINT))"

#: Near words share what is left of them when a character is taken away, at the same place or, of the longer, all of it.
VARIANTS = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
often AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
told AS (SELECT run, n, {crc(f"list_concat({ID_BYTES}, {RUN_BYTES})")} AS h FROM often, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM told),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(k)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
best AS (SELECT word, n_near, top, min(other) AS other FROM near JOIN pairs USING (word) WHERE m = top GROUP BY ALL),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.step = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT chain.word, step AS root FROM chain JOIN formed ON chain.step = formed.word WHERE formed.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""
