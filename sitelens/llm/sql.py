"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
best AS (
  SELECT n, page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v = 'block' DESC) AS k
  FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best WHERE k = 1
"""

OP9 = """
WITH p AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT n, page_id, body, strlen(body) AS payload_bytes, sha1(body) AS hex,
         max(page_id) OVER (PARTITION BY body) AS top,
         row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, n DESC) AS k
  FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN top END AS refers_to
FROM d
"""


def _secret_sql() -> str:
    """Spans from the pieces between matches, as plain lists."""
    rules = [  # kind, expression, part that counts, its least length, base
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]{16,}", 0, 16),
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
        ("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1)]
    parts = []
    for i, (kind, regex, group, least) in enumerate(rules):
        r = "'" + regex.replace("'", "''") + "'"
        parts.append(f"""
  SELECT n, {i} AS o, '{kind}' AS kind, s, s + size AS e FROM (
    SELECT n, k, counted, size, sum(gap) OVER w + sum(size) OVER w - size AS s FROM (
      SELECT n, unnest(range(1, len(m) + 1)) AS k, unnest(list_transform(m, lambda x: length(x))) AS size,
             unnest(list_transform(m, lambda x: length(regexp_extract(x, {r}, {group})))) AS counted,
             unnest(list_transform(c[1:len(m)], lambda x: length(x))) AS gap
      FROM (SELECT n, regexp_extract_all(t, {r}) AS m, string_split_regex(t, {r}) AS c
            FROM docs WHERE regexp_matches(t, {r})))
    WINDOW w AS (PARTITION BY n ORDER BY k ROWS UNBOUNDED PRECEDING))
  WHERE counted >= {least}""")
    spans = "\n  UNION ALL".join(parts)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({spans}),
report AS (
  SELECT n, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN report USING (n)
"""


OP13 = r"""
WITH crc AS (  -- the byte table of CRC-32
  SELECT list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda z: z::BIGINT),
           lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS bytes),
docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
words AS (
  SELECT n, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM docs),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
bucket_of AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(0, strlen(word)),
                     lambda i: ('0x' || substr(hex(word), 2 * i::INT + 1, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM wanted), crc),
s AS (SELECT bucket, count(*) AS s FROM words JOIN bucket_of USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN bucket_of USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE)
                               / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)),
weighed AS (
  SELECT n, count(*) AS n_features, sum(g)::BIGINT AS total
  FROM words JOIN bucket_of USING (word) JOIN gain USING (bucket) GROUP BY n),
scored AS (
  SELECT n, doc_id, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN weighed USING (n)),
final AS (
  SELECT n, doc_id, n_features, weight,
         (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n) AS k,
         count(*) OVER (PARTITION BY n_features >= 20) AS held FROM final)
SELECT doc_id, n_features, weight::BIGINT AS weight, score,
       CASE WHEN n_features >= 20 AND k <= 10 * held // 100 THEN k END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": OP3, "op9_warc": OP9, "op10_secrets": _secret_sql(), "op13_resample": OP13}
