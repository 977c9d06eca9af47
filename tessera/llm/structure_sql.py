"""DuckDB SQL of the queries on periodic runs and on the trie of conversations."""

#: Unsigned CRC-32 of a decimal number, byte by byte over a table made here.
_CRC = """
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ascii(ch))),
                                  lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295) AS h FROM keys, tab)
"""

OP12_SQL = f"""
WITH keys AS (SELECT DISTINCT doc_id AS c FROM documents), {_CRC},
     d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS ws, h % 10 AS k, h // 10 AS g
           FROM documents JOIN crc ON c = doc_id),
     a AS (SELECT *, len(ws) AS n, CASE WHEN k = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM d),
     p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
     r AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws, n FROM p),
     w AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM r),
     v AS (SELECT doc_id, n, i, word, lead(word, 4) OVER o IS NOT NULL AS fits,
                  concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five
           FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.five = y.five AND x.fits AND y.fits AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
     s AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 5 + q AS size FROM (
             SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
     m AS (SELECT doc_id, start, size, min(q) AS q FROM s WHERE size >= 6 AND size >= 4 * q GROUP BY doc_id, start, size),
     b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(size AS DECIMAL(38, 18)) / q DESC, start, q) AS best FROM m),
     t AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || size || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256,
                  max(CASE WHEN best = 1 THEN start END) AS start, max(CASE WHEN best = 1 THEN size END) AS length, max(CASE WHEN best = 1 THEN q END) AS period
           FROM b GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + size)) AS i FROM m),
     k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT r.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM r LEFT JOIN t ON t.doc_id = r.doc_id LEFT JOIN k ON k.doc_id = r.doc_id
"""

OP13_SQL = f"""
WITH RECURSIVE keys AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
     t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
           FROM conversations WHERE conv_id IS NOT NULL),
     f AS (SELECT c, h % 9 AS h FROM crc),
     r AS (SELECT c, 0 AS part, i, role, text FROM f JOIN t ON conv_id = c - c % 5 AND i < h UNION ALL SELECT c, 1, i, role, text FROM f JOIN t ON conv_id = c AND i >= h),
     o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, sha256(octet_length(encode(role)) || ':' || role || text) AS digest, octet_length(encode(text)) AS bytes FROM r),
     l AS (SELECT c, max(d) AS turns FROM o GROUP BY c),
     x(c, d, prefix, parent, bytes) AS (SELECT c, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM f
           UNION ALL SELECT o.c, o.d, sha256(prefix || digest), prefix, o.bytes FROM x JOIN o ON o.c = x.c AND o.d = x.d + 1),
     n AS (SELECT prefix, parent, d, min(x.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                  sha256(coalesce(string_agg(CAST(x.c AS VARCHAR), ',' ORDER BY x.c) FILTER (WHERE d = coalesce(turns, 0)), '')) AS ends_sha256
           FROM x LEFT JOIN l ON l.c = x.c GROUP BY prefix, parent, d),
     k AS (SELECT parent AS prefix, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
     u(top, prefix, parent) AS (SELECT prefix, prefix, parent FROM n UNION ALL SELECT a.prefix, u.prefix, a.parent FROM u JOIN n a ON a.prefix = u.parent),
     s AS (SELECT top, count(*) FILTER (WHERE k.prefix IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
           FROM u JOIN n ON n.prefix = u.prefix LEFT JOIN k ON k.prefix = u.prefix GROUP BY top)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n a ON a.prefix = n.parent LEFT JOIN k ON k.prefix = n.prefix JOIN s ON s.top = n.prefix
"""
