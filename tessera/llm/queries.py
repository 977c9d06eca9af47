"""The thin ``opN_<name>`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import (
    collisions,
    decontaminate,
    hyperminhash,
    linededup,
    packing,
    periodic,
    quality,
    secrets,
    substring,
    toxicity,
    turntrie,
    urlfilter,
    warc,
)
from tessera.llm.common import table
from tessera.llm.structure_sql import OP12_SQL, OP13_SQL


def tokenizer_path() -> str:
    """The public vocabulary file that the packing query is fixed to."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed by the query: (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"), "n_entropy",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of lines and the numbers of those removed."""
    docs = table(spark, sf_dir, "documents")
    gone = linededup.repeated_lines(docs).groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(
        F.sort_array(F.collect_set("line")).alias("removed"), F.sum(F.col("distance").cast("long")).alias("edits")
    )
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.size(F.split("text", "\n")).cast("long").alias("n"))
    return lines.join(gone, (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("edits", F.lit(0)).alias("n_near"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urlfilter.verdicts(pages, urlfilter.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def _planted(docs: DataFrame) -> DataFrame:
    """The query's texts: every tenth document's words, by a hash of the id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("w")
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    docs = docs.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get("w", F.col("a") + i % F.col("p")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(text).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    c, n = F.col("conv_id").cast("long"), F.col("h")
    paths = turntrie.turn_paths(turns, spread=c - c % 5)
    first = F.max(F.when(F.col("conv_id") == F.col("spread"), F.col("path"))).over(Window.partitionBy("spread"))
    first = F.coalesce(first, F.slice("path", 1, 0))
    paths = paths.select("conv_id", "path", first.alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"))
    own = F.slice("path", n + 1, F.greatest(F.size("path") - n, F.lit(0)))
    return turntrie.trie(paths.select("conv_id", F.concat(F.slice("first", F.lit(1), n), own).alias("path")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_warc, op3_quality_rules, op4_hyperminhash, op5_toxicity, op6_line_dedup,
        op7_substring_dedup, op8_decontamination, op9_url_filter, op10_packing, op11_collision_neighbours, op12_periodic_runs,
        op13_prefix_trie,
    )
}

_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     s AS (SELECT page_id, sha256(html) AS payload_digest, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

_OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
     n AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
     v AS (SELECT doc_id, i, word, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win,
                  lead(word, 4) OVER o IS NOT NULL AS fits FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT doc_id, i, fits AND count(*) OVER (PARTITION BY doc_id, win, fits) > 1 AS again FROM v),
     c AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (
             SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r) GROUP BY doc_id),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM w),
     j AS (SELECT doc_id, line, pos, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS m,
                  length(line) - length(translate(line, '#*$%&|<>', '')) AS sym, length(line) - length(translate(line, '|»•›', '')) AS sep,
                  length(line) - length(translate(line, '.,;:!?…。，、；：！？،؛؟۔।', '')) AS punct FROM l),
     u AS (SELECT *, m > 0 AND (sym * 100 > 10 * length(line) OR (sep >= 3 AND sep * 5 >= m) OR (m > 15 AND punct = 0)
                    OR regexp_matches(lower(line), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|lorem ipsum|subscribe to our newsletter|click here|sign in to continue|tous droits réservés|politique de confidentialité|mentions légales|cliquez ici|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|hier klicken|todos los derechos reservados|política de privacidad|política de cookies|haga clic aquí'))
                  AS fails, m BETWEEN 1 AND 3 AND punct = 0 AS entry FROM j),
     q AS (SELECT doc_id, pos, count(*) FILTER (WHERE m > 0 AND NOT entry) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM u WHERE NOT fails),
     e AS (SELECT doc_id, pos, entry AND count(*) FILTER (WHERE entry) OVER (PARTITION BY doc_id, run) >= 5 AS menu FROM q JOIN u USING (doc_id, pos)),
     g AS (SELECT u.doc_id, CAST(count(*) FILTER (WHERE m > 0) - count(DISTINCT line) FILTER (WHERE m > 0) AS BIGINT) AS n_dup_lines,
                  CAST(sum(m) FILTER (WHERE NOT fails AND NOT menu) AS BIGINT) AS words_left
           FROM u LEFT JOIN e ON e.doc_id = u.doc_id AND e.pos = u.pos GROUP BY u.doc_id),
     a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                  n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(words_left, 0) AS words_left
           FROM w JOIN g ON g.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left * 100 >= n_words * 50 AS kept
FROM a
"""

_OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b),
     c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

_OP9_SQL = """
WITH rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
     u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
     p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
     m AS (SELECT page_id, rhost || rpath AS rule, action,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, action DESC, rhost || rpath DESC) AS k
           FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""

_OP6_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
     t AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM l),
     v AS (SELECT doc_id, line, v FROM t WHERE v <> ''),
     f AS (SELECT v, min((doc_id, line)) AS first, length(v) AS n FROM v GROUP BY v),
     e AS (SELECT v.doc_id, v.line, 0 AS d FROM v JOIN f ON f.v = v.v WHERE f.first < (v.doc_id, v.line)),
     h AS (SELECT v, first, n, unnest([left(v, n // 2), left(v, (n + 1) // 2), left(v, (n - 1) // 2)]) AS head FROM f WHERE n >= 20
           UNION ALL SELECT v, first, n, reverse(head) FROM (SELECT v, first, n, unnest([left(reverse(v), n // 2), left(reverse(v), (n + 1) // 2), left(reverse(v), (n - 1) // 2)]) AS head FROM f WHERE n >= 20)),
     p AS (SELECT DISTINCT a.v AS v, a.first AS first, b.v AS w FROM h a JOIN h b ON a.head = b.head AND b.first < a.first AND abs(a.n - b.n) <= 1),
     s AS (SELECT DISTINCT first FROM p WHERE levenshtein(v, w) = 1),
     g AS (SELECT doc_id, line, d FROM e UNION ALL SELECT first[1], first[2], 1 FROM s),
     r AS (SELECT doc_id, count(*) AS n_removed, sum(d) AS n_near, string_agg(line, ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed_lines
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""

#: The two that scan windows are whole-table window functions in SQL.
_OP7_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     n AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
     v AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER o = 13 THEN string_agg(word, ' ') OVER o END AS win FROM n
           WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
     f AS (SELECT doc_id, i, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM v),
     c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
     k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": _OP2_SQL,
    "op3_quality_rules": _OP3_SQL,
    "op4_hyperminhash": _OP4_SQL,
    "op6_line_dedup": _OP6_SQL,
    "op7_substring_dedup": _OP7_SQL,
    "op9_url_filter": _OP9_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
