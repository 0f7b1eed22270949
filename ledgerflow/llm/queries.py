"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents
from ledgerflow.llm.divergence import audit
from ledgerflow.llm.exact_dedup import exact_dedup
from ledgerflow.llm.lang_id import identify
from ledgerflow.llm.line_dedup import drop_lines
from ledgerflow.llm.mixing import mix
from ledgerflow.llm.order_minhash import with_edits
from ledgerflow.llm.packing import VOCABULARY, markers_of, pack
from ledgerflow.llm.secrets import BASE_RULES, scan_secrets
from ledgerflow.llm.sharding import shard_by_bytes
from ledgerflow.llm.simhash import near_duplicates
from ledgerflow.llm.url_filter import Rule, judge_urls
from ledgerflow.llm.whitening import whiten
from ledgerflow.llm.wrappers import main_text
from ledgerflow.sources.tables import Tables


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line,
         trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
gone AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone ON lines.key = gone.key
GROUP BY r
"""


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(Tables(spark, sf_dir).get("pages")).withColumn("n_chars", F.length("text").cast("long"))


MIX_REPEATS = 2.0


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir), max_repeats=MIX_REPEATS)
    return out.select("doc_id", "source", "tokens", "copies", F.round("weight", 6).alias("weight"), "block", "start",
                      F.round("mix_key", 9).alias("mix_key"))


# The bisection's grid point has a closed form for a limit on repeats: (smallest / largest)^(a - 1) = limit.
OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key, md5(coalesce(doc_id::VARCHAR, '') || chr(0) || coalesce(text, '')) AS rk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, count(*) AS copies
  FROM documents GROUP BY ALL),
totals AS (SELECT key, sum(tokens * copies)::BIGINT AS total FROM docs GROUP BY key),
ends AS (SELECT sum(total) AS every, max(total)::DOUBLE AS hi, (min(total) FILTER (WHERE total > 0))::DOUBLE AS lo FROM totals),
point AS (SELECT every, hi, CASE WHEN hi / lo <= {MIX_REPEATS} THEN 0.0
                 ELSE ceil((1 + ln({MIX_REPEATS}::DOUBLE) / ln(lo / hi)) * 16777216) / 16777216 END AS a FROM ends),
plan AS (SELECT key, total, every, CASE WHEN total > 0 THEN pow(total::DOUBLE / every, a) ELSE 0 END AS w,
                CASE WHEN total > 0 THEN round(pow(total::DOUBLE, a) * pow(hi, 1 - a))::BIGINT ELSE 0 END AS budget FROM totals, point),
weighted AS (SELECT *, w / sum(w) OVER () AS weight FROM plan),
blocks AS (SELECT *, unnest(range(0, CASE WHEN total > 0 THEN (budget + total - 1) // total ELSE 1 END)) AS block FROM weighted),
placed AS (
  SELECT docs.*, weight, total, budget, block,
         coalesce(sum(tokens * copies) OVER (PARTITION BY key, block ORDER BY md5('0|' || block || '|' || rk), doc_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs JOIN blocks USING (key))
SELECT doc_id, source, tokens, copies, round(weight, 6) AS weight, block, start,
       round(CASE WHEN budget > 0 THEN (block * total + start)::DOUBLE / budget ELSE 0 END, 9) AS mix_key
FROM placed WHERE total = 0 OR (block + 1) * total <= budget OR block * total + start < budget
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir), length=1024, markers=markers_of(VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[number(r.kind) for r in BASE_RULES],
                      F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: The rules of the query.
URL_RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
             Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(Tables(spark, sf_dir).get("pages"), URL_RULES).drop("url")


# Links in their plain form only: absolute targets, quoted or bare, outside comments and scripts.
OP11_SQL = r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '<(?:link|meta)\s[^>]*>', 0, 'i')) AS tag
         FROM pages WHERE contains(url, '://')),
named AS (
  SELECT url, CASE WHEN regexp_matches(tag, '^<link\b.*\srel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is')
                     THEN regexp_extract(tag, '\shref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
                   WHEN regexp_matches(tag, '^<meta\b.*\shttp-equiv\s*=\s*["'']?refresh\b', 'is')
                     THEN regexp_extract(tag, 'url\s*=\s*["'']?([^"''\s>]+)', 1, 'i') END AS target FROM tags),
every AS (SELECT page_id, url, NULL::VARCHAR AS target FROM pages UNION ALL SELECT NULL, url, NULL::VARCHAR FROM named WHERE contains(target, '://')
          UNION ALL SELECT NULL, target, url FROM named WHERE contains(target, '://')),
split AS (
  SELECT page_id, url, target, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') END AS key FROM every),
hosts AS (SELECT DISTINCT host, path FROM split),
ruled AS (
  SELECT h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM hosts h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY ALL),
judged AS (SELECT split.*, rule, verdict FROM split LEFT JOIN ruled USING (host, path)),
links AS (SELECT DISTINCT a.key AS a, b.key AS b FROM judged a JOIN split b ON b.url = a.target WHERE a.target IS NOT NULL),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
bad AS (SELECT key FROM judged WHERE verdict = 'block' AND key IN (SELECT a FROM sides)
        UNION SELECT b FROM bad JOIN sides ON a = key)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
       verdict IS NULL AND coalesce(key IN (SELECT key FROM bad), false) AS inherited
FROM judged WHERE target IS NULL AND page_id IS NOT NULL
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(Tables(spark, sf_dir).get("embeddings"), components=4, scale=256)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), min_docs=3, top=200)


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN total USING (lang, source)
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
inlang AS (SELECT lang, term, sum(n) AS n, any_value(every) AS every FROM own JOIN (SELECT lang, sum(total) AS every FROM total GROUP BY lang)
           USING (lang) GROUP BY ALL),
wide AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (every + v)::HUGEINT AS q FROM inlang JOIN size USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense JOIN wide USING (lang, term)
          WHERE dense.n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
           UNION ALL
           SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_order_minhash": op7_order_minhash,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_secret_scan": op10_secret_scan,
    "op11_url_filter": op11_url_filter,
    "op12_whitening": op12_whitening,
    "op13_divergence_audit": op13_divergence_audit,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op11_url_filter": OP11_SQL,
    "op13_divergence_audit": OP13_SQL,
}
