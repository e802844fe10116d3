"""The queries of the corpus operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, imatch, language, line_dedup, mixing, simhash, site_tree, substring_dedup, toxicity, url_reputation
from .common import table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document that bears its number; it went badly if that is of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fold(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out fold. A document with several labels is toxic if one says so."""
    marks = labels.where(fold(4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.train(docs.join(marks, "doc_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    """offending: the numbers, from 0, of the sentences that score 0.3 or more by themselves."""
    out = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("offending.sentence").alias("offending"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(3) != 1).select("doc_id", "text", "lang"))
    out = language.identify(docs, model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_tree.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it leaks."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_reputation, op2_simhash, op3_substring_dedup, op4_mixing, op5_imatch, op6_toxicity, op7_language, op8_site_tree, op9_line_dedup, op10_decontamination)
}

OP1_SQL = r"""
WITH urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM urls)),
marks AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::bigint AS bad,
         array_to_string(string_split(name, '.')[-(labels + 1):], '.') AS domain, array_to_string(string_split(name, '.')[-labels:], '.') AS suffix
  FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, CASE WHEN regexp_matches(name, '(^|\.)(' || '@SUFFIXES@' || ')$') THEN 2 ELSE 1 END AS labels FROM parts) named LEFT JOIN marks USING (page_id) GROUP BY host, name, labels),
domains AS (SELECT domain, suffix, sum(n)::bigint AS n, sum(bad)::bigint AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::bigint AS n, sum(bad)::bigint AS bad FROM hosts GROUP BY suffix),
groups AS (SELECT 1 AS l, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains UNION ALL SELECT 3, n, bad FROM hosts),
sums AS (
  SELECT l, sum(bad)::double AS x, sum(n)::double AS m, count(*) AS k, sum(n * n)::double AS n2, sum(bad::double * bad / n) AS r2
  FROM groups WHERE n > 0 GROUP BY l),
rho AS (
  SELECT l, x, m, m - n2 / m - (k - 1) AS free, x > 0 AND x < m AND m - n2 / m - (k - 1) > 0 AS usable,
         ((r2 - x * (x / m)) / ((x / m) * (1 - x / m)) - (k - 1)) / (m - n2 / m - (k - 1)) AS rho FROM sums),
strength AS (SELECT l, CASE WHEN usable AND rho > 0.000999 THEN least(greatest((1 - rho) / rho, 1.0), 1000.0) ELSE 1000.0 END AS k, (x + 1.0) / (m + 2.0) AS mean FROM rho),
ks AS (
  SELECT coalesce(max(k) FILTER (l = 1), 1000.0) AS k1, coalesce(max(k) FILTER (l = 2), 1000.0) AS k2, coalesce(max(k) FILTER (l = 3), 1000.0) AS k3,
         coalesce(max(mean) FILTER (l = 1), 0.5) AS mean FROM strength),
ms AS (SELECT suffix, (bad + k1 * mean) / (n + k1) AS ms FROM suffixes, ks),
md AS (SELECT domain, (bad + k2 * ms) / (n + k2) AS md FROM domains JOIN ms USING (suffix), ks),
post AS (SELECT host, n, bad, (bad + k3 * md) / (n + k3) AS p, n + k3 AS total FROM hosts JOIN md USING (domain), ks),
rules(action, rule, host, path) AS (
  VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
         ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits AS (
  SELECT DISTINCT p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path)
SELECT page_id, parts.host, parts.path, fits.rule,
       coalesce(fits.action, CASE WHEN p - 1.645 * sqrt(p * (1 - p) / (total + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS host_labelled, bad AS host_bad
FROM parts JOIN post USING (host) LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
""".replace("@SUFFIXES@", "|".join(s.replace(".", "\\.") for s in url_reputation.SUFFIXES))

OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
sums AS (SELECT source, sum(size)::bigint AS source_size, count(*) AS n FROM sizes GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::bigint AS w FROM sums),
fill AS (
  SELECT *, 1.5::double * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER (ORDER BY source_size * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size * 10 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM ranked),
marked AS (SELECT *, rest * w >= free * 2 * source_size AS whole_source FROM fill),
goal AS (
  SELECT source, source_size, n, CASE WHEN whole_source THEN (2 * source_size)::double
    ELSE (SELECT max(rest::double / free) FILTER (NOT whole_source AND rest * w < free * 2 * source_size) FROM (SELECT * FROM marked WHERE NOT whole_source ORDER BY source_size * 10 / w, source NULLS LAST LIMIT 1)) * w END AS target
  FROM marked),
classes AS (SELECT source, length(bin(size)) AS bits, sum(size)::bigint AS s FROM sizes WHERE size > 0 GROUP BY ALL),
c1 AS (
  SELECT c.source, c.bits, s, target, n, bits + 8 AS w,
         target - coalesce(2 * sum(s) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS rest,
         sum((bits + 8) * s) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::double AS mass
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
c2 AS (SELECT *, rest * w >= mass * 2 AS whole_class FROM c1),
c3 AS (
  SELECT *, CASE WHEN whole_class THEN 2.0::double
    ELSE first_value(CASE WHEN NOT whole_class THEN rest / mass END IGNORE NULLS) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w END AS copies FROM c2),
c4 AS (SELECT *, floor(copies)::bigint AS whole, copies - floor(copies) AS p FROM c3),
c5 AS (SELECT *, round(target)::bigint - sum(whole * s) OVER (PARTITION BY source) AS lack FROM c4),
drawn AS (
  SELECT z.doc_id, z.source, z.size, whole, p, lack,
         (('0x' || substr(md5(coalesce(z.doc_id::varchar, 'null') || ':mix'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 AS u
  FROM sizes z JOIN c5 ON z.source IS NOT DISTINCT FROM c5.source AND length(bin(z.size)) = c5.bits WHERE z.size > 0),
odds AS (SELECT *, u / (1.0::double - u) * ((1.0::double - p) / p) AS q FROM drawn WHERE p > 0),
ahead AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds),
taken AS (
  SELECT doc_id, source, size, whole * size + greatest(0, least(size, lack - before)) AS taken FROM ahead
  UNION ALL SELECT doc_id, source, size, whole * size FROM drawn WHERE NOT p > 0
  UNION ALL SELECT doc_id, source, size, 0 FROM sizes WHERE size = 0)
SELECT doc_id, size, source_size, target, taken::bigint AS taken FROM taken t JOIN goal g ON t.source IS NOT DISTINCT FROM g.source
"""

OP3_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 18))) AS i FROM split),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM starts),
gone AS (SELECT DISTINCT doc_id, i + o.o AS pos FROM ranked, range(20) o(o) WHERE r > 1),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
texts AS (
  SELECT line, min((doc_id, i)) AS f, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS toks
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
numbered AS (SELECT row_number() OVER (ORDER BY f) AS id, * FROM texts),
tokens AS (SELECT id, len(toks) AS n, unnest(toks) AS t FROM numbered),
rarity AS (SELECT t, count(*) AS df FROM tokens GROUP BY t),
placed AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS pos FROM tokens JOIN rarity USING (t)),
heads AS (SELECT * FROM placed WHERE pos <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.t = b.t AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
links AS (
  SELECT a, b FROM pairs JOIN numbered x ON x.id = a JOIN numbered y ON y.id = b
  WHERE 9 * len(list_intersect(x.toks, y.toks)) >= 4 * (len(x.toks) + len(y.toks))),
ends AS (SELECT a AS id, b AS o FROM links UNION ALL SELECT b, a FROM links),
other AS (SELECT id, count(*) AS links, min(o) AS o FROM ends GROUP BY id),
verdict AS (
  SELECT l.doc_id, l.i, l.line, coalesce(links, 0) AS links,
         coalesce(x.f < (l.doc_id, l.i) OR z.f < (l.doc_id, l.i), x.f < (l.doc_id, l.i), false) AS goes
  FROM lines l LEFT JOIN numbered x ON x.line = l.line LEFT JOIN other ON other.id = x.id LEFT JOIN numbered z ON z.id = other.o)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed, sum(links)::bigint AS n_links,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM verdict GROUP BY doc_id
"""

#: What SQL can express of them.
ORACLE_SQL: dict[str, str] = {"op1_url_reputation": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op9_line_dedup": OP9_SQL}
