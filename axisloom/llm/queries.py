"""Queries of this subpackage: each opN_* applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import held_out_scores
from .chat_format import fit_chat_model, formatted, marked
from .collision import near_vectors
from .common import crc_mod, table
from .decontaminate import contaminated
from .fill_middle import digests
from .jaccard_join import jaccard_classes
from .language_id import held_out_languages
from .license_scan import licenses
from .materialise import written_index
from .mixing import mixed
from .simhash import edited_fingerprints
from .spelling import spelling_variants, vocabulary
from .url_filter import host, judged


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations (markers in many styles, a quarter of them missing), parsed and rendered
    by a model of four of five folds of them; held_out marks the conversations of the fifth."""
    raw = marked(table(spark, sf_dir, "conversations"))
    held = crc_mod("conv_id", 5) == 2
    return formatted(raw.drop("role"), fit_chat_model(raw.filter(~held))).withColumn("held_out", held)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in every document."""
    return licenses(table(spark, sf_dir, "documents"))


# Hosts that the list blocks from its first day.
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "adult-x.example.net", "free-bets.example.com", "casino-win.example.org", "ads-track.example.org")


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of pages, as the table has none: the digest of a host decides whether it is
    blocked, released and blocked again, or blocked with one path allowed later."""
    h = pages.select(host(F.col("url")).alias("h")).filter("h is not null").distinct()
    m = F.conv(F.substring(F.md5(F.col("h")), 1, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n)
    row = lambda e, k, a, n: F.struct(e.alias("entry"), F.lit(k).alias("kind"), F.lit(a).alias("action"), day(n).alias("at"))
    again = F.array(row(F.col("h"), "host", "block", m), row(F.col("h"), "host", "remove", m + 300), row(F.col("h"), "host", "block", m + 600))
    part = F.array(row(F.col("h"), "host", "block", m), row(F.concat("h", F.lit("/en")), "path", "allow", m + 150))
    rule = h.select(F.explode(F.when(m < 48, again).when(m < 80, part)).alias("r")).select("r.*")
    fixed = pages.sparkSession.createDataFrame([(b,) for b in BLOCKED_HOSTS], "entry string").select("entry", F.lit("host").alias("kind"), F.lit("block").alias("action"), day(0).alias("at"))
    return rule.union(fixed)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active on its fetch day, which its id gives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(1000)).cast("int"))
    return judged(pages.withColumn("fetched_at", day), url_list(pages))


OP5_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST((page_id * 7919) % 1000 AS INT) AS fetched_at,
         rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS h,
         rtrim(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS p
  FROM pages),
h AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 2) AS INT) AS m FROM c WHERE h <> ''),
l AS (
  SELECT h AS key, 'host' AS kind, 'block' AS action, DATE '2023-01-01' + m AS day_at FROM h WHERE m < 80
  UNION ALL SELECT h, 'host', 'remove', DATE '2023-01-01' + m + 300 FROM h WHERE m < 48
  UNION ALL SELECT h, 'host', 'block', DATE '2023-01-01' + m + 600 FROM h WHERE m < 48
  UNION ALL SELECT h || '/en', 'path', 'allow', DATE '2023-01-01' + m + 150 FROM h WHERE m >= 48 AND m < 80
  UNION ALL SELECT unnest([BLOCKED]), 'host', 'block', DATE '2023-01-01'),
d AS (SELECT kind, key, day_at, max(action) AS action FROM l GROUP BY ALL),
s AS (SELECT *, lead(day_at) OVER (PARTITION BY kind, key ORDER BY day_at) AS until FROM d),
j AS (
  SELECT c.page_id, c.url, c.fetched_at, s.key, s.action, s.day_at AS since,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY (kind = 'path') DESC, length(key) DESC, (action = 'allow') DESC, key DESC) AS k
  FROM c JOIN s ON s.action <> 'remove' AND s.day_at <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until)
   AND ((s.kind = 'host' AND (c.h = s.key OR ends_with(c.h, '.' || s.key))) OR (s.kind = 'path' AND (c.h || c.p = s.key OR starts_with(c.h || c.p, s.key || '/')))))
SELECT c.page_id, c.url, c.fetched_at, coalesce(j.action = 'block', false) AS blocked, j.key AS rule, j.action AS rule_action, j.since AS rule_since
FROM c LEFT JOIN j ON j.k = 1 AND c.page_id = j.page_id AND c.url = j.url AND c.fetched_at = j.fetched_at
""".replace("BLOCKED", ", ".join(f"'{b}'" for b in BLOCKED_HOSTS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three of four folds."""
    return held_out_languages(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted 5, 2, 1 share 150 % of all words, none above two epochs."""
    return mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix') AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size, CAST(source_size AS DOUBLE) * 2.0 AS clamp, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
f AS (
  SELECT *, budget - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         CAST(sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open,
         row_number() OVER (ORDER BY clamp / weight, source NULLS LAST) AS k
  FROM r),
g AS (SELECT *, clamp * open <= rest * weight AS clamped FROM f),
e AS (SELECT rest, open FROM g WHERE NOT clamped ORDER BY k LIMIT 1),
t AS (
  SELECT g.source, g.source_size, CASE WHEN g.clamped THEN g.clamp ELSE e.rest * g.weight / e.open END AS target
  FROM g LEFT JOIN e ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (
  SELECT source, digest, size, count(*) AS n, CAST(sum(size) AS BIGINT) AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled
  FROM d GROUP BY source, digest, size),
x AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, u.n, u.words, CAST(round(p.target) AS BIGINT) - p.whole * p.source_size - u.filled AS room
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.digest = u.digest AND d.size = u.size)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (whole + CASE WHEN room >= words THEN 1 ELSE 0 END) * size + CASE WHEN room > 0 AND room < words THEN room // n ELSE 0 END END AS BIGINT) AS taken,
       CAST(CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN room >= words THEN 1 ELSE 0 END END AS BIGINT) AS repeats,
       CAST(CASE WHEN room > 0 AND room < words THEN room // n ELSE 0 END AS BIGINT) AS part
FROM x
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and add-one unigram scores of every document, learnt from six of seven folds."""
    return held_out_scores(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard of at least 0.9: set size and component of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents in training order; one row per sequence written."""
    return written_index(table(spark, sf_dir, "documents"), stored_input=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alignment of a document with a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 97 misspelt by deletion, with the words one edit away and their root form."""
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), one_in=97))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document by code points, and the digests of its output and of the text rebuilt."""
    return digests(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label with a cosine of 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_language_id": op2_language_id,
        "op3_mixing": op3_mixing,
        "op4_license_scan": op4_license_scan,
        "op5_url_filter": op5_url_filter,
        "op6_simhash": op6_simhash,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_token_output": op9_token_output,
        "op10_decontamination": op10_decontamination,
        "op11_spelling": op11_spelling,
        "op12_fill_middle": op12_fill_middle,
        "op13_near_vectors": op13_near_vectors,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_url_filter": OP5_SQL, "op12_fill_middle": OP12_SQL}
