"""The queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from . import decontam, kneser_ney, langid, licenses, neardup, packing, perplexity, quality_rules, substring, warc

#: The tokenizer file that op8 and the pipeline pack with; a parameter of ``packing.pack``.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pages in an archive of op1.
ARCHIVE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(n: int):
    """Is crc32 of the id's digits divisible by n?"""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == 0


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages, archived 4096 pages to a file, that lost and damaged some records in a fixed way."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / ARCHIVE).cast("string").alias("archive"), F.pmod("page_id", F.lit(ARCHIVE)).cast("long").alias("ord"), body.cast("binary").alias("payload"), F.octet_length(body).cast("long").alias("length"), "page_id")
    base = base.withColumn("offset", F.sum("length").over(W.partitionBy("archive").orderBy("ord")) - F.col("length"))
    lost, hurt = F.col("page_id") * 7919 % 101 == 7, F.col("page_id") * 7919 % 97 == 5
    payload = F.when(hurt, F.concat(F.lit("?"), F.col("payload").cast("string")).cast("binary")).otherwise(F.col("payload"))
    return warc.audit(base.drop("page_id"), base.filter(~lost).withColumn("payload", payload).drop("page_id")).drop("checked")


OP1_SQL = f"""WITH p AS (SELECT page_id, CAST(page_id // {ARCHIVE} AS VARCHAR) AS archive, page_id % {ARCHIVE} AS ord, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length FROM pages),
a AS (SELECT *, CAST(sum(length) OVER (PARTITION BY archive ORDER BY ord) AS BIGINT) - length AS "offset" FROM p)
SELECT archive, ord, "offset", length, sha256(html) AS digest_a, CASE WHEN page_id * 7919 % 101 = 7 THEN NULL ELSE sha256('?' || html) END AS digest_b,
CASE WHEN page_id * 7919 % 101 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM a WHERE page_id * 7919 % 101 = 7 OR page_id * 7919 % 97 = 5"""


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.learn(docs.filter(~held_out(5)), "text", "lang")
    return langid.identify(docs, known).select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark, digests=licenses.DIGESTS))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs.filter(~held_out(10)))).withColumn("held_out", held_out(10))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
OP10_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS}, []) AS w FROM documents),
s AS (SELECT r, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
g AS (SELECT r, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM g),
x AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
sha256(array_to_string(list_filter(w, lambda a, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k"""

OP4_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, w[p] || ' ' || w[p + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS p FROM w WHERE len(w) >= 2) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
sh AS (SELECT DISTINCT doc_id, s FROM u),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT DISTINCT a AS doc_id, a AS r FROM e2 UNION SELECT c.doc_id, e2.b FROM c JOIN e2 ON c.r = e2.a),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.r, w.doc_id) AS component_id, coalesce(m.r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""

QUERIES = {f.__name__: f for f in (op1_warc_fixity, op2_decontam, op3_quality_rules, op4_near_dedup, op5_language_id, op6_quality_perplexity, op7_license_scan, op8_packing, op9_lm_scoring, op10_substring_dedup)}
ORACLE = {"op1_warc_fixity": OP1_SQL, "op2_decontam": decontam.ORACLE, "op4_near_dedup": OP4_SQL, "op7_license_scan": licenses.scan_sql(digests=licenses.DIGESTS), "op10_substring_dedup": OP10_SQL}
