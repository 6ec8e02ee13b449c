"""Tables derived from the given ones, as SQL for both engines.

``{documents}`` and the like stand for table names. One text serves Spark and
the checking engine, except for ``buckets``, see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WEBPAGES = r"""
SELECT doc_id AS seq,
       CASE doc_id % 5
         WHEN 0 THEN concat('# ', replace(text, chr(10), concat(chr(10), chr(10))))
         WHEN 1 THEN replace(text, chr(10), concat(chr(10), chr(10), '## '))
         WHEN 2 THEN concat(' # ', replace(text, chr(10), concat('  ', chr(10), chr(10), ' #')))
         WHEN 3 THEN concat(replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10))
         ELSE concat('# ', text) END AS webpage,
       concat('Writes in ', lang, ' for ', source) AS author
FROM {documents}
"""

PAIRS = r"""
SELECT CASE WHEN d.doc_id % 3 < 2 THEN 'WI' ELSE 'WR' END AS pool,
       d.doc_id AS seq,
       w.webpage AS webpage,
       CASE WHEN d.doc_id % 19 = 7 THEN '' ELSE d.text END AS request,
       CASE WHEN d.doc_id % 23 = 5 THEN NULL
            WHEN d.doc_id % 29 = 3 THEN ''
            WHEN d.doc_id % 11 = 0 THEN concat('I''m sorry, ', d.text)
            WHEN d.doc_id % 13 = 0 THEN concat('I apologize. ', d.text)
            WHEN d.doc_id % 17 = 0 THEN concat('We are sorry, I''m sorry: ', d.text)
            WHEN d.doc_id % 7 = 1 THEN concat('Here is the Improved Answer:', chr(10), chr(10), '---', chr(10), d.text, chr(10), chr(10), '---')
            WHEN d.doc_id % 7 = 2 THEN concat('Here''s it all in one block: ', d.text)
            WHEN d.doc_id % 7 = 3 THEN concat('"', d.text, '"')
            ELSE d.text END AS response
FROM {documents} d JOIN {webpages} w ON w.seq =
  CASE WHEN d.doc_id < 3 THEN d.doc_id
       WHEN d.doc_id % 3 = 2 AND d.doc_id % 4 = 0 THEN d.doc_id - 1
       WHEN d.doc_id % 3 = 2 AND d.doc_id % 4 = 1 THEN d.doc_id - 3
       WHEN d.doc_id % 3 = 1 AND d.doc_id % 8 = 0 THEN d.doc_id - 1
       ELSE d.doc_id END
"""

TURN_PAIRS = r"""
SELECT conv_id, turn, text AS request, next_text AS response
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM {conversations}) t
WHERE role = 'user' AND next_role = 'assistant'
"""

# Texts with letters of other scripts in place of some: Han, Thai, kana with an ideographic
# space, and combining marks.
SCRIPTS = """
SELECT doc_id AS seq, lang,
       CASE doc_id % 4
         WHEN 0 THEN translate(text, 'aeiou', '的一是不了')
         WHEN 1 THEN translate(text, 'st.', 'กขฯ')
         WHEN 2 THEN replace(translate(text, 'en', 'のア'), ' ', '　')
         ELSE replace(text, 'e', 'e\u0301') END AS text
FROM {documents}
"""

# Answers of two stages under the category that a page is routed to (``doc_id`` is dense), but
# every seventh under another one.
COMPLETIONS = r"""
SELECT seq, stage,
       CASE WHEN seq % 7 = 3 THEN 'WI_all' WHEN seq < 2 * k THEN 'WI_all' WHEN seq < 4 * k THEN 'WI_part'
            WHEN seq < 5 * k THEN 'WR_all' ELSE 'WR_part' END AS category,
       concat(stage, ' of page ', CAST(seq AS STRING)) AS completion
FROM (SELECT seq, 'request' AS stage, floor((SELECT count(*) FROM {webpages}) / 6) AS k FROM {webpages} WHERE seq % 10 <> 9
      UNION ALL
      SELECT seq, 'response', floor((SELECT count(*) FROM {webpages}) / 6) FROM {webpages} WHERE seq % 10 < 6) answered
"""

# Three rows per document, without a join: the bands are unnested from a list
# ({bands}, spelled per engine) and the table size is a scalar subquery.
BUCKETS = r"""
SELECT doc_id AS idx, band,
       (doc_id * doc_id * (band + 1) + 7 * doc_id * band + doc_id * (doc_id % 11))
         % (3 * (SELECT count(*) FROM {documents}) + 7) AS key
FROM (SELECT doc_id, {bands} AS band FROM {documents}) d
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def webpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEBPAGES, documents=documents(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAIRS, documents=documents(spark, sf_dir), webpages=webpages(spark, sf_dir))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TURN_PAIRS, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCRIPTS, documents=documents(spark, sf_dir))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMPLETIONS, webpages=webpages(spark, sf_dir))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = BUCKETS.replace("{bands}", "explode(array(0, 1, 2))")
    return spark.sql(text, documents=documents(spark, sf_dir))


def quota_base(spark: SparkSession, sf_dir: str) -> int:
    """Rows to save at this scale: three tenths of the documents (60, 300, 3,000)."""
    return documents(spark, sf_dir).count() * 3 // 10
