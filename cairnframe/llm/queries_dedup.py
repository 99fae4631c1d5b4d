"""Registered queries of deduplication: near-duplicate documents and repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, near_dedup
from ._common import table


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=4, percent=80)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.removed_lines(docs).withColumnRenamed("doc_id", "id")
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


def line_dedup_sql(documents: str = "documents") -> str:
    """CTEs that end in ``gone`` (doc_id, line_no): the lines to remove."""
    return rf"""
src AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM {documents} WHERE doc_id IS NOT NULL),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS line_no FROM src),
l1 AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l0),
ln AS (SELECT * FROM l1 WHERE len(s) > 0),
st AS (SELECT s, min((doc_id, line_no)) AS f, row_number() OVER () AS id FROM ln GROUP BY s),
tk AS (SELECT id, f, len(s) AS n, unnest(s) AS w FROM st),
rk AS (SELECT id, f, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS i FROM (SELECT *, count(*) OVER (PARTITION BY w) AS df FROM tk)),
px AS (SELECT * FROM rk WHERE i <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
cd AS (SELECT DISTINCT a.id AS a, b.id AS b FROM px a JOIN px b ON a.w = b.w AND a.f < b.f AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
sm AS (SELECT DISTINCT cd.b AS id FROM cd JOIN st x ON x.id = cd.a JOIN st y ON y.id = cd.b
       WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
gone AS (SELECT DISTINCT ln.doc_id, ln.line_no FROM ln JOIN st ON ln.s = st.s LEFT JOIN sm ON sm.id = st.id
         WHERE sm.id IS NOT NULL OR (ln.doc_id, ln.line_no) <> st.f)
"""


OP1_SQL = "WITH " + line_dedup_sql() + r"""
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.r, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT line_no) AS n FROM ln GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS r FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""
