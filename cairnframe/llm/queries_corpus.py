"""Registered queries over the whole corpus: packing and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing
from ._common import table


def tokenizer_paths() -> tuple[str, str]:
    """The public byte-level vocabulary and its rank file, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, *tokenizer_paths()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixing_sql(documents: str = "documents") -> str:
    """The mix as SQL over a relation with doc_id, source and text; gives s.* of each document too."""
    return rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM {documents}),
bs AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
w AS (SELECT *, {mixing.MAX_REPEAT} * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM bs),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, CAST(sum(w) OVER () AS DOUBLE) AS all_w,
             CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE) AS cap_before, CAST(coalesce(sum(w) OVER b, 0) AS DOUBLE) AS w_before FROM w
      WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS DOUBLE) * (all_w - w_before) < (all_size - cap_before) * CAST(w AS DOUBLE) AS capped FROM c),
t AS (SELECT source, n_docs, source_size, all_size,
             CASE WHEN capped THEN CAST(cap AS DOUBLE)
                  ELSE CAST((CAST(all_size AS BIGINT) - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS BIGINT)) * w AS DOUBLE)
                       / (all_w - CAST(coalesce(sum(w) FILTER (capped) OVER (), 0) AS DOUBLE)) END AS target FROM f),
{_apportion_sql("ta", "(SELECT *, 1 AS one, CAST(floor(all_size / " + str(mixing.BLOCK) + " + 0.5) AS BIGINT) AS seats FROM t)", "one", "source NULLS LAST", "target")},
q AS (SELECT source, source_size, target, quota AS blocks, CAST(ceil(CAST(n_docs AS DOUBLE) / {mixing.SHARD_DOCS}) AS BIGINT) AS n_shards FROM ta_q),
p AS (SELECT z.doc_id, z.source, z.size, z.h, q.source_size, q.target, q.blocks, CAST('0x' || substr(z.h, 1, 8) AS BIGINT) % q.n_shards AS shard
      FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
ce AS (SELECT source, shard, blocks AS seats, CAST(sum(size) AS BIGINT) AS cell_size FROM p GROUP BY ALL),
{_apportion_sql("ca", "ce", "source", "shard", "cell_size")},
cw AS (SELECT source, shard, cell_size, least(quota * {mixing.BLOCK}, cell_size * {mixing.MAX_REPEAT}) AS cell_words FROM ca_q),
l AS (SELECT p.*, cell_size, cell_words,
             CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM p JOIN cw ON p.source IS NOT DISTINCT FROM cw.source AND p.shard = cw.shard),
mixed AS (SELECT doc_id, source, size, source_size, target, CAST(CASE WHEN cell_size > 0
              THEN size * (cell_words // cell_size) + least(greatest(cell_words % cell_size - start, 0), size) ELSE 0 END AS BIGINT) AS taken FROM l)
"""


def _apportion_sql(name: str, rows: str, group: str, order: str, weight: str) -> str:
    """CTEs that end in ``{name}_q``: the rows and their ``quota`` of ``seats``."""
    return f"""
{name}_0 AS (SELECT *, CAST({weight} AS DOUBLE) AS wt, CAST(sum(CAST({weight} AS DOUBLE)) OVER (PARTITION BY {group}) AS DOUBLE) AS wall,
             count(*) OVER (PARTITION BY {group}) AS n, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS ord FROM {rows}),
{name}_1 AS (SELECT *, CASE WHEN wall > 0 THEN CAST(floor(CAST(seats AS DOUBLE) * wt / wall + 0.5) AS BIGINT) ELSE 0 END AS q0 FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN wall > 0 THEN CAST(seats - sum(q0) OVER (PARTITION BY {group}) AS BIGINT) ELSE 0 END AS diff FROM {name}_1),
{name}_3 AS (SELECT *, unnest(range(0, CASE WHEN diff = 0 THEN 1 ELSE CAST(floor(2 * n * wt / greatest(wall, 1.0)) AS BIGINT) + 3 END)) AS k FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN diff >= 0 THEN 2 * (q0 + k) + 1 ELSE 2 * (q0 - k) - 1 END AS odd FROM {name}_3),
{name}_5 AS (SELECT *, CASE WHEN odd > 0 THEN wt / odd END AS quo FROM {name}_4),
{name}_6 AS (SELECT *, quo IS NOT NULL AND row_number() OVER (PARTITION BY {group} ORDER BY quo IS NULL,
             CASE WHEN diff >= 0 THEN -quo ELSE quo END, CASE WHEN diff >= 0 THEN ord ELSE -ord END, k) <= abs(diff) AS moved FROM {name}_5),
{name}_q AS (SELECT * EXCLUDE (k, odd, quo, moved, up), q0 + CAST(sign(diff) AS BIGINT) * CAST(up AS BIGINT) AS quota
             FROM (SELECT *, count(*) FILTER (moved) OVER (PARTITION BY {group}, ord) AS up FROM {name}_6) WHERE k = 0)"""


OP6_SQL = mixing_sql() + "SELECT doc_id, size, source_size, target, taken FROM mixed"
