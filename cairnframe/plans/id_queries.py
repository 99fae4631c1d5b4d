"""Registered queries over ids, package ids, locators, paths and node states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, package_ids, versions
from ..operators import locators, overlay
from ..operators import packages as pkg
from .queries import query
from .tables import packages, table

KINDS = ("sha256", "mix256", "sha512", "mix512", "qcid", "cydir", "cyfile", "clist", "clist-fix", "cylist-mtree", "cypkg")
_KIND = "[" + ",".join(f"'{k}'" for k in KINDS) + "][CAST(doc_id % 11 AS INTEGER) + 1]"
_SHA = "sha256(coalesce(text, ''))"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, and the hash of each document under a type tag that goes round."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 11).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.concat(kind, F.lit(":"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("obj_id"))


@query(f"""SELECT doc_id, k IN ('sha256','mix256','sha512','mix512','qcid') AS chunk, k IN ('mix256','mix512','qcid') AS mix, k = 'clist' AS chunk_list,
k IN ('cydir','clist','clist-fix','cylist-mtree') AS container, k IN ('clist-fix','cylist-mtree') AS big, k IN ('cyfile','cypkg') AS json,
CASE k WHEN 'cydir' THEN 'Dir' WHEN 'cyfile' THEN 'File' ELSE 'Unknown' END AS kind,
CASE WHEN k = 'mix256' THEN 'sha256' WHEN k = 'mix512' THEN 'sha512' ELSE k END AS method, CASE WHEN k IN ('sha512','mix512') THEN 64 ELSE 32 END AS hash_size
FROM (SELECT doc_id, {_KIND} AS k FROM documents)""")
def id_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    return _typed(spark, sf_dir).select(
        "doc_id", ids.is_chunk(k).alias("chunk"), ids.is_mix(k).alias("mix"), ids.is_chunk_list(k).alias("chunk_list"), ids.is_container(k).alias("container"),
        ids.is_big_container(k).alias("big"), ids.is_json(k).alias("json"), ids.object_kind(k).alias("kind"), ids.hash_method(k).alias("method"), ids.hash_size(k).alias("hash_size"))


@query(f"""SELECT doc_id, obj_id, split_part(obj_id, ':', 2) || '.' || k AS filename, 'did:' || obj_id AS did, lower(hex(encode(k || ':')) || split_part(obj_id, ':', 2)) AS raw_hex,
obj_id AS parsed, obj_id AS unpacked, obj_id AS from_base32, 'http://data.example/o/' || obj_id AS url, CASE WHEN k IN ('sha256','mix256','sha512','mix512','qcid') THEN 'chunk' WHEN k = 'clist' THEN 'chunk_list' WHEN k = 'cyfile' THEN 'file' ELSE 'unsupported' END AS pull
FROM (SELECT doc_id, {_KIND} AS k, {_KIND} || ':' || {_SHA} AS obj_id FROM documents)""")
def id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("obj_id")
    return _typed(spark, sf_dir).select(
        "doc_id", "obj_id", ids.to_filename(x).alias("filename"), ids.to_did(x).alias("did"), F.lower(F.hex(ids.to_bytes(x))).alias("raw_hex"),
        ids.parse_id(x).alias("parsed"), ids.from_bytes(ids.to_bytes(x)).alias("unpacked"), ids.parse_id(ids.to_base32(x)).alias("from_base32"),
        ids.object_url(F.lit("http://data.example/o/"), x).alias("url"), locators.pull_kind(x).alias("pull"))


@query(f"""WITH u AS (SELECT doc_id, 'https://h.example/v/' || lang || '/sha256:' || {_SHA} || '/part/' || (doc_id % 7) || '?x=' || doc_id AS url, lang, {_SHA} AS h FROM documents)
SELECT doc_id, 'sha256:' || h AS obj_id, '/part/' || (doc_id % 7) AS inner_path, 'path:2' AS locator, 'https://h.example/v/' || lang || '/sha256:00ff/part/' || (doc_id % 7) || '?x=' || doc_id AS replaced,
CASE WHEN doc_id % 2 = 0 THEN 'known:01' ELSE 'sha256:' || h END AS effective FROM u""")
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, digest = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    url = F.concat(F.lit("https://h.example/v/"), "lang", F.lit("/sha256:"), digest, F.lit("/part/"), (doc % 7).cast("string"), F.lit("?x="), doc.cast("string"))
    at = ids.from_url(F.col("url"))
    return table(spark, sf_dir, "documents").select("doc_id", url.alias("url")).withColumn("at", at).select(
        "doc_id", "at.obj_id", "at.inner_path", "at.locator", ids.replace_id(F.col("url"), F.lit("sha256:00ff")).alias("replaced"),
        locators.effective_id(F.when(doc % 2 == 0, F.lit("known:01")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("at.obj_id")).alias("effective"))


_PKGS = """pk AS (SELECT p_partkey, lower(p_type) AS pkg_name, regexp_extract(p_brand, '([0-9]+)', 1) || '.' || p_size || '.' || (p_partkey % 7) AS version,
CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS v1, p_size AS v2, p_partkey % 7 AS v3, 'meta' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS metaobjid,
CASE p_partkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'beta' END AS tag FROM part)"""


@query(f"""WITH {_PKGS} SELECT p_partkey, pkg_name AS name, CASE WHEN p_partkey % 4 IN (1, 3) THEN '>=' || version ELSE NULL END AS version, CASE WHEN p_partkey % 4 IN (2, 3) THEN metaobjid END AS objid,
'did:bns:' || pkg_name AS did, pkg_name || '#' || version || coalesce(':' || tag, '') AS package_id, 'linux.' || pkg_name AS prefixed, pkg_name AS unique_name FROM pk""")
def pkg_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.concat(F.lit(">="), "version")
    form = F.col("p_partkey") % 4
    text = F.when(form == 0, F.col("pkg_name")).when(form == 1, F.concat_ws("#", "pkg_name", wanted)).when(form == 2, F.concat_ws("#", "pkg_name", "metaobjid")).otherwise(F.concat_ws("#", "pkg_name", wanted, "metaobjid"))
    rows = packages(spark, sf_dir).withColumn("p", package_ids.parse(text))
    return rows.select(
        "p_partkey", "p.name", "p.version", "p.objid", package_ids.to_did(F.col("pkg_name")).alias("did"),
        package_ids.package_id(F.col("pkg_name"), F.col("version"), F.col("tag")).alias("package_id"), package_ids.with_prefix(F.col("pkg_name"), "linux").alias("prefixed"),
        package_ids.unique_name(F.concat(F.lit("linux."), "pkg_name")).alias("unique_name"))


_BEST = "max_by(metaobjid, [CAST(v1 AS BIGINT), v2, v3, CAST(substr(metaobjid, 5) AS BIGINT)])"
_LOOKUP = f"""{_PKGS}, w AS (SELECT DISTINCT pkg_name FROM pk),
a AS (SELECT pkg_name AS pkg_id, {_BEST} AS metaobjid FROM pk GROUP BY pkg_name),
b AS (SELECT pkg_name || '#>=20.10.0:stable' AS pkg_id, {_BEST} AS metaobjid FROM pk WHERE tag = 'stable' AND (v1 > 20 OR v1 = 20 AND v2 >= 10) GROUP BY pkg_name),
c AS (SELECT pkg_name || '#' || metaobjid AS pkg_id, metaobjid FROM pk WHERE p_partkey % 10 = 0),
e AS (SELECT pkg_name || '#' || version AS pkg_id, max_by(metaobjid, metaobjid) AS metaobjid FROM pk GROUP BY pkg_name, version)"""


def _wanted(index: DataFrame) -> DataFrame:
    """Ids of all forms: any version, a requirement with a tag, an object, a version."""
    some = index.where(F.col("p_partkey") % 10 == 0).select(F.concat_ws("#", "pkg_name", "metaobjid").alias("pkg_id"))
    return index.select(F.explode(F.array(F.col("pkg_name"), F.concat("pkg_name", F.lit("#>=20.10.0:stable")), F.concat_ws("#", "pkg_name", "version"))).alias("pkg_id")).unionByName(some)


@query(f"""WITH {_LOOKUP}, f AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e)
SELECT f.pkg_id, f.metaobjid, pk.version FROM f JOIN pk USING (metaobjid)""")
def pkg_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = packages(spark, sf_dir)
    return pkg.lookup(index, _wanted(index))


@query(f"""WITH {_PKGS}, f AS (SELECT pkg_name AS pkg_id, 0 AS env, {_BEST} AS metaobjid FROM pk WHERE v2 < 5 GROUP BY pkg_name
UNION ALL SELECT pkg_name, 1, {_BEST} FROM pk WHERE v2 >= 5 AND pkg_name NOT IN (SELECT pkg_name FROM pk WHERE v2 < 5) GROUP BY pkg_name)
SELECT f.pkg_id, f.metaobjid, pk.version, f.env FROM f JOIN pk USING (metaobjid)""")
def pkg_lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = packages(spark, sf_dir)
    return pkg.lookup_chain([index.where("p_size < 5"), index.where("p_size >= 5")], index.select(F.col("pkg_name").alias("pkg_id")))


@query(f"""WITH {_PKGS}, own AS (SELECT pkg_name, metaobjid, v1, v2, v3, metaobjid = {_BEST} OVER (PARTITION BY pkg_name) AS top FROM pk WHERE v2 < 25),
par AS (SELECT pkg_name AS n, max([CAST(v1 AS BIGINT), v2, v3]) AS t FROM pk WHERE v2 >= 25 GROUP BY pkg_name)
SELECT pkg_name, metaobjid, top AND (t IS NULL OR [CAST(v1 AS BIGINT), v2, v3] >= t) AS is_latest FROM own LEFT JOIN par ON n = pkg_name""")
def pkg_latest_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = packages(spark, sf_dir)
    return pkg.is_latest_everywhere([index.where("p_size < 25"), index.where("p_size >= 25")])


@query(f"WITH {_PKGS} SELECT pkg_name, metaobjid, CAST(row_number() OVER (PARTITION BY pkg_name ORDER BY v2 DESC, metaobjid) AS INTEGER) AS place FROM pk")
def pkg_versions_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pkg.by_update_time(packages(spark, sf_dir).withColumn("update_time", F.col("p_size"))).select("pkg_name", "metaobjid", "place")


@query(f"""WITH {_PKGS} SELECT p_partkey, version, v1 > 30 OR v1 = 30 AND v2 >= 7 AS at_least, v1 = 12 AND v2 = 9 AS tilde, v1 = 25 AND v2 >= 3 AS caret, CASE WHEN v1 <> 20 THEN sign(v1 - 20) WHEN v2 <> 20 THEN sign(v2 - 20) ELSE sign(v3) END AS sign FROM pk""")
def pkg_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("version")
    meets = lambda r: versions.satisfies(v, F.lit(r))
    return packages(spark, sf_dir).select("p_partkey", "version", meets(">=30.7.0").alias("at_least"), meets("~12.9.0").alias("tilde"), meets("^25.3.0").alias("caret"),
                                          versions.compare(v, F.lit("20.20.0")).cast("int").alias("sign"))


@query("""WITH e AS (SELECT event_id, user_id, event_type FROM events), n AS (SELECT event_id AS inode, 'Working' AS state, user_id % 3 AS holder FROM e)
SELECT inode, CASE WHEN inode % 2 = 0 AND holder = 1 THEN 'Cooling' ELSE state END AS state, holder, inode % 2 = 0 AND holder = 1 AS updated FROM n""")
def node_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("event_id").alias("inode"), F.lit("Working").alias("state"), (F.col("user_id") % 3).alias("holder"))
    changes = nodes.where("inode % 2 = 0").select("inode", F.lit("Working").alias("old_state"), F.lit(1).cast("long").alias("old_holder"), F.lit("Cooling").alias("new_state"), F.lit(1).cast("long").alias("new_holder"))
    return overlay.compare_and_set(nodes, changes, "inode", ["state", "holder"]).select("inode", "state", "holder", "updated")
