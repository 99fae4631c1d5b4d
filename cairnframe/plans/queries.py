"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, ids, paths, versions
from ..operators import chunks, cow, ledger, lifecycle, locators, objects, overlay, placement, traversal
from ..operators import packages as pkg
from .tables import deltas, file_paths, files, mutations, packages, table

SIZE = 4096
QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL fragments: bytes as hex, the length prefix, and the chunks of the documents.
def _varint(n: str) -> str:
    return f"(SELECT string_agg(lower(lpad(to_hex((({n} >> (7 * i)) & 127) | CASE WHEN ({n} >> (7 * (i + 1))) > 0 THEN 128 ELSE 0 END), 2, '0')), '' ORDER BY i) FROM range(0, 9) t(i) WHERE i = 0 OR ({n} >> (7 * i)) > 0)"


DOCS = "d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)"
CHUNKS = f"""{DOCS}, c0 AS (SELECT doc_id, h, n, unnest(range(0, greatest(CAST(ceil(n / {SIZE}.0) AS BIGINT), 1))) AS idx FROM d),
c1 AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, idx * {SIZE} AS start, substr(h, CAST(2 * idx * {SIZE} + 1 AS BIGINT), {2 * SIZE}) AS p FROM c0),
c2 AS (SELECT doc_id, idx, start, CAST(length(p) // 2 AS BIGINT) AS chunk_size, sha256(unhex(p)) AS sha FROM c1),
c AS (SELECT doc_id, idx, start, chunk_size, 'mix256:' || {_varint("chunk_size")} || sha AS chunk_id FROM c2)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_ids(files(spark, sf_dir), "doc_id", size=SIZE)


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_size, count(*) AS copies, CAST((count(*) - 1) * chunk_size AS BIGINT) AS bytes_saved FROM c GROUP BY chunk_id, chunk_size")
def doc_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(_chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT doc_id, idx, chunk_id, chunk_size, CAST(coalesce(sum(chunk_size) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def doc_chunk_list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.offsets(_chunks(spark, sf_dir).drop("start"), "doc_id").select("doc_id", "idx", "chunk_id", "chunk_size", "start")


LISTS = f"""{CHUNKS}, ls AS (SELECT doc_id, count(*) AS n_chunks, CAST(sum(chunk_size) AS BIGINT) AS total_size,
'[' || string_agg('"' || chunk_id || '"', ',' ORDER BY idx) || ']' AS j FROM c GROUP BY doc_id)"""


@query(f"WITH {LISTS} SELECT doc_id, n_chunks, total_size, 'clist:' || {_varint('total_size')} || sha256(j) AS list_id FROM ls")
def doc_chunk_list_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_lists(_chunks(spark, sf_dir), "doc_id").select("doc_id", "n_chunks", "total_size", "list_id")


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, n, unnest([0, n // 2, n - 1, n]) AS position FROM d WHERE n > 0),
u AS (SELECT DISTINCT doc_id, n, position FROM r)
SELECT u.doc_id, position, CASE WHEN position >= n THEN CAST(ceil(n / {SIZE}.0) AS INTEGER) ELSE CAST(position // {SIZE} AS INTEGER) END AS idx,
CAST(CASE WHEN position >= n THEN 0 ELSE position % {SIZE} END AS BIGINT) AS chunk_offset FROM u""")
def doc_range_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("content").cast("bigint")
    asked = files(spark, sf_dir).where(n > 0).select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.floor(n / 2), n - 1, n)).alias("position")).distinct()
    return chunks.locate(asked, _chunks(spark, sf_dir).drop("start"), "doc_id", bucket=SIZE)


@query(f"WITH {DOCS} SELECT doc_id, n // 3 AS start, CAST(100 AS BIGINT) AS length, sha256(unhex(substr(h, 2 * (n // 3) + 1, 200))) AS piece_sha FROM d")
def doc_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    asked = rows.select("doc_id", F.floor(F.length("content") / 3).cast("bigint").alias("start"), F.lit(100).cast("bigint").alias("length"))
    return chunks.read_ranges(rows, asked, "doc_id").select("doc_id", "start", "length", F.sha2("piece", 256).alias("piece_sha"))


QUICK = f"""{DOCS}, q AS (SELECT doc_id, n, 'qcid:' || {_varint('n')} || sha256(unhex(substr(h, 1, 8192) || substr(h, 2 * (n // 2) + 1, 8192))) AS quick_id,
'qcid:' || {_varint('n')} || sha256(unhex(substr(h, 1, 8192) || substr(h, 2 * (n // 2) + 1, 8192) || substr(h, 2 * (n - 4096) + 1, 8192))) AS quick3,
sha256(unhex(h)) AS full_sha FROM d WHERE n >= 12288)"""


@query(f"WITH {QUICK} SELECT doc_id, quick_id FROM q")
def doc_quick_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", hashing.quick_id(F.col("content")).alias("quick_id")).where("quick_id IS NOT NULL")


@query(f"WITH {QUICK} SELECT doc_id, quick3 AS quick_id FROM q")
def doc_quick_id3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", hashing.quick_id3(F.col("content")).alias("quick_id")).where("quick_id IS NOT NULL")


@query(f"WITH {QUICK} SELECT quick_id, count(*) AS files, count(DISTINCT full_sha) AS contents FROM q GROUP BY quick_id")
def doc_quick_vs_full_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(hashing.quick_id(F.col("content")).alias("quick_id"), F.sha2("content", 256).alias("full_sha")).where("quick_id IS NOT NULL")
    return rows.groupBy("quick_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("full_sha").alias("contents"))


@query()
def doc_sha512_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no SHA-512; tests hold it against hashlib."""
    return files(spark, sf_dir).select("doc_id", hashing.chunk_id(F.col("content"), "sha512").alias("chunk_id"))


FILES = """f AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, 'sha256:' || sha256(coalesce(text, '')) AS content FROM documents),
fo AS (SELECT *, '{' || CASE WHEN content <> '' THEN '"content":"' || content || '",' ELSE '' END || '"create_time":0,"last_update_time":0,"name":"' || doc_id || '"' || CASE WHEN size <> 0 THEN ',"size":' || size ELSE '' END || '}' AS j FROM f)"""


def _file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = file_paths(spark, sf_dir).join(files(spark, sf_dir), "doc_id")
    text = objects.file_object(F.col("doc_id").cast("string"), F.col("size"), hashing.chunk_id(F.col("content")), F.lit(0))
    return rows.select("doc_id", "path", "size", text.alias("obj_json")).withColumn("obj_id", objects.object_id(ids.FILE, F.col("obj_json")))


@query(f"WITH {FILES} SELECT doc_id, 'cyfile:' || sha256(j) AS obj_id FROM fo")
def doc_file_object_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_objects(spark, sf_dir).select("doc_id", "obj_id")


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END) AS claimed FROM documents WHERE doc_id % 10 = 0")
def doc_verify_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim is verified; those of every tenth document are wrong by design."""
    rows = files(spark, sf_dir)
    wrong = F.when(F.col("doc_id") % 10 == 0, F.lit("x")).otherwise(F.lit("")).cast("binary")
    claims = rows.withColumn("claimed", hashing.chunk_id(F.concat("content", wrong)))
    return chunks.verify(claims, claimed="claimed").where(~F.col("ok")).select("doc_id", "claimed")


ROLL = f"""{FILES}, pr AS (SELECT size, string_split(path, '/')[2:4] AS s FROM f),
lv AS (SELECT size, unnest(range(0, 3)) AS l, s FROM pr),
ro AS (SELECT CASE WHEN l = 0 THEN '/' ELSE '/' || array_to_string(s[1:l], '/') END AS path, CAST(sum(CASE WHEN l = 2 THEN 1 ELSE 0 END) AS BIGINT) AS file_count,
CAST(sum(CASE WHEN l = 2 THEN size ELSE 0 END) AS BIGINT) AS file_size, CAST(sum(size) AS BIGINT) AS total_size FROM lv GROUP BY ALL)"""


@query(f"WITH {ROLL} SELECT path, file_count, file_size FROM ro WHERE file_count > 0")
def dir_rollup_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.rollup(file_paths(spark, sf_dir)).where("file_count > 0").select("path", "file_count", "file_size")


@query(f"WITH {ROLL} SELECT path, file_count, file_size, total_size FROM ro")
def dir_rollup_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.rollup(file_paths(spark, sf_dir))


def _dir_sql(level: str, name: str, kids: str, group: str) -> str:
    return f"""{level} AS (SELECT r.path, r.total_size, {name} AS nm, 'cydir:' || sha256('{{"body":{{' || k.b || '}},"create_time":0,"file_count":' || file_count || ',"file_size":' || file_size || ',"last_update_time":0'
|| CASE WHEN {name} <> '' THEN ',"name":"' || {name} || '"' ELSE '' END || ',"total_size":' || total_size || '}}') AS obj_id
FROM ro r JOIN (SELECT {group} AS path, string_agg('"' || nm || '":"' || obj_id || '"', ',' ORDER BY nm) AS b FROM {kids} GROUP BY 1) k ON k.path = r.path)"""


@query(f"""WITH {ROLL}, l3 AS (SELECT path, CAST(doc_id AS VARCHAR) AS nm, 'cyfile:' || sha256(j) AS obj_id FROM fo),
{_dir_sql('l2', "string_split(r.path, '/')[3]", 'l3', "regexp_replace(path, '/[^/]*$', '')")},
{_dir_sql('l1', "string_split(r.path, '/')[2]", 'l2', "regexp_replace(path, '/[^/]*$', '')")},
{_dir_sql('l0', "''", 'l1', "'/'")}
SELECT path, obj_id, total_size FROM l2 UNION ALL SELECT path, obj_id, total_size FROM l1 UNION ALL SELECT path, obj_id, total_size FROM l0""")
def dir_merkle_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.directory_ids(_file_objects(spark, sf_dir).select("path", "size", "obj_id"))


OVER = """b AS (SELECT source AS parent, CAST(doc_id AS VARCHAR) AS name, 'sha256:' || sha256(coalesce(text, '')) AS target FROM documents),
u AS (SELECT d.source AS parent, CAST(l.doc_id AS VARCHAR) AS name, CASE WHEN l.toxic = 1 THEN 'tombstone' ELSE 'object' END AS kind, CASE WHEN l.toxic = 0 THEN 'up' || l.doc_id END AS target FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
m AS (SELECT coalesce(b.parent, u.parent) AS parent, coalesce(b.name, u.name) AS name, CASE WHEN u.kind IS NOT NULL THEN u.target ELSE b.target END AS target, CASE WHEN u.kind IS NOT NULL THEN 'upper' ELSE 'base' END AS origin
FROM b FULL JOIN u ON b.parent = u.parent AND b.name = u.name WHERE u.kind IS DISTINCT FROM 'tombstone')"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.col("source").alias("parent"), F.col("doc_id").cast("string").alias("name"), hashing.chunk_id(F.coalesce("text", F.lit("")).cast("binary")).alias("target"))
    upper = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("parent"), F.col("doc_id").cast("string").alias("name"),
        F.when(F.col("toxic") == 1, overlay.TOMBSTONE).otherwise("object").alias("kind"), F.when(F.col("toxic") == 0, F.concat(F.lit("up"), F.col("doc_id").cast("string"))).alias("target"),
    )
    return overlay.merge(base, upper)


@query(f"WITH {OVER} SELECT parent, name, target, origin FROM m")
def overlay_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"WITH {OVER} SELECT parent, name, (row_number() OVER (PARTITION BY parent ORDER BY name) - 1) // 10 AS page FROM m")
def overlay_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.pages(_merged(spark, sf_dir), 10).select("parent", "name", "page")


TREE = """SELECT '/' || r_name || '/' || n_name || '/' || c_custkey AS path, 'object' AS status, 'cust' || c_custkey AS node, CAST(NULL AS VARCHAR) AS rest
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_custkey || '/inner/x', 'object', 'cust' || c_custkey, '/inner/x'
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 1
UNION ALL SELECT '/all/' || n_name || '/none', 'missing', NULL, NULL FROM nation UNION ALL SELECT '/all/' || n_name, 'dir', '/' || r_name || '/' || n_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query(TREE)
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under /region/nation, with a link /all/nation to each nation; one link may be followed."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    region, nation = F.concat(F.lit("/"), "r_name"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")
    key = F.col("c_custkey").cast("string")
    entry = lambda df, parent, name, kind, node, target: df.select(parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), node.alias("node"), target.alias("target"))
    entries = entry(table(spark, sf_dir, "region"), F.lit("/"), F.col("r_name"), "dir", region, none)
    entries = entries.unionByName(entry(spark.range(1), F.lit("/"), F.lit("all"), "dir", F.lit("/all"), none))
    entries = entries.unionByName(entry(n, region, F.col("n_name"), "dir", nation, none))
    entries = entries.unionByName(entry(n, F.lit("/all"), F.col("n_name"), "link", none, F.concat(F.lit("../"), "r_name", F.lit("/"), "n_name")))
    entries = entries.unionByName(entry(c, nation, key, "object", F.concat(F.lit("cust"), key), none))
    asked = c.select(F.concat(nation, F.lit("/"), key, F.when(F.col("c_custkey") % 2 == 1, "/inner/x").otherwise("")).alias("path"))
    asked = asked.unionByName(n.select(F.explode(F.array(F.concat(F.lit("/all/"), "n_name", F.lit("/none")), F.concat(F.lit("/all/"), "n_name"))).alias("path")))
    return traversal.resolve(asked, entries, links=1)


@query("SELECT n_name, '/a/' || n_name AS up, '/' || n_name AS top, '/x/' || n_name AS absolute FROM nation")
def symlink_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda parent, target: paths.normalize_symlink(F.lit(parent), target)
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_name", at("/a/b", F.concat(F.lit(".././"), n)).alias("up"), at("/a", F.concat(F.lit("../../.."), F.lit("/"), n)).alias("top"), at("/a", F.concat(F.lit("/x/y/../"), n, F.lit("/."))).alias("absolute"),
    )


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) AS path, 'sha256:' || sha256(coalesce(html, '')) AS id FROM pages)
SELECT page_id, id AS obj_id, CASE WHEN path IN ('', '/') THEN NULL ELSE regexp_replace(path, '/+$', '') END AS inner_path, 'path:0' AS locator FROM p""")
def url_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address with its content's id put before the path, and taken apart again."""
    p = table(spark, sf_dir, "pages")
    host, path = F.regexp_extract("url", "^([a-z]+://[^/]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1)
    made = p.select("page_id", ids.from_url(F.concat(host, F.lit("/"), hashing.chunk_id(F.coalesce("html", F.lit("")).cast("binary")), path, F.lit("?v=1"))).alias("u"))
    return made.select("page_id", "u.obj_id", "u.inner_path", "u.locator")


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, idx, '{{"range":{{"end":' || (start + chunk_size) || ',"start":' || start || '}},"relation":"part_of","source":"' || chunk_id || '","target":"doc:' || doc_id || '"}}' AS j FROM c)
SELECT doc_id, idx, 'cyrel:' || sha256(j) AS obj_id FROM r""")
def relation_part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    text = objects.relation(F.col("chunk_id"), F.lit("part_of"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("start"), F.col("start") + F.col("chunk_size"))
    return c.select("doc_id", "idx", objects.object_id(ids.RELATION, text).alias("obj_id"))


PKG = """p AS (SELECT lower(p_type) AS pkg_name, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS ma, CAST(p_size AS BIGINT) AS mi, p_partkey % 7 AS pa,
regexp_extract(p_brand, '([0-9]+)', 1) || '.' || p_size || '.' || (p_partkey % 7) AS version, 'meta' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS metaobjid,
CASE p_partkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'beta' END AS tag, p_partkey, p_size FROM part),
v AS (SELECT *, ma * 72057594037927936 + mi * 1099511627776 + pa * 16777216 AS version_int FROM p)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).withColumn("version_int", versions.pack(F.col("version")))


@query(f"WITH {PKG} SELECT metaobjid, version, CAST(version_int AS BIGINT) AS version_int FROM v")
def pkg_version_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("metaobjid", "version", "version_int")


@query(f"WITH {PKG} SELECT pkg_name, version, metaobjid FROM v QUALIFY row_number() OVER (PARTITION BY pkg_name ORDER BY version_int DESC, metaobjid DESC) = 1")
def pkg_latest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pkg.latest(_index(spark, sf_dir)).select("pkg_name", "version", "metaobjid")


@query(f"WITH {PKG} SELECT pkg_name, version, metaobjid FROM v WHERE tag = 'stable' AND version_int > 10 * 72057594037927936 AND version_int <= 20 * 72057594037927936 + 5 * 1099511627776")
def pkg_range_tag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pkg.matching(_index(spark, sf_dir), ">10.0.0, <=20.5.0", "stable").select("pkg_name", "version", "metaobjid")


@query(f"WITH {PKG}, w AS (SELECT DISTINCT pkg_name, version FROM v WHERE p_size % 2 = 0) SELECT v.pkg_name, v.version, v.metaobjid, p_name AS name FROM w JOIN v ON w.pkg_name = v.pkg_name AND w.version = v.version JOIN part ON part.p_partkey = v.p_partkey")
def pkg_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    metas = index.select("metaobjid", "p_partkey").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey").select("metaobjid", "name")
    return pkg.exact(index.select("pkg_name", "version", "metaobjid"), metas, index.where("p_size % 2 = 0").select("pkg_name", "version").distinct()).select("pkg_name", "version", "metaobjid", "name")


@query(f"WITH {PKG} SELECT metaobjid, row_number() OVER (PARTITION BY pkg_name ORDER BY version_int DESC, metaobjid DESC) = 1 AS is_latest FROM v")
def pkg_is_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pkg.is_latest(_index(spark, sf_dir)).select("metaobjid", "is_latest")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1),
r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src)
SELECT start, node, CAST(depth AS INTEGER) AS depth, false AS cycle FROM r""")
def pkg_dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part depends on the part of half its key."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    edges = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return pkg.closure(edges, p.select(F.col("p_partkey").alias("node")))


@query("WITH n AS (SELECT p_partkey, 'sha256:' || sha256(p_type || ':' || (p_partkey // 2)) AS chunk_id FROM part) SELECT p_partkey, chunk_id FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM n WHERE p_partkey % 3 = 0)")
def pkg_missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that no part with a key divisible by three holds."""
    need = table(spark, sf_dir, "part").select("p_partkey", hashing.chunk_id(F.concat("p_type", F.lit(":"), F.expr("p_partkey div 2").cast("string")).cast("binary")).alias("chunk_id"))
    return chunks.missing(need, need.where("p_partkey % 3 = 0"))


@query(f"WITH {PKG} SELECT metaobjid, CASE WHEN p_size % 2 = 0 THEN 'incoming' ELSE 'base' END AS origin FROM v")
def pkg_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return pkg.merge_index(index.select("metaobjid", F.lit("base").alias("origin")), index.where("p_size % 2 = 0").select("metaobjid", F.lit("incoming").alias("origin")), ["metaobjid"])


@query("SELECT l_partkey AS obj_id, count(*) AS ref_count FROM lineitem GROUP BY l_partkey")
def obj_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ref_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obj_id"), F.lit(1).cast("bigint").alias("delta")))


STAT = """e AS (SELECT user_id AS obj_id, event_id AS seq, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('error', 'view') THEN -1 ELSE 0 END AS delta FROM events),
r AS (SELECT *, sum(delta) OVER (PARTITION BY obj_id ORDER BY ts, seq) AS run FROM e),
n AS (SELECT *, run - least(min(run) OVER (PARTITION BY obj_id ORDER BY ts, seq), 0) AS n FROM r),
g AS (SELECT *, max(CASE WHEN n > 0 OR delta > 0 THEN row_no END) OVER (PARTITION BY obj_id) AS alive FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY ts, seq) AS row_no FROM n)),
s AS (SELECT obj_id, CAST(arg_max(n, row_no) AS BIGINT) AS ref_count, min(ts) FILTER (n = 0 AND delta <= 0 AND row_no > coalesce(alive, 0)) AS z, max(ts) AS updated_at FROM g GROUP BY obj_id),
st AS (SELECT obj_id, ref_count, CASE WHEN ref_count = 0 THEN z END AS zero_since, updated_at FROM s)"""


@query(f"WITH {STAT} SELECT obj_id, ref_count, zero_since, updated_at FROM st")
def obj_zero_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ref_ledger(deltas(spark, sf_dir))


@query(f"WITH {STAT} SELECT obj_id, zero_since FROM st WHERE ref_count = 0 AND zero_since <= TIMESTAMP '2024-02-01' ORDER BY zero_since, obj_id LIMIT 20")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the operator's own."""
    return ledger.gc_candidates(ledger.ref_ledger(deltas(spark, sf_dir)), F.lit("2024-02-01").cast("timestamp"), 20).select("obj_id", "zero_since")


@query("SELECT user_id AS chunk_id, arg_max(value, (ts, event_id)) AS progress FROM events GROUP BY user_id")
def progress_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("value").alias("progress"), "ts", F.col("event_id").alias("seq")))


@query("""WITH n AS (SELECT event_id AS inode, CASE WHEN event_type IN ('click', 'purchase') THEN 'Working' ELSE 'Cooling' END AS state, CASE WHEN event_type <> 'signup' THEN 'u' || user_id END AS s, epoch(date_trunc('second', ts))::BIGINT + 300 AS x FROM events)
SELECT inode, CASE WHEN s IS NOT NULL AND x <= 1705276800 THEN 'Cooling' ELSE state END AS state, CASE WHEN s IS NOT NULL AND x <= 1705276800 THEN NULL ELSE s END AS lease_session,
coalesce(s IS NOT NULL AND x <= 1705276800, false) AS reclaimed FROM n""")
def lease_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    nodes = e.select(
        F.col("event_id").alias("inode"), F.when(F.col("event_type").isin("click", "purchase"), "Working").otherwise("Cooling").alias("state"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("lease_session"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + ledger.LEASE_SECONDS).alias("lease_expire_at"), F.lit(None).cast("bigint").alias("closed_at"),
    )
    return ledger.reclaim_leases(nodes, 1705276800).select("inode", "state", "lease_session", "reclaimed")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'Cooling' ELSE event_type END AS state, CASE WHEN event_type = 'click' THEN 'fb' END AS fb, event_type = 'click' AS updated FROM events")
def inode_state_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node gets a change; those whose old state was not as expected keep theirs."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("state"), F.lit(None).cast("string").alias("fb"))
    none = F.lit(None).cast("string")
    changes = e.select("event_id", F.lit("click").alias("old_state"), F.lit("Cooling").alias("new_state"), none.alias("old_fb"), F.lit("fb").alias("new_fb"))
    return overlay.compare_and_set(e, changes, "event_id", ["state", "fb"])


@query("""WITH g AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'view' THEN 'tombstone' ELSE 'object' END AS kind, CAST(user_id AS VARCHAR) AS parent, 'n' || (event_id % 50) AS name, 'obj' || event_id AS target FROM events),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY parent, name ORDER BY seq DESC) = 1)
SELECT l.parent, name, kind, CASE WHEN kind = 'object' THEN target END AS target, rev FROM l JOIN (SELECT parent, count(*) AS rev FROM g GROUP BY parent) r ON r.parent = l.parent""")
def namespace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.fold(mutations(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS obj_id, 's' || (o_orderkey % 4) AS held FROM orders),
l AS (SELECT obj_id, 2 AS epoch, 's' || ((obj_id % 97) % 3) AS store_id, held FROM o UNION ALL SELECT obj_id, 1, 's' || ((obj_id % 89) % 4), held FROM o)
SELECT obj_id, max(epoch) AS epoch, arg_max(store_id, epoch) AS store_id FROM l WHERE store_id = held GROUP BY obj_id""")
def layout_epoch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obj_id"))
    present = o.withColumn("store_id", F.concat(F.lit("s"), (F.col("obj_id") % 4).cast("string")))
    layout = lambda epoch, size, n: spark.range(size).select(F.lit(epoch).alias("epoch"), F.lit(size).alias("size"), F.col("id").cast("int").alias("slot"), F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("store_id"))
    return placement.locate(o.withColumn("hash", F.col("obj_id")), layout(2, 97, 3).unionByName(layout(1, 89, 4)), present)


TARGETS = [placement.Target(f"store{i}", 1 + i % 3) for i in range(8)]


@query()
def placement_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by store; the table is a property-tested hash layout, so SQL has no value for it."""
    o = files(spark, sf_dir).select(hashing.chunk_id(F.col("content")).alias("obj_id")).distinct()
    return placement.primary(o, placement.slots(spark, TARGETS), placement.table_size(sum(t.weight for t in TARGETS))).groupBy("store_id").agg(F.count(F.lit(1)).alias("objects"))


@query()
def placement_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects move when a store is added."""
    o = files(spark, sf_dir).select(hashing.chunk_id(F.col("content")).alias("obj_id")).distinct()
    more = [*TARGETS, placement.Target("store8", 2)]
    size = placement.table_size(sum(t.weight for t in more))
    return placement.movement(o, placement.slots(spark, TARGETS), placement.slots(spark, more), size, size)


@query("SELECT conv_id || ':' || turn AS msg_id, conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) AS root, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations")
def msg_thread_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    return traversal.thread_depth(c.select(name(F.col("turn")).alias("msg_id"), name(F.col("turn") - 1).alias("reply_to")))


@query(f"""WITH {CHUNKS}, m AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 1 THEN 'mix256:new' || idx ELSE chunk_id END AS chunk_id, CASE WHEN idx % 3 = 1 THEN 10 ELSE chunk_size END AS chunk_size, CASE WHEN idx % 3 = 1 THEN 'diff' ELSE 'base' END AS origin FROM c
UNION ALL SELECT doc_id, CAST(max(idx) + 1 AS INTEGER), 'mix256:end', 7, 'diff' FROM c GROUP BY doc_id)
SELECT doc_id, idx, chunk_id, CAST(chunk_size AS BIGINT) AS chunk_size, origin, CAST(coalesce(sum(chunk_size) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM m""")
def cow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _chunks(spark, sf_dir).drop("start")
    over = base.where("idx % 3 = 1").select("doc_id", "idx", F.concat(F.lit("mix256:new"), F.col("idx").cast("string")).alias("chunk_id"), F.lit(10).cast("bigint").alias("chunk_size"))
    end = base.groupBy("doc_id").agg((F.max("idx") + 1).alias("idx")).select("doc_id", "idx", F.lit("mix256:end").alias("chunk_id"), F.lit(7).cast("bigint").alias("chunk_size"))
    return cow.merge(base, over.unionByName(end), "doc_id").select("doc_id", "idx", "chunk_id", "chunk_size", "origin", "start")


@query("""WITH r AS (SELECT event_id, ['Append','ContinueWrite','CreateExclusive','CreateOrTruncate','CreateOrAppend'][event_id % 5 + 1] AS flag, ['absent','tombstone','object','directory','link','inode'][user_id % 6 + 1] AS entry,
CASE event_type WHEN 'click' THEN 'Working' WHEN 'view' THEN 'Cooling' ELSE 'Finalized' END AS state FROM events),
o AS (SELECT event_id, flag, entry, CASE WHEN entry = 'directory' THEN 'is_directory' WHEN entry = 'link' THEN 'is_link'
WHEN entry IN ('absent', 'tombstone') THEN CASE WHEN flag IN ('Append', 'ContinueWrite') THEN 'not_found' ELSE 'created' END
WHEN flag = 'CreateExclusive' THEN 'exists' WHEN flag = 'ContinueWrite' THEN CASE WHEN entry = 'inode' AND state <> 'Finalized' THEN 'resumed' ELSE 'conflict' END
WHEN entry = 'inode' AND state = 'Working' THEN 'conflict' ELSE 'opened' END AS outcome FROM r)
SELECT event_id, outcome, outcome IN ('created', 'opened', 'resumed') AND flag IN ('CreateExclusive', 'CreateOrTruncate') AS truncates,
outcome IN ('opened', 'resumed') AND flag NOT IN ('CreateExclusive', 'CreateOrTruncate') AS keeps_base FROM o""")
def file_open_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    asked = e.select(
        "event_id", pick(lifecycle.FLAGS, F.col("event_id") % 5).alias("flag"), pick(("absent", "tombstone", "object", "directory", "link", "inode"), F.col("user_id") % 6).alias("entry"),
        F.when(F.col("event_type") == "click", "Working").when(F.col("event_type") == "view", "Cooling").otherwise("Finalized").alias("state"),
    )
    return lifecycle.open_writer(asked).select("event_id", "outcome", "truncates", "keeps_base")


@query("""SELECT o_orderkey, 'bytes=' || o_orderkey || '-' || (o_orderkey + o_custkey) AS byte_range,
CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'incompleted' ELSE 'not_exist' END AS state,
CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE greatest(1000 - o_custkey, 0) END AS BIGINT) AS left_bytes FROM orders""")
def transfer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and what is left to send, with orders as uploads."""
    o = table(spark, sf_dir, "orders")
    state = locators.remote_state(F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 206).otherwise(404))
    return o.select(
        "o_orderkey", locators.byte_range(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") + 1).alias("byte_range"),
        state.alias("state"), locators.left_to_push(F.lit(1000), F.col("o_custkey"), state).alias("left_bytes"),
    )


@query("""WITH l AS (SELECT doc_id AS name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS content FROM documents WHERE doc_id % 4 <> 0),
r AS (SELECT doc_id AS name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, sha256(coalesce(text, '')) AS content FROM documents)
SELECT r.name, l.size IS NULL OR l.size <> r.size OR l.content <> r.content AS better FROM r LEFT JOIN l ON l.name = r.name""")
def remote_is_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as local and remote files: a quarter is absent here, a fifth differs in size."""
    f = files(spark, sf_dir).select(F.col("doc_id").alias("name"), F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("content"))
    remote = f.withColumn("size", F.col("size") + F.when(F.col("name") % 5 == 0, 1).otherwise(0))
    return pkg.remote_is_better(f.where("name % 4 <> 0"), remote).select("name", "better")


@query("""WITH c AS (SELECT doc_id, 'did:x' AS curator, 'sha256:' || sha256(coalesce(text, '')) AS id FROM documents),
p AS (SELECT l.doc_id, '{"content_id":"' || id || '","curator":"did:x","exp":' || (31104000 + l.doc_id) || ',"iat":' || l.doc_id || ',"rank":' || (quality * 100) || '}' AS j FROM labels l JOIN c ON c.doc_id = l.doc_id)
SELECT doc_id, 'cyinc:' || sha256(j) AS obj_id FROM p""")
def inclusion_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as inclusion proofs of documents, ranked by quality."""
    c = files(spark, sf_dir).select("doc_id", hashing.chunk_id(F.col("content")).alias("id"))
    text = objects.inclusion_proof(F.col("id"), F.lit("did:x"), F.col("quality") * 100, F.col("doc_id"))
    return table(spark, sf_dir, "labels").join(c, "doc_id").select("doc_id", objects.object_id(ids.PROOF, text).alias("obj_id"))


@query("""SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS chunk_size, 'completed' AS chunk_state FROM
(SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def chunk_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put as chunks: copies go in once; the path tells which row was kept."""
    from ..sources import store

    rows = files(spark, sf_dir).select(
        hashing.chunk_id(F.col("content")).alias("chunk_id"), F.length("content").cast("bigint").alias("chunk_size"), F.lit("new").alias("chunk_state"), F.lit(None).cast("string").alias("local_path"),
        F.lit(None).cast("string").alias("progress"), F.col("doc_id").alias("update_time"), F.col("content").alias("payload"),
    )
    return store.put_chunks(rows.where("false"), rows).select(F.col("update_time").alias("doc_id"), "chunk_size", "chunk_state")
