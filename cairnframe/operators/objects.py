"""Named objects: canonical JSON, ids, verification, typed builders, edges.

Typed builders assemble canonical text (sorted keys, defaults left out) from
columns, so ids of objects with a known shape need no Python. Arbitrary JSON
goes through ``canonical``, an Arrow-batched function, because only it keeps
the spelling of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import ids

#: Seconds that inclusion proofs, and path bindings, are valid.
PROOF_LIFE = 31_104_000
PATH_LIFE = 3 * 365 * 24 * 3600


@F.pandas_udf(StringType())
def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text with keys sorted at every level, without spaces; null for what is no JSON."""
    import json

    def one(text):
        try:
            value = json.loads(text, parse_float=_Number, parse_int=int)
        except (TypeError, ValueError):
            return None
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)

    class _Number(float):
        """A float that prints with a fraction, as it was read."""

        def __repr__(self):
            return float.__repr__(self)

    for values in batches:
        yield pd.Series([one(v) for v in values], dtype=object)


def json_string(value: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, the rest as it is."""
    plain = F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$")
    return F.regexp_extract(plain, r'^\{"v":([\s\S]*)\}$', 1)


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of named JSON texts; a null text leaves its field out. Names are sorted here."""
    parts = [F.when(fields[k].isNotNull(), F.concat(F.lit(f'"{k}":'), fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def text_field(value: Column) -> Column:
    """A string field that is left out when null or empty."""
    return F.when(value.isNotNull() & (value != ""), json_string(value))


def number_field(value: Column) -> Column:
    """A number field that is left out when null or zero."""
    return F.when(value.isNotNull() & (value != 0), value.cast("bigint").cast("string"))


def object_id(kind: str, text: Column) -> Column:
    """Id of canonical text."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(text, 256))


def file_object(name: Column, size: Column, content: Column, create_time: Column, update_time: Column | None = None, author: Column | None = None) -> Column:
    """Canonical text of a file object."""
    return json_object({
        "name": text_field(name), "author": text_field(author) if author is not None else F.lit(None).cast("string"),
        "create_time": create_time.cast("bigint").cast("string"), "last_update_time": (update_time if update_time is not None else create_time).cast("bigint").cast("string"),
        "size": number_field(size), "content": text_field(content),
    })


def verify(objects: DataFrame, obj_id: str = "obj_id", text: str = "obj_json") -> DataFrame:
    """Add ``ok``: whether the id is that of the (canonical) text; a chunk list's id also carries its length."""
    kind, total = ids.id_type(F.col(obj_id)), F.aggregate(F.from_json(text, "array<string>"), F.lit(0).cast("bigint"), lambda a, x: a + ids.content_length(x))
    as_list = ids.make_id(ids.CHUNK_LIST, ids.mix_hash(total, F.unhex(F.sha2(text, 256))))
    return objects.withColumn("ok", F.when(kind == ids.CHUNK_LIST, as_list == F.col(obj_id)).otherwise(F.concat(kind, F.lit(":"), F.sha2(text, 256)) == F.col(obj_id)))


def jwt_claims(token: Column) -> Column:
    """The claims of a token, without a check of its signature."""
    body = F.translate(F.get(F.split(token, r"\."), 1), "-_", "+/")
    return F.decode(F.unbase64(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")


def load_text(text: Column) -> Column:
    """Object text as JSON: what holds a brace is JSON, anything else a token."""
    return F.when(F.contains(text, F.lit("{")), text).otherwise(jwt_claims(text))


def id_at(text: Column, path: str) -> Column:
    """The id at a JSON path, null where there is none."""
    return ids.parse_id(F.get_json_object(text, path))


def children(objects: DataFrame) -> DataFrame:
    """Edge table (obj_id, child_id, name) of directories, files and chunk lists."""
    kind = ids.id_type(F.col("obj_id"))
    body = F.from_json(F.get_json_object("obj_json", "$.body"), "map<string,string>")
    in_dir = objects.where(kind == ids.DIRECTORY).select("obj_id", F.explode(body).alias("name", "child_id"))
    in_file = objects.where(kind == ids.FILE).select("obj_id", F.lit(None).cast("string").alias("name"), F.get_json_object("obj_json", "$.content").alias("child_id"))
    in_list = objects.where(kind == ids.CHUNK_LIST).select("obj_id", F.posexplode(F.from_json("obj_json", "array<string>")).alias("name", "child_id")).withColumn("name", F.col("name").cast("string"))
    return in_dir.unionByName(in_file).unionByName(in_list).where(F.col("child_id").isNotNull() & (F.col("child_id") != "")).select("obj_id", "child_id", "name")


def relation(source: Column, kind: Column, target: Column, start: Column | None = None, end: Column | None = None, iat: Column | None = None) -> Column:
    """Canonical text of a relation; ``part_of`` carries a byte range."""
    span = json_object({"start": start.cast("string"), "end": end.cast("string")}) if start is not None else F.lit(None).cast("string")
    return json_object({
        "source": json_string(source), "relation": json_string(kind), "target": json_string(target), "range": span,
        "iat": number_field(iat) if iat is not None else F.lit(None).cast("string"),
    })


def link_of(text: Column) -> Column:
    """Struct (source, relation, target, start, end) of a relation's text."""
    at = lambda p: F.get_json_object(text, p)
    return F.struct(at("$.source").alias("source"), at("$.relation").alias("relation"), at("$.target").alias("target"),
                    at("$.range.start").cast("bigint").alias("start"), at("$.range.end").cast("bigint").alias("end"))


def inclusion_proof(content_id: Column, curator: Column, rank: Column, iat: Column) -> Column:
    """Canonical text of an inclusion proof; it expires ``PROOF_LIFE`` seconds later."""
    return json_object({
        "content_id": json_string(content_id), "curator": json_string(curator), "rank": rank.cast("bigint").cast("string"),
        "iat": iat.cast("bigint").cast("string"), "exp": (iat + PROOF_LIFE).cast("bigint").cast("string"),
    })


def message(sender: Column, to: Column, content: Column, created_ms: Column, reply_to: Column, topic: Column) -> Column:
    """Canonical text of a chat message; an empty thread is left out. Times are milliseconds."""
    thread = json_object({"reply_to": text_field(reply_to), "topic": text_field(topic)})
    return json_object({
        "from": json_string(sender), "to": F.concat(F.lit("["), json_string(to), F.lit("]")), "kind": F.lit('"chat"'),
        "created_at_ms": created_ms.cast("bigint").cast("string"), "content": json_object({"content": json_string(content)}),
        "thread": F.when(F.coalesce(reply_to, topic).isNotNull(), thread),
    })
