"""Names of the registered training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_corpus as corpus
from . import queries_dedup as dedup
from . import queries_learned as learned
from . import queries_pages as pages
from . import queries_text as text
from . import queries_vectors as vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": dedup.op1_line_dedup,
    "op2_packing": corpus.op2_packing,
    "op3_toxicity": learned.op3_toxicity,
    "op4_html_text": pages.op4_html_text,
    "op5_quality_rules": text.op5_quality_rules,
    "op6_mixing": corpus.op6_mixing,
    "op7_pii": text.op7_pii,
    "op8_near_dedup": dedup.op8_near_dedup,
    "op9_secrets": text.op9_secrets,
    "op10_topk": vectors.op10_topk,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": dedup.OP1_SQL,
    "op5_quality_rules": text.OP5_SQL,
    "op6_mixing": corpus.OP6_SQL,
    "op10_topk": vectors.OP10_SQL,
}
