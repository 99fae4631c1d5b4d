"""Registered query over web pages: main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_text
from ._common import table


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
