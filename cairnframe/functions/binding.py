"""Name a sub-expression, so that it is built and evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``; the body refers to a variable and not to copies of the expression."""
    return F.get(F.transform(F.array(value), body), 0)
