"""Evaluate an expensive expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Expressions inside conditional branches are not shared by the code
    generator; a one-element array keeps the value for all of them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
