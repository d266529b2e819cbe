"""Name an intermediate value inside one expression, so that it is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep(value: Column) -> Column:
    """A generator that emits the value and drops the row where it is NULL.

    A filter on a computed column is pushed below the projection and computes it a second time; this does not.
    """
    return F.explode(F.filter(F.array(value), lambda v: v.isNotNull()))
