"""Names for expressions, within a column and within a plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(function):
    """A Python function of columns that the optimizer may neither repeat nor move.

    An explosion of its result otherwise adds a filter with a second call of it, and pushes that below the
    shuffle that spreads a small scan.
    """
    return function.asNondeterministic()


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with JVM columns that are computed once, however often later steps use them.

    The optimizer folds chains of projections into one and with them repeats every expression at
    each use; a generator that yields exactly one row stops that, without a shuffle.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
