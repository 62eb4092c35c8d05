"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A filter on a derived column is pushed below the projection that derives
    it, and every mention of its inputs is then spelled out again. A lambda
    variable is evaluated once wherever the expression ends up.
    """
    return F.transform(F.array(value), lambda bound: body(bound)).getItem(0)


def computed_once(df: DataFrame, *columns: Column, keep: list | None = None, apart: bool = False) -> DataFrame:
    """``df`` (or its ``keep`` columns) with ``columns`` added behind a generator.

    Filters on the added columns stay above the generator, so an expensive
    column that is both filtered on and used is still worked out only once. They are worked
    out in a projection below it: Spark compiles that, but walks through what stands in
    a generator (or in the argument of a lambda function) expression by expression for every row.

    ``apart`` is for long lists of conditions: compiled with their whole stage they would be
    one method, larger than the JVM takes. A projection with a lambda function in it is
    compiled by itself, in many small methods; so an idle one is put beside them.
    """
    kept = df.columns if keep is None else keep
    made, idle = "_made", "_idle"
    extra = [F.transform(F.array(F.col(df.columns[0]).isNull()), lambda x: x).alias(idle)] if apart else []
    done = df.select(*kept, F.struct(*columns, *extra).alias(made)).select(*kept, F.inline_outer(F.array(made)))
    return done.drop(idle) if apart else done
