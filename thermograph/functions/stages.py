"""A stage: named SQL expressions added to a frame in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Append columns; later expressions may use earlier names of the stage.

    One call and one analysis per stage (lateral aliases), so wide models stay
    cheap to plan, and everything remains inside whole-stage codegen.
    """
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in exprs.items()])


def pin(df: DataFrame, **columns) -> DataFrame:
    """Append columns that are computed exactly once per row.

    A one-element generator keeps the optimizer from copying an expensive
    expression into every filter and projection above it.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(packed).alias("_pin")).select(*df.columns, *[F.col(f"_pin.{n}").alias(n) for n in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it.

    The column form of ``pin``: a name bound in an expression. Long tests over
    a nested regular expression stay as small as they are written.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
