"""Small constant relations, planned as LocalTableScan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def sql_literal(v) -> str:
    """A SQL literal that Spark and other ANSI engines read alike."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_clause(rows, columns, alias: str = "t") -> str:
    """``(VALUES ...) AS alias(columns)`` for use in any SQL engine."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(columns)})"


def constant_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows known at plan time; the optimizer sees their exact size."""
    struct = T.StructType.fromDDL(schema)
    # backslash is an escape character in Spark string literals
    body = ", ".join(
        "(" + ", ".join(
            f"CAST({sql_literal(v.replace(chr(92), chr(92) * 2) if isinstance(v, str) else v)} AS {f.dataType.simpleString()})"
            for v, f in zip(r, struct.fields)
        ) + ")"
        for r in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f.name for f in struct.fields)})")
