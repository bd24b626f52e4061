"""Registry of named queries (Spark builder + DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (engines differ in the last bits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # two-stage rounding: snap float noise at 10 dp, then round to 6 dp,
            # so values sitting on a rounding midpoint round the same everywhere
            cols.append(F.round(F.round(F.col(f"`{f.name}`"), 10), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def snap_sql(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` as decimal rounding (10 dp, then 6 dp
    half away from zero) — the same rule Spark's ``round`` applies to doubles."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6:k]
        if inner.rstrip().endswith(", 6"):
            expr = snap_sql(inner.rstrip()[:-3])
            out.append(sql[i:j] + f"CAST(round(CAST({expr} AS DECIMAL(38, 10)), 6) AS DOUBLE)")
        else:
            out.append(sql[i:j] + "round(" + snap_sql(inner) + ")")
        i = k + 1


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return rounded(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = snap_sql(sql)
        return fn
    return deco
