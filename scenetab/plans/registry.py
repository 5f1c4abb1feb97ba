"""Where queries register themselves, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetab.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the fixture views and the driver's tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``fn(t: Tables)``. ``needs`` lists the views the SQL text may use by name."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fixtures.with_views(needs, sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and freed of negative zero, so results can be compared by hash."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rnd(exprs: str, digits: int = 6) -> str:
    """SQL list ``a=expr; b`` -> ``round(expr, d) + 0.0 AS a, round(b, d) + 0.0 AS b``."""
    out = []
    for part in exprs.split(";"):
        name, _, e = part.strip().partition("=")
        out.append(f"round(CAST({e.strip() or name.strip()} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name.strip()}")
    return ", ".join(out)
