"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pin derived columns to one evaluation per row.

    A later filter on a derived column is pushed below the projection by substituting its whole expression, which
    repeats long chains (a projected covariance, a lens model) many times over. Passing the columns through a one-element
    ``inline`` keeps filters on them above it; it stays inside generated code and moves no data.
    """
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*cols)))).select(*df.columns)
