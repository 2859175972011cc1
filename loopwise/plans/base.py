"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise.sources import routes as R

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with SQL that goes
    on from the adapter's common tables (`, name as (...)` or `select`)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with recursive {R.SQL.strip()}\n{sql}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and ints widened, as both engines compare them."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else c for c, t in df.dtypes])
