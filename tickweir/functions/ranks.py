"""Exact ranks and quantiles over whole tables, without bringing all rows to one partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_rank(df: DataFrame, value: str, ties: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Adds the row's place, from 0, by value, then ties; nulls first.

    Rows are parted at approximate quantiles, ranked within their part, and moved up by the sizes of the parts before.
    How good the quantiles are only affects how even the parts are."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    known = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    part = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(known, lambda e: e < F.col(value))))
    df = df.withColumn("_part", part)
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a part
    own = F.row_number().over(W.partitionBy("_part").orderBy(F.col(value).asc_nulls_first(), *ties))
    return df.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own - 1).drop("_part", "_before")


def quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation; empty without known values."""
    df = df.select(value).filter(F.col(value).isNotNull())
    n = df.count()
    if not n:
        return []
    at = [p * (n - 1) for p in probs]
    need = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    got = dict(with_rank(df, value).filter(F.col("rank").isin(need)).select("rank", value).collect())
    return [got[math.floor(a)] + (got[math.ceil(a)] - got[math.floor(a)]) * (a - math.floor(a)) for a in at]


def bin_of(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at or below x."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) if edges else F.lit(0)
