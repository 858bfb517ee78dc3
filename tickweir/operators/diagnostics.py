"""The aggregates behind diagnostic plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.functions.ranks import bin_of, quantiles, with_rank


def residual_histogram(df: DataFrame, y: str = "y_fwd", pred: str = "pred", bins: int = 120) -> DataFrame:
    """bin (from 1), n: residuals in equal bins from the least to the greatest, which belongs to the last bin."""
    r = df.select((F.col(y) - F.col(pred)).alias("r"))
    ends = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    return r.crossJoin(F.broadcast(ends)).groupBy((F.least(place, F.lit(bins - 1)) + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pred_vs_actual(df: DataFrame, y: str = "y_fwd", pred: str = "pred", grid: int = 60) -> DataFrame:
    """Counts on a grid over the square within the 99th percentile of absolute values: px, py (from 0), n."""
    got = quantiles(df.select(F.explode(F.array(F.abs(y), F.abs(pred))).alias("v")), "v", [0.99])
    lim = F.lit(got[0] if got else 0.0)
    cell = lambda c: F.floor(F.try_divide(F.col(c) + lim, 2 * lim) * grid).cast("int")
    return df.filter((F.abs(y) < lim) & (F.abs(pred) < lim)).groupBy(cell(pred).alias("px"), cell(y).alias("py")).agg(F.count("*").alias("n"))


def error_by_move(df: DataFrame, y: str = "y_fwd", pred: str = "pred", bins: int = 20, ties: tuple[str, ...] = ("market_id", "timestamp_ns")) -> DataFrame:
    """bin (from 0), move, error: mean absolute truth and mean absolute error in bins of equal count by absolute truth;
    bin i holds the places from floor(i n / bins) up to, not with, floor((i + 1) n / bins)."""
    t = df.select(*ties, F.abs(y).alias("mv"), F.abs(F.col(y) - F.col(pred)).alias("ae"))
    placed = with_rank(t, "mv", ties).crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))
    bin_ = F.expr(f"((rank + 1) * {bins} - 1) div n").cast("int")
    return placed.groupBy(bin_.alias("bin")).agg(F.avg("mv").alias("move"), F.avg("ae").alias("error"))


def calibration(df: DataFrame, y: str = "y_fwd", pred: str = "pred", bins: int = 10) -> DataFrame:
    """bin (from 0), mean_pred, mean_actual, n by quantile of the prediction; the greatest prediction belongs to the last
    bin, bins between equal edges stay empty."""
    edges = quantiles(df, pred, [i / bins for i in range(bins + 1)])
    place = F.least(F.greatest(bin_of(F.col(pred), edges) - 1, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(place.cast("int").alias("bin")).agg(F.avg(pred).alias("mean_pred"), F.avg(y).alias("mean_actual"), F.count("*").alias("n"))


def by_price_decile(df: DataFrame, price: str = "mid", bins: int = 10) -> DataFrame:
    """Adds decile (from 0), by quantiles of the price."""
    return df.withColumn("decile", bin_of(F.col(price), quantiles(df, price, [i / bins for i in range(1, bins)])))
