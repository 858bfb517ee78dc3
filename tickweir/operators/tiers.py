"""Markets by how busy they are. What is joined back is a row a market, never broadcast without Spark's own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.functions.frames import block_of, in_blocks, order_of, rows, time_edges
from tickweir.schema import ACTIVE, NS, TIERS

def minutes() -> Column:
    """From a group's first row to its last."""
    return (F.max("timestamp_ns") - F.min("timestamp_ns")) / NS / 60.0


def tier(value: str, n_tiers: int) -> Column:
    """Equal-count tiers from average ranks: ties share a tier, 0 is the least."""
    by, all_ = W.orderBy(value), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    average = F.rank().over(by) + (F.count("*").over(W.partitionBy(value)) - 1) / 2.0
    place = F.floor((average - 1) / F.count("*").over(all_) * n_tiers)
    return F.least(place, F.lit(n_tiers - 1)).cast("int")


def add_liquidity_tier(df: DataFrame, n_tiers: int = TIERS) -> DataFrame:
    """Adds updates_per_min and liq_tier of each row's market."""
    rate = df.groupBy("market_id").agg((F.count("*") / F.greatest(minutes(), F.lit(1e-9))).alias("updates_per_min"))
    return df.join(rate.withColumn("liq_tier", tier("updates_per_min", n_tiers)), "market_id", "left")


def moves_by_block(df: DataFrame, eps: float, edges: list[int]) -> DataFrame:
    """A row a market: n_mid_moves and _minutes. Moves are counted within blocks of time, then between a block's last row
    and the next one's first."""
    lean = df.select("market_id", *order_of(df), "mid", block_of("timestamp_ns", edges).alias("_blk"))
    w = W.partitionBy("market_id", "_blk").orderBy(*order_of(df))
    end = lambda beside: F.when(beside(F.lit(1)).over(w).isNull(), F.col("mid"))
    moved = F.abs(F.col("mid") - F.lag("mid").over(w)) > eps
    steps = in_blocks(lean, edges).select("market_id", "_blk", "timestamp_ns", moved.alias("_moved"), end(F.lag).alias("_first"), end(F.lead).alias("_last"))
    per = steps.groupBy("market_id", "_blk").agg(F.count_if("_moved").alias("_n"), F.min("timestamp_ns").alias("_t0"), F.max("timestamp_ns").alias("_t1"), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    between = F.abs(F.col("_first") - F.lag("_last").over(W.partitionBy("market_id").orderBy("_blk"))) > eps
    per = per.withColumn("_between", between).groupBy("market_id")
    return per.agg((F.sum("_n") + F.count_if("_between")).alias("n_mid_moves"), ((F.max("_t1") - F.min("_t0")) / NS / 60.0).alias("_minutes"))


def market_activity(df: DataFrame, *, eps: float = 1e-12, edges: list[int] | None = None) -> DataFrame:
    """A row a market: n_mid_moves, _minutes and mid_moves_per_min. Large tables are parted at `edges`, time_edges of the
    frame unless given."""
    edges = time_edges(df) if edges is None else edges
    if edges:
        per = moves_by_block(df, eps, edges)
    else:
        moved = F.abs(F.col("mid") - F.lag("mid").over(rows(df))) > eps
        per = df.select("market_id", "timestamp_ns", moved.alias("_moved")).groupBy("market_id").agg(F.count_if("_moved").alias("n_mid_moves"), minutes().alias("_minutes"))
    return per.withColumn("mid_moves_per_min", F.col("n_mid_moves") / F.greatest(F.col("_minutes"), F.lit(1e-9)))


def activity_tiers(df: DataFrame, n_tiers: int = TIERS, *, min_mid_moves: int = ACTIVE, edges: list[int] | None = None) -> DataFrame:
    """A row a market with at least min_mid_moves mid changes: n_mid_moves, mid_moves_per_min and act_tier; ValueError if
    there is none."""
    active = market_activity(df, edges=edges).filter(F.col("n_mid_moves") >= min_mid_moves)
    if active.isEmpty():
        raise ValueError(f"no market has {min_mid_moves} mid moves")
    return active.drop("_minutes").withColumn("act_tier", tier("mid_moves_per_min", n_tiers))


def add_activity_tier(df: DataFrame, n_tiers: int = TIERS, *, min_mid_moves: int = ACTIVE) -> DataFrame:
    """Rows of the markets of activity_tiers, with what it holds."""
    return df.join(activity_tiers(df, n_tiers, min_mid_moves=min_mid_moves), "market_id")


def top_tier(df: DataFrame, n_tiers: int = TIERS, *, min_mid_moves: int = ACTIVE) -> DataFrame:
    return add_activity_tier(df, n_tiers, min_mid_moves=min_mid_moves).filter(F.col("act_tier") == n_tiers - 1)
