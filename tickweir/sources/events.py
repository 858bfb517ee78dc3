"""A book and a trade tape derived from the events table, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME = "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) * 5) div 6"
LADDER = range(5)


def keyed(events: DataFrame) -> DataFrame:
    return events.select(
        "event_type", F.col("event_id").alias("seq"), F.concat(F.lit("M"), (F.col("user_id") % 6).cast("string")).alias("market_id"),
        F.expr(TIME).alias("timestamp_ns"), F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )


def book_from_events(events: DataFrame) -> DataFrame:
    """Every event but purchases as a book update of 3 to 5 levels; seq is the event's id."""
    e = keyed(events.filter("event_type <> 'purchase'"))
    e = e.withColumns({"bt": 10000 + F.col("v") % 7, "gap": F.col("seq") % 3, "depth": (3 + F.col("seq") % 3).cast("int")})
    e = e.withColumn("ak", F.col("bt") + 1 + F.col("gap"))
    off = lambda k: k + (F.col("gap") if k >= 2 else F.lit(0))
    size = lambda k, m: (1 + (F.col("v") * (m + 2 * k)) % 50).cast("double")
    cut = lambda cells: F.slice(F.array(*cells), F.lit(1), F.col("depth"))
    return e.select(
        "seq", "market_id", "timestamp_ns", (F.col("bt") / 100.0).alias("bid_price"), size(0, 3).alias("bid_size"), (F.col("ak") / 100.0).alias("ask_price"), size(0, 5).alias("ask_size"),
        ((F.col("bt") + F.col("ak")) / 200.0).alias("mid"), ((F.col("ak") - F.col("bt")) / 100.0).alias("spread"),
        cut([(F.col("bt") - off(k)) / 100.0 for k in LADDER]).alias("bids_price"), cut([size(k, 3) for k in LADDER]).alias("bids_size"),
        cut([(F.col("ak") + off(k)) / 100.0 for k in LADDER]).alias("asks_price"), cut([size(k, 5) for k in LADDER]).alias("asks_size"),
    )


def trades_from_events(events: DataFrame) -> DataFrame:
    e = keyed(events.filter("event_type = 'purchase'"))
    return e.select(
        "market_id", "timestamp_ns", ((10000 + F.col("v") % 9) / 100.0).alias("price"), (1 + F.col("v") % 10).cast("double").alias("size"),
        F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).cast("bigint").alias("side"),
    )
