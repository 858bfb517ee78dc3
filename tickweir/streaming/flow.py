"""Order flow and its exponential mean as book updates arrive, and bars with late data; beyond what the batch studies need.

State is a market's last quote and mean: a few numbers, whatever the stream's length.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickweir.schema import NS, QUOTE, require

OUT = "market_id string, timestamp_ns bigint, ofi double, ofi_ewma double"
STATE = "bp double, bs double, ap double, az double, t bigint, y double"


def step(last: tuple | None, now: tuple) -> float | None:
    """Order flow between two quotes (bid price, bid size, ask price, ask size)."""
    if last is None or any(v is None or v != v for v in (*last, *now)):
        return None
    (bp, bs, ap, az), (b, s, a, z) = last, now
    bid = s if b > bp else s - bs if b == bp else -bs
    ask = -z if a < ap else az - z if a == ap else az
    return bid + ask


def stream_flow(book: DataFrame, halflife_s: float = 5.0) -> DataFrame:
    """ofi and ofi_ewma of each update. Updates of one batch are put in order of time; one that arrives in a later batch
    than updates after it is taken as it comes, with no time passed."""
    require(book, ("market_id", "timestamp_ns", *QUOTE), "stream_flow")
    rate = math.log(2) / halflife_s

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *quote, t, y = state.get if state.exists else (None,) * 6
        last = None if quote[0] is None else tuple(quote)
        df = pd.concat(list(frames)).sort_values("timestamp_ns", kind="stable")
        out = []
        for row in df[["timestamp_ns", *QUOTE]].itertuples(index=False, name=None):
            now, quote_now = row[0], row[1:]
            x = step(last, quote_now)
            if x is not None:
                keep = 0.0 if y is None else math.exp(-rate * max(0, now - t) / NS)
                y, t = (x if y is None else (1 - keep) * x + keep * y), now
            last = quote_now
            out.append((key[0], now, x, y if x is not None else 0.0))
        state.update((*[float(v) for v in last], t, y))
        yield pd.DataFrame(out, columns=["market_id", "timestamp_ns", "ofi", "ofi_ewma"])

    return book.select("market_id", "timestamp_ns", *QUOTE).groupBy("market_id").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_bars(book: DataFrame, width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Per market and bar: updates, the mid's low, high and mean. Updates later than `late` are left out."""
    at = F.timestamp_micros((F.col("timestamp_ns") / 1000).cast("bigint"))
    timed = book.withColumn("at", at).withWatermark("at", late)
    bars = timed.groupBy(F.window("at", width).alias("w"), "market_id").agg(F.count("*").alias("updates"), F.min("mid").alias("low"), F.max("mid").alias("high"), F.avg("mid").alias("mean"))
    return bars.select("market_id", F.col("w.start").alias("start"), "updates", "low", "high", "mean")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
