"""Forward labels that look at nothing before the decision time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.functions.expr import known
from tickweir.functions.frames import drop_sums, first_at_or_after, rows, window_sums
from tickweir.schema import NS, Count, Maybe, nanos, require


def add_forward_target(df: DataFrame, *, price_col: str = "microprice", horizon_events: Count = None, horizon_s: Maybe = None, max_stale_s: Maybe = None, avg_window_s: Maybe = None, edges: list[int] | None = None) -> DataFrame:
    """Adds y_fwd, the price's forward change, and fwd_dt_s, the seconds it took; rows without one go.

    horizon_s: the first row at or after t + horizon, unless it is later than that by more than max_stale_s; edges part
    the work by time and are found unless given.
    horizon_events: the row so many rows ahead. avg_window_s: the mean over (t, t + window] of the known prices.
    Exactly one of the three is given."""
    given = [avg_window_s, horizon_events, horizon_s]
    if given.count(None) != len(given) - 1:
        raise ValueError("give one of horizon_s, horizon_events and avg_window_s")
    require(df, (price_col,), "add_forward_target", "build the features that hold the price first")
    px = known(F.col(price_col).cast("double"))
    if avg_window_s is not None:
        values = {"px": px, "one": px.isNotNull().cast("double")}
        df = window_sums(df, values, (avg_window_s,), forward=True)
        y = F.when(F.col("sum_one_0") > 0, F.col("sum_px_0") / F.col("sum_one_0")) - px
        df = drop_sums(df.withColumns({"y_fwd": y, "fwd_dt_s": F.lit(float(avg_window_s))}), values, (avg_window_s,))
    elif horizon_events is not None:
        w = rows(df)
        there, later = F.lead(px, horizon_events).over(w), F.lead("timestamp_ns", horizon_events).over(w)
        df = df.withColumns({"y_fwd": there - px, "fwd_dt_s": (later - F.col("timestamp_ns")) / NS})
    else:
        df = first_at_or_after(df, horizon_s, price_col, edges)
        y = F.col("hit.px") - px
        if max_stale_s is not None:
            y = F.when(F.col("hit.t") - F.col("timestamp_ns") - nanos(horizon_s) <= nanos(max_stale_s), y)
        df = df.withColumns({"y_fwd": y, "fwd_dt_s": (F.col("hit.t") - F.col("timestamp_ns")) / NS}).drop("hit")
    return df.filter(F.col("y_fwd").isNotNull() & ~F.isnan("y_fwd"))


def add_sign_label(df: DataFrame, alpha: float = 0.0) -> DataFrame:
    """Adds y_cls: 1 above alpha, -1 below -alpha, else 0."""
    y = F.col("y_fwd")
    return df.withColumn("y_cls", F.when(y > alpha, 1).when(y < -alpha, -1).otherwise(0))
