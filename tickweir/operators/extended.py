"""Backward-looking features of a market's recent past. All share one shuffle on market_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.functions.expr import list_sum, or_zero, ratio
from tickweir.functions.frames import ALL, change, drop_sums, previous, rows, value_before, window_sums, with_ewma
from tickweir.operators.base import Built, flow, level
from tickweir.schema import LEVELS, LONG, SHORT, TICK, TRADES, Seconds, label, require

Events = tuple[int, ...]
SCALARS = "run add_scalar_features first"
MOVE = 1e-12


def level_flows(df: DataFrame, levels: range, name: str) -> dict[str, Column]:
    """Order flow of single levels (from 1); 0 on a market's first row."""
    w, out = rows(df), {}
    for m in levels:
        (bp, bs), (ap, az) = level("bid", m - 1), level("ask", m - 1)
        both = [flow(p, s, F.lag(p).over(w), F.lag(s).over(w), sign) for p, s, sign in ((bp, bs, 1), (ap, az, -1))]
        out[f"{name}{m}"] = F.coalesce(both[0] + both[1], F.lit(0.0))
    return out


def add_flow_features(df: DataFrame, *, time_windows_s: Seconds = SHORT, event_windows: Events = (10, 50), levels: int = 3) -> Built:
    """Rolling order flow by time and by events, order flow of deeper levels, rolling mean imbalance."""
    require(df, ("ofi", "imbalance_l1"), "add_flow_features", SCALARS)
    values = {"ofi": F.col("ofi"), "obi": F.col("imbalance_l1")}
    w = rows(df)
    deep = level_flows(df, range(2, levels + 1), "ofi_l")
    events = {f"ofi_ev_{k}": F.sum(or_zero(F.col("ofi"))).over(w.rowsBetween(1 - k, 0)) for k in event_windows}
    df = window_sums(df.withColumns(deep | events), values, time_windows_s)
    roll = {f"ofi_roll_{label(s)}": F.col(f"sum_ofi_{i}") for i, s in enumerate(time_windows_s)}
    mean = {f"obi_roll_{label(s)}": F.col(f"sum_obi_{i}") / F.greatest(F.col(f"count_{i}"), F.lit(1)) for i, s in enumerate(time_windows_s)}
    return drop_sums(df.withColumns(roll | mean), values, time_windows_s), [*roll, *events, *deep, *mean]


def add_history_features(df: DataFrame, *, event_lags: Events = (1, 5, 10), time_windows_s: Seconds = LONG, tick: float = TICK) -> Built:
    """Microprice returns over events and seconds, and realised volatility, in ticks."""
    require(df, ("microprice",), "add_history_features", SCALARS)
    w = rows(df)
    df = df.withColumn("_mp", or_zero(F.col("microprice")))
    lagged = {f"ret_ev_{k}": F.coalesce((F.col("_mp") - F.lag("_mp", k).over(w)) / F.lit(tick), F.lit(0.0)) for k in event_lags}
    rolled = {f"ret_roll_{label(s)}": (F.col("_mp") - value_before("_mp", s, "seq" in df.columns)) / F.lit(tick) for s in time_windows_s}
    df = df.withColumns(lagged | {"_r": change(df, "_mp")}).withColumns(rolled)
    values = {"r2": F.col("_r") * F.col("_r")}
    df = window_sums(df, values, time_windows_s)
    rv = {f"rv_{label(s)}": F.sqrt(F.greatest(F.col(f"sum_r2_{i}"), F.lit(0.0)) / F.greatest(F.col(f"count_{i}"), F.lit(1))) / F.lit(tick) for i, s in enumerate(time_windows_s)}
    return drop_sums(df.withColumns(rv), values, time_windows_s).drop("_mp", "_r"), [*lagged, *rolled, *rv]


def add_shape_features(df: DataFrame, *, tick: float = TICK) -> Built:
    """Concentration at the touch, depth by side on a log scale, deeper microprice gaps, imbalance of ten levels."""
    require(df, ("microprice_l3", "microprice_l5", "imbalance_l10"), "add_shape_features", SCALARS)
    df = df.withColumns({"_bt": list_sum("bids_size"), "_at": list_sum("asks_size")})
    out = {
        "touch_conc_bid": F.coalesce(ratio(F.col("bid_size"), F.col("_bt")), F.lit(0.0)),
        "touch_conc_ask": F.coalesce(ratio(F.col("ask_size"), F.col("_at")), F.lit(0.0)),
        "depth_log_ratio": F.log1p("_bt") - F.log1p("_at"),
        "log_depth_bid": F.log1p("_bt"),
        "log_depth_ask": F.log1p("_at"),
        "micro_gap_l3": (F.col("microprice_l3") - F.col("mid")) / F.lit(tick),
        "micro_gap_l5": (F.col("microprice_l5") - F.col("mid")) / F.lit(tick),
    }
    return df.withColumns(out).drop("_bt", "_at"), [*out, "imbalance_l10"]


def add_trade_features(book: DataFrame, trades: DataFrame, *, windows_s: Seconds = LONG, tick: float = TICK) -> Built:
    """Of the trades in (t - w, t]: signed-volume imbalance, count, volume (log), VWAP's gap from mid in ticks, and
    illiquidity (absolute mid changes by volume). All 0 without trades.

    Book rows and trades are put in one series; there is no join, so a busy tape multiplies nothing."""
    require(trades, TRADES.names, "add_trade_features: the trade tape")
    require(book, ("mid",), "add_trade_features")
    book = book.withColumn("_move", F.abs(change(book, "mid")))
    nothing = {c: F.lit(0.0) for c in ("_n", "_sz", "_sg", "_pv")}
    tape = trades.select(
        "market_id", "timestamp_ns", F.lit(0.0).alias("_move"), F.lit(1.0).alias("_n"), F.col("size").alias("_sz"),
        (F.col("side") * F.col("size")).alias("_sg"), (F.col("price") * F.col("size")).alias("_pv"), F.lit(False).alias("_book"),
    )
    both = book.withColumns(nothing | {"_book": F.lit(True)}).unionByName(tape, allowMissingColumns=True)
    values = {"n": F.col("_n"), "sz": F.col("_sz"), "sg": F.col("_sg"), "pv": F.col("_pv"), "mv": F.col("_move")}
    df = window_sums(both, values, windows_s).filter("_book")
    out: dict[str, dict[str, Column]] = {k: {} for k in ("tfi", "trades", "vol", "vwapgap", "amihud")}
    for i, s in enumerate(windows_s):
        vol = F.col(f"sum_sz_{i}")
        by_vol = lambda x, vol=vol: F.coalesce(ratio(x, vol), F.lit(0.0))
        out["tfi"][f"tfi_{label(s)}"] = by_vol(F.col(f"sum_sg_{i}"))
        out["trades"][f"trades_{label(s)}"] = F.col(f"sum_n_{i}")
        out["vol"][f"vol_{label(s)}"] = F.log1p(F.greatest(vol, F.lit(0.0)))
        out["vwapgap"][f"vwapgap_{label(s)}"] = F.coalesce((ratio(F.col(f"sum_pv_{i}"), vol) - F.col("mid")) / F.lit(tick), F.lit(0.0))
        out["amihud"][f"amihud_{label(s)}"] = by_vol(F.col(f"sum_mv_{i}"))
    made = {c: x for group in out.values() for c, x in group.items()}
    return drop_sums(df.withColumns(made), values, windows_s).drop("_move", "_book", *nothing), list(made)


def add_activity_spread_features(df: DataFrame, *, time_windows_s: Seconds = SHORT, spread_windows_s: Seconds = LONG) -> Built:
    """Mid changes and updates of the last seconds, mean and deviation of the spread in ticks, spread by mid."""
    require(df, ("spread_ticks",), "add_activity_spread_features", SCALARS)
    df = df.withColumns({"rel_spread": F.coalesce(ratio(F.col("spread"), F.col("mid")), F.lit(0.0)), "_moved": (F.abs(change(df, "mid")) > MOVE).cast("double"), "_sp": or_zero(F.col("spread_ticks"))})
    every = tuple(dict.fromkeys((*time_windows_s, *spread_windows_s)))
    values = {"mv": F.col("_moved"), "sp": F.col("_sp"), "sp2": F.col("_sp") * F.col("_sp")}
    df = window_sums(df, values, every)
    n = {s: F.greatest(F.col(f"count_{i}"), F.lit(1)) for i, s in enumerate(every)}
    at = {s: i for i, s in enumerate(every)}
    moves = {f"mid_moves_{label(s)}": F.col(f"sum_mv_{at[s]}") for s in time_windows_s}
    updates = {f"updates_{label(s)}": F.col(f"count_{at[s]}").cast("double") for s in time_windows_s}
    mean = {f"spread_mean_{label(s)}": F.col(f"sum_sp_{at[s]}") / n[s] for s in spread_windows_s}
    std = {f"spread_std_{label(s)}": F.sqrt(F.greatest(F.col(f"sum_sp2_{at[s]}") / n[s] - F.pow(F.col(f"sum_sp_{at[s]}") / n[s], 2), F.lit(0.0))) for s in spread_windows_s}
    return drop_sums(df.withColumns(moves | updates | mean | std), values, every).drop("_moved", "_sp"), ["rel_spread", *moves, *updates, *mean, *std]


def add_impact_features(df: DataFrame, *, time_windows_s: Seconds = LONG) -> Built:
    """Size added and cancelled at unchanged touches, and the slope of mid changes on order flow."""
    require(df, ("ofi",), "add_impact_features", SCALARS)
    same = {}
    for s in ("bid", "ask"):
        stays = F.col(f"{s}_price") == previous(df, f"{s}_price", True)
        same[f"_d{s}"] = F.when(stays, F.col(f"{s}_size") - previous(df, f"{s}_size", True)).otherwise(0.0)
    df = df.withColumns(same | {"_dm": change(df, "mid"), "_of": or_zero(F.col("ofi"))})
    up = F.greatest(F.col("_dbid"), F.lit(0.0)) + F.greatest(F.col("_dask"), F.lit(0.0))
    down = F.greatest(-F.col("_dbid"), F.lit(0.0)) + F.greatest(-F.col("_dask"), F.lit(0.0))
    values = {"add": up, "cut": down, "xy": F.col("_dm") * F.col("_of"), "xx": F.col("_of") * F.col("_of")}
    df = window_sums(df, values, time_windows_s)
    e = list(enumerate(time_windows_s))
    adds = {f"add_rate_{label(s)}": F.col(f"sum_add_{i}") for i, s in e}
    cuts = {f"cancel_rate_{label(s)}": F.col(f"sum_cut_{i}") for i, s in e}
    slope = {f"kyle_lambda_{label(s)}": F.col(f"sum_xy_{i}") / F.greatest(F.col(f"sum_xx_{i}"), F.lit(1e-12)) for i, s in e}
    return drop_sums(df.withColumns(adds | cuts | slope), values, time_windows_s).drop(*same, "_dm", "_of"), [*adds, *cuts, *slope]


def add_smoothed_features(df: DataFrame, *, halflives_s: Seconds = LONG) -> Built:
    """Exponentially weighted means, by time, of the microprice gap, imbalance, order flow and order flow by depth."""
    require(df, ("micro_gap_ticks", "ofi", "imbalance_l1"), "add_smoothed_features", SCALARS)
    df = df.withColumn("_deep", F.col("ofi") / (F.lit(1.0) + list_sum("bids_size") + list_sum("asks_size")))
    sources = {"mg_ewma": "micro_gap_ticks", "obi_ewma": "imbalance_l1", "ofi_ewma": "ofi", "ofidepth_ewma": "_deep"}
    names: list[str] = []
    for h in halflives_s:
        made = {f"{n}_{label(h)}": c for n, c in sources.items()}
        df = with_ewma(df, made, h)
        names += made
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}).drop("_deep"), names


def add_perlevel_features(df: DataFrame, *, levels: int = LEVELS) -> Built:
    """Of each level its imbalance, order flow and share of all size, level by level."""
    df = df.withColumns(level_flows(df, range(1, levels + 1), "pl_ofi_")).withColumn("_tot", list_sum("bids_size") + list_sum("asks_size"))
    out = {}
    for m in range(1, levels + 1):
        (_, b), (_, a) = level("bid", m - 1), level("ask", m - 1)
        out[f"pl_obi_{m}"] = F.coalesce(ratio(b - a, b + a), F.lit(0.0))
        out[f"pl_relsz_{m}"] = F.coalesce(ratio(b + a, F.col("_tot")), F.lit(0.0))
    return df.withColumns(out).drop("_tot"), [f"pl_{c}_{m}" for m in range(1, levels + 1) for c in ("obi", "ofi", "relsz")]
