"""Sequence windows and exact-size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.functions.frames import numbered, order_of, rows
from tickweir.functions.ranks import with_rank
from tickweir.operators.splits import Scaler, clean_features
from tickweir.schema import Count, Maybe, nanos, require


def eligible(df: DataFrame, *, min_window_mid_moves: Count = None, max_window_span_s: Maybe = None, seq_len: int) -> DataFrame:
    """Rows at which a window of seq_len rows of their market ends; guards drop windows that span more than
    max_window_span_s or see fewer than min_window_mid_moves mid changes after their first row."""
    w = rows(df)
    df = df.withColumn("_rn", F.row_number().over(w))
    keep = F.col("_rn") >= seq_len
    if max_window_span_s is not None:
        df = df.withColumn("_t0", F.lag("timestamp_ns", seq_len - 1).over(w))
        keep &= F.col("timestamp_ns") - F.col("_t0") <= nanos(max_window_span_s)
    if min_window_mid_moves is not None:
        require(df, ("mid",), "min_window_mid_moves")
        df = df.withColumn("_mv", (F.abs(F.col("mid") - F.lag("mid").over(w)) > 1e-12).cast("int"))
        seen = F.sum(F.coalesce("_mv", F.lit(0))).over(w.rowsBetween(2 - seq_len, 0)) if seq_len > 1 else F.lit(0)
        df = df.withColumn("_mvs", seen)
        keep &= F.col("_mvs") >= min_window_mid_moves
    return df.withColumn("_keep", keep)


def make_windows(df: DataFrame, feat_cols: list[str], *, scaler: Scaler | None = None, seq_len: int, min_window_mid_moves: Count = None, max_window_span_s: Maybe = None) -> DataFrame:
    """A row a window: market_id, timestamp_ns, x (seq_len vectors of the features, floats, oldest first), y_fwd, and
    y_cls where the table has it. Windows never cross markets; null and NaN are 0 after scaling. The arrays are made of
    the needed columns only, after the market's rows are in place; for models of the last row use `snapshots`."""
    if not set(feat_cols) <= set(df.columns):
        require(df, feat_cols, "make_windows")
    labels = [c for c in ("y_fwd", "y_cls") if c in df.columns]
    df = eligible(df, seq_len=seq_len, max_window_span_s=max_window_span_s, min_window_mid_moves=min_window_mid_moves)
    vector = F.array(*[c.cast("float") for c in clean_features(feat_cols, scaler)])
    keys = [c for c in ("market_id", *order_of(df)) if c in df.columns]
    lean = df.select(*keys, *labels, "_keep", vector.alias("_f"))
    x = F.collect_list("_f").over(rows(lean).rowsBetween(1 - seq_len, 0))
    return lean.withColumn("x", x).filter("_keep").select(*keys, "x", *labels)


def snapshots(df: DataFrame, feat_cols: list[str], *, seq_len: int = 1, scaler: Scaler | None = None, edges: list[int] | None = None, **guards) -> DataFrame:
    """The last row of each window make_windows would give, its features as columns; no array is built. Without guards the
    rows are numbered in blocks of time, parted at `edges` where given."""
    labels = [c for c in ("y_fwd", "y_cls") if c in df.columns]
    kept = eligible(df, seq_len=seq_len, **guards).filter("_keep") if guards else numbered(df, "_rn", edges).filter(F.col("_rn") >= seq_len)
    keys = [c for c in ("market_id", *order_of(df)) if c in df.columns]
    return kept.select(*keys, *clean_features(feat_cols, scaler), *labels)


def flatten(windows: DataFrame) -> DataFrame:
    """x as one array, row after row."""
    return windows.withColumn("x", F.flatten("x"))


def draw(df: DataFrame, seed: int) -> Column:
    """An order that looks random and is the same in every run: a hash of the row's key."""
    keys = [c for c in ("market_id", *order_of(df)) if c in df.columns]
    return F.xxhash64(F.lit(seed), *keys)


def subsample(df: DataFrame, n: int, seed: int = 0, by: Column | None = None) -> DataFrame:
    """Exactly n rows, or all where there are no more: those of the n least hashes, by rank, so that n may grow with the
    data and no partition has to hold n rows."""
    keys = tuple(c for c in ("market_id", *order_of(df)) if c in df.columns)
    return with_rank(df.withColumn("_h", draw(df, seed) if by is None else by), "_h", keys, "_rank").filter(F.col("_rank") < n).drop("_h", "_rank")


def balance(df: DataFrame, seed: int = 0, by: Column | None = None) -> DataFrame:
    """All rows of class 1 and -1; of class 0 as many as the larger of these has, those of least hash."""
    n = df.agg(F.count_if(F.col("y_cls") == 1).alias("up"), F.count_if(F.col("y_cls") == -1).alias("down")).first()
    return df.filter("y_cls <> 0").unionByName(subsample(df.filter("y_cls = 0"), max(n["up"], n["down"]), seed, by))
