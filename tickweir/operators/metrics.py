"""Forecast metrics, one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.functions.expr import argmax, known, total

NAN = float("nan")


def over(num: Column, den: Column, empty: float = NAN) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def regression_metrics(df: DataFrame, y: str = "y_fwd", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """r2, corr, hit_rate, weighted_hit and n, for all rows or by group. r2 is NaN for constant truth, corr 0 for a
    constant prediction (NaN for constant truth), hits count where the truth isn't 0 (NaN if nowhere)."""
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    moved, right = t != 0, F.signum(p) == F.signum(t)
    g = df.groupBy(*(by or [])).agg(
        F.sum((t - p) * (t - p)).alias("sse"), F.var_pop(t).alias("vt"), F.var_pop(p).alias("vp"), F.covar_pop(t, p).alias("c"), F.count("*").alias("n"),
        F.count_if(moved).alias("k"), F.count_if(moved & right).alias("h"), F.sum(F.when(moved & right, F.abs(t)).otherwise(0.0)).alias("wh"), F.sum(F.abs(t)).alias("w"),
    )
    corr = F.when(F.col("vp") <= 0, 0.0).when(F.col("vt") <= 0, F.lit(NAN)).otherwise(F.try_divide(F.col("c"), F.sqrt("vt") * F.sqrt("vp")))
    return g.select(*(by or []), over(F.col("n") * F.col("vt") - F.col("sse"), F.col("n") * F.col("vt")).alias("r2"), corr.alias("corr"), over(F.col("h"), F.col("k")).alias("hit_rate"), over(F.col("wh"), F.col("w")).alias("weighted_hit"), "n")


def predicted_class(probs: str = "probs") -> Column:
    return argmax(F.col(probs)) - 1


def classification_metrics(df: DataFrame, truth: str = "y_cls", probs: str = "probs", y: str = "y_fwd", by: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1 over -1, 0, 1 (a class that never occurs counts 0), hit_rate and weighted_hit where a move is
    predicted and there is one, and n. probs are of -1, 0, 1 in this order; the first of equal ones wins."""
    df = df.withColumn("_p", predicted_class(probs))
    t, p, v = F.col(truth), F.col("_p"), F.col(y).cast("double")
    called = (p != 0) & (v != 0)
    right = called & (F.signum(v) == p)
    cells = [F.count_if(cond).alias(f"{n}{c + 1}") for c in (-1, 0, 1) for n, cond in (("tp", (t == c) & (p == c)), ("t", t == c), ("p", p == c))]
    g = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(t == p).alias("ok"), F.count_if(called).alias("k"), F.count_if(right).alias("h"), F.sum(F.when(right, F.abs(v)).otherwise(0.0)).alias("wh"), F.sum(F.when(called, F.abs(v)).otherwise(0.0)).alias("w"), *cells)
    f1 = total(over(2.0 * F.col(f"tp{c}"), F.col(f"t{c}") + F.col(f"p{c}"), 0.0) for c in range(3)) / 3
    return g.select(*(by or []), over(F.col("ok"), F.col("n")).alias("accuracy"), f1.alias("macro_f1"), over(F.col("h"), F.col("k")).alias("hit_rate"), over(F.col("wh"), F.col("w")).alias("weighted_hit"), "n")


def mean_of_folds(df: DataFrame, by: list[str]) -> DataFrame:
    """Metrics averaged over folds, NaN left out; n summed."""
    metrics = [c for c, kind in df.dtypes if kind == "double" and c not in by]
    return df.groupBy(*by).agg(*[F.avg(known(F.col(c))).alias(c) for c in metrics], F.sum("n").alias("n"))


def phase_gaps(table: DataFrame, metric: str = "corr") -> DataFrame:
    """Each model's metric by phase with its difference to the phase before."""
    w = W.partitionBy("model").orderBy("phase")
    return table.select("phase", "model", metric, (F.col(metric) - F.lag(metric).over(w)).alias("gain"))


def format_table(df: DataFrame, title: str) -> str:
    """A small metrics table as fixed-width text."""
    rows = [[c for c in df.columns]] + [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = ["  ".join(v.rjust(n) if i > 1 else v.ljust(n) for i, (v, n) in enumerate(zip(r, width))) for r in rows]
    return "\n".join([title, lines[0], "-" * len(lines[0]), *lines[1:]])
