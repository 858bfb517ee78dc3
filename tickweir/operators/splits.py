"""Walk-forward folds and train-only scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.functions.expr import finite, known
from tickweir.schema import nanos


def fold_bounds(df: DataFrame, *, embargo_mult: float = 1.0, horizon_s: float, n_folds: int) -> DataFrame:
    """A row a fold: fold (from 1), test_lo, test_hi (not included, but in the last fold), train_end (not included).

    Folds share the span of all decision times in whole nanoseconds; training ends embargo_mult * horizon_s before the
    test block. It begins at the first row, so the first fold never has training rows."""
    span = df.agg(F.min("timestamp_ns").alias("t0"), F.max("timestamp_ns").alias("t1"))
    edge = lambda k: F.expr(f"t0 + ((t1 - t0) * ({k})) div {n_folds}")
    bounds = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    last = F.col("fold") == n_folds
    bounds = bounds.select("fold", edge("fold - 1").alias("test_lo"), F.when(last, F.col("t1") + 1).otherwise(edge("fold")).alias("test_hi"))
    return bounds.withColumn("train_end", F.col("test_lo") - nanos(embargo_mult * horizon_s))


def in_train(b: dict | None = None) -> Column:
    return F.col("timestamp_ns") < (F.col("train_end") if b is None else F.lit(b["train_end"]))


def in_test(b: dict | None = None) -> Column:
    lo, hi = (F.col("test_lo"), F.col("test_hi")) if b is None else (F.lit(b["test_lo"]), F.lit(b["test_hi"]))
    return (F.col("timestamp_ns") >= lo) & (F.col("timestamp_ns") < hi)


def walk_forward(df: DataFrame, *, embargo_mult: float = 1.0, horizon_s: float, n_folds: int) -> DataFrame:
    """Each row once for each fold that uses it, with fold and role ("train" or "test"). Bounds are n_folds rows."""
    bounds = fold_bounds(df, n_folds=n_folds, horizon_s=horizon_s, embargo_mult=embargo_mult)
    role = F.when(in_test(), "test").when(in_train(), "train")
    return df.crossJoin(F.broadcast(bounds)).withColumn("role", role).filter("role is not null").drop("test_lo", "test_hi", "train_end")


@dataclass(frozen=True)
class Fold:
    """A fold's bounds; its rows are selected by time when they are needed."""

    number: int
    test_lo: int
    test_hi: int
    train_end: int

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(in_train(vars(self)))

    def test(self, df: DataFrame) -> DataFrame:
        return df.filter(in_test(vars(self)))


def walk_forward_splits(df: DataFrame, *, embargo_mult: float = 1.0, horizon_s: float, n_folds: int) -> list[Fold]:
    """The folds that have training and test rows; ValueError if there is none."""
    bounds = [Fold(*r) for r in fold_bounds(df, n_folds=n_folds, horizon_s=horizon_s, embargo_mult=embargo_mult).orderBy("fold").collect() if r["test_lo"] is not None]
    counts = df.agg(*[F.count_if(c(vars(b))).alias(f"{n}{b.number}") for b in bounds for n, c in (("a", in_train), ("b", in_test))]).first() if bounds else {}
    folds = [b for b in bounds if counts[f"a{b.number}"] and counts[f"b{b.number}"]]
    if not folds:
        raise ValueError("no fold has rows to train and to test on; use a longer span or other folds")
    return folds


@dataclass(frozen=True)
class Scaler:
    """Means and deviations of features, in order."""

    cols: list[str]
    mean: list[float]
    std: list[float]

    def scaled(self) -> list[Column]:
        return [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(self.cols, self.mean, self.std)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(self.cols, self.scaled())))


def scaler_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """feature, mean and std (of the population; under 1e-12 taken as 1) over known values; one pass."""
    x = {c: known(F.col(c).cast("double")) for c in cols}
    one = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x.values())], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x.values())])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") < 1e-12, 1.0).otherwise(F.col(f"s{i}")).alias("std")) for i, c in enumerate(cols)])
    return one.select(F.explode(cells).alias("f")).select("f.*")


def fit_scaler(train: DataFrame, cols: list[str]) -> Scaler:
    """Statistics of these (training) rows; a feature without values gets mean 0 and deviation 1."""
    got = {r["feature"]: r for r in scaler_stats(train, cols).collect()}
    return Scaler(list(cols), [got[c]["mean"] or 0.0 for c in cols], [1.0 if got[c]["std"] is None else got[c]["std"] for c in cols])


def clean_features(cols: list[str], scaler: Scaler | None = None) -> list[Column]:
    """Scaled features with null, NaN and infinities as 0."""
    return [finite(x).alias(c) for c, x in zip(cols, scaler.scaled() if scaler else map(F.col, cols))]
