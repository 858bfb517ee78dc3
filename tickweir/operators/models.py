"""Baselines by MLlib, on the last row of each window."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


def assembled(df: DataFrame, feats: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep").transform(df)


def last_step(windows: DataFrame) -> DataFrame:
    """Windows with the last vector of x as features."""
    return windows.withColumn("features", array_to_vector(F.element_at("x", -1).cast("array<double>")))


def whole_window(windows: DataFrame) -> DataFrame:
    """Windows with all vectors of x, one after another, as features: for trees on the flattened window."""
    return windows.withColumn("features", array_to_vector(F.flatten("x").cast("array<double>")))


def with_features(df: DataFrame, feats: list[str] | None) -> DataFrame:
    return df if feats is None else assembled(df, feats)


def persistence(df: DataFrame) -> DataFrame:
    """Predicts no change."""
    return df.withColumn("pred", F.lit(0.0))


def ridge_fit(train: DataFrame, feats: list[str] | None, *, alpha: float = 1.0, y: str = "y_fwd") -> Any:
    """The minimiser of squared errors plus alpha times squared coefficients, solved by the normal equations.

    MLlib's objective is a mean and penalises in units of the label's deviation, so alpha is put in its terms."""
    train = with_features(train, feats)
    n, s = train.agg(F.count("*"), F.stddev_pop(y)).first()
    if not n:
        raise ValueError("no rows to fit on")
    return LinearRegression(featuresCol="features", labelCol=y, predictionCol="pred", solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha / n * (s or 1.0)).fit(train)


def gbt_fit(train: DataFrame, feats: list[str] | None, *, y: str = "y_fwd", trees: int = 40, depth: int = 5, rate: float = 0.1, seed: int = 0, **kw) -> Any:
    """Gradient-boosted regression trees. The algorithm is MLlib's; scores of other boosters can't be expected."""
    return GBTRegressor(featuresCol="features", labelCol=y, predictionCol="pred", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=100, seed=seed, **kw).fit(with_features(train, feats))


def predict(model: Any, df: DataFrame, feats: list[str] | None) -> DataFrame:
    return model.transform(with_features(df, feats)).drop("features")


@dataclass
class ClassModel:
    """A classifier with the classes its labels stand for. probs are always of -1, 0, 1: a class that training didn't
    see has probability 0."""

    model: Any
    seen: tuple[int, ...]

    def predict(self, df: DataFrame, feats: list[str] | None) -> DataFrame:
        p = self.model.transform(with_features(df, feats)).withColumn("_p", vector_to_array("probability"))
        probs = [F.get("_p", F.lit(self.seen.index(c))) if c in self.seen else F.lit(0.0) for c in CLASSES]
        return p.withColumn("probs", F.array(*probs)).drop("_p", "features", "probability", "rawPrediction", "prediction", "_label")


@dataclass
class OneClass:
    """What there is to learn from one class."""

    seen: tuple[int, ...]

    def predict(self, df: DataFrame, feats: list[str] | None) -> DataFrame:
        return df.withColumn("probs", F.array(*[F.lit(1.0 if c in self.seen else 0.0) for c in CLASSES]))


def labelled(train: DataFrame, feats: list[str] | None, y: str) -> tuple[DataFrame, tuple[int, ...]]:
    seen = tuple(sorted(r[0] for r in train.select(y).distinct().collect()))
    if not seen:
        raise ValueError("no rows to fit on")
    place = F.create_map(*[F.lit(v) for i, c in enumerate(seen) for v in (c, float(i))])
    return with_features(train, feats).withColumn("_label", place[F.col(y)]), seen


def logistic_fit(train: DataFrame, feats: list[str] | None, *, y: str = "y_cls", c: float = 1.0) -> ClassModel | OneClass:
    """Multinomial logistic regression with penalty 1 / c on the sum of losses."""
    rows, seen = labelled(train, feats, y)
    if len(seen) == 1:
        return OneClass(seen)
    n = train.count()
    return ClassModel(LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-8).fit(rows), seen)


@dataclass
class BoostedClasses:
    """One boosted model a class, against the rest; probabilities are normed."""

    models: list[Any]
    seen: tuple[int, ...]

    def predict(self, df: DataFrame, feats: list[str] | None) -> DataFrame:
        out = with_features(df, feats)
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        whole = sum((F.col(f"_p{i}") for i in range(len(self.models))), F.lit(0.0))
        probs = [F.try_divide(F.col(f"_p{self.seen.index(c)}"), whole) if c in self.seen else F.lit(0.0) for c in CLASSES]
        return out.withColumn("probs", F.array(*[F.coalesce(p, F.lit(0.0)) for p in probs])).drop("features", *[f"_p{i}" for i in range(len(self.models))])


def gbt_class_fit(train: DataFrame, feats: list[str] | None, *, y: str = "y_cls", trees: int = 20, depth: int = 5, seed: int = 0) -> BoostedClasses | OneClass:
    rows, seen = labelled(train, feats, y)
    if len(seen) == 1:
        return OneClass(seen)
    rows = rows.select("features", "_label").persist()
    try:
        models = [
            GBTClassifier(featuresCol="features", labelCol="_own", maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=100, subsamplingRate=0.8).fit(rows.withColumn("_own", (F.col("_label") == float(i)).cast("double")))
            for i in range(len(seen))
        ]
    finally:
        rows.unpersist()
    return BoostedClasses(models, seen)


def forest_class_fit(train: DataFrame, feats: list[str] | None, *, y: str = "y_cls", trees: int = 50, depth: int = 8, seed: int = 0) -> ClassModel | OneClass:
    rows, seen = labelled(train, feats, y)
    return OneClass(seen) if len(seen) == 1 else ClassModel(RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows), seen)


def majority(train: DataFrame, df: DataFrame, y: str = "y_cls") -> DataFrame:
    """The training rows' most frequent class, the least of equal ones, as certain."""
    top = train.groupBy(y).count().orderBy(F.desc("count"), y).limit(1).select(F.array(*[(F.col(y) == c).cast("double") for c in CLASSES]).alias("probs"))
    return df.crossJoin(F.broadcast(top))
