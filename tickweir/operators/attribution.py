"""Which features a model's skill rests on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.functions.frames import order_of
from tickweir.operators.metrics import regression_metrics
from tickweir.operators.windows import draw

Groups = dict[str, list[str]]
#: Group, names it holds, beginnings of names it holds; the first match counts.
GROUPS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("grid_bid", (), ("bid_grid_",)),
    ("grid_ask", (), ("ask_grid_",)),
    ("smooth_microgap", (), ("mg_ewma",)),
    ("smooth_obi", (), ("obi_ewma",)),
    ("smooth_ofi", (), ("ofi_ewma", "ofidepth_ewma")),
    ("price_impact", (), ("kyle_lambda_", "amihud_")),
    ("orderflow_decomp", (), ("add_rate_", "cancel_rate_")),
    ("trade_flow", (), ("trades_", "vol_", "tfi_", "vwapgap_")),
    ("ofi_dynamics", (), ("ofi_roll_", "ofi_ev_", "ofi_l")),
    ("ofi", ("ofi",), ()),
    ("return/vol", (), ("ret_", "rv_")),
    ("activity", (), ("mid_moves_", "updates_")),
    ("spread/micro_gap", ("micro_gap_ticks", "spread_ticks"), ()),
    ("spread_dyn", ("rel_spread",), ("spread_",)),
    ("imbalance", (), ("imbalance_", "obi_roll_")),
    ("book_shape", (), ("log_depth_", "depth_log_ratio", "micro_gap_l", "touch_conc_")),
)


def group_of(feature: str) -> str:
    return next((g for g, names, starts in GROUPS if feature in names or feature.startswith(starts)), "other")


def feature_groups(names: list[str]) -> Groups:
    """Features by group, in the order in which groups first occur."""
    out: Groups = {}
    for c in names:
        out.setdefault(group_of(c), []).append(c)
    return out


def shuffled(df: DataFrame, cols: list[str], seed: int = 0) -> DataFrame:
    """These columns of the rows, all moved by one permutation of the rows.

    Rows are parted by a hash; in each part, the i-th row by one hash gives its values to the i-th by another, so no
    partition has to hold all rows and nothing is lost."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in ("market_id", *order_of(df)) if c in df.columns]
    df = df.withColumn("_part", F.pmod(draw(df, seed + 1), F.lit(parts)))
    place = lambda s: F.row_number().over(W.partitionBy("_part").orderBy(draw(df, s), *keys))
    given = df.select("_part", *cols, place(seed + 2).alias("_i"))
    taken = df.drop(*cols).withColumn("_i", place(seed + 3))
    return taken.join(given, ["_part", "_i"]).drop("_part", "_i")


def permutation_importance(test: DataFrame, feats: list[str], predict: Callable[[DataFrame], DataFrame], y: str = "y_fwd", seed: int = 0) -> DataFrame:
    """group, base_corr, corr and drop: the correlation lost when a group's features are permuted together."""
    spark = test.sparkSession
    base = regression_metrics(predict(test), y).first()["corr"]
    rows = []
    for i, (g, cols) in enumerate(feature_groups(feats).items()):
        corr = regression_metrics(predict(shuffled(test, cols, seed + 10 * i)), y).first()["corr"]
        rows.append((g, float(base), float(corr), float(base - corr)))
    return spark.createDataFrame(rows, "`group` string, base_corr double, corr double, drop double").orderBy(F.desc("drop"))


def importance_share(importances: list[float], feats: list[str]) -> dict[str, float]:
    """Each group's share, in per cent, of a tree model's feature importances."""
    whole = sum(importances) or 1.0
    at = dict(zip(feats, importances))
    return {g: 100 * sum(at[c] for c in cols) / whole for g, cols in feature_groups(feats).items()}
