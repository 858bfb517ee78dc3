"""Every query of the engine by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweir.functions.expr import at
from tickweir.functions.ranks import quantiles
from tickweir.operators import attribution, base, diagnostics, extended, labels, metrics, models, splits, tiers, windows
from tickweir.plans import studies
from tickweir.schema import QUOTE, tune
from tickweir.sources import synthetic
from tickweir.sources.events import book_from_events, trades_from_events
from tickweir.sources.files import LoadConfig, clean, drop_tail, min_rows
from tickweir.sqlbook import SQL

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("market_id", "timestamp_ns", "seq")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return book_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and never -0. What lies just between two values is moved off the edge first, as engines differ there.
    Plain arithmetic: round() makes a decimal of every value."""
    scale = float(10**digits)
    if isinstance(x, str):
        return F.expr(f"rint((CAST(`{x}` AS DOUBLE) + 1e-9D) * {scale}D) / {scale}D + 0D")
    return F.rint((x.cast("double") + 1e-9) * scale) / scale + 0.0


def tidy(df: DataFrame, cols: list[str], digits: int = 6, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in cols])


def scalars(s: SparkSession, d: str) -> DataFrame:
    return base.add_scalar_features(book(s, d))[0]


def features(add: Callable, digits: int = 6, only: Callable[[str], bool] | None = None, raw: bool = False) -> Query:
    """A builder on the book with its scalar features, or on the bare one."""

    def run(s: SparkSession, d: str) -> DataFrame:
        df, names = add(book(s, d) if raw else scalars(s, d))
        return tidy(df, [c for c in names if only is None or only(c)], digits)

    return run


MICRO = ["microprice", "imbalance_l1", *[f"{c}_l{n}" for n in base.DEPTHS for c in ("bid_size", "ask_size", "imbalance", "microprice")]]
SCALED = ["ofi", *base.IMBALANCES[:2], "micro_gap_ticks", "spread_ticks"]


def book_rows(s: SparkSession, d: str) -> DataFrame:
    cells = [rounded(at(c, k - 1)).alias(f"{n}_{k}") for n, c in (("bp", "bids_price"), ("bs", "bids_size"), ("ap", "asks_price"), ("az", "asks_size")) for k in range(1, 6)]
    b = book(s, d)
    return b.select(*KEYS, *[rounded(c).alias(c) for c in (*QUOTE, "mid", "spread")], *cells)


def trade_features(s: SparkSession, d: str) -> DataFrame:
    df, names = extended.add_trade_features(book(s, d), tape(s, d))
    return tidy(df, names, 4)


def target(**kw) -> Query:
    return lambda s, d: tidy(labels.add_forward_target(scalars(s, d), **kw), ["y_fwd", "fwd_dt_s"], 5 if "avg_window_s" in kw else 6)


def labelled(s: SparkSession, d: str) -> DataFrame:
    return labels.add_sign_label(labels.add_forward_target(scalars(s, d), horizon_events=10), 0.0021)


def predicted(s: SparkSession, d: str) -> DataFrame:
    """Labelled rows with a rule's prediction, for metrics."""
    return labelled(s, d).withColumn("pred", (F.col("microprice") - F.col("mid")) * 0.5 - F.col("imbalance_l3") * 0.001)


def classed(s: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("pred") > 0.0005, 1).when(F.col("pred") < -0.0005, -1).otherwise(0)
    return predicted(s, d).withColumn("probs", F.array(*[(k == c).cast("double") for c in models.CLASSES]))


def six(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cleaned(s: SparkSession, d: str) -> DataFrame:
    """Prices between 100 and 100.1, of which a corner of 0.01 goes on either side, and the last minute."""
    return clean(book(s, d), LoadConfig(price_bounds=(100.0, 100.1), corner_eps=0.01, tail_drop_s=60.0))


def walk(s: SparkSession, d: str) -> DataFrame:
    return splits.walk_forward(book(s, d), n_folds=4, horizon_s=30.0).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first"), F.max("timestamp_ns").alias("last"))


def scaler(s: SparkSession, d: str) -> DataFrame:
    df = scalars(s, d)
    bounds = splits.fold_bounds(df, n_folds=4, horizon_s=30.0).filter("fold = 2")
    train = df.crossJoin(F.broadcast(bounds)).filter(splits.in_train())
    return splits.scaler_stats(train, SCALED).select("feature", (F.round("mean", 6) + 0.0).alias("mean"), F.round("std", 6).alias("std"))


def window_ends(**guard) -> Query:
    return lambda s, d: windows.eligible(scalars(s, d), seq_len=16, **guard).filter("_keep").select(*KEYS)


def window_rows(s: SparkSession, d: str) -> DataFrame:
    w = windows.flatten(windows.make_windows(labelled(s, d), ["imbalance_l1"], seq_len=8))
    x = lambda k: F.element_at("x", k).cast("double")
    whole = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return w.select(*KEYS, "y_cls", F.size("x").alias("n"), rounded(x(1), 5).alias("x_first"), rounded(x(-1), 5).alias("x_last"), rounded(whole, 4).alias("x_sum"))


def key() -> Column:
    return (F.col("seq") * 7919) % 10007


def balanced(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).select(*KEYS, "y_cls").filter("y_cls = 0 or seq % 4 = 0")
    return windows.balance(rows, by=key())


def flow_signal(s: SparkSession, d: str) -> DataFrame:
    """Correlation, by market, of five seconds of order flow with the mean move over the next five."""
    df, _ = extended.add_flow_features(scalars(s, d), time_windows_s=(5.0,), event_windows=(), levels=1)
    df = labels.add_forward_target(df, avg_window_s=5.0)
    g = df.groupBy("market_id").agg(F.count("*").alias("n"), F.covar_pop("ofi_roll_5s", "y_fwd").alias("c"), F.stddev_pop("ofi_roll_5s").alias("a"), F.stddev_pop("y_fwd").alias("b"), F.sum("ofi_roll_5s").alias("flow"))
    return g.select("market_id", "n", F.round(F.try_divide(F.col("c"), F.col("a") * F.col("b")), 6).alias("corr"), rounded("flow", 4).alias("flow"))


def fold_means(s: SparkSession, d: str) -> DataFrame:
    per = metrics.regression_metrics(predicted(s, d), by=["market_id"]).withColumn("model", F.lit("rule"))
    return six(metrics.mean_of_folds(per.drop("market_id"), ["model"]))


def deciles(s: SparkSession, d: str) -> DataFrame:
    return six(metrics.regression_metrics(diagnostics.by_price_decile(predicted(s, d)), by=["decile"]))


def prepared(s: SparkSession, d: str) -> studies.Prepared:
    df = labelled(s, d)
    return studies.prepare(df, SCALED, studies.Settings(seq_len=8), 30.0)


def last_fold(s: SparkSession, d: str, name: str) -> DataFrame:
    p = prepared(s, d)
    fold = p.folds[-1]
    scored = studies.fitted(name, fold.train(p.rows), SCALED, studies.Settings(trees=10, depth=4))(fold.test(p.rows))
    return metrics.regression_metrics(scored) if "pred" in scored.columns else metrics.classification_metrics(scored)


def importance(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    fold = p.folds[-1]
    return attribution.permutation_importance(fold.test(p.rows), SCALED, studies.fitted("ridge", fold.train(p.rows), SCALED, studies.Settings()))


def staged(s: SparkSession, d: str) -> DataFrame:
    return studies.staged_attribution(book(s, d), studies.Settings(seq_len=8, n_folds=3, models=("ridge",), tasks=("reg",), min_mid_moves=5), phases="02")["reg"]


def cells_of_grid(s: SparkSession, d: str) -> DataFrame:
    return six(base.grid_clipped(book(s, d), k=3))


def majority_rows(s: SparkSession, d: str) -> DataFrame:
    """Every fourth row, with the most frequent class of the others as certain."""
    df = labelled(s, d)
    out = models.majority(df.filter("seq % 4 <> 0"), df.filter("seq % 4 = 0"))
    return out.select(*KEYS, *[at("probs", k).alias(f"p_{n}") for k, n in enumerate(("down", "flat", "up"))])


def vectors(place: Callable, n: str) -> Query:
    """What a model sees of a window of 8 rows of two features, put in place by `place`."""

    def run(s: SparkSession, d: str) -> DataFrame:
        w = place(windows.make_windows(labelled(s, d), ["imbalance_l1", "spread_ticks"], seq_len=8))
        w = w.withColumn("v", vector_to_array("features"))
        return w.select(*KEYS, F.size("v").alias(n), rounded(F.element_at("v", 1), 5).alias("first"), rounded(F.element_at("v", -2), 5).alias("near"), rounded(F.element_at("v", -1), 5).alias("last"))

    return run


def gaps_by_phase(s: SparkSession, d: str) -> DataFrame:
    per = metrics.regression_metrics(predicted(s, d), by=["market_id"])
    return six(metrics.phase_gaps(per.select(F.col("market_id").alias("phase"), F.lit("rule").alias("model"), "corr")))


def tied(s: SparkSession, d: str) -> DataFrame:
    """The book with whole seconds for times, so that many rows share one, and a null price in every ninth row."""
    b = scalars(s, d).withColumn("timestamp_ns", F.expr("timestamp_ns div 60000000000 * 60000000000"))
    return b.withColumn("microprice", F.when(F.col("seq") % 9 != 0, F.col("microprice")))


def history_of_ties(s: SparkSession, d: str) -> DataFrame:
    df, names = extended.add_history_features(tied(s, d), event_lags=(1,), time_windows_s=(120.0,))
    return tidy(df, names, 4)


def queries() -> dict[str, Query]:
    return {
        "flow_signal": flow_signal,
        "book": book_rows,
        "trades": lambda s, d: tidy(tape(s, d), ["price", "size"], keys=("market_id", "timestamp_ns", "side")),
        "microstructure": lambda s, d: tidy(base.add_microstructure(book(s, d)), MICRO),
        "ofi": lambda s, d: tidy(base.add_ofi(book(s, d)), ["delta_bid", "delta_ask", "ofi"]),
        "scalar": features(base.add_scalar_features, raw=True),
        "paper_levels": features(base.add_paper_features, raw=True),
        "grid": features(base.add_grid_features, raw=True),
        "grid_clipped": cells_of_grid,
        "stationary": features(base.add_stationary_features, raw=True),
        "flow_time": features(extended.add_flow_features, 4, lambda c: "_roll_" in c),
        "flow_events": features(extended.add_flow_features, 4, lambda c: "_ev_" in c),
        "ofi_levels": features(extended.add_flow_features, 6, lambda c: c.startswith("ofi_l")),
        "history": features(extended.add_history_features, 4),
        "shape": features(extended.add_shape_features),
        "trade_features": trade_features,
        "activity_spread": features(extended.add_activity_spread_features, 4),
        "impact": features(extended.add_impact_features, 4),
        "ewma": features(lambda df: extended.add_smoothed_features(df, halflives_s=(5.0,)), 5, lambda c: c in ("mg_ewma_5s", "obi_ewma_5s")),
        "perlevel": features(extended.add_perlevel_features, raw=True),
        "fwd_point": target(horizon_s=5.0),
        "fwd_point_stale": target(horizon_s=5.0, max_stale_s=1.0),
        "fwd_event": target(horizon_events=10),
        "fwd_smooth": target(avg_window_s=5.0),
        "sign_label": lambda s, d: tidy(labelled(s, d), ["y_fwd"], keys=(*KEYS, "y_cls")),
        "market_activity": lambda s, d: six(tiers.market_activity(book(s, d)).withColumnRenamed("_minutes", "minutes")),
        "liq_tier": lambda s, d: six(tiers.add_liquidity_tier(book(s, d)).select("seq", "market_id", "updates_per_min", "liq_tier")),
        "act_tier": lambda s, d: six(tiers.add_activity_tier(book(s, d)).select("seq", "market_id", "mid_moves_per_min", "act_tier")),
        "min_rows": lambda s, d: min_rows(book(s, d), book(s, d).count() // 6).groupBy("market_id").agg(F.count("*").alias("n")),
        "tail_drop": lambda s, d: drop_tail(book(s, d), 600.0).select("seq", "market_id", "timestamp_ns"),
        "clean": lambda s, d: cleaned(s, d).select("seq", "market_id", "timestamp_ns"),
        "whitelist": lambda s, d: book(s, d).filter(F.col("market_id").isin("M1", "M4")).groupBy("market_id").agg(F.count("*").alias("n"), F.count_distinct("market_id").alias("markets")),
        "walk_forward": walk,
        "scaler": scaler,
        "windows_span": window_ends(max_window_span_s=18.0),
        "windows_moves": window_ends(min_window_mid_moves=14),
        "windows_flat": window_rows,
        "reg_metrics": lambda s, d: six(metrics.regression_metrics(predicted(s, d), by=["market_id"])),
        "cls_metrics": lambda s, d: six(metrics.classification_metrics(classed(s, d), by=["market_id"])),
        "majority": lambda s, d: labelled(s, d).groupBy("y_cls").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y_cls").limit(1),
        "majority_rows": majority_rows,
        "persistence": lambda s, d: six(metrics.regression_metrics(models.persistence(labelled(s, d)), by=["market_id"])),
        "last_step": vectors(models.last_step, "n_features"),
        "whole_window": vectors(models.whole_window, "n_features"),
        "top_tier": lambda s, d: tiers.top_tier(book(s, d)).select("seq", "market_id", "act_tier"),
        "phase_gaps": gaps_by_phase,
        "history_ties": history_of_ties,
        "fold_means": fold_means,
        "residual_histogram": lambda s, d: diagnostics.residual_histogram(predicted(s, d)),
        "pred_vs_actual": lambda s, d: diagnostics.pred_vs_actual(predicted(s, d), grid=20),
        "error_bins": lambda s, d: six(diagnostics.error_by_move(predicted(s, d))),
        "calibration": lambda s, d: six(diagnostics.calibration(predicted(s, d))),
        "price_decile": deciles,
        "balance": balanced,
        "subsample": lambda s, d: windows.subsample(book(s, d).select(*KEYS), 500, by=key()),
        "median_wall": lambda s, d: s.createDataFrame([(round(quantiles(labels.add_forward_target(scalars(s, d), horizon_events=10), "fwd_dt_s", [0.5])[0], 6),)], "median_s double"),
        "feature_groups": lambda s, d: s.createDataFrame([(c, attribution.group_of(c)) for c in ("ofi", "imbalance_l10", "micro_gap_l3", "spread_ticks", "spread_std_5s", "ofi_l2", "vol_5s", "bid_grid_3", "pl_obi_1")], "feature string, grp string"),
        "ridge": lambda s, d: last_fold(s, d, "ridge"),
        "gbt": lambda s, d: last_fold(s, d, "gbt"),
        "logistic": lambda s, d: last_fold(s, d, "logistic"),
        "gbt_classes": lambda s, d: last_fold(s, d, "gbt_cls"),
        "permutation_importance": importance,
        "staged_attribution": staged,
        "synthetic_book": lambda s, d: synthetic.generate_pool(s, n_markets=3, minutes=5.0).select("market_id", "timestamp_ns", "mid"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
