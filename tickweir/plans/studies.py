"""The studies, each from loaded books to small result tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.functions.frames import order_of, time_edges
from tickweir.functions.ranks import quantiles
from tickweir.operators import attribution, diagnostics, metrics, models, tiers
from tickweir.operators.base import add_grid_features, add_paper_features, add_scalar_features
from tickweir.operators.extended import (
    add_activity_spread_features,
    add_flow_features,
    add_history_features,
    add_impact_features,
    add_perlevel_features,
    add_shape_features,
    add_smoothed_features,
    add_trade_features,
)
from tickweir.operators.labels import add_forward_target, add_sign_label
from tickweir.operators.splits import Fold, fit_scaler, walk_forward_splits
from tickweir.operators.windows import balance, snapshots, subsample

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """What the studies share. The defaults are those of staged attribution."""

    horizon_s: float = 30.0
    horizon_events: int = 50
    max_stale_s: float | None = 120.0
    seq_len: int = 32
    n_folds: int = 4
    n_tiers: int = 3
    min_mid_moves: int = 10
    grid_k: int = 20
    alpha: float = 0.0
    subsample: int = 0
    seed: int = 0
    base_features_only: bool = False
    balance: bool = False
    trees: int = 40
    depth: int = 5
    models: tuple[str, ...] = ("ridge", "gbt")
    tasks: tuple[str, ...] = ("reg", "cls")


COMPARISON = Settings(seq_len=24, n_folds=3, alpha=0.002, subsample=80_000)
TARGETS = Settings(seq_len=24, n_folds=3, alpha=0.002, subsample=60_000)
DIAGNOSIS = Settings(seq_len=24, n_folds=3, alpha=0.002, subsample=100_000)
#: Price that the label is of, feature set.
PHASES = {"0": ("mid", "levels")} | {str(i): ("microprice", kind) for i, kind in enumerate(("levels", "grid", "grid+scalar", "extended", "extended+trades"), 1)}


def add_extended(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The families that need no tape. Markets stay where the first of them put them: one shuffle for all."""
    feats: list[str] = []
    for add in (add_flow_features, add_history_features, add_shape_features, add_activity_spread_features, add_impact_features, add_smoothed_features):
        df, more = add(df)
        feats += more
    return df, feats


def build_features(df: DataFrame, kind: str, s: Settings, trades: DataFrame | None = None, *, scalars_in_grid: bool = False) -> tuple[DataFrame, list[str]]:
    """A feature set by name: "levels", "grid", "grid+scalar", "extended", "extended+trades", or "combined", the extended
    set with raw and per-level features. "grid" holds the grid alone; with scalars_in_grid it also holds the scalars, as
    "grid+scalar" does."""
    if kind == "levels":
        df, feats = add_paper_features(df)
        return add_scalar_features(df)[0], feats
    df, feats = add_grid_features(df, k=s.grid_k)
    df, scalars = add_scalar_features(df)
    if kind != "grid" or scalars_in_grid:
        feats = feats + scalars
    if kind.startswith("extended") or kind == "combined":
        df, more = add_extended(df)
        feats = feats + more
    if kind == "combined":
        for add in (add_paper_features, add_perlevel_features):
            df, more = add(df)
            feats = feats + more
    if kind.endswith("+trades"):
        if trades is None or trades.isEmpty():
            raise ValueError("this phase needs trades and there are none")
        df, more = add_trade_features(df, trades)
        feats = feats + more
    return df, feats


@dataclass
class Prepared:
    """Rows ready to fit on: scaled features of each window's last row, labels, and the folds."""

    rows: DataFrame
    feats: list[str]
    folds: list[Fold]


def prepare(df: DataFrame, feats: list[str], s: Settings, embargo_s: float, edges: list[int] | None = None) -> Prepared:
    """Scale by the first fold's training rows, keep windows' last rows, part them anew by their times. `edges` part the
    work and are found unless given."""
    keep = [c for c in ("market_id", *order_of(df), "mid", "y_fwd", "y_cls") if c in df.columns]
    df = df.select(*keep, *[c for c in feats if c not in keep]).persist()
    first = walk_forward_splits(df, n_folds=s.n_folds, horizon_s=embargo_s)[0]
    rows = snapshots(df, feats, seq_len=s.seq_len, scaler=fit_scaler(first.train(df), feats), edges=edges).persist()
    folds = walk_forward_splits(rows, n_folds=s.n_folds, horizon_s=embargo_s)
    df.unpersist()
    return Prepared(rows, feats, folds)


def fitted(name: str, train: DataFrame, feats: list[str], s: Settings) -> Callable[[DataFrame], DataFrame]:
    """A fitted model as a function from rows to rows with pred or probs."""
    if name == "persistence":
        return models.persistence
    if name == "ridge":
        m: Any = models.ridge_fit(train, feats)
        return lambda d: models.predict(m, d, feats)
    if name == "gbt":
        m = models.gbt_fit(train, feats, trees=s.trees, depth=s.depth, seed=s.seed)
        return lambda d: models.predict(m, d, feats)
    if name == "majority":
        return lambda d: models.majority(train, d)
    if name == "logistic":
        c: Any = models.logistic_fit(train, feats)
        return lambda d: c.predict(d, feats)
    if name == "gbt_cls":
        c = models.gbt_class_fit(train, feats, trees=max(1, s.trees // 2), depth=s.depth, seed=s.seed)
        return lambda d: c.predict(d, feats)
    raise ValueError(f"no model {name!r}")


def training(p: Prepared, fold: Fold, s: Settings) -> DataFrame:
    rows = fold.train(p.rows)
    return subsample(rows, s.subsample, s.seed) if s.subsample else rows


def run_folds(p: Prepared, s: Settings, reg: list[str], cls: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Mean metrics over folds by model: of regressions, of classifications."""
    found: dict[str, list[DataFrame]] = {"reg": [], "cls": []}
    for fold in p.folds:
        train = training(p, fold, s).persist()
        test = fold.test(p.rows)
        for kind, names in (("reg", reg), ("cls", cls)):
            for name in names:
                scored = fitted(name, train, p.feats, s)(test)
                m = metrics.regression_metrics(scored) if kind == "reg" else metrics.classification_metrics(scored)
                row = m.first()  # a row, while the training rows are held
                found[kind].append(p.rows.sparkSession.createDataFrame([(name, fold.number, *row)], f"model string, fold int, {m.schema.simpleString()[7:-1].replace(':', ' ')}"))
        train.unpersist()
    mean = lambda k: metrics.mean_of_folds(reduce(DataFrame.unionByName, found[k]), ["model"]) if found[k] else None
    return mean("reg"), mean("cls")


def staged_attribution(pool: DataFrame, s: Settings = Settings(), phases: str = "01234", trades: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """What each stage of features adds: tables "reg" and "cls" by phase and model, over the most active tier."""
    edges = time_edges(pool)
    top = tiers.activity_tiers(pool, s.n_tiers, min_mid_moves=s.min_mid_moves, edges=edges).filter(F.col("act_tier") == s.n_tiers - 1).persist()
    top.count()  # once it is held, its size is known: the books needn't move to join it
    base = pool.join(top, "market_id")
    out: dict[str, list[DataFrame]] = {"reg": [], "cls": []}
    for phase in phases:
        price, kind = PHASES[phase]
        df, feats = build_features(base, kind, s, trades)
        df = add_sign_label(add_forward_target(df, horizon_s=s.horizon_s, price_col=price, max_stale_s=s.max_stale_s, edges=edges), s.alpha)
        p = prepare(df, feats, s, s.horizon_s, edges)
        reg = ["persistence", *s.models] if "reg" in s.tasks else []
        cls = ["majority", "logistic", *(["gbt_cls"] if "gbt" in s.models else [])] if "cls" in s.tasks else []
        for k, t in zip(("reg", "cls"), run_folds(p, s, reg, cls)):
            if t is not None:
                out[k].append(t.select(F.lit(f"phase{phase}").alias("phase"), "*"))
        p.rows.unpersist()
    top.unpersist()
    return {k: reduce(DataFrame.unionByName, v).orderBy("phase", "model") if v else None for k, v in out.items()}


def with_all_features(pool: DataFrame, s: Settings, trades: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The most active tier with the base, the extended and, with a tape, the trade features. Markets are chosen first:
    features are made of a market's own rows, so the result is the same and less is computed."""
    base = tiers.top_tier(pool, s.n_tiers, min_mid_moves=s.min_mid_moves)
    df, feats = build_features(base, "grid+scalar" if s.base_features_only else "extended", s)
    if trades is not None and not trades.isEmpty():
        df, more = add_trade_features(df, trades)
        feats = feats + more
    return df, feats


def model_comparison(pool: DataFrame, s: Settings = COMPARISON, trades: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """Models on an event horizon: "reg", "cls", and "importance" by permuting feature groups of the last fold."""
    df, feats = with_all_features(pool, s, trades)
    df = add_sign_label(add_forward_target(df, horizon_events=s.horizon_events), s.alpha).persist()
    wall = quantiles(df, "fwd_dt_s", [0.5])
    p = prepare(df, feats, s, max(wall[0] if wall else 1.0, 1.0))
    df.unpersist()
    reg, cls = run_folds(p, s, ["ridge", "gbt"], ["logistic", "gbt_cls"])
    last = p.folds[-1]
    predict = fitted("gbt", training(p, last, s), feats, s)
    importance = attribution.permutation_importance(last.test(p.rows).persist(), feats, predict, seed=s.seed)
    return {"reg": reg, "cls": cls, "importance": importance}


def target_study(pool: DataFrame, s: Settings = TARGETS, horizons: tuple[float, ...] = (2.0, 5.0, 10.0, 30.0), trades: DataFrame | None = None) -> DataFrame:
    """horizon_s, target ("point" or "smooth"), wall_s, n and the boosted model's metrics. A cell that can't be worked
    out is left out with a warning. Directional hits aren't given for classes, as the labels there carry no moves."""
    df, feats = with_all_features(pool, s, trades)
    cells = []
    for h, mode in product(horizons, ("point", "smooth")):
        try:
            cells.append(target_cell(df, feats, mode, h, s))
        except ValueError as e:
            log.warning("horizon %s, %s: %s", h, mode, e)
    if not cells:
        raise ValueError("no cell could be worked out")
    return pool.sparkSession.createDataFrame(cells, "horizon_s double, target string, wall_s double, n bigint, corr double, hit_rate double, accuracy double, macro_f1 double")


def target_cell(df: DataFrame, feats: list[str], mode: str, h: float, s: Settings) -> tuple:
    df = add_forward_target(df, horizon_s=h, max_stale_s=s.max_stale_s) if mode == "point" else add_forward_target(df, avg_window_s=h)
    df = add_sign_label(df, s.alpha)
    wall = quantiles(df, "fwd_dt_s", [0.5])
    p = prepare(df, feats, s, max(h, 1.0))
    found = []
    for fold in p.folds:
        train, test = training(p, fold, s), fold.test(p.rows)
        r = metrics.regression_metrics(fitted("gbt", train, feats, s)(test)).first()
        if s.balance:
            train, test = balance(train, s.seed), balance(test, s.seed)
        c = metrics.classification_metrics(fitted("gbt_cls", train, feats, s)(test)).first()
        found.append((r["corr"], r["hit_rate"], c["accuracy"], c["macro_f1"]))
    n = p.rows.count()
    p.rows.unpersist()
    known = [[x for x in col if x == x] for col in zip(*found)]
    return (float(h), mode, float(wall[0]) if wall else None, n, *[sum(x) / len(x) if x else None for x in known])


def diagnose(pool: DataFrame, s: Settings = DIAGNOSIS, phase: str = "3", model: str = "ridge") -> dict[str, DataFrame]:
    """A model's last fold: "metrics" and the aggregates of the diagnostic plots."""
    price, kind = PHASES[phase]
    df, feats = build_features(tiers.top_tier(pool, s.n_tiers, min_mid_moves=s.min_mid_moves), kind, s)
    df = add_sign_label(add_forward_target(df, horizon_s=s.horizon_s, price_col=price, max_stale_s=s.max_stale_s), s.alpha)
    p = prepare(df, feats, s, s.horizon_s)
    fold = p.folds[-1]
    scored = fitted(model, training(p, fold, s), feats, s)(fold.test(p.rows)).select("market_id", "timestamp_ns", "y_fwd", "pred").persist()
    return {
        "metrics": metrics.regression_metrics(scored),
        "residuals": diagnostics.residual_histogram(scored),
        "hexbin": diagnostics.pred_vs_actual(scored),
        "error_by_move": diagnostics.error_by_move(scored),
        "calibration": diagnostics.calibration(scored),
    }
