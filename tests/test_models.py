import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweir.functions import frames
from tickweir.operators import attribution, diagnostics, metrics, models
from tickweir.plans import studies
from tickweir.sources import synthetic


def table(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 + rng.normal(size=n)
    c = np.where(y > 1, 1, np.where(y < -1, -1, 0))
    rows = [("a", i, *map(float, x[i]), float(y[i]), int(c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "market_id string, timestamp_ns bigint, a double, b double, c double, y_fwd double, y_cls int"), x, y, c


def test_ridge_solves_the_normal_equations(spark):
    df, x, y, _ = table(spark)
    for alpha in (1.0, 50.0):
        m = models.ridge_fit(df, ["a", "b", "c"], alpha=alpha)
        xc = x - x.mean(0)
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
        assert np.allclose(m.coefficients.toArray(), want, atol=1e-9)
        assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_logistic_is_at_the_optimum(spark):
    df, x, _, c = table(spark, 400)
    m = models.logistic_fit(df, ["a", "b", "c"])
    w, b = m.model.coefficientMatrix.toArray(), m.model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g = (p - (c[:, None] == np.array([-1, 0, 1]))).T @ x + w
    assert np.abs(g).max() < 1e-3


def test_probabilities_follow_the_classes(spark):
    df, *_ = table(spark)
    two = df.filter("y_cls <> 0")
    for fit in (models.logistic_fit, lambda d, f: models.gbt_class_fit(d, f, trees=2), lambda d, f: models.forest_class_fit(d, f, trees=5)):
        p = fit(two, ["a", "b", "c"]).predict(df, ["a", "b", "c"]).select("probs").first()[0]
        assert len(p) == 3 and p[1] == 0.0 and sum(p) == pytest.approx(1.0)
    one = models.logistic_fit(df.filter("y_cls = -1"), ["a"]).predict(df, ["a"]).select("probs").first()[0]
    assert one == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        models.logistic_fit(df.filter("a > 99"), ["a"])


def test_majority_takes_the_least_of_ties(spark):
    train = spark.createDataFrame([(1,), (1,), (-1,), (-1,), (0,)], "y_cls int")
    assert models.majority(train, train).first()["probs"] == [1.0, 0.0, 0.0]


def one(df):
    return df.first().asDict()


def test_metrics_at_the_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "y_fwd double, pred double")
    flat = one(metrics.regression_metrics(make([(0.0, 1.0), (0.0, 2.0)])))
    assert all(flat[k] != flat[k] for k in ("r2", "corr", "hit_rate", "weighted_hit")) and flat["n"] == 2
    const = one(metrics.regression_metrics(make([(1.0, 3.0), (-2.0, 3.0)])))
    assert const["corr"] == 0.0 and const["hit_rate"] == 0.5 and const["weighted_hit"] == pytest.approx(1 / 3)
    y = np.random.default_rng(0).normal(size=(2, 50))
    m = one(metrics.regression_metrics(make([tuple(map(float, r)) for r in y.T])))
    assert m["corr"] == pytest.approx(np.corrcoef(y)[0, 1]) and m["r2"] == pytest.approx(1 - ((y[0] - y[1]) ** 2).sum() / ((y[0] - y[0].mean()) ** 2).sum())
    probs = spark.createDataFrame([(1, [0.4, 0.2, 0.4], 2.0), (-1, [0.5, 0.3, 0.2], -1.0), (0, [0.1, 0.8, 0.1], 0.0)], "y_cls int, probs array<double>, y_fwd double")
    c = one(metrics.classification_metrics(probs))
    assert c["accuracy"] == pytest.approx(2 / 3) and c["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3) and c["hit_rate"] == 0.5 and c["weighted_hit"] == pytest.approx(1 / 3)


def test_mean_of_folds_leaves_nan_out_and_gaps_follow_phases(spark):
    df = spark.createDataFrame([("m", 1.0, 2), ("m", float("nan"), 3)], "model string, corr double, n int")
    assert one(metrics.mean_of_folds(df, ["model"])) == {"model": "m", "corr": 1.0, "n": 5}
    t = spark.createDataFrame([("phase0", "m", 0.1), ("phase1", "m", 0.3)], "phase string, model string, corr double")
    assert [r["gain"] for r in metrics.phase_gaps(t).orderBy("phase").collect()] == [None, pytest.approx(0.2)]
    assert "phase1" in metrics.format_table(t, "T")


def test_groups_are_complete_and_permutation_breaks_what_matters(spark):
    df, *_ = table(spark)
    df = df.withColumnsRenamed({"a": "ofi", "b": "imbalance_l1", "c": "spread_ticks"})
    feats = ["ofi", "imbalance_l1", "spread_ticks"]
    moved = attribution.shuffled(df, ["ofi"], 3)
    assert moved.count() == df.count() and sorted(r[0] for r in moved.select("ofi").collect()) == sorted(r[0] for r in df.select("ofi").collect())
    m = models.ridge_fit(df, feats)
    got = {r["group"]: r["drop"] for r in attribution.permutation_importance(df, feats, lambda d: models.predict(m, d, feats)).collect()}
    assert got["imbalance"] > got["ofi"] > 0.05 > abs(got["spread/micro_gap"])
    assert attribution.importance_share([1.0, 3.0, 0.0], feats) == {"ofi": 25.0, "imbalance": 75.0, "spread/micro_gap": 0.0}


def test_error_bins_of_few_rows(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(7)], "market_id string, timestamp_ns bigint, y_fwd double, pred double")
    got = {r["bin"]: r["move"] for r in diagnostics.error_by_move(df, bins=3).collect()}
    edges = np.linspace(0, 7, 4).astype(int)
    assert got == {i: np.arange(7)[edges[i] : edges[i + 1]].mean() for i in range(3)}
    assert diagnostics.residual_histogram(df.withColumn("pred", F.col("y_fwd"))).collect()[0]["n"] == 7
    assert sum(r["n"] for r in diagnostics.calibration(df).collect()) == 7


@pytest.fixture(scope="module")
def planted(spark):
    return synthetic.generate_pool(spark, n_markets=4, minutes=25.0, seed=4, kappa=1.0).persist()


SMALL = dict(seq_len=8, n_folds=3, n_tiers=1, min_mid_moves=5, trees=5, depth=3, grid_k=5)


def test_the_planted_signal_is_found(spark, planted):
    s = studies.Settings(horizon_events=20, base_features_only=True, **SMALL)
    out = studies.model_comparison(planted, s)
    corr = {r["model"]: r["corr"] for r in out["reg"].collect()}
    assert corr["ridge"] > 0.15 and corr["gbt"] > 0.15
    assert {r["model"] for r in out["cls"].collect()} == {"logistic", "gbt_cls"}
    assert out["importance"].first()["drop"] > 0


def test_staged_attribution_and_feature_sets(spark, planted):
    s = studies.Settings(horizon_s=5.0, models=("ridge",), tasks=("reg",), **SMALL)
    t = studies.staged_attribution(planted, s, phases="02")["reg"]
    assert {(r["phase"], r["model"]) for r in t.collect()} == {(p, m) for p in ("phase0", "phase2") for m in ("persistence", "ridge")}
    count = lambda kind, **kw: len(studies.build_features(planted, kind, studies.Settings(), **kw)[1])
    assert [count(k) for k in ("levels", "grid", "grid+scalar", "extended")] == [20, 40, 46, 96]
    _, trades = synthetic.generate_with_trades(spark, n_markets=4, minutes=25.0, seed=4, kappa=1.0)
    assert count("extended+trades", trades=trades) == 106 and count("grid", scalars_in_grid=True) == 46 and count("combined") == 96 + 20 + 15
    with pytest.raises(ValueError):
        studies.build_features(planted, "extended+trades", s)


def test_staged_attribution_in_blocks_of_time(spark, planted, monkeypatch):
    s = studies.Settings(horizon_s=5.0, models=("ridge",), tasks=("reg",), **(SMALL | {"n_tiers": 4}))
    whole = studies.staged_attribution(planted, s, phases="02")["reg"].collect()
    placed = []
    run = studies.run_folds

    def watched(p, *args):
        placed.append([r["count"] for r in p.rows.groupBy(F.spark_partition_id()).count().collect()])
        return run(p, *args)

    monkeypatch.setattr(studies, "run_folds", watched)
    monkeypatch.setattr(frames, "BLOCK", planted.count() // 40, raising=False)
    parted = studies.staged_attribution(planted, s, phases="02")["reg"].collect()
    assert len(placed) == 2 and all(max(n) < sum(n) / 2 for n in placed)  # the tier is one market
    assert len(whole) == 4
    for a, b in zip(whole, parted):
        assert a[:2] == b[:2] and a["n"] == b["n"] and np.allclose(a[2:], b[2:], atol=1e-9, equal_nan=True)


def test_target_study_and_diagnosis(spark, planted):
    s = studies.Settings(base_features_only=True, balance=True, **SMALL)
    t = studies.target_study(planted, s, horizons=(5.0, 10_000.0)).collect()
    assert {(r["horizon_s"], r["target"]) for r in t} >= {(5.0, "point"), (5.0, "smooth")}
    d = studies.diagnose(planted, studies.Settings(horizon_s=5.0, **SMALL), phase="2")
    n = d["metrics"].first()["n"]
    assert sum(r["n"] for r in d["calibration"].collect()) == n == sum(r["n"] for r in d["residuals"].collect())


def test_extended_features_are_finite_and_bounded(spark, planted):
    df, feats = studies.build_features(planted, "extended", studies.Settings())
    lo = df.agg(*[F.min(c).alias(c) for c in feats]).first()
    hi = df.agg(*[F.max(c).alias(c) for c in feats]).first()
    bad = df.agg(*[F.count_if(F.isnan(c) | F.col(c).isNull()).alias(c) for c in feats if c != "ofi"]).first()
    assert not any(bad)
    for c in feats:
        if c.startswith(("obi_", "imbalance")):
            assert -1 <= lo[c] and hi[c] <= 1
        if c.startswith(("add_rate", "cancel_rate", "rv_", "mid_moves", "spread_std")):
            assert lo[c] >= 0
        if c.startswith("updates"):
            assert lo[c] >= 1
