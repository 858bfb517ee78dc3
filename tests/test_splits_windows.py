import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweir.operators.splits import fit_scaler, fold_bounds, walk_forward, walk_forward_splits
from tickweir.operators.tiers import add_activity_tier, add_liquidity_tier, tier
from tickweir.operators.windows import balance, flatten, make_windows, snapshots, subsample
from tickweir.schema import NS


def rows(spark, n=40, start=1_700_000_000 * NS, gap=None, frozen=None):
    out, t = [], start
    for i in range(n):
        t += NS if i != gap else 3600 * NS
        out.append(("a", t, 1.0 + (0.01 * (i % 7) if frozen is None or i < frozen else 0.0), float(i), 0.1 * i))
    return spark.createDataFrame(out, "market_id string, timestamp_ns bigint, mid double, f0 double, y_fwd double")


def test_epoch_scale_folds_hold_the_last_row(spark):
    df = rows(spark, 101)
    b = fold_bounds(df, n_folds=3, horizon_s=5.0).orderBy("fold").collect()
    last = df.agg(F.max("timestamp_ns")).first()[0]
    assert b[-1]["test_hi"] == last + 1 and all(x["test_hi"] == y["test_lo"] for x, y in zip(b, b[1:]))
    folds = walk_forward_splits(df, n_folds=3, horizon_s=5.0)
    assert [f.number for f in folds] == [2, 3]
    assert folds[-1].test(df).agg(F.max("timestamp_ns")).first()[0] == last
    for f in folds:
        assert f.train(df).agg(F.max("timestamp_ns")).first()[0] < f.test_lo - 5 * NS
    roles = walk_forward(df, n_folds=3, horizon_s=5.0)
    assert roles.filter("role = 'test'").count() == 101 and roles.filter("fold = 1 and role = 'train'").count() == 0


def test_one_fold_or_no_rows_raises(spark):
    with pytest.raises(ValueError):
        walk_forward_splits(rows(spark), n_folds=1, horizon_s=1.0)
    with pytest.raises(ValueError):
        walk_forward_splits(rows(spark).filter("f0 < 0"), n_folds=3, horizon_s=1.0)


def test_scaler_is_of_the_population_and_guards_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0, float("nan")), (3.0, 5.0, 1.0), (None, 5.0, None)], "a double, b double, c double")
    s = fit_scaler(df, ["a", "b", "c"])
    assert (s.mean, s.std) == ([2.0, 5.0, 1.0], [1.0, 1.0, 1.0])


def test_windows_are_causal_and_fill_after_scaling(spark):
    df = rows(spark, 6).withColumn("f0", F.when(F.col("f0") != 3, F.col("f0"))).unionByName(spark.createDataFrame([("b", 1, 1.0, 9.0, 0.0)], rows(spark, 1).schema))
    s = fit_scaler(df.filter("f0 < 3"), ["f0"])
    w = make_windows(df, ["f0", "mid"], seq_len=3, scaler=fit_scaler(df.filter("f0 < 3"), ["f0", "mid"])).orderBy("timestamp_ns").collect()
    assert len(w) == 4 and {r["market_id"] for r in w} == {"a"} and [len(r["x"]) for r in w] == [3] * 4
    f = [(x - s.mean[0]) / s.std[0] for x in range(6)]
    assert [v[0] for v in w[0]["x"]] == pytest.approx(f[:3]) and [v[0] for v in w[1]["x"]] == pytest.approx([f[1], f[2], 0.0])
    flat = flatten(make_windows(df, ["f0", "mid"], seq_len=3)).first()
    assert len(flat["x"]) == 6
    snap = snapshots(df, ["f0"], seq_len=3, scaler=s).orderBy("timestamp_ns").collect()
    assert [r["f0"] for r in snap] == pytest.approx([f[2], 0.0, f[4], f[5]])


def test_stale_windows_go(spark):
    df = rows(spark, 40, gap=20)
    whole = make_windows(df, ["f0"], seq_len=8).count()
    assert whole == 33 and make_windows(df, ["f0"], seq_len=8, max_window_span_s=60.0).count() == 33 - 7
    moving = rows(spark, 40, frozen=20)
    assert make_windows(moving, ["f0"], seq_len=8, min_window_mid_moves=1).count() == 20  # the last change is in row 20
    with pytest.raises(KeyError):
        make_windows(moving.drop("mid"), ["f0"], seq_len=8, min_window_mid_moves=1)


def test_samples_are_exact_and_repeatable(spark):
    df = rows(spark, 200).withColumn("y_cls", F.when(F.col("f0") < 20, 1).when(F.col("f0") < 50, -1).otherwise(0))
    a = {r["f0"] for r in subsample(df, 30, 1).collect()}
    assert len(a) == 30 and a == {r["f0"] for r in subsample(df.repartition(7), 30, 1).collect()} != {r["f0"] for r in subsample(df, 30, 2).collect()}
    assert {r["y_cls"]: r["n"] for r in balance(df).groupBy("y_cls").agg(F.count("*").alias("n")).collect()} == {1: 20, -1: 30, 0: 30}


def test_tiers_use_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 2.0, 5.0, 6.0)], "v double").withColumn("t", tier("v", 3))
    ranks = np.array([1, 3, 3, 3, 5, 6])
    assert [r["t"] for r in df.orderBy("v").collect()] == list(np.minimum((ranks - 1) / 6 * 3 // 1, 2).astype(int))


def test_quiet_markets_leave_the_activity_tiers(spark):
    busy, quiet = rows(spark, 40), rows(spark, 40, frozen=0).withColumn("market_id", F.lit("q"))
    df = busy.unionByName(quiet)
    assert {r[0] for r in add_activity_tier(df).select("market_id").distinct().collect()} == {"a"}
    with pytest.raises(ValueError):
        add_activity_tier(quiet)
    assert add_liquidity_tier(df).count() == 80
