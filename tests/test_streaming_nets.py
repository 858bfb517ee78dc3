import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweir.operators import nets
from tickweir.operators.base import add_ofi
from tickweir.functions.frames import with_ewma
from tickweir.sources import synthetic
from tickweir.streaming.flow import stream_bars, stream_flow


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A book in three files, by time."""
    root = tmp_path_factory.mktemp("stream")
    book = synthetic.generate_pool(spark, n_markets=2, minutes=3.0, seed=3).persist()
    for i in range(3):
        lo, hi = i * 60 * 10**9, (i + 1) * 60 * 10**9 + (i == 2)
        book.filter((F.col("timestamp_ns") >= lo) & (F.col("timestamp_ns") < hi)).coalesce(1).write.mode("append").parquet(str(root / "in"))
    return book, str(root)


def run(spark, parts, build, name):
    book, root = parts
    stream = spark.readStream.schema(book.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{root}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_flow_of_a_stream_is_that_of_the_batch(spark, parts):
    got = {(r[0], r[1]): r[2:] for r in run(spark, parts, stream_flow, "flow").collect()}
    want = with_ewma(add_ofi(parts[0]), {"e": "ofi"}, 5.0).select("market_id", "timestamp_ns", "ofi", F.coalesce("e", F.lit(0.0)).alias("e")).collect()
    assert len(got) == len(want)
    for r in want:
        x, y = got[r["market_id"], r["timestamp_ns"]]
        assert (x is None or x != x) if r["ofi"] is None else x == pytest.approx(r["ofi"])
        assert y == pytest.approx(r["e"], abs=1e-9)


def test_bars_close_behind_the_watermark(spark, parts):
    bars = run(spark, parts, lambda b: stream_bars(b, "20 seconds", "5 seconds"), "bars")
    assert bars.groupBy("market_id", "start").count().filter("count > 1").isEmpty() and bars.count() >= 8
    r = bars.orderBy("market_id", "start").first()
    assert r["low"] <= r["mean"] <= r["high"] and r["updates"] > 0


def test_unknown_networks_and_missing_torch():
    with pytest.raises(ValueError):
        nets.build_model("nothing", n_features=4, seq_len=8)
    with pytest.raises(ValueError):
        nets.build_model("perlevel", n_features=4, seq_len=8)
    if importlib.util.find_spec("torch") is None:
        with pytest.raises(ImportError):
            nets.build_model("TCN", n_features=4, seq_len=8)


@pytest.mark.skipif(importlib.util.find_spec("torch") is None, reason="torch isn't installed")
@pytest.mark.parametrize("name", sorted(nets.NAMES))
def test_networks_have_their_shapes(name):
    import torch

    net = nets.build_model(name, n_features=15, seq_len=8, out_dim=3)
    assert net(torch.zeros(2, 8, 15)).shape == (2, 3)


def test_training_helpers():
    z, m, s = nets.target_scale(np.array([1.0, 1.0]))
    assert (list(z), m, s) == ([0.0, 0.0], 1.0, 1.0)
    assert nets.target_scale(np.array([0.0, 0, 0, 10]), 1.0)[0].max() == 1.0
    assert list(nets.balanced_weights(np.array([0, 0, 2, 2]), 3)) == pytest.approx([2 / 3, 4 / 3, 2 / 3])
    fit_at, val_at = nets.time_split(np.array([5, 1, 4, 2, 3]), 0.4)
    assert list(fit_at) == [1, 3, 4] and list(val_at) == [2, 0]
    p = nets.attention_profile(np.array([0.1, 0.7, 0.2]), ["ofi", "bid_grid_3", "ask_grid_0"])
    assert list(p["feature"]) == ["bid_grid_3", "ask_grid_0", "ofi"] and p["tick"][0] == 3
