import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweir.operators.base import add_scalar_features
from tickweir.operators.tiers import add_activity_tier
from tickweir.schema import BOOK, NS, TRADES
from tickweir.sources import matrix, synthetic
from tickweir.sources.files import LoadConfig, clean, discover_book_parquets, discover_trade_parquets, load_pool, load_trades, read_by_market, write_by_market


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return synthetic.generate(spark, tmp_path_factory.mktemp("books"), n_markets=4, minutes=4.0, seed=1)


def test_generated_files_load(spark, folder):
    pool = load_pool(spark, LoadConfig(roots=[folder], min_rows=50))
    assert pool.schema == BOOK and pool.select("market_id").distinct().count() == 4
    assert pool.filter("ask_price < bid_price").isEmpty()
    some = load_pool(spark, LoadConfig(roots=[folder], min_rows=50, market_ids=["SYN01"]))
    assert {r[0] for r in some.select("market_id").distinct().collect()} == {"SYN01"}
    trades = load_trades(spark, [folder], ["SYN01", "SYN02"])
    assert trades.schema == TRADES and {r[0] for r in trades.select("market_id").distinct().collect()} == {"SYN01", "SYN02"}
    with pytest.raises(ValueError):
        load_pool(spark, LoadConfig(roots=[folder], min_rows=10**6))


def test_absent_and_broken_files(spark, tmp_path, folder):
    with pytest.raises(FileNotFoundError):
        discover_book_parquets(tmp_path)
    assert discover_trade_parquets(tmp_path) == [] and load_trades(spark, [tmp_path]).count() == 0
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    (tmp_path / "bad.trades.parquet").write_bytes(b"no parquet")
    (tmp_path / "_system").mkdir()
    (tmp_path / "_system" / "x.parquet").write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in discover_book_parquets(tmp_path)] == ["bad.parquet"]
    assert load_trades(spark, [tmp_path]).count() == 0
    assert load_pool(spark, LoadConfig(roots=[tmp_path, folder], min_rows=50)).count() > 0


def test_narrower_types_are_widened(spark, tmp_path, folder):
    pool = load_pool(spark, LoadConfig(roots=[folder], min_rows=50, market_ids=["SYN01"]))
    pool.limit(5).withColumns({"bid_price": F.col("bid_price").cast("float"), "market_id": F.lit("thin")}).coalesce(1).write.parquet(f"{tmp_path}/thin.parquet")
    both = load_pool(spark, LoadConfig(roots=[tmp_path, folder], min_rows=1))
    assert both.schema == BOOK and both.filter("market_id = 'thin'").count() == 5


def test_cleaning(spark):
    row = lambda t, mid, size=1.0: ("a", t * NS, 1.0, size, 1.0, 1.0, mid, 0.1 if mid else None, [1.0], [1.0], [1.0], [1.0])
    df = spark.createDataFrame([row(0, 0.5), row(1, None), row(2, 0.5, 0.0), row(3, 0.02), row(4, 0.98), row(5, 0.5), row(9, 0.5), row(10, 0.5), row(99, 0.999)], BOOK)
    cfg = LoadConfig(price_bounds=(0.0, 1.0), corner_eps=0.02, tail_drop_s=1.0)
    assert [r["timestamp_ns"] // NS for r in clean(df, cfg).orderBy("timestamp_ns").collect()] == [0, 5, 9]
    assert clean(df, LoadConfig()).count() == 7 and clean(df, LoadConfig(require_two_sided=False)).count() == 8


def test_partitioned_table(spark, tmp_path, folder):
    pool = load_pool(spark, LoadConfig(roots=[folder], min_rows=50))
    write_by_market(pool, str(tmp_path / "t"))
    back = read_by_market(spark, str(tmp_path / "t"), ["SYN00"])
    assert back.schema.names == BOOK.names and back.count() == pool.filter("market_id = 'SYN00'").count()
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString() and len(back.inputFiles()) < 4 * 4


def test_generator_is_repeatable_and_leans(spark):
    a, t = synthetic.simulate(synthetic.Model(minutes=20, seed=4), 2)
    b, _ = synthetic.simulate(synthetic.Model(minutes=20, seed=4), 2)
    assert a.equals(b) and (a["ask_price"] >= a["bid_price"]).all() and (np.diff(a["timestamp_ns"]) >= 0).all()
    assert set(t["side"]) == {1, -1} and t["timestamp_ns"].is_monotonic_increasing
    lean = np.log(a["bid_size"] / a["ask_size"]).to_numpy()[:-1]
    assert np.corrcoef(lean, np.diff(a["mid"]))[0, 1] > 0.15


def test_tiers_of_generated_markets(spark):
    df = add_activity_tier(synthetic.generate_pool(spark, n_markets=9, minutes=10.0, seed=2), min_mid_moves=5)
    by = df.groupBy("act_tier").agg(F.min("mid_moves_per_min").alias("lo"), F.max("mid_moves_per_min").alias("hi")).orderBy("act_tier").collect()
    assert [r["act_tier"] for r in by] == [0, 1, 2] and all(x["hi"] <= y["lo"] for x, y in zip(by, by[1:]))


def test_matrix(spark, tmp_path):
    rng = np.random.default_rng(0)
    mat = rng.uniform(1, 2, (149, 30))
    for k in range(10):
        mat[4 * k], mat[4 * k + 2] = 100 + 0.01 * k, 99.9 - 0.01 * k
    df = matrix.load_matrix(spark, mat, dt_s=0.5, t_start_ns=7)
    r = df.orderBy("timestamp_ns").collect()
    assert df.schema.names == BOOK.names and len(r) == 30 and len(r[0]["bids_price"]) == 10 and r[3]["timestamp_ns"] == 7 + 3 * NS // 2
    assert r[4]["asks_size"] == pytest.approx(list(mat[1:40:4, 4])) and r[4]["bid_price"] == mat[2, 4]
    with pytest.raises(ValueError):
        matrix.load_matrix(spark, mat[:39])
    for n in ("x", "y"):
        np.savetxt(tmp_path / f"{n}.txt", mat)
    assert matrix.load(spark, tmp_path).select("market_id").distinct().count() == 2
    out = matrix.write_parquets(spark, tmp_path, tmp_path / "out")
    assert load_pool(spark, LoadConfig(roots=[out], min_rows=30)).count() == 60
    assert add_scalar_features(df)[0].filter("imbalance_l10 is null").isEmpty()
    with pytest.raises(FileNotFoundError):
        matrix.load(spark, [])
