"""Kernels against brute force, with ties, gaps, nulls and exact window ends."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweir.functions import frames
from tickweir.functions.frames import block_of, first_at_or_after, numbered, time_edges, value_before, window_sums, with_ewma
from tickweir.functions.ranks import quantiles, with_rank
from tickweir.operators.base import add_grid_features, add_microstructure, add_ofi, add_scalar_features, add_stationary_features, grid_clipped
from tickweir.operators.extended import add_activity_spread_features, add_flow_features, add_impact_features, add_perlevel_features, add_smoothed_features, add_trade_features
from tickweir.operators.labels import add_forward_target, add_sign_label
from tickweir.operators.tiers import market_activity
from tickweir.operators.windows import snapshots
from tickweir.schema import BOOK, NS

S = NS


def series(spark, rows, cols="market_id string, timestamp_ns bigint, seq bigint, v double"):
    return spark.createDataFrame(rows, cols)


def tied(n=400, seed=0, markets=3):
    rng = np.random.default_rng(seed)
    out = []
    for m in range(markets):
        t = np.sort(rng.integers(0, 60, n)) * S // 2  # many ties, ends of windows hit exactly
        out += [(f"m{m}", int(x), i, float(rng.integers(-5, 6)) if rng.random() > 0.1 else None) for i, x in enumerate(t)]
    return out


@pytest.mark.parametrize("forward", [False, True])
def test_window_sums(spark, forward):
    rows = tied()
    df = window_sums(series(spark, rows), {"v": F.col("v")}, (1.0, 5.0), forward)
    got = {(r["market_id"], r["seq"]): r for r in df.collect()}
    assert len(got) == len(rows)
    for m, t, i, _ in rows[::7]:
        for k, w in enumerate((S, 5 * S)):
            inside = [v for mm, u, _, v in rows if mm == m and (t < u <= t + w if forward else t - w < u <= t)]
            r = got[m, i]
            assert r[f"count_{k}"] == len(inside)
            assert r[f"sum_v_{k}"] == sum(v or 0.0 for v in inside)


def test_zero_sums_are_exactly_zero(spark):
    rows = [("a", i * S, i, 0.1 if i < 50 else 0.0) for i in range(100)]
    last = window_sums(series(spark, rows), {"v": F.col("v")}, (5.0,)).orderBy(F.desc("seq")).first()
    assert last["sum_v_0"] == 0.0 and last["count_0"] == 5


def test_value_before_takes_the_last_of_ties_or_itself(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 5 * S, 2, 3.0), ("a", 9 * S, 3, 4.0)]
    df = series(spark, rows).withColumn("old", value_before("v", 5.0)).orderBy("seq")
    assert [r["old"] for r in df.collect()][2:] == [2.0, 2.0]
    assert df.first()["old"] == 1.0


def test_first_at_or_after_takes_the_first_of_ties(spark):
    rows = tied(seed=3)
    rows = [(m, t, i, v if v is not None else 0.0) for m, t, i, v in rows]
    got = {(r["market_id"], r["seq"]): r["hit"] for r in first_at_or_after(series(spark, rows), 5.0, "v").collect()}
    for m, t, i, _ in rows[::5]:
        later = [(u, j, v) for mm, u, j, v in rows if mm == m and u >= t + 5 * S]
        want = min(later) if later else None
        assert (got[m, i] is None) == (want is None)
        if want:
            assert (got[m, i]["t"], got[m, i]["px"]) == (want[0], want[2])


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_no_task_holds_a_market(spark, monkeypatch):
    """Forward times and numbers of one market's rows are found in blocks of time, however many rows it has."""
    monkeypatch.setattr(frames, "BLOCK", 100, raising=False)
    df = series(spark, [("a", i * S, i, float(i)) for i in range(4000)])
    target = add_forward_target(df, price_col="v", horizon_s=500.0)
    assert target.count() == 3500 and target.filter("y_fwd <> 500").count() == 0 and most_in_a_task(target) < 1000
    last = snapshots(df, ["v"], seq_len=250)
    assert last.count() == 3751 and last.agg(F.min("seq")).first()[0] == 249 and most_in_a_task(last) < 1000


def test_block_of(spark):
    for n in (1, 2, 3, 4, 8, 9, 15, 16, 17, 100):
        edges = [10 * i for i in range(1, n + 1)]
        df = spark.range(0, 10 * n + 25).select("id", block_of("id", edges).alias("k"))
        assert {r["id"]: r["k"] for r in df.collect()} == {i: min(n, i // 10) for i in range(10 * n + 25)}
    late = spark.createDataFrame([(None,)], "t bigint").select(block_of("t", [1, 2, 3]))
    assert late.first()[0] == 0 and time_edges(series(spark, [])) == []


def gappy():
    """Ties, a market that begins late, one that ends early, one with a long gap and one without a name."""
    rows = [(m, t, i, float(i % 7)) for m, t, i, _ in tied(120, seed=5)]
    rows += [("late", (28 + i // 2) * S, i, float(i)) for i in range(9)] + [("early", i * S // 4, i, float(i)) for i in range(9)]
    return rows + [("gap", t * S, i, float(i)) for i, t in enumerate((0, 1, 29, 29, 40))] + [(None, i * S, i, float(i)) for i in range(30)]


@pytest.mark.parametrize("edges", [[7 * S], [S, 2 * S, 3 * S, 8 * S + 1, 20 * S, 28 * S, 35 * S], [i * S // 2 for i in range(1, 60)]])
def test_blocks_change_nothing(spark, edges):
    df = series(spark, gappy())
    key = lambda rows: sorted(rows, key=str)
    for h in (0.0, 0.5, 5.0, 25.0):
        assert key(first_at_or_after(df, h, "v", edges).collect()) == key(first_at_or_after(df, h, "v", []).collect())
    assert key(numbered(df, "n", edges).collect()) == key(numbered(df, "n", []).collect())
    books = df.withColumn("mid", F.when(F.col("seq") % 11 != 3, F.col("v")))
    assert key(market_activity(books, edges=edges).collect()) == key(market_activity(books, edges=[]).collect())
    loose = df.drop("seq")  # the order of ties is open, how many there are isn't
    count = lambda e: key(numbered(loose, "n", e).filter("n >= 8").groupBy("market_id").count().collect())
    assert count(edges) == count([]) and first_at_or_after(loose, 5.0, "v", edges).count() == df.count()


def ewma(rows, h):
    y, before, out = None, None, {}
    for t, i, x in rows:
        if x is None:
            continue
        a = 1.0 if y is None else 1 - 2 ** (-(t - before) / S / h)
        y = x if y is None else a * x + (1 - a) * y
        before, out[i] = t, y
    return out


@pytest.mark.parametrize("h", [0.5, 5.0, 30.0])
def test_ewma_with_ties_nulls_and_gaps(spark, h):
    rng = np.random.default_rng(1)
    t, rows = 0, []
    for i in range(600):
        t += int(rng.choice([0, 1, 3, 400, 8000], p=[0.2, 0.4, 0.3, 0.09, 0.01]) * S)
        rows.append(("a", t, i, None if i == 0 or rng.random() < 0.05 else float(rng.normal())))
    got = {r["seq"]: r["y"] for r in with_ewma(series(spark, rows), {"y": "v"}, h).collect()}
    want = ewma([r[1:] for r in rows], h)
    assert all((got[i] is None) == (i not in want) for i in got)
    assert max(abs(got[i] - y) for i, y in want.items()) < 1e-9


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.integers(0, 40, 1000)] + [None] * 3
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = [r["i"] for r in with_rank(df, "v", ("i",)).orderBy("rank").collect()]
    assert got == sorted(range(len(v)), key=lambda i: (v[i] is not None, v[i] or 0.0, i))
    known = [x for x in v if x is not None]
    assert quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1]) == pytest.approx(list(np.quantile(known, [0, 0.1, 0.5, 0.99, 1])))
    assert quantiles(df.filter("i < 0"), "v", [0.5]) == []


def books(spark, rows):
    """Rows of (market, t, bid ladder, ask ladder); a ladder is a list of (price, size), or None."""
    out = []
    for m, t, bids, asks in rows:
        (bp, bs), (ap, az) = ((x[0] if x else (None, None)) for x in (bids, asks))
        known = bp is not None and ap is not None
        lists = [None if x is None else [e[i] for e in x] for x in (bids, asks) for i in (0, 1)]
        out.append((m, t, bp, bs, ap, az, (bp + ap) / 2 if known else None, ap - bp if known else None, *lists))
    return spark.createDataFrame(out, BOOK)


def test_book_states_at_the_edges(spark):
    df = books(
        spark,
        [
            ("a", 1, [(1.0, 2.0), (0.99, None), (0.97, 4.0)], [(1.02, 6.0)]),  # a null size, a gap, one level
            ("b", 1, [(1.0, 0.0)], [(1.02, 0.0)]),  # no size
            ("c", 1, None, None),
            ("d", 1, [], [(1.02, 1.0)]),
        ],
    )
    r = {x["market_id"]: x for x in add_microstructure(df).collect()}
    assert r["a"]["bid_size_l3"] == 6.0 and r["a"]["imbalance_l3"] == 0.0 and r["a"]["microprice"] == pytest.approx((1.0 * 6 + 1.02 * 2) / 8)
    assert r["a"]["microprice_l3"] == pytest.approx((1.0 * 2 + 0.97 * 4 + 1.02 * 6) / 12)
    assert r["b"]["microprice"] is None and r["b"]["imbalance_l5"] is None
    assert r["c"]["microprice"] is None and r["c"]["bid_size_l3"] is None
    assert r["d"]["bid_size_l10"] == 0.0
    grid, cols = add_grid_features(df, k=3)
    g = {x["market_id"]: x for x in grid.collect()}
    assert len(cols) == 6 and [g["a"][f"bid_grid_{o}"] for o in range(3)] == [0.25, 0.0, 0.0] and g["a"]["ask_grid_0"] == 0.75
    assert all(g["b"][c] == 0.0 for c in cols) and all(g["c"][c] == 0.0 for c in cols)
    clipped = {x["side"]: x for x in grid_clipped(df, k=3).collect()}
    assert clipped["bid"]["n_levels"] == 3 and clipped["bid"]["clipped"] == pytest.approx(1 / 3)
    st, names = add_stationary_features(df)
    assert len(names) == 29 and {x["market_id"]: x for x in st.collect()}["b"]["bid_relsz_1"] == 0.0


def test_order_flow_branches_and_first_rows(spark):
    up, same, down = [(1.01, 5.0)], [(1.01, 7.0)], [(1.0, 3.0)]
    ask = [[(1.03, 4.0)], [(1.03, 1.0)], [(1.02, 2.0)], [(1.04, 9.0)]]
    df = books(spark, [("a", i, b, a) for i, (b, a) in enumerate(zip([down, up, same, down], ask))])
    assert [(r["delta_bid"], r["delta_ask"]) for r in add_ofi(df).orderBy("timestamp_ns").collect()] == [(None, None), (5.0, 3.0), (2.0, -2.0), (-7.0, 2.0)]
    per, cols = add_perlevel_features(df)
    first = per.orderBy("timestamp_ns").first()
    assert cols[:4] == ["pl_obi_1", "pl_ofi_1", "pl_relsz_1", "pl_obi_2"] and first["pl_ofi_1"] == 0.0


def test_trades_at_the_window_ends_and_markets_without_any(spark):
    flat = ([(1.0, 1.0)], [(1.02, 1.0)])
    book = books(spark, [("a", 10 * S, *flat), ("a", 20 * S, *flat), ("b", 10 * S, *flat)])
    trades = spark.createDataFrame([("a", 5 * S, 1.0, 100.0, 1), ("a", 5 * S + 1, 1.02, 3.0, 1), ("a", 10 * S, 1.0, 1.0, -1)], "market_id string, timestamp_ns bigint, price double, size double, side bigint")
    df, cols = add_trade_features(book, trades)
    got = {(r["market_id"], r["timestamp_ns"] // S): r for r in df.collect()}
    a = got["a", 10]
    assert len(got) == 3 and a["trades_5s"] == 2 and a["tfi_5s"] == 0.5 and a["vol_5s"] == pytest.approx(math.log1p(4)) and a["trades_30s"] == 3
    assert a["vwapgap_5s"] == pytest.approx(((1.02 * 3 + 1.0) / 4 - 1.01) / 0.01)
    assert all(got["b", 10][c] == 0.0 for c in cols) and got["a", 20]["trades_5s"] == 0.0


def test_builders_check_their_inputs_before_any_job(spark):
    df = books(spark, [("a", 1, [(1.0, 1.0)], [(1.02, 1.0)])])
    for add in (add_flow_features, add_activity_spread_features, add_impact_features, add_smoothed_features):
        with pytest.raises(KeyError):
            add(df)
    with pytest.raises(KeyError):
        add_trade_features(df, df)
    with pytest.raises(KeyError):
        add_forward_target(df, horizon_s=1.0)
    for kw in ({}, {"horizon_s": 1.0, "horizon_events": 2}):
        with pytest.raises(ValueError):
            add_forward_target(df, **kw)


def test_fractional_windows_have_names_of_their_own(spark):
    df = add_scalar_features(books(spark, [("a", i * S, [(1.0, 1.0)], [(1.02, 1.0)]) for i in range(3)]))[0]
    assert add_flow_features(df, time_windows_s=(1.0, 1.5), event_windows=(), levels=1)[1] == ["ofi_roll_1s", "ofi_roll_1p5s", "obi_roll_1s", "obi_roll_1p5s"]


def test_labels_at_the_ends(spark):
    px = [1.0, 2.0, None, 4.0, 8.0]
    df = series(spark, [("a", i * S, i, p) for i, p in enumerate(px)]).withColumnRenamed("v", "microprice")
    y = lambda **kw: {r["seq"]: (r["y_fwd"], r["fwd_dt_s"]) for r in add_forward_target(df, **kw).collect()}
    assert y(horizon_s=3.0) == {0: (3.0, 3.0), 1: (6.0, 3.0)}
    assert y(horizon_events=1) == {0: (1.0, 1.0), 3: (4.0, 1.0)}
    assert y(avg_window_s=2.0) == {0: (1.0, 2.0), 1: (2.0, 2.0), 3: (4.0, 2.0)}  # the null price is passed over
    assert set(y(horizon_s=2.5, max_stale_s=0.4)) == set() and set(y(horizon_s=2.5, max_stale_s=0.5)) == {0, 1}
    labels = spark.createDataFrame([(0.1,), (-0.1,), (0.2,), (-0.3,)], "y_fwd double")
    assert [r["y_cls"] for r in add_sign_label(labels, 0.1).collect()] == [0, 0, 1, -1]
