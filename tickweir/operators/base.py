"""Features of a single book state, and order-flow imbalance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.functions.expr import at, dot, list_sum, ratio
from tickweir.functions.frames import rows
from tickweir.schema import LADDERS, LEVELS, QUOTE, TICK, require

Built = tuple[DataFrame, list[str]]  # a frame, and the names of the features in it
DEPTHS = (3, 5, 10)
IMBALANCES = [f"imbalance_l{n}" for n in (1, 3, 5)]
SIDES = tuple((s, f"{s}s_price", f"{s}s_size", f"{s}_price", outward) for s, outward in (("bid", -1), ("ask", 1)))


def level(side: str, k: int) -> tuple[Column, Column]:
    """Price and size of the k-th level, from 0; a missing level has the touch's price and size 0."""
    return F.coalesce(at(f"{side}s_price", k), F.col(f"{side}_price")), F.coalesce(at(f"{side}s_size", k), F.lit(0.0))


def add_microstructure(df: DataFrame) -> DataFrame:
    """microprice, imbalance_l1 and, for each depth N, bid_size_lN, ask_size_lN, imbalance_lN, microprice_lN (the mean of
    both sides' first N prices by their own sizes). Null where the sizes don't add up to more than 0."""
    require(df, (*QUOTE, *LADDERS), "add_microstructure")
    b, a = F.col("bid_size"), F.col("ask_size")
    df = df.withColumns({c: F.col(c).cast("array<double>") for c in LADDERS if df.schema[c].dataType.simpleString() != "array<double>"})
    out = {"microprice": ratio(F.col("bid_price") * a + F.col("ask_price") * b, b + a), "imbalance_l1": ratio(b - a, b + a)}
    df = df.withColumns(out | {f"{s}_size_l{n}": list_sum(f"{s}s_size", n) for n in DEPTHS for s in ("bid", "ask")})
    deep = {}
    for n in DEPTHS:
        b, a = F.col(f"bid_size_l{n}"), F.col(f"ask_size_l{n}")
        deep[f"imbalance_l{n}"] = ratio(b - a, b + a)
        deep[f"microprice_l{n}"] = ratio(dot("bids_price", "bids_size", n) + dot("asks_price", "asks_size", n), b + a)
    return df.withColumns(deep)


def flow(price: Column, size: Column, price0: Column, size0: Column, sign: int) -> Column:
    """One side's part of order-flow imbalance: size gained at the touch or lost with it. sign is 1 for bids, -1 for
    asks; null where a price is unknown."""
    better, worse = (price > price0, price < price0) if sign > 0 else (price < price0, price > price0)
    gain = F.when(better, size).when(price == price0, size - size0).when(worse, -size0)
    return gain if sign > 0 else -gain


def add_ofi(df: DataFrame) -> DataFrame:
    """delta_bid, delta_ask and their sum, ofi; null on a market's first row."""
    require(df, ("market_id", "timestamp_ns", *QUOTE), "add_ofi")
    w = rows(df)
    part = {s: flow(F.col(f"{s}_price"), F.col(f"{s}_size"), F.lag(f"{s}_price").over(w), F.lag(f"{s}_size").over(w), sign) for s, sign in (("bid", 1), ("ask", -1))}
    return df.withColumns({f"delta_{s}": x for s, x in part.items()}).withColumn("ofi", F.col("delta_bid") + F.col("delta_ask"))


def add_paper_features(df: DataFrame, levels: int = LEVELS) -> Built:
    """Raw prices and sizes of the first levels, a side after the other."""
    out = {}
    for side, *_ in SIDES:
        for k in range(levels):
            out[f"{side}_px_{k + 1}"], out[f"{side}_sz_{k + 1}"] = level(side, k)
    return df.withColumns(out), list(out)


def on_grid(touch: str, sign: int, tick: float) -> Callable[[Column], Column]:
    """A level's distance from the touch in whole ticks, outward positive."""
    return lambda e: F.rint(F.lit(sign) * (e["p"] - F.col(touch)) / F.lit(tick))


def grid_cell(side: str, o: int, deep: int = 10) -> Column:
    """The size at a distance of o ticks. The first `deep` levels are picked one by one, in generated code; what an array
    holds beyond them is folded."""
    t, s = f"_o_{side}", f"_s_{side}"
    here = " + ".join(f"CASE WHEN get({t}, {k}) = {o}D THEN get({s}, {k}) ELSE 0D END" for k in range(deep))
    more = f"aggregate(slice(arrays_zip({t}, {s}), {deep + 1}, 1000000000), 0D, (a, e) -> a + CASE WHEN e.{t} = {o}D THEN e.{s} ELSE 0D END)"
    return F.expr(f"coalesce(CASE WHEN size({t}) > {deep} THEN {here} + {more} ELSE {here} END, 0D)")


def add_grid_features(df: DataFrame, *, normalize: bool = True, k: int = 20, tick: float = TICK) -> Built:
    """Resting size at each of k ticks from the touch, by side; with `normalize` as a share of all size in the grid.
    Levels beyond the grid, or with an unknown price or size, are left out."""
    grids = {}
    for side, px, sz, touch, sign in SIDES:
        pairs = F.filter(F.arrays_zip(F.col(px).alias("p"), F.col(sz).alias("s")), lambda e: e["p"].isNotNull() & e["s"].isNotNull())
        grids |= {f"_o_{side}": F.transform(pairs, on_grid(touch, sign, tick)), f"_s_{side}": F.transform(pairs, lambda e: e["s"].cast("double"))}
    df = df.withColumns(grids)
    cells = {f"{side}_grid_{o}": grid_cell(side, o) for side, *_ in SIDES for o in range(k)}
    names = list(cells)
    df = df.withColumns(cells).drop(*grids)
    if normalize:
        df = df.withColumn("_all", F.expr(" + ".join(names)))
        df = df.withColumns({c: F.expr(f"CASE WHEN _all > 0 THEN {c} / _all ELSE 0D END") for c in names}).drop("_all")
    return df, names


def grid_clipped(df: DataFrame, *, k: int = 20, tick: float = TICK) -> DataFrame:
    """Of each side, the levels (known price and size) and the share of them outside a grid of k ticks: side, n_levels,
    clipped. One pass, no shuffle but the final sum."""
    sums = []
    for side, px, sz, touch, sign in SIDES:
        pairs = F.filter(F.arrays_zip(F.col(px).alias("p"), F.col(sz).alias("s")), lambda e: e["p"].isNotNull() & e["s"].isNotNull())
        off = F.transform(pairs, on_grid(touch, sign, tick))
        sums += [F.sum(F.size(pairs)).alias(f"n_{side}"), F.sum(F.size(F.filter(off, lambda o: (o >= 0) & (o < k)))).alias(f"in_{side}")]
    one = df.agg(*sums)
    rows_ = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"n_{s}").alias("n_levels"), F.coalesce(1 - ratio(F.col(f"in_{s}"), F.col(f"n_{s}")), F.lit(0.0)).alias("clipped")) for s in ("bid", "ask")]))
    return one.select(rows_.alias("r")).select("r.*")


def add_scalar_features(df: DataFrame, *, tick: float = TICK) -> Built:
    """Order flow, imbalances, the microprice's gap from mid and the spread, both in ticks."""
    df = add_ofi(add_microstructure(df)).withColumns(gaps(tick))
    return df, ["ofi", *IMBALANCES, *gaps(tick)]


def gaps(tick: float) -> dict[str, Column]:
    return {"micro_gap_ticks": (F.col("microprice") - F.col("mid")) / F.lit(tick), "spread_ticks": F.col("spread") / F.lit(tick)}


def add_stationary_features(df: DataFrame, levels: int = LEVELS, tick: float = TICK) -> Built:
    """Imbalances, microprices and order flow with every level's price from mid, in ticks, and share of its side."""
    df = add_ofi(add_microstructure(df)).withColumns({f"_all_{side}": list_sum(sz) for side, _, sz, *_ in SIDES})
    out = gaps(tick)
    for side, px, sz, *_ in SIDES:
        for k in range(levels):
            out[f"{side}_relpx_{k + 1}"] = F.expr(f"coalesce((get({px}, {k}) - mid) / {tick!r}D, 0D)")
            out[f"{side}_relsz_{k + 1}"] = F.expr(f"coalesce(CASE WHEN _all_{side} > 0 THEN get({sz}, {k}) / _all_{side} END, 0D)")
    first = [*IMBALANCES, *[f"microprice{n}" for n in ("", "_l3", "_l5")]]
    return df.withColumns(out).drop("_all_bid", "_all_ask"), [*first, "ofi", *out]
