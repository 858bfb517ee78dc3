"""Ordered-series kernels: every market's rows by time, one shuffle on market_id, or on market_id and block of time.

Sums over time windows are differences of running sums looked up at the window's ends. Frames that begin at the
partition's start grow by a row at a time, so the cost doesn't depend on how many rows a window holds; a sliding frame
is summed anew for every row.

Blocks part all rows by time, so that no task has to sort a whole market. What a block needs of its neighbours comes as one
row more for each market and block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.functions.expr import or_zero
from tickweir.functions.ranks import bin_of
from tickweir.schema import nanos

ALL = W.unboundedPreceding
BLOCK = 100_000  # rows of a block of time, of all markets, about
TOGETHER = 5  # blocks a task, on average, beyond which a shuffle gets more tasks


def order_of(df: DataFrame) -> list[str]:
    """Time, then the ingestion number where the table has one: ties keep their order."""
    return ["timestamp_ns", "seq"] if "seq" in df.columns else ["timestamp_ns"]


def rows(df: DataFrame) -> WindowSpec:
    return W.partitionBy("market_id").orderBy(*order_of(df))


def time_edges(df: DataFrame, block: int | None = None) -> list[int]:
    """Times that part the rows, of all markets together, into blocks of about `block` rows; none for so few. Rows of one
    time are never parted. How even the blocks are affects memory only, so edges may be those of a larger table."""
    parts = math.ceil(df.count() / (block or BLOCK))
    if parts < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx("timestamp_ns", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []))


def block_of(time: str, edges: list[int]) -> Column:
    """How many edges are at or below a time. Edges are looked up in groups, so that few are compared."""
    x, step = F.col(time), math.isqrt(len(edges)) + 1
    array = lambda cells: f"array({', '.join(cells)})"
    groups = array(array(f"{e}L" for e in edges[i : i + step]) for i in range(0, len(edges), step))
    full = bin_of(x, edges[step - 1 :: step])
    within = F.array_size(F.filter(F.get(F.expr(groups), full), lambda e: e <= x))
    return full * step + F.coalesce(within, F.lit(0))


def in_blocks(df: DataFrame, edges: list[int]) -> DataFrame:
    """Rows with a column _blk, each market's rows of a block in one task. Asked for, as a window by market and block is
    content with rows that lie by market. A shuffle gets more tasks than it has only for very many blocks, as its writers
    sort in memory where it has over 200."""
    n = math.ceil((len(edges) + 1) / TOGETHER)
    more = [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return df.repartition(*more, "market_id", "_blk")


def numbered(df: DataFrame, name: str, edges: list[int] | None = None) -> DataFrame:
    """Adds the row's number, from 1, in its market's order. Each block's first row is one that counts for all the blocks
    before."""
    edges = time_edges(df) if edges is None else edges
    if not edges:
        return df.withColumn(name, F.row_number().over(rows(df)))
    order, df = order_of(df), df.withColumn("_blk", block_of("timestamp_ns", edges))
    sizes = df.groupBy("market_id", "_blk").agg(F.count("*").alias("_n"))
    before = sizes.select("market_id", "_blk", (F.sum("_n").over(W.partitionBy("market_id").orderBy("_blk")) - F.col("_n")).alias("_n"), F.lit(0).alias("_row"))
    series = in_blocks(df.withColumns({"_n": F.lit(1).cast("bigint"), "_row": F.lit(1)}).unionByName(before, allowMissingColumns=True), edges)
    w = W.partitionBy("market_id", "_blk").orderBy("_row", *order).rowsBetween(ALL, 0)
    return series.withColumn(name, F.sum("_n").over(w)).filter("_row = 1").drop("_blk", "_n", "_row")


def times() -> WindowSpec:
    """For range frames; rows of equal time are peers."""
    return W.partitionBy("market_id").orderBy("timestamp_ns")


def previous(df: DataFrame, c: str, default_self: bool = False) -> Column:
    before = F.lag(c).over(rows(df))
    return F.coalesce(before, F.col(c)) if default_self else before


def change(df: DataFrame, c: str) -> Column:
    """The difference to the row before; 0 on a market's first row."""
    return F.coalesce(F.col(c) - F.lag(c).over(rows(df)), F.lit(0.0))


def window_sums(df: DataFrame, values: dict[str, Column], seconds: tuple[float, ...], forward: bool = False) -> DataFrame:
    """Adds sum_<name>_<i> and count_<i> for the i-th window.

    Backward windows are (t - w, t] and hold later rows of time t too; forward ones are (t, t + w]. Null and NaN count
    as 0 in sums. A sum of zeros is exactly 0, whatever came before."""
    v = {n: f"_v_{n}" for n in values}
    df = df.withColumns({v[n]: or_zero(x) for n, x in values.items()})
    over = "OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {})"  # as text: fewer calls to the JVM
    upto = over.format("CURRENT ROW")
    run = {f"_p_{n}": F.expr(f"sum({c}) {upto}") for n, c in v.items()} | {f"_k_{n}": F.expr(f"count_if({c} != 0) {upto}") for n, c in v.items()}
    df = df.withColumns(run | {"_c": F.expr(f"count(*) {upto}")})
    ends, names = {}, ["_c", *run]
    for i, s in enumerate(seconds):
        frame = over.format(f"{nanos(s)}L {'FOLLOWING' if forward else 'PRECEDING'}")
        ends |= {f"{n}_{i}": F.expr(f"last({n}) {frame}") for n in names}
    df = df.withColumns(ends)
    between = lambda n, i: f"coalesce({n}_{i}, 0) - {n}" if forward else f"{n} - coalesce({n}_{i}, 0)"
    out = {}
    for i in range(len(seconds)):
        out[f"count_{i}"] = F.expr(between("_c", i))
        for n in values:
            out[f"sum_{n}_{i}"] = F.expr(f"CASE WHEN {between(f'_k_{n}', i)} > 0 THEN {between(f'_p_{n}', i)} ELSE 0D END")
    return df.withColumns(out).drop(*v.values(), *names, *ends)


def drop_sums(df: DataFrame, values: dict[str, Column], seconds: tuple[float, ...]) -> DataFrame:
    return df.drop(*[f"count_{i}" for i in range(len(seconds))], *[f"sum_{n}_{i}" for n in values for i in range(len(seconds))])


def value_before(c: str, seconds: float, numbered: bool = False) -> Column:
    """The last value at or before t - seconds; of rows of equal time, where they are numbered, the one of the greatest
    seq. The row's own if there is none."""
    old = times().rangeBetween(ALL, -nanos(seconds))
    found = F.max_by(F.col(c), F.struct("timestamp_ns", "seq")) if numbered else F.last(c)
    return F.coalesce(found.over(old), F.col(c))


def first_at_or_after(df: DataFrame, seconds: float, price: str, edges: list[int] | None = None) -> DataFrame:
    """Adds hit: a struct (t, px) of the first row at or after t + seconds, null if there is none.

    Quotes by their time and probes by the time they look for are put in one series in descending order; the last
    quote seen before a probe is the answer. Linear, where a frame from +h to the end would be quadratic. Large tables are
    parted at `edges` (time_edges of the frame unless given); each block begins with the first quote after it."""
    edges = time_edges(df) if edges is None else edges
    hit = F.struct(F.col("timestamp_ns").alias("t"), F.col(price).alias("px"))
    seq = F.col("seq") if "seq" in df.columns else F.lit(0)
    both = F.explode(F.array(F.struct(F.col("timestamp_ns").alias("key"), F.lit(0).alias("probe")), F.struct((F.col("timestamp_ns") + nanos(seconds)).alias("key"), F.lit(1).alias("probe"))))
    series = df.withColumn("_x", both).withColumns({"_q": F.when(F.col("_x.probe") == 0, hit), "_s": seq.cast("bigint")})
    by = ["market_id"]
    if edges:
        series = series.withColumn("_key", F.col("_x.key")).withColumn("_blk", block_of("_key", edges)).drop("_key")
        series = in_blocks(series.unionByName(next_quotes(df, hit, seq, edges), allowMissingColumns=True), edges)
        by += ["_blk"]
    w = W.partitionBy(*by).orderBy(F.desc("_x.key"), F.asc("_x.probe"), F.desc("_s")).rowsBetween(ALL, 0)
    return series.withColumn("hit", F.last("_q", ignorenulls=True).over(w)).filter("_x.probe = 1").drop("_x", "_q", "_s", "_blk")


def next_quotes(df: DataFrame, hit: Column, seq: Column, edges: list[int]) -> DataFrame:
    """For each market's blocks that have a quote in a later one, the first of these as a quote of theirs. First times are
    found by themselves, so that nothing is sorted but the rows of these times."""
    quotes = df.select("market_id", "timestamp_ns", block_of("timestamp_ns", edges).alias("_blk"), hit.alias("_q"), seq.cast("bigint").alias("_s"))
    start = quotes.groupBy(F.col("market_id").alias("_m"), F.col("_blk").alias("_b")).agg(F.min("timestamp_ns").alias("_t"))
    at = F.col("market_id").eqNullSafe(F.col("_m")) & (F.col("_blk") == F.col("_b")) & (F.col("timestamp_ns") == F.col("_t"))
    first = quotes.join(start, at).groupBy("market_id", "_blk").agg(F.min(F.struct("_s", "_q")).alias("_f"))
    before = F.coalesce(F.lag("_blk").over(W.partitionBy("market_id").orderBy("_blk")), F.lit(0))
    blocks = first.withColumn("_before", before).filter("_blk > 0").withColumn("_blk", F.explode(F.sequence("_before", F.col("_blk") - 1)))
    key = F.struct(F.col("_f._q.t").alias("key"), F.lit(0).alias("probe"))
    return blocks.select("market_id", "_blk", key.alias("_x"), F.col("_f._q").alias("_q"), F.col("_f._s").alias("_s"))


def with_ewma(df: DataFrame, columns: dict[str, str], halflife: float, span: int = 50) -> DataFrame:
    """Adds, for each (name, source), the source's mean with weights that halve every `halflife` seconds.

    The recurrence is y = a x + (1 - a) y' with a = 1 - 2^(-dt / halflife) and y = x at first; rows where the source is
    null are passed over and get null. In closed form, y is a running sum of x weighted by 2^(t / halflife); time is cut
    into blocks of `span` half-lives so that weights can't overflow, and a block takes over what the two before it left
    (older rest is below 2^-100)."""
    rate, block = math.log(2) / halflife, max(1, nanos(halflife * span))
    w = rows(df)
    decay = math.exp(-rate * block / 1e9)
    df = df.withColumns({"_b": F.floor(F.col("timestamp_ns") / block).cast("bigint")}).withColumn("_rel", (F.col("timestamp_ns") - F.col("_b") * block) / 1e9)
    before = {f"_t_{n}": F.last(F.when(F.col(c).isNotNull(), F.col("timestamp_ns")), ignorenulls=True).over(w.rowsBetween(ALL, -1)) for n, c in columns.items()}
    df = df.withColumns(before)
    grow = F.exp(F.lit(rate) * F.col("_rel"))
    part = {}
    for n, c in columns.items():
        gap = (F.col("timestamp_ns") - F.col(f"_t_{n}")) / 1e9
        part[f"_w_{n}"] = F.col(c) * grow * F.when(F.col(f"_t_{n}").isNull(), 1.0).otherwise(-F.expm1(F.lit(-rate) * gap))
    df = df.withColumns(part)
    inside = W.partitionBy("market_id", "_b").orderBy(*order_of(df)).rowsBetween(ALL, 0)
    blocks = W.partitionBy("market_id").orderBy("_b")
    sums = {}
    for n in columns:
        sums[f"_s_{n}"] = F.sum(f"_w_{n}").over(inside)
        for k in (1, 2):
            sums[f"_e{k}_{n}"] = F.sum(f"_w_{n}").over(blocks.rangeBetween(-k, -k))
    df = df.withColumns(sums)
    out = {}
    for n, c in columns.items():
        carried = F.coalesce(F.col(f"_e1_{n}"), F.lit(0.0)) * decay + F.coalesce(F.col(f"_e2_{n}"), F.lit(0.0)) * decay * decay
        out[n] = F.when(F.col(c).isNotNull(), F.exp(F.lit(-rate) * F.col("_rel")) * (carried + F.coalesce(F.col(f"_s_{n}"), F.lit(0.0))))
    return df.withColumns(out).drop("_b", "_rel", *before, *part, *sums)
