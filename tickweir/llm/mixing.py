"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import DOC_COLUMNS, discard, materialise, pick, ship, unit_hash

ROUNDS = 100
POWER = 0.7  # a marginal's target: its observed share of tokens to this power, normed
MARGINS = ("m_source", "m_lang", "m_topic")
LIFT = 4.0  # a target that isn't given is at most this many times the observed share, so that no rare value decides the budget
BUDGET = 0.5  # share of all tokens that the sample is to hold, where the targets allow it
STEPS = 50  # budgets that are tried: so many equal steps up to BUDGET
CLOSE = 1e-3  # of its target share, the most by which a value's expected share may miss it
HELD = 1 << 20  # cells that are raked on the driver and broadcast; more are raked and joined in the cluster
SALT = ":mix"


def topic_of(text: str = "text") -> Column:
    """A document's topic by surface form, where the table has no such column."""
    t = F.col(text)
    return (
        F.when(t.contains("icense"), "legal").when(t.contains("@"), "contact").when(t.contains(" | "), "table")
        .when(F.length(t) < 600, "note").when(F.length(t) < 4000, "article").otherwise("book")
    )


def token_count(text: str = "text") -> Column:
    """White-space tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def labelled(docs: DataFrame, topic: Column | None) -> DataFrame:
    named = [F.coalesce(F.col(c), F.lit("(none)")).alias(f"m_{c}") for c in ("source", "lang")]
    return docs.select("*", *named, F.coalesce(topic_of() if topic is None else topic, F.lit("(none)")).alias("m_topic"))


def wanted(cells: DataFrame, margin: str, targets: dict[str, dict[str, float]], power: float) -> DataFrame:
    """The margin's values and their target shares."""
    seen = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if margin in targets:
        given = cells.sparkSession.createDataFrame(list(targets[margin].items()), "k string, share double")
        raw = seen.join(given, seen[margin] == given["k"], "left").select(margin, F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        root = F.pow(F.col("t").cast("double"), F.lit(power))
        sums = seen.agg(F.sum(root).alias("roots"), F.sum(F.col("t").cast("double")).alias("tokens"))
        raw = seen.crossJoin(F.broadcast(sums)).select(margin, F.least(root / F.col("roots"), F.lit(LIFT) * F.col("t") / F.col("tokens")).alias("share"))
    total = raw.agg(F.sum("share").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select(margin, (F.col("share") / F.col("total")).alias("want"))


def rake_held(pdf: pd.DataFrame, want: dict[str, dict[str, float]], rounds: int, budget: float) -> np.ndarray:
    """p of cells that fit in memory."""
    codes = {m: pd.factorize(pdf[m], sort=True) for m in MARGINS}
    share = {m: np.array([want[m][v] for v in names]) for m, (_, names) in codes.items()}
    tokens = pdf["tokens"].to_numpy(float)
    sums = lambda code, x, n: np.stack([np.bincount(code, r, n) for r in x])
    goal = budget * np.arange(1, STEPS + 1)[:, None] / STEPS * tokens.sum()
    q = tokens * goal / max(tokens.sum(), 1.0)
    for _ in range(rounds):
        for m, (code, names) in codes.items():
            have = sums(code, np.minimum(q, tokens), len(names))
            q = q * np.divide(share[m] * goal, have, out=np.zeros_like(have), where=have > 0)[:, code]
    x = np.minimum(q, tokens)
    whole = np.maximum(x.sum(1, keepdims=True), 1e-300)
    miss = np.zeros(STEPS)
    for m, (code, names) in codes.items():
        off = np.abs(sums(code, x, len(names)) / whole - share[m]) / np.where(share[m] > 0, share[m], np.inf)
        miss = np.maximum(miss, off.max(1, initial=0.0))
    best = min(range(STEPS), key=lambda k: (max(round(float(miss[k]), 6), CLOSE), -k))
    return x[best] / tokens


def rake_spread(cells: DataFrame, want: dict[str, DataFrame], rounds: int, budget: float) -> DataFrame:
    """The same of cells in the cluster: a row a cell and budget, written after each round."""
    total = cells.agg(F.sum("tokens").alias("all"))
    steps = cells.sparkSession.range(1, STEPS + 1).select(F.col("id").cast("int").alias("k"))
    raked = cells.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(steps)).withColumn("goal", F.lit(budget) * F.col("k") / F.lit(STEPS) * F.col("all")).drop("all")
    raked = materialise(raked.withColumn("q", F.col("tokens") * F.lit(budget) * F.col("k") / F.lit(STEPS)), "raked")
    x = F.least("q", F.col("tokens").cast("double"))
    for _ in range(rounds):
        last, now = raked, raked
        for m in MARGINS:
            have = now.groupBy("k", m).agg(F.sum(x).alias("have")).join(want[m], m)
            now = now.join(have, ["k", m]).withColumn("q", F.when(F.col("have") > 0, F.col("q") * F.col("want") * F.col("goal") / F.col("have")).otherwise(0.0)).drop("have", "want")
        raked = materialise(now, "raked")
        discard(last)
    whole = raked.groupBy("k").agg(F.sum(x).alias("whole"))
    off = F.when(F.col("want") > 0, F.abs(F.col("x") / F.col("whole") - F.col("want")) / F.col("want")).otherwise(0.0)
    misses = None
    for m in MARGINS:
        one = raked.groupBy("k", m).agg(F.sum(x).alias("x")).join(whole, "k").join(want[m], m).select("k", off.alias("miss"))
        misses = one if misses is None else misses.unionByName(one)
    order = F.struct(F.greatest(F.round("miss", 6), F.lit(CLOSE)), -F.col("k"))
    best = misses.groupBy("k").agg(F.max("miss").alias("miss")).agg(F.min_by("k", order).alias("k"))
    return raked.join(F.broadcast(best), "k").select(*MARGINS, "tokens", (x / F.col("tokens")).alias("p"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, power: float = POWER, held: int = HELD, budget: float = BUDGET) -> DataFrame:
    """Iterative proportional fitting of cells (m_source, m_lang, m_topic, tokens): adds p, a document's probability.

    Each round scales the cells' weights, at first their tokens, to the target share of every source, then language,
    then topic. A cell gives no more tokens than it has: its part of a sum is the lesser of weight and tokens, so that the
    others make up for it. Targets are shares by value (normed over the values that occur; a value without one gets none);
    a margin without targets gets its observed shares to `power`, none over LIFT times what is observed. Weights are fitted for each of STEPS budgets up to
    `budget` of all tokens. The greatest budget is taken whose expected shares miss no target by more than CLOSE of it; where
    none does so, the one that misses by the least (of equal ones the greatest). p is the cell's part over its tokens.

    Up to `held` cells are raked on the driver, more of them in the cluster; both give the same. Ties decide nothing. With
    no cells there are no rows."""
    targets = {f"m_{m}": t for m, t in (targets or {}).items()}
    want = {m: wanted(cells, m, targets, power) for m in MARGINS}
    if cells.count() > held:
        return rake_spread(cells, want, rounds, budget)
    pdf = cells.toPandas()
    pdf["p"] = rake_held(pdf, {m: dict(map(tuple, want[m].collect())) for m in MARGINS}, rounds, budget) if len(pdf) else 0.0
    kinds = pa.schema([*[(m, pa.string()) for m in MARGINS], ("tokens", pa.int64()), ("p", pa.float64())])
    # by Arrow: rows sent as Python objects would be read by Python workers of another kind, kept beside those of mapInArrow
    return cells.sparkSession.createDataFrame(pa.Table.from_pandas(pdf, kinds, preserve_index=False))


def with_probability(docs: DataFrame, targets: dict[str, dict[str, float]] | None, topic: Column | None, rounds: int, power: float, held: int, budget: float) -> DataFrame:
    marked = labelled(docs, topic)
    cells = materialise(marked.select(*MARGINS, token_count().alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "cells")
    raked = rake(cells, targets, rounds, power, held, budget).select(*MARGINS, "p")
    small = cells.count() <= held
    return marked.join(F.broadcast(raked) if small else raked, list(MARGINS))


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, rounds: int = ROUNDS, power: float = POWER, held: int = HELD, budget: float = BUDGET) -> DataFrame:
    """A sample of the documents whose tokens have the target shares of sources, languages and topics: doc_id, source,
    lang, topic, tokens, p.

    p is the document's probability (see rake). A document is in the sample if a hash of its doc_id, as a number in
    [0, 1), is below p, so a run can be repeated and repeated rows share their fate. Statistics are taken over all
    documents and whole texts. Topic is given as a column expression or derived from the text's form. Null sources,
    languages and topics count as the value "(none)"; null ids are hashed as empty ones. A text without tokens, null or
    empty, is drawn with its cell's probability and weighs nothing; it is left out where its whole cell has no tokens. An
    empty table gives no rows. Other columns are ignored.
    """
    docs = with_probability(pick(docs, "doc_id", "text", "source", "lang"), targets, topic, rounds, power, held, budget)
    drawn = docs.filter(unit_hash("doc_id", SALT) < F.col("p"))
    return drawn.select("doc_id", F.col("m_source").alias("source"), F.col("m_lang").alias("lang"), F.col("m_topic").alias("topic"), token_count().alias("tokens"), F.round("p", 6).alias("p"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that `mixture` draws, with the columns of documents."""
    docs = with_probability(pick(docs, *DOC_COLUMNS), targets, None, ROUNDS, POWER, HELD, budget)
    return docs.filter(unit_hash("doc_id", SALT) < F.col("p")).select(*DOC_COLUMNS)


ship(__name__)
