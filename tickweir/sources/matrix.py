"""FI-2010 text matrices: features in rows, events in columns, ten levels of ask and bid first."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweir.schema import BOOK, NS

Paths = str | Path | Sequence[str | Path]
LEVELS, CELLS = 10, 40


def load_matrix(spark: SparkSession, mat: np.ndarray, *, t_start_ns: int = 0, dt_s: float = 1.0, market_id: str = "FI2010") -> DataFrame:
    """A matrix as a book: rows 4k .. 4k + 3 are level k's ask price, ask size, bid price and bid size; event i is at
    t_start_ns + i * dt_s. ValueError where there are fewer rows than ten levels need."""
    if mat.shape[0] < CELLS:
        raise ValueError(f"{mat.shape[0]} rows, but {CELLS} are needed; features must be in rows")
    levels = np.ascontiguousarray(mat[:CELLS].T, dtype=float).reshape(-1, LEVELS, 4)
    ts = (t_start_ns + np.arange(len(levels)) * (dt_s * NS)).astype(np.int64)
    rows = [(int(t), *(x[:, i].tolist() for i in range(4))) for t, x in zip(ts, levels)]
    raw = spark.createDataFrame(rows, "timestamp_ns bigint, " + ", ".join(f"{c} array<double>" for c in ("asks_price", "asks_size", "bids_price", "bids_size")))
    touch = {f"{s}_{c}": F.col(f"{s}s_{c}")[0] for s in ("bid", "ask") for c in ("price", "size")}
    book = raw.withColumns(touch | {"market_id": F.lit(market_id)})
    return book.withColumns({"mid": (F.col("bid_price") + F.col("ask_price")) / 2, "spread": F.col("ask_price") - F.col("bid_price")}).select(*BOOK.names)


def load_file(spark: SparkSession, path: str | Path, *, t_start_ns: int = 0, dt_s: float = 1.0, market_id: str | None = None) -> DataFrame:
    return load_matrix(spark, np.loadtxt(path), market_id=market_id or Path(path).stem, dt_s=dt_s, t_start_ns=t_start_ns)


def load(spark: SparkSession, paths: Paths, *, dt_s: float = 1.0) -> DataFrame:
    """Files, or a folder's .txt files, one market each, on the same clock."""
    given = list(paths) if not isinstance(paths, (str, Path)) else [paths]
    files = [f for p in map(Path, given) for f in (sorted(p.glob("*.txt")) if p.is_dir() else [p])]
    if not files:
        raise FileNotFoundError(f"no .txt matrix at {paths}")
    out = load_file(spark, files[0], dt_s=dt_s)
    for f in files[1:]:
        out = out.unionByName(load_file(spark, f, dt_s=dt_s))
    return out


def write_parquets(spark: SparkSession, paths: Paths, out_dir: str | Path, *, dt_s: float = 1.0) -> str:
    """Each market as <market>.parquet below out_dir."""
    pool = load(spark, paths, dt_s=dt_s)
    for (m,) in pool.select("market_id").distinct().collect():
        pool.filter(F.col("market_id") == m).coalesce(1).sortWithinPartitions("timestamp_ns").write.mode("overwrite").parquet(f"{out_dir}/{m}.parquet")
    return str(out_dir)
