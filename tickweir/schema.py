"""The canonical tables and checks made before any job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NS = 1_000_000_000
TICK = 0.01
LEVELS = 5

QUOTE = tuple(f"{side}_{what}" for side in ("bid", "ask") for what in ("price", "size"))
LADDERS = tuple(f"{side}s_{what}" for side in ("bid", "ask") for what in ("price", "size"))

#: Lengths of time in seconds; a length of time, or a count, that may be left out.
Seconds = tuple[float, ...]
Maybe = float | None
Count = int | None
SHORT: Seconds = (1.0, 5.0, 30.0)
LONG: Seconds = (5.0, 30.0)
TIERS = 3
ACTIVE = 10  # mid changes that make a market active

_D, _A = T.DoubleType(), T.ArrayType(T.DoubleType())
BOOK = T.StructType(
    [T.StructField("market_id", T.StringType()), T.StructField("timestamp_ns", T.LongType())]
    + [T.StructField(c, _D) for c in (*QUOTE, "mid", "spread")]
    + [T.StructField(c, _A) for c in LADDERS]
)
TRADES = T.StructType(
    [T.StructField("market_id", T.StringType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("price", _D), T.StructField("size", _D), T.StructField("side", T.LongType())]
)


def require(df: DataFrame, columns: Iterable[str], who: str, hint: str = "") -> None:
    """KeyError, before any job, where columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{who} needs {missing}" + (f"; {hint}" if hint else ""))


def tune(spark: SparkSession) -> None:
    """Where the session has Spark's default, let stages whose one generated method would be too long to be compiled (over
    8000 bytes of bytecode) run as several short ones."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def label(seconds: float) -> str:
    """A duration as a column suffix: 5s, 0.5s as 0p5s. Durations of different length never share one."""
    return f"{seconds:g}s".replace(".", "p")


def nanos(seconds: float) -> int:
    return int(seconds * NS)
