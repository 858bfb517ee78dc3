from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", f"file:{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """duck(sql, sf): rows of DuckDB over the tables at a scale."""

    def run(sql: str, sf: str = "sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            p = f"{DATA}/{sf}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
        return con.sql(sql)

    return run


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v + 1e-12, 9)
    return v


def same_rows(df, rel) -> None:
    """Spark's rows and DuckDB's, whatever their order, with the same columns."""
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    at = [rel.columns.index(c) for c in cols]
    theirs = [tuple(normal(r[i]) for i in at) for r in rel.fetchall()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert order(mine) == order(theirs)
