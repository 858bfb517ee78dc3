"""Every query that SQL can express gives DuckDB's rows."""

import subprocess
import sys

import pytest

from tests.conftest import DATA, ROOT, same_rows
from tickweir import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, f"{DATA}/sf0.001"), duck(SQL[name]))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["market_id", "n", "corr", "flow"] and df.count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("hidden", ["regex", "corpus_pipeline", "tickweir.llm"])
def test_the_other_queries_do_without_the_training_data_operators(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'flow_signal' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
