"""The studies from the command line: python -m tickweir attribution --roots DIR ..."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession

from tickweir.operators.metrics import format_table, phase_gaps
from tickweir.plans import studies
from tickweir.sources import matrix, synthetic
from tickweir.sources.files import LoadConfig, load_pool, load_trades

STUDIES = {"attribution": (studies.Settings(), 2000), "comparison": (studies.COMPARISON, 1000), "targets": (studies.TARGETS, 2000), "diagnose": (studies.DIAGNOSIS, 2000)}


def flag(name: str) -> str:
    return "--" + name.replace("_", "-")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickweir")
    sub = p.add_subparsers(dest="what", required=True)
    for study, (defaults, least) in STUDIES.items():
        s = sub.add_parser(study)
        s.add_argument("--roots", nargs="+", required=True, help="folders of book and tape files")
        s.add_argument("--min-rows", type=int, default=least)
        s.add_argument("--trades", action="store_true", help="use the tape")
        s.add_argument("--phases", default="01234", help="attribution: which phases; diagnose: the first of them")
        s.add_argument("--horizons", nargs="+", type=float, default=[2.0, 5.0, 10.0, 30.0], help="targets: seconds")
        for f in dataclasses.fields(defaults):
            value = getattr(defaults, f.name)
            if isinstance(value, bool):
                s.add_argument(flag(f.name), action=argparse.BooleanOptionalAction, default=value)
            elif isinstance(value, tuple):
                s.add_argument(flag(f.name), nargs="+", default=list(value))
            else:
                s.add_argument(flag(f.name), type=float if value is None else type(value), default=value)
    g = sub.add_parser("generate", help="write synthetic books and tapes")
    g.add_argument("--out", required=True)
    g.add_argument("--no-trades", action="store_true")
    for f in dataclasses.fields(synthetic.Model):
        g.add_argument(flag(f.name), type=type(f.default), default=f.default)
    m = sub.add_parser("convert", help="FI-2010 matrices to book files")
    m.add_argument("--paths", nargs="+", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--dt-s", type=float, default=1.0)
    return p


def settings(a: argparse.Namespace) -> studies.Settings:
    names = {f.name for f in dataclasses.fields(studies.Settings)}
    return studies.Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in vars(a).items() if k in names})


def show(tables: dict[str, DataFrame | None]) -> None:
    for name, t in tables.items():
        if t is not None:
            print("\n" + format_table(t, name))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tickweir {a.what}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "generate":
        model = {f.name: getattr(a, f.name) for f in dataclasses.fields(synthetic.Model)}
        print(synthetic.generate(spark, a.out, with_trades=not a.no_trades, **model))
        return 0
    if a.what == "convert":
        print(matrix.write_parquets(spark, a.paths, a.out, dt_s=a.dt_s))
        return 0
    pool = load_pool(spark, LoadConfig(roots=a.roots, min_rows=a.min_rows))
    trades = load_trades(spark, a.roots) if a.trades or "5" in a.phases else None
    s = settings(a)
    if a.what == "attribution":
        tables = studies.staged_attribution(pool, s, a.phases, trades)
        if tables["reg"] is not None:
            tables["gain"] = phase_gaps(tables["reg"]).orderBy("model", "phase")
        show(tables)
    elif a.what == "comparison":
        show(studies.model_comparison(pool, s, trades))
    elif a.what == "targets":
        show({"targets": studies.target_study(pool, s, tuple(a.horizons), trades)})
    else:
        show(studies.diagnose(pool, s, a.phases[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
