"""WARC (1) and mixing (4)."""

import gzip
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, same_rows
from tests.llm import helpers as H
from tickweir.llm import mixing, registry, warc


def record(i, body, url="http://x/"):
    return b"WARC/1.0\r\nWARC-Record-ID: %d\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n" % (i, url.encode(), len(body)) + body + b"\r\n\r\n"


def members(data):
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return out


def normalised(source, target):
    return [tuple(r.values()) for b in warc.normalised(str(source), str(target)) for r in b.to_pylist()]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_one_stream_becomes_a_member_a_record(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    bodies = [b"", b"x", b"WARC/1.0\r\n\r\n", rng.bytes(5000), b"a" * 100_000]
    data = b"".join(record(i, b) for i, b in enumerate(bodies))
    for name, raw in (("one", gzip.compress(data)), ("many", b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))), ("padded", gzip.compress(data) + b"\0" * 20)):
        (tmp_path / f"{name}.warc.gz").write_bytes(raw)
        rows = normalised(tmp_path / f"{name}.warc.gz", tmp_path / f"{name}.out.gz")
        out = (tmp_path / f"{name}.out.gz").read_bytes()
        assert members(out) == [record(i, b) for i, b in enumerate(bodies)]
        assert [(r[3], r[4]) for r in rows] == [(sum(x[4] for x in rows[:i]), rows[i][4]) for i in range(len(rows))]
        assert [r[6] for r in rows] == [hashlib.md5(b).hexdigest() for b in bodies]
        assert pd.read_parquet(tmp_path / f"{name}.out.gz.idx.parquet")["offset"].tolist() == [r[3] for r in rows]
        for r, b in zip(rows, bodies):
            fields, body = warc.read_record(str(tmp_path / f"{name}.out.gz"), r[3], r[4])
            assert body == b and fields["warc-record-id"] == r[0]
    assert not list(tmp_path.glob("*.part*"))


def test_broken_and_empty_files(tmp_path):
    whole = gzip.compress(record(0, b"x" * 1000))
    for name, raw, error in (("cut", whole[: len(whole) // 2], EOFError), ("short", gzip.compress(record(0, b"x" * 1000)[:-500]), EOFError), ("odd", gzip.compress(b"hello\n"), ValueError)):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(error):
            normalised(tmp_path / name, tmp_path / f"{name}.out")
        assert not (tmp_path / f"{name}.out").exists()
    (tmp_path / "empty").write_bytes(b"")
    assert normalised(tmp_path / "empty", tmp_path / "e.out") == []


def test_files_of_one_name_and_many_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROWS", 3)
    files = []
    for k, where in enumerate(("a/x", "b/x", "b/y", "x")):
        path = tmp_path / "in" / f"{where}.warc.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(b"".join(record(10 * k + i, b"body %d %d" % (k, i)) for i in range(k + 4))))
        files.append(f"file:{path}")
    index = warc.normalise(spark, [*files, files[0]], f"file:{tmp_path}/out")
    seen = [{(r["record_id"], r["file"], r["offset"], r["length"]) for r in index.collect()} for _ in range(2)]
    assert seen[0] == seen[1] and len(seen[0]) == 4 + 5 + 6 + 7 and {x[1] for x in seen[0]} == {"a__x.warc.gz", "b__x.warc.gz", "b__y.warc.gz", "x.warc.gz"}
    for rid, name, offset, length in seen[0]:
        k, i = divmod(int(rid), 10)
        assert warc.read_record(f"file:{tmp_path}/out/{name}", offset, length)[1] == b"body %d %d" % (k, i)
    sidecars = [pd.read_parquet(p) for p in (tmp_path / "out").glob("*.idx.parquet")]
    assert len(sidecars) == 4 and sum(map(len, sidecars)) == len(seen[0])
    with pytest.raises(ValueError):
        warc.normalise(spark, ["file:/x/a/b__c", "file:/x/a__b/c"], f"file:{tmp_path}/clash")


def test_pages_come_back_through_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "shared_dir", lambda s, what: f"file:{tmp_path}/{what}")
    root = f"file:{tmp_path}/warc/normal"
    rows = [(1, "http://a/", "<p>é</p>"), (None, None, None), (3, "http://b/ c\nd", ""), (1, "http://a/", "<p>é</p>"), (4, None, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, HTML string").repartition(2)
    index = warc.pages_index(df).collect()
    assert len(index) == 5
    back = []
    for r in index:
        fields, body = warc.read_record(f"{root}/{r['file']}", r["offset"], r["length"])
        assert hashlib.md5(body).hexdigest() == r["digest"] and len(body) == r["n_bytes"]
        back.append((r["page_id"], r["url"], None if "x-null" in fields else body.decode()))
    want = [(i, None if u is None else " ".join(u.split()), h) for i, u, h in rows]
    assert sorted(back, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(warc, "shared_dir", lambda s, what: f"file:{tmp_path}/empty")
    assert warc.pages_index(df.limit(0)).count() == 0
    assert warc.normalise(spark, [], f"{root}/none").count() == 0


def test_the_query_indexes_every_page(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()}
    got = registry.queries()["op1_warc_index"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r["page_id"]]["html"].encode()
        assert (r["url"], r["n_bytes"], r["digest"]) == (pages[r["page_id"]]["url"], len(body), hashlib.md5(body).hexdigest())


CELLS = [("s1", "en", "a", 100), ("s1", "fr", "a", 10), ("s2", "en", "b", 50), ("s2", "fr", "a", 5), ("(none)", "en", "a", 1)]


def cells(spark):
    return spark.createDataFrame(CELLS, "m_source string, m_lang string, m_topic string, tokens bigint")


def best_fit(cells, given, budget):
    return H.best_fit(cells, budget, mixing.STEPS, mixing.ROUNDS, mixing.CLOSE, mixing.POWER, given)


GIVEN = {"source": {"s1": 1.0, "s2": 1.0, "(none)": 0.02, "gone": 9.0}, "lang": {"en": 0.7, "fr": 0.3}}


@pytest.mark.parametrize("given,held,budget", [({}, mixing.HELD, 0.5), ({}, 0, 0.5), (GIVEN, mixing.HELD, 0.9), (GIVEN, mixing.HELD, 0.02)])
def test_raking_against_brute_force(spark, monkeypatch, given, held, budget):
    if not held:
        monkeypatch.setattr(mixing, "STEPS", 5)
    got = mixing.rake(cells(spark), given, held=held, budget=budget).collect()
    want = best_fit(CELLS, given, budget)
    assert {(r["m_source"], r["m_lang"], r["m_topic"]): r["p"] for r in got} == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_targets_that_contradict_each_other(spark):
    """s2 has French only, so half from s2 and a tenth French can't be; values without a target get nothing."""
    df = spark.createDataFrame([("s1", "en", "a", 100), ("s2", "fr", "a", 100), ("s3", "en", "a", 50)], "m_source string, m_lang string, m_topic string, tokens bigint")
    got = {r["m_source"]: r["p"] for r in mixing.rake(df, {"source": {"s1": 0.5, "s2": 0.5}, "lang": {"en": 0.9, "fr": 0.1}}).collect()}
    assert got["s3"] == 0 and 0 < got["s2"] < got["s1"] <= 1


def test_sample_of_awkward_rows(spark):
    df = H.docs(spark, H.AWKWARD)
    got = mixing.mixture(df)
    rows = [(i, t, "src" if n else "(none)", "(none)" if t is not None and len(t) % 2 == 0 else "en") for n, (i, t) in enumerate(H.AWKWARD)]
    rows[0] = (*rows[0][:2], "(none)", rows[0][3])  # the ids 0 have no source
    rows = [(i, t, "(none)" if i == 0 else "src", lang) for i, t, _, lang in rows]
    topic = lambda t: "book" if t is None else "note" if len(t) < 600 else "book"
    tokens = lambda t: len((t or "").split())
    by = {}
    for i, t, source, lang in rows:
        key = (source, lang, topic(t))
        by[key] = by.get(key, 0) + tokens(t)
    p = best_fit([(*k, n) for k, n in by.items() if n], {}, 0.5)
    unit = lambda i: int(hashlib.md5(f"{'' if i is None else i}{mixing.SALT}".encode()).hexdigest()[:8], 16) / 2**32
    want = [(i, source, lang, topic(t), tokens(t), round(p[source, lang, topic(t)], 4)) for i, t, source, lang in rows if unit(i) < p.get((source, lang, topic(t)), -1)]
    assert sorted([(*r[:5], round(r[5], 4)) for r in map(tuple, got.collect())], key=repr) == sorted(want, key=repr) and want
    assert mixing.mixture(df.limit(0)).count() == 0
    assert mixing.mixture(H.docs(spark, [(2, None)])).count() == 0  # no token in any cell
    assert mixing.mix(df).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_shares_of_a_sample_approach_the_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 15))), rng.choice(["en", "fr"], p=[0.9, 0.1]), rng.choice(["a", "b"], p=[0.8, 0.2]), 0) for i in range(6000)]
    df = spark.createDataFrame([(i, t, str(a), str(b), n) for i, t, a, b, n in rows], H.DOCS)
    got = mixing.mixture(df, {"lang": {"en": 0.5, "fr": 0.5}, "source": {"a": 0.5, "b": 0.5}}, topic=F.lit("t"), budget=0.1)
    whole = got.agg(F.sum("tokens")).first()[0]
    for m in ("lang", "source"):
        for r in got.groupBy(m).agg(F.sum("tokens").alias("t")).collect():
            assert abs(r["t"] / whole - 0.5) < 0.08


@pytest.mark.parametrize("given", [{}, {"lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}}])
def test_expected_shares_at_the_default_budget_are_the_targets(spark, given):
    rng = np.random.default_rng(5)
    size = lambda i, j, k: int(2000 * rng.random() ** 3 * (1, 4, 5)[i] * (1, 5, 30)[j] * (1, 3, 9)[k]) + 20
    rows = [(f"s{j}", f"l{i}", f"t{k}", size(i, j, k)) for i in range(3) for j in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "m_source string, m_lang string, m_topic string, tokens bigint")
    got = mixing.rake(df, given).toPandas()
    every, got["x"] = got["tokens"].sum(), got["p"] * got["tokens"]
    assert (got["p"] == 1).any() and got["p"].between(0, 1).all() and 0 < got["x"].sum() <= mixing.BUDGET * every * 1.001
    for m in mixing.MARGINS:
        want = pd.Series(given["lang"]) if given and m == "m_lang" else got.groupby(m)["tokens"].sum().astype(float) ** mixing.POWER
        assert (got.groupby(m)["x"].sum() / got["x"].sum()).to_dict() == pytest.approx((want / want.sum()).to_dict(), rel=3e-3)


def test_a_sample_has_targets_that_half_of_the_tokens_cannot_meet(spark):
    df = spark.createDataFrame([(i, "w " * 10, "fr" if i % 10 == 0 else "en", "a", 0) for i in range(8000)], H.DOCS)
    got = mixing.mixture(df, {"lang": {"en": 0.5, "fr": 0.5}}, topic=F.lit("t")).groupBy("lang").agg(F.sum("tokens").alias("t")).collect()
    t = {r["lang"]: r["t"] for r in got}
    assert t["fr"] == 8000 and abs(t["en"] / t["fr"] - 1) < 0.12


def test_a_rare_value_does_not_decide_the_budget(spark):
    """Without LIFT the share of "rare" would be 25 times what there is of it, and the sample a twenty-fifth of the tokens."""
    rows = [("s1", "en", t, n) for t, n in (("a", 600_000), ("b", 399_990), ("rare", 10))]
    df = spark.createDataFrame(rows, "m_source string, m_lang string, m_topic string, tokens bigint")
    got = {r["m_topic"]: r["p"] for r in mixing.rake(df).collect()}
    assert got == pytest.approx({k[2]: v for k, v in best_fit(rows, {}, 0.5).items()}) and 0.9 < got["rare"] <= 1 and got["a"] > 0.2


def test_query_gives_the_rows_of_its_sql(spark, duck):
    same_rows(registry.queries()["op4_mixture"](spark, f"{DATA}/sf0.001"), duck(registry.oracle_sql()["op4_mixture"]))
