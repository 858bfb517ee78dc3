"""The pipeline against a brute-force version of every stage."""

import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import helpers as H
from tickweir.llm import decontam, mixing, setsketch, toxicity
from tickweir.llm._common import shared_dir

DIR = f"{DATA}/sf0.001"


def lines(pairs):
    out = []
    for (i, t), keep in H.kept_lines(pairs).items():
        all_ = t.split("\n")
        new = "\n".join(all_[k] for k in keep)
        if len(keep) == len(all_) or any(x.strip(" ") for x in new.split("\n")):
            out.append((i, new))
    return out


def near(pairs):
    gone = {i for g in H.near_groups(pairs, setsketch.THRESHOLD) for i in g[1:]}
    return [(i, t) for i, t in pairs if i not in gone]


def leaks(pairs, items):
    out = []
    for i, t in pairs:
        hits = {(a, n) for a, n, _ in H.leaks(t, items)}
        cover = {w for a, n in hits for w in range(a, a + n)}
        if 2 * len(cover) >= len(H.words(t)) and hits:
            continue
        at = [m.span() for m in decontam.WORD.finditer(t)]
        cut, done = "", 0
        for w, (a, _) in enumerate(at):
            nxt = at[w + 1][0] if w + 1 < len(at) else len(t)
            if w not in cover:
                cut += t[done:nxt] if w == 0 else t[a:nxt]
            elif w == 0:
                cut += t[:a]
            done = nxt
        out.append((i, cut if hits else t))
    return out


def topic(t):
    return "legal" if "icense" in t else "contact" if "@" in t else "table" if " | " in t else "note" if len(t) < 600 else "article" if len(t) < 4000 else "book"


def drawn(rows, raked):
    out = []
    for i, t, source, lang in rows:
        u = int(hashlib.md5(f"{i}{mixing.SALT}".encode()).hexdigest()[:8], 16) / 2**32
        if u < raked.get((source, lang, topic(t)), -1):
            out.append((i, t))
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_run_against_brute_force(spark, documents):
    rows = documents.collect()
    meta = {r["doc_id"]: (r["source"], r["lang"]) for r in rows}
    scored = toxicity.scores(documents, spark.read.parquet(f"{DIR}/labels.parquet"))  # held against brute force in its own test
    toxic = {r["doc_id"] for r in scored.filter("toxic").collect()}
    pairs = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] not in toxic]
    assert 0 < len(rows) - len(pairs) < 40
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for stage in (lines, near, lambda x: leaks(x, items)):
        before = len(pairs), sum(len(t) for _, t in pairs)
        pairs = stage(pairs)
        assert (len(pairs), sum(len(t) for _, t in pairs)) < before
    cells = {}
    for i, t in pairs:
        key = (*meta[i], topic(t))
        cells[key] = cells.get(key, 0) + len(t.split())
    raked = H.best_fit([(*k, n) for k, n in cells.items() if n], mixing.BUDGET, mixing.STEPS, mixing.ROUNDS, mixing.CLOSE, mixing.POWER)
    want = drawn([(i, t, *meta[i]) for i, t in pairs], raked)
    shared = lambda: {p.name for p in Path(shared_dir(spark, "x").removeprefix("file:")).parent.iterdir()}
    before = shared()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, DIR).collect()]
    assert [n.split("-")[0] for n in shared() - before] == ["pipeline"]
    assert sorted(got) == sorted(want) and got


def test_stages_take_awkward_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns, stage by stage."""
    df = H.docs(spark, H.AWKWARD)
    rows = sorted(H.AWKWARD, key=repr)
    ids = lambda out: sorted((r["doc_id"] for r in out.collect()), key=repr)
    want = {
        "toxicity": [i for i, _ in rows],
        "line dedup": sorted((i for i, t in H.AWKWARD if (i, t) != (8, H.LONG)), key=repr),
        "near-duplicate removal": sorted([None, None, 0, 2, 3, 4, 5, 7, 9], key=repr),
        "decontamination": [i for i, _ in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DIR)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, df.limit(0), DIR).count() == 0
        if name in want:
            assert ids(out) == want[name], name
        else:
            drawn = ids(out)
            assert all(drawn.count(i) in (0, [k for k, _ in H.AWKWARD].count(i)) for i in drawn if i == 0)
    assert [n for n, _ in corpus_pipeline.STAGES] == [*want, "mixing"]


def python_steps(node):
    """Of a physical plan: how many Python steps its topmost stage runs at once in a task, and the most of any stage."""
    name, kids = node.nodeName(), node.children()
    below = [python_steps(kids.apply(i)) for i in range(kids.size())]
    most = max((m for _, m in below), default=0)
    if "Exchange" in name:
        return 0, most
    here = [n for n, _ in below] or [0]
    now = (max(here) if name == "Union" else sum(here)) + ("MapInArrow" in name or "Python" in name or "ExistingRDD" in name)
    return now, max(now, most)


def test_no_task_takes_two_python_workers(spark, documents):
    """Workers stay with their executor, so the most that a task takes at once is what it holds from then on."""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, documents, DIR)._jdf.queryExecution().executedPlan()
        seen[name] = python_steps(plan.initialPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan)[1]
    assert seen == {"toxicity": 1, "line dedup": 0, "near-duplicate removal": 1, "decontamination": 1, "mixing": 0}


def test_a_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
