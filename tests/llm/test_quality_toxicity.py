"""Quality ratios (8) and the toxicity chain (9)."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from tests.llm import helpers as H
from tickweir.llm import quality, registry, toxicity

TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~\x7f]+")


def grams(text):
    t = TOKEN.findall(text or "")
    return t + list(zip(t, t[1:]))


def ratios(pairs, good):
    raw = Counter(g for _, t in pairs for g in grams(t))
    target = Counter(g for i, t in pairs if i in good for g in grams(t))
    n = 1 << quality.BITS
    a, b = sum(target.values()) + n, sum(raw.values()) + n
    mean = lambda x: sum(x) / len(x) if x else None
    return [(i, mean([math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b) for g in grams(t)])) for i, t in pairs]


def label_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, QUALITY string")


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    good = ["the river runs slowly to the sea", "a quiet house by the old road", "They walked home in the evening."]
    bad = ["BUY!! NOW!! CHEAP!!", "click $$$ here $$$", "a%%% b%%% c###"]
    return [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, rng.integers(3, 9)))) for i in range(n)]


def test_scores_are_the_ratios_of_unhashed_counts(spark):
    pairs = prose(0) + [(90, ""), (91, None), (92, " \n"), (None, "the river"), (3, "Été “x”"), (1, prose(0)[1][1])]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 60)] + [(5, 1, 0), (None, 1, 0), (7, None, 0)]
    good = {i for i in range(60) if i % 4}
    for held in (quality.HELD, 0):  # labels broadcast, and joined by a shuffle
        got = quality.quality(H.docs(spark, pairs), label_table(spark, labels), held).collect()
        key = lambda r: repr((r[0], None if r[1] is None else round(r[1], 9)))
        mine, want = sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(ratios(pairs, good), key=key)
        assert [m[0] for m in mine] == [w[0] for w in want]
        assert all((m[1] is None) == (w[1] is None) and (m[1] is None or abs(m[1] - w[1]) < 1e-9) for m, w in zip(mine, want))
        kept = {(r["doc_id"], r["keep"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] != 3}
        assert kept == {(i, i % 4 != 0) for i in range(80) if i != 3}
        assert all(not r["keep"] for r in got if r["score"] is None)


def test_no_labels_and_no_documents(spark):
    df = H.docs(spark, prose(1))
    none = label_table(spark, [(1, 1, 0)]).filter("doc_id > 5")
    got = quality.quality(df, none)
    assert got.count() == 80 and got.filter("score is null").count() == 0
    assert quality.quality(df.limit(0), none).count() == 0
    assert toxicity.scores(df, none).filter("toxic").count() == 0
    assert toxicity.scores(df.limit(0), label_table(spark, [(1, 1, 0)])).count() == 0


def test_threshold_is_between_the_kinds(spark):
    scored = spark.createDataFrame([(i, s) for i, s in enumerate([-2.0, -1.5, -0.1, 0.3, 0.5])], "doc_id bigint, unseen double")
    known = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "doc_id bigint, good int")
    assert -1.5 < quality.threshold(scored, known) < -0.1
    assert quality.threshold(scored, known.filter("good = 1")) == 0.0


def test_quality_on_documents_whose_labels_are_held_out(spark):
    d = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r["doc_id"]: r["keep"] for r in quality.quality(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    right = [got[i] == bool(q) for i, q in held.items()]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert registry.queries()["op8_quality"](spark, d).count() == docs.count()


def noisy(seed, n):
    rng = np.random.default_rng(seed)
    clean = [f"{a}{b}" for a in ("al", "ber", "cor", "del") for b in ("on", "ta", "mir", "us", "ine")]
    insult = ["scoundrel", "blockhead", "knavery"]
    out = []
    for i in range(n):
        w = list(rng.choice(clean, rng.integers(20, 200)))
        if i % 5 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(insult)))
        out.append((i, " ".join(w)))
    return out


def test_the_chain_finds_held_out_toxic_documents_and_leaves_the_others(spark):
    pairs = noisy(0, 1200)
    labels = [(i, 1, int(i % 5 == 0)) for i in range(800)]
    got = {r["doc_id"]: r for r in toxicity.scores(H.docs(spark, pairs), label_table(spark, labels)).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(800, 1200))
    assert {r["doc_id"] for r in toxicity.reject_toxic(H.docs(spark, pairs), label_table(spark, labels)).collect()} == {i for i in range(1200) if i % 5}


def test_awkward_rows_and_labels(spark):
    pairs = [*noisy(1, 900), (1000, None), (1001, ""), (1002, "!!"), (None, "You scoundrel, blockhead"), (5, noisy(1, 60)[5][1]), (1003, H.LONG + " scoundrel blockhead scoundrel")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(900)] + [(None, 1, 1), (7, None, 1), (8, 1, None), (10, 1, 0)]
    got = toxicity.scores(H.docs(spark, pairs), label_table(spark, labels)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(pairs) and all(by[i]["p_toxic"] is None and not by[i]["toxic"] for i in (1000, 1001, 1002))
    assert by[None]["toxic"] and by[1003]["toxic"] and not by[8]["toxic"] and by[10]["toxic"]


def test_fits_are_repeatable_and_bounded(spark):
    df, labels = H.docs(spark, noisy(2, 200)), label_table(spark, [(i, 1, int(i % 5 == 0)) for i in range(200)])
    a, b = toxicity.fit(df, labels, 50), toxicity.fit(df.repartition(5), labels.repartition(3), 50)
    assert len(a.out_of_fold["toxic"]) == 50 and a.cuts == b.cuts and np.array_equal(a.links[1].w, b.links[1].w)


def test_later_links_see_earlier_ones_out_of_fold():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    texts = pa.array([f"{'junk' if a else 'fine'} {'pad ' * int(rng.integers(1, 9))}" for a in y])
    flip = np.where(rng.random(300) < 0.05, 1 - y, y)
    c = toxicity.Chain(texts, {"junk": y, "toxic": flip})
    assert c.links[1].mean.shape[0] == toxicity.DENSE + 1 and c.links[0].mean.shape[0] == toxicity.DENSE
    assert np.mean((c.out_of_fold["junk"] > 0.5) == y) > 0.99 and np.mean((c.score(texts)[0][:, 1] > 0.5) == y) > 0.95


def test_toxic_documents_of_the_table_whose_labels_are_held_out(spark):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 4 = 0").collect()}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scores(docs, labels.filter("doc_id % 4 <> 0")).collect()}
    assert np.mean([got[i] for i, t in held.items() if t]) > 0.88  # some labels are wrong
    assert np.mean([got[i] for i, t in held.items() if not t]) < 0.01
    assert len(got) == docs.count()


def test_newton_is_at_the_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 2, 200).astype(float)
    w = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(200)] @ w)))
    assert np.abs(np.c_[x, np.ones(200)].T @ (p - y) + np.r_[w[:4], 0]).max() < 1e-4


def test_cut_is_in_the_middle_of_the_gap():
    assert toxicity.cut_of(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)
    assert toxicity.cut_of(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5


def logit_fit(x, y, penalty):
    """Newton's method with halving, on rows that end in a 1."""
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    loss = lambda v: np.sum(np.logaddexp(0, x @ v) - y * (x @ v)) + np.sum(ridge * v * v) / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) + ridge * w
        step, t = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), g), 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return w


def brute_link(train, y, folds, test, dense, test_dense):
    """Probabilities of `test` by a model of `train`, and of `train` out of fold; documents are sets of features."""

    def model(docs, d, y):
        pos, n = y.sum(), len(y)
        z = {}
        for f in set().union(*docs):
            has = np.array([f in s for s in docs])
            share = has.mean()
            v = (has[y == 1].sum() / pos - share) / math.sqrt((share * (1 - share) + 1 / n) / pos)
            if has.sum() > 1 and abs(v) >= toxicity.MIN_Z:
                z[f] = v
        chosen = sorted(z, key=lambda f: -abs(z[f]))[: toxicity.SELECTED]
        mean, scale = d.mean(0), np.maximum(d.std(0), 0.01)
        rows = lambda s, d: np.c_[[[f in x for f in chosen] for x in s], np.clip((d - mean) / scale, -8, 8), np.ones(len(s))].astype(float)
        w = logit_fit(rows(docs, d), y, toxicity.PENALTY)
        return lambda s, d: 1 / (1 + np.exp(-rows(s, d) @ w))

    oof = np.zeros(len(y))
    for f in range(toxicity.FOLDS):
        own = folds == f
        oof[own] = model([s for s, o in zip(train, own) if not o], dense[~own], y[~own])([s for s, o in zip(train, own) if o], dense[own])
    return model(train, dense, y)(test, test_dense), oof


def described(text):
    w, raw = H.words(text), text.encode()
    share = lambda kind: sum(map(kind, text)) / max(1, len(raw))
    signs = lambda c: c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return {(n, x[:n]) for x in w for n in (99, 4, 5)}, [share(lambda c: "A" <= c <= "Z"), share(signs), share(lambda c: "0" <= c <= "9"), float(bool(w))]


def test_the_chain_against_brute_force(spark):
    """Unhashed features, fitted and scored one by one; and the threshold tried at every step."""
    rng = np.random.default_rng(7)
    pairs = [(i, (t.upper() if i % 7 == 0 else t) + (" ###! 99" if i % 11 == 0 else "")) for i, t in noisy(5, 260)]
    label = {i: (int(i % 11 != 0), int(i % 5 == 0) ^ int(rng.random() < 0.03)) for i, _ in pairs if i < 200}
    sample = 120
    table = label_table(spark, [(i, *v) for i, v in label.items()])
    chain = toxicity.fit(H.docs(spark, pairs), table, sample)
    drawn = [r[0] for r in H.docs(spark, pairs, clash=False).filter("doc_id < 200").selectExpr("doc_id", "xxhash64(doc_id, xxhash64(text)) as h").orderBy("h").limit(sample).collect()]
    ids = sorted(drawn)
    folds = np.arange(sample) % toxicity.FOLDS
    assert len(ids) == sample
    parts = {i: described(t) for i, t in pairs}
    sets, dense = [parts[i][0] for i in ids], np.array([parts[i][1] for i in ids])
    every, every_dense = [parts[i][0] for i, _ in pairs], np.array([parts[i][1] for i, _ in pairs])
    junk, junk_oof = brute_link(sets, np.array([1.0 - label[i][0] for i in ids]), folds, every, dense, every_dense)
    toxic, toxic_oof = brute_link(sets, np.array([float(label[i][1]) for i in ids]), folds, every, np.c_[dense, junk_oof], np.c_[every_dense, junk])
    own = dict(zip(ids, toxic_oof))
    p = {i: own.get(i, toxic[k]) for k, (i, _) in enumerate(pairs) if i in label}
    f1 = lambda c: 2 * sum(label[i][1] for i in p if p[i] >= c) / (sum(x >= c for x in p.values()) + sum(v[1] for v in label.values()))
    assert f1(chain.cuts[1]) == pytest.approx(max(f1(c) for c in np.arange(0, 1, 1e-3)), abs=0.01)
    got = {r["doc_id"]: r for r in toxicity.scores(H.docs(spark, pairs), table, sample).collect()}
    for k, (i, _) in enumerate(pairs):
        assert got[i]["p_low_quality"] == pytest.approx(junk[k], abs=1e-4) and got[i]["p_toxic"] == pytest.approx(toxic[k], abs=1e-4)
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= chain.cuts[1])


def test_the_sample_is_bounded_in_bytes_and_drawn_from_documents_that_are_there(spark):
    df, labels = H.docs(spark, noisy(2, 200)), label_table(spark, [(i, 1, int(i % 5 == 0)) for i in range(200)] + [(9999, 1, 1)] * 50)
    assert 5 < len(toxicity.fit(df, labels, 200, 20_000).out_of_fold["toxic"]) < 60
    assert len(toxicity.fit(df, labels, 200).out_of_fold["toxic"]) == 200


def test_scores_of_a_very_long_text(spark):
    long = " ".join(["the river runs slowly"] * 40_000)
    got = {r["doc_id"]: r["score"] for r in quality.quality(H.docs(spark, [(1, long), (2, long[: len(long) // 2])]), label_table(spark, [(1, 1, 0)])).collect()}
    want = dict(ratios([(1, long), (2, long[: len(long) // 2])], {1}))
    assert got == pytest.approx(want, abs=1e-9)
