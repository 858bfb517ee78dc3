"""SetSketch near duplicates (10)."""

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from tests.llm import helpers as H
from tickweir.llm import registry, setsketch
from tickweir.llm._text import Words


def groups(df):
    by = {}
    for r in df.collect():
        by.setdefault((r["group_id"], r["group_size"]), []).append(r["doc_id"])
    assert all(min(v) == k[0] and len(v) == k[1] for k, v in by.items())
    return sorted(map(sorted, by.values()))


def families(seed, n=40, copies=6, edits=(0.0, 0.01, 0.03, 0.06, 0.1)):
    """Documents and edited copies, some many times over; ids in random order."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"t{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        w = rng.choice(vocabulary, rng.integers(30, 150))
        texts.append(" ".join(w))
        for _ in range(int(rng.integers(0, copies))):
            e = rng.choice(edits)
            texts.append(" ".join(np.where(rng.random(len(w)) < e, rng.choice(vocabulary, len(w)), w)))
    ids = rng.permutation(len(texts))
    return [(int(i), t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_and_precision_against_all_pairs(spark, seed):
    pairs = families(seed)
    got = groups(setsketch.near_duplicates(H.docs(spark, pairs).repartition(3)))
    want = H.near_groups(pairs, setsketch.THRESHOLD)
    together = lambda gs: {(a, b) for g in gs for k, a in enumerate(g) for b in g[k + 1 :]}
    assert len(together(got) & together(want)) >= 0.9 * len(together(want)) and together(got) <= together(want)


def test_query_against_all_pairs_of_the_table(spark):
    d = f"{DATA}/sf0.001"
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert groups(registry.queries()["op10_near_duplicates"](spark, d)) == sorted(H.near_groups(pairs, setsketch.THRESHOLD))


def test_awkward_rows(spark):
    pairs = [*H.AWKWARD, (50, "a b"), (51, "A, b!"), (52, "b a"), (53, "solo"), (54, "Solo."), (56, "another text of some words, one of its own kind"), (55, "another text of some words, one of its own kind"), (56, "SOLO")]
    got = groups(setsketch.near_duplicates(H.docs(spark, pairs)))
    assert got == [[0, 0], [7, 8], [50, 51], [53, 54, 56], [55, 56]]
    assert setsketch.near_duplicates(H.docs(spark, pairs).limit(0)).count() == 0
    assert setsketch.near_duplicates(H.docs(spark, pairs[:1])).count() == 0
    left = setsketch.one_of_each(H.docs(spark, pairs))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = sorted((r["doc_id"] for r in left.collect()), key=lambda i: (i is not None, i or 0))
    assert ids == [None, None, 0, 2, 3, 4, 5, 7, 9, 50, 52, 53, 55]


def test_other_texts_of_a_used_id_stay(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    pairs = [(3, a), (7, a), (7, b), (0, c), (0, c), (0, d), (9, e), (9, e + " more"), (11, e)]
    left = setsketch.one_of_each(H.docs(spark, pairs).repartition(3)).collect()
    kept = sorted((r["doc_id"], r["text"]) for r in left)
    assert [x for x in kept if x[0] != 9] == [(0, c), (0, d), (3, a), (7, b)]
    assert len(kept) == 5 and kept[-1] in pairs[6:8]


def test_a_group_of_many_unequal_copies(spark):
    rng = np.random.default_rng(0)
    w = [f"t{i}" for i in range(200)]
    pairs = [(i, " ".join(w[:k] + [f"own{i}"] + w[k:])) for i, k in enumerate(rng.integers(0, 200, 700))]
    assert [len(g) for g in groups(setsketch.near_duplicates(H.docs(spark, pairs, clash=False)))] == [700]


def test_a_text_and_the_same_text_several_times_over(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for k, (n, times) in enumerate([(100, 2), (100, 10), (300, 2), (300, 10), (5, 40), (2, 30)]):
        w = " ".join(f"d{k}x{i}" for i in rng.permutation(n))
        pairs += [(10 * k, w), (10 * k + 1, " ".join([w] * times))]
    w = [f"e{i}" for i in range(100)]
    pairs += [(90, " ".join(w)), (91, " ".join(w + w[:80]))]
    want = sorted(H.near_groups(pairs, setsketch.THRESHOLD))
    assert [0, 1] in want and [10, 11] in want and [90, 91] in want
    assert groups(setsketch.near_duplicates(H.docs(spark, pairs))) == want


def test_distinct_shingles():
    col = pa.array(["", "a b c a b c a b c", "x", None, "a b c d"])
    h, begin = setsketch.distinct(*setsketch.shingles(Words(col)))
    assert np.diff(begin).tolist() == [0, 3, 1, 0, 2] and len(h) == begin[-1]


def sketch_of(sets):
    col = pa.array([" ".join(map(str, s)) for s in sets])
    h, begin = setsketch.shingles(Words(col))
    return setsketch.registers(h, begin), np.diff(begin).astype(float), h, begin


def test_registers_merge(spark):
    h = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    one = lambda x: setsketch.registers(x, np.array([0, len(x)]))
    assert np.array_equal(one(h), np.maximum(one(h[:200]), one(h[150:])))


def test_estimates_are_close_to_the_truth():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        n, share = int(rng.integers(50, 2000)), rng.random()
        both = int(n * share)
        h = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        k = setsketch.registers(np.r_[h[:n], h[n - both :]], np.array([0, n, 2 * n]))
        truth = both / (2 * n - both)
        errors.append(setsketch.estimate(k[:1], k[1:], np.array([float(n)]), np.array([float(n)]))[0] - truth)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_unlike_members_of_a_bucket_are_still_connected():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    k = setsketch.registers(np.concatenate([a, b, a, b, b]), np.arange(6) * 300)
    edges = setsketch.linked(k, np.full(5, 300), 0.5)
    assert sorted(map(tuple, map(sorted, edges))) == [(0, 2), (1, 3), (1, 4)]


def test_components_of_long_chains(spark):
    n = 200
    order = np.random.default_rng(0).permutation(n)
    chain = [(int(order[i]).to_bytes(2), int(order[i + 1]).to_bytes(2)) for i in range(n - 1) if i != 120]
    got = {bytes(r["node"]): bytes(r["comp"]) for r in setsketch.components(spark.createDataFrame(chain, "src binary, dst binary")).collect()}
    for part in (order[:121], order[121:]):
        assert {got[int(x).to_bytes(2)] for x in part} == {int(min(part)).to_bytes(2)}
