"""Suffix spans (2) and substring windows (7)."""

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA, same_rows
from tests.llm import helpers as H
from tickweir.llm import _runs, _text, registry, suffix, superkmer


def found_windows(df):
    return sorted(((r["doc_id"], r["windows"], r["max_copies"], r["spans"]) for r in df.collect()), key=repr)


def found_spans(df):
    return sorted(((r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"]) for r in df.collect()), key=repr)


def wanted(pairs, size):
    by = [(d[0], H.spans_of(w, size)) for d, w in H.repeated_windows(pairs, size).items()]
    windows = [(i, sum(s[2] for s in ss), max(s[3] for s in ss), ",".join(f"{s[0]}-{s[1]}" for s in ss)) for i, ss in by]
    return sorted(windows, key=repr), sorted(((i, s[0], s[1] - s[0], s[4]) for i, ss in by for s in ss), key=repr)


@pytest.mark.parametrize("seed,size,k", [(0, 5, 2), (1, 4, 3), (2, 3, 3)])
def test_against_all_windows(spark, seed, size, k):
    pairs = H.random_texts(seed)
    df = H.docs(spark, pairs).repartition(3)
    windows, spans = wanted(pairs, size)
    assert windows
    assert found_windows(superkmer.repeated_windows(df, size, k)) == windows
    assert found_spans(suffix.repeated_spans(df, size, k)) == spans
    assert found_spans(suffix.repeated_spans(df, size, k, every=True)) == spans


def test_awkward_rows(spark):
    df = H.docs(spark, H.AWKWARD)
    windows, spans = wanted(H.AWKWARD, 6)
    got = found_windows(superkmer.repeated_windows(df, 6, 2))
    assert got == windows and {r[0] for r in got} == {None, 0, 7, 8} and max(r[1] for r in got) == 30_000 - 5
    assert found_spans(suffix.repeated_spans(df, 6, 2)) == spans
    none = df.limit(0)
    assert superkmer.repeated_windows(none).count() == suffix.repeated_spans(none).count() == 0
    with pytest.raises(ValueError):
        superkmer.repeated_windows(df, 5, 6)
    with pytest.raises(KeyError):
        suffix.repeated_spans(df.drop("text"))


def test_rows_without_an_id_or_of_one_id_are_told_apart(spark):
    """Two texts of one id (or none) that share words 0-80 of one and 10-90 of the other, and a repeated row."""
    w = [f"v{i}" for i in range(90)]
    for i in (None, 4):
        pairs = [(i, " ".join(w[:80])), (i, " ".join([*(f"u{j}" for j in range(10)), *w[:80]])), (9, "own " * 20), (8, " ".join(w[:60])), (8, " ".join(w[:60]))]
        df = H.docs(spark, pairs)
        first = 8 if i is None else 4
        spans = [(8, 0, 60, first), (i, 0, 80, first), (i, 10, 80, first)]
        assert found_spans(suffix.repeated_spans(df)) == sorted(spans, key=repr) == wanted(pairs, 50)[1]
        assert found_windows(superkmer.repeated_windows(df)) == wanted(pairs, 50)[0] == sorted([(8, 11, 4, "0-60"), (i, 31, 4, "0-80"), (i, 31, 4, "10-90")], key=repr)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(_runs, "BUCKET", 100)
    pairs = H.random_texts(3)
    df = H.docs(spark, pairs)
    assert found_spans(suffix.repeated_spans(df, 5, 2)) == wanted(pairs, 5)[1]
    assert found_windows(superkmer.repeated_windows(df, 5, 2)) == wanted(pairs, 5)[0]


def one_bucket(texts, size, k, runs=_runs.anchors):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    packed = _runs.packer(size, k, lambda w, at, h: np.zeros(len(at), np.int64), runs)(iter([batch]))
    return _runs.Bucket([(m, d) for b in packed for m, d in zip(b["meta"].to_pylist(), b["data"].to_pylist())], size)


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_are_in_lexicographic_order(seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join("x" * int(n) for n in rng.integers(1, 4 + 6 * seed, rng.integers(0, 30))) for _ in range(40)] + ["é 日本 x", "x" * 70 + " y z", "x" * 70 + " y z"]
    for runs in (_runs.anchors, suffix.every_word):
        b = one_bucket(texts, 3, 2, runs)
        order, common, length = suffix.multikey_sort(b)
        text = [b.buf[x:y].tobytes() for x, y in zip(b.begin, b.end)]
        got = [text[i] for i in order]
        assert got == sorted(text) and length.tolist() == list(map(len, text)) and len(text) == sum(max(0, len(t.split()) - 2) for t in texts)
        prefix = [0] + [next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x, y in zip(got, got[1:])]
        assert common.tolist() == prefix


def test_places_that_do_not_fit_beside_the_hash(monkeypatch):
    text = pa.array([" ".join(map(str, np.random.default_rng(i).integers(0, 3, 90))) for i in range(20)])
    want = _runs.anchors(_text.Words(text), 10, 3)
    m = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 7, 16):
        low, at = _runs.first_least(m, width)
        assert low.tolist() == [m[i : i + width].min() for i in range(201 - width)] == _runs.least(m, width).tolist()
        assert at.tolist() == [i + int(m[i : i + width].argmin()) for i in range(201 - width)]
    monkeypatch.setattr(_runs, "LOW", np.uint64(7))
    got = _runs.anchors(_text.Words(text), 10, 3)
    assert all(np.array_equal(x, y) for x, y in zip(got[:4], want[:4]))


@pytest.mark.parametrize("name", ["op2_suffix_spans", "op7_substring_windows"])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, f"{DATA}/sf0.001"), duck(registry.oracle_sql()[name]))


def test_words_are_those_of_the_expression():
    texts = ["Hello, “world” x", "", None, "é É·a", "a", "b c", "!!", "x…y　z q", "end ", "ÀÉß µ ª 日本語 \U0001f600"]
    w = _text.Words(pa.array(texts))
    got = [[bytes(w.buf[w.start[i] : w.end[i]]).decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert got == [H.words(t) for t in texts]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    text = [" ".join(map(str, rng.integers(0, 3, 60))) for _ in range(30)]
    w = _text.Words(pa.array(text))
    d, first, count, at, h = _runs.anchors(w, 10, 3)
    by = {}
    for i in range(len(d)):
        for x in range(first[i], first[i] + count[i]):
            gram = bytes(w.buf[w.start[x] : w.end[x + 9]])
            assert by.setdefault(gram, (at[i] - x, h[i])) == (at[i] - x, h[i])
    assert count.sum() == 30 * 51


def test_a_hash_collision_is_told_apart():
    texts = pa.array(["a b c d", "a b c d", "e f g h"])
    parts = [(b["meta"][0].as_py(), b["data"][0].as_py()) for b in _runs.packer(4, 2, lambda w, at, h: np.zeros(len(at), np.int64))(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], ["doc_id", "text"])]))]
    b = _runs.Bucket(parts, 4)
    group = b.verified(np.arange(3), np.zeros(3, np.int64))
    assert len(set(group)) == 2 and sorted(np.unique(group, return_counts=True)[1]) == [1, 2]
