"""Token counts (3), decontamination (5) and line dedup (6)."""

import numpy as np
import pytest
import tiktoken

from tests.conftest import DATA, same_rows
from tests.llm import helpers as H
from tickweir.llm import bpe, decontam, linededup, registry


@pytest.fixture(scope="module")
def encoding():
    with open(bpe.VOCABULARY, "rb") as f:
        return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_counts_are_the_tokenizers(spark, encoding):
    pairs = [*H.AWKWARD, (20, "x" * 20_000), (21, "<|endoftext|> it's  \t\n\n tab"), (22, "日本語のテキスト 😀😀"), (23, "ab" * 500)]
    got = sorted(map(tuple, bpe.token_counts(H.docs(spark, pairs)).collect()), key=repr)
    assert got == sorted([(i, None if t is None else len(encoding.encode_ordinary(t))) for i, t in pairs], key=repr)
    assert bpe.token_counts(H.docs(spark, pairs).limit(0)).count() == 0


def test_counts_of_a_whole_table(spark, encoding):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = dict(map(tuple, registry.queries()["op3_token_counts"](spark, f"{DATA}/sf0.001").collect()))
    assert got == {r["doc_id"]: len(encoding.encode_ordinary(r["text"])) for r in df.collect()}


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        i = int(np.argmin(r))
        if r[i] == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def test_merging_with_ties():
    rng = np.random.default_rng(0)
    for _ in range(300):
        ranks = {bytes([97 + i]): i for i in range(3)}
        while len(ranks) < 12:
            a, b = (list(ranks)[i] for i in rng.integers(0, len(ranks), 2))
            ranks.setdefault(a + b, len(ranks))
        piece = bytes(97 + rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint8))
        assert bpe.merged_length(piece, ranks) == (1 if piece in ranks else naive(piece, ranks))


ITEMS = [(1, "The quick brown fox jumps over the lazy dog today."), (2, "one two three four five"), (3, "too short"), (None, "one two three four five six"), (4, None), (1, "The quick brown fox jumps over the lazy dog today."), (5, "a quick brown fox jumps over the lazy dog"), (6, "what?"), (7, "Too\nshort"), (8, "!"), (9, "")]


def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, TEXT string")


def leak_rows(pairs):
    out = []
    for i, t in pairs:
        hits = set(H.leaks(t, [x for x in ITEMS if x[1]]))
        if hits:
            cover = {w for a, n, _ in hits for w in range(a, a + n)}
            n = len(H.words(t))
            out.append((i, ",".join(map(str, sorted({x for *_, x in hits}))), len(hits), len(cover), n, "document" if 2 * len(cover) >= n else "span"))
    return sorted(out, key=repr)


LEAKY = [*H.AWKWARD, (30, "Intro. THE QUICK\nbrown fox -- jumps over the lazy dog, today! Outro " + "pad " * 30), (31, "two three four five one two three four six"), (32, "The quick brown fox jumps over the"), (33, H.LONG + " One, two... three four five!"), (34, "this is too short\nToo, short!\n\nto tell what"), (35, "What\n" + "and so on " * 9 + "\nwhat"), (36, "too"), (37, "short\ntoo\nshort what")]


def test_leaks_against_brute_force(spark):
    df = H.docs(spark, LEAKY)
    for held in (decontam.HELD, 40):  # in one scan, and in many
        got = decontam.contaminated(df, bench(spark), held=held)
        assert sorted(map(tuple, got.collect()), key=repr) == leak_rows(LEAKY)
    assert decontam.contaminated(df.limit(0), bench(spark)).count() == 0
    assert decontam.contaminated(df, bench(spark).filter("item_id > 99")).count() == 0


def test_spans_are_cut_and_documents_go(spark):
    df = H.docs(spark, LEAKY)
    left = decontam.decontaminate(df, bench(spark))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: r for r in left.collect() if r["doc_id"] is not None}
    assert set(got) == {2, 3, 4, 5, 7, 8, 9, 30, 31, 32, 33, 34, 35, 36, 37}  # 0, seven words of which five are a benchmark item, goes
    assert got[30]["text"] == "Intro. Outro " + "pad " * 30 and got[30]["n_chars"] == len(got[30]["text"])
    assert got[33]["text"] == H.LONG + " " and got[32]["text"] == LEAKY[-6][1] and got[2]["text"] is None
    assert got[34]["text"] == "this is too short\nto tell what" and got[35]["text"] == "and so on " * 9 + "\n" and got[37]["text"] == LEAKY[-1][1]
    assert decontam.contaminated(left, bench(spark)).count() == 0


def test_spans_are_cut_in_one_scan_and_in_many(spark):
    df = H.docs(spark, LEAKY)
    one, many = (sorted(map(tuple, decontam.decontaminate(df, bench(spark), held=held).collect()), key=repr) for held in (decontam.HELD, 40))
    assert one == many and len(one) < len(LEAKY)


def test_short_items_in_sql(spark, duck, tmp_path):
    import duckdb

    docs, items = H.docs(spark, [(i, t) for n, (i, t) in enumerate(LEAKY) if n > 10 and i is not None], clash=False), spark.createDataFrame([x for x in ITEMS if x[0] not in (None, 1) and x[1]], "item_id bigint, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        con.register(name, df.toPandas())
    same_rows(decontam.contaminated(docs, items), con.sql(registry.oracle_sql()["op5_contaminated"]))


@pytest.mark.parametrize("name", ["op5_contaminated", "op6_line_bitmaps"])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, f"{DATA}/sf0.001"), duck(registry.oracle_sql()[name]))


def bitmaps(pairs):
    out = []
    for (i, t), keep in H.kept_lines(pairs).items():
        runs = []
        for k in keep:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        out.append((i, len(t.split("\n")), len(keep), ",".join(f"{a}-{b}" for a, b in runs)))
    return sorted(out, key=repr)


LINED = [(-3, "\t"), (-2, "\t\n "), (-1, " \n\t\n\r"), *H.AWKWARD, (40, "a\n\nb\na\nc"), (41, "c\nb"), (42, "b\nd\nsame line\ne\n"), (43, "a\r\nA\n a"), (44, "same line")]


def test_lines_against_brute_force(spark):
    df = H.docs(spark, LINED).repartition(3)
    assert sorted(map(tuple, linededup.line_bitmaps(df).collect()), key=repr) == bitmaps(LINED)
    assert linededup.line_bitmaps(df.limit(0)).count() == 0


def test_one_line_over_several_partitions(spark):
    """A line so frequent that its rows fill partitions: only the first of all stays."""
    pairs = [(i, f"hot\nown {i}\nhot") for i in range(5000)]
    got = {r["doc_id"]: r["bitmap"] for r in linededup.line_bitmaps(H.docs(spark, pairs, clash=False).repartition(5)).collect()}
    assert got.pop(0) == "0-1" and set(got.values()) == {"1-1"}


def test_lines_are_dropped(spark):
    got = linededup.drop_repeated_lines(H.docs(spark, LINED))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    by = H.kept_lines(LINED)
    want = []
    for i, t in LINED:
        if t is None:
            want.append((i, None))
            continue
        lines = t.split("\n")
        new = "\n".join(lines[k] for k in by[i, t])
        if len(by[i, t]) == len(lines) or any(x.strip(" ") for x in new.split("\n")):
            want.append((i, new))
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert {r["doc_id"]: r["n_chars"] for r in got.collect()}[42] == len("d\ne\n")
    assert {-3, -1} <= {i for i, _ in rows} and -2 not in {i for i, _ in rows}
