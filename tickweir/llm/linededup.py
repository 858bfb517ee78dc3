"""Line dedup over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import DOC_COLUMNS, materialise, partitions, pick, ship

KEPT = "doc_id bigint, dk bigint, pos int, part int, head boolean, first binary, last binary"


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def is_blank(line: Column) -> Column:
    """Whether a line holds nothing but spaces."""
    return F.trim(line) == ""


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document and position, the first of each hash; then one row that says with which hash
    the partition began and ended. The first hash's row is marked: it may have begun in an earlier partition."""
    part, last, first = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        new = np.ones(batch.num_rows, bool)
        new[1:] = (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])
        new[0] = (h[0][0], h[1][0]) != last
        at = np.flatnonzero(new)
        head = np.zeros(len(at), bool)
        if last is None:
            head[0] = True
            first = (h[0][0], h[1][0])
        last = (h[0][-1], h[1][-1])
        if len(at):
            kept = batch.take(pa.array(at))
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(3), kept.column(4), pa.array(np.full(len(at), part, np.int32)), pa.array(head), none, none], ["doc_id", "dk", "pos", "part", "head", "first", "last"])
    if last is not None:
        mark = [pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (first, last)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), *mark], ["doc_id", "dk", "pos", "part", "head", "first", "last"])


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dk (the text's hash), n_lines, kept (ascending positions) of every document; see line_bitmaps."""
    n = partitions(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").filter(F.col("text").isNotNull()).withColumn("dk", F.xxhash64("text"))
    lines = (
        docs.select("doc_id", "dk", F.posexplode(lines_of("text")).alias("pos", "line"))
        .filter(~is_blank(F.col("line")))
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc_id", "dk", "pos")
    )
    order = ["h1", "h2", "doc_id", "dk", "pos"]
    found = materialise(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(first_occurrences, KEPT), "lines")
    ends = found.filter("first is not null").select("part", "first", "last").orderBy("part").collect()  # a row a partition
    late = [b["part"] for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]]
    kept = found.filter("pos is not null")
    if late:
        kept = kept.filter(~(F.col("head") & F.col("part").isin(late)))
    blank = F.filter(F.transform(lines_of("text"), lambda x, i: F.when(is_blank(x), i)), lambda i: i.isNotNull())
    whole = docs.select("doc_id", "dk", F.size(lines_of("text")).alias("n"), blank.alias("ps"))
    rows = whole.unionByName(kept.select("doc_id", "dk", F.lit(None).cast("int").alias("n"), F.array("pos").alias("ps")))
    return rows.groupBy("doc_id", "dk").agg(F.max("n").alias("n_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("kept"))


def runs(kept: str) -> Column:
    """Ascending positions as an array of runs (start, end), both included."""
    p = F.col(kept)
    starts = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """Which lines of each document are the first of their kind in the corpus: doc_id, n_lines, n_kept, bitmap.

    The bitmap of kept lines is run-length compressed: "start-end" of each run of kept lines, counted from 0, both
    included, comma-separated; "" keeps none. Lines are ordered by doc_id (null first), then position; the hashes
    (128 bits) are range-partitioned together with document and position, so that a line repeated without end spreads
    over partitions, sorted by the same, and streamed. Where a partition begins with the hash that the one before ended
    with, its first row isn't a first occurrence.

    Lines are what lies between newlines, compared exactly. Blank lines, which hold nothing but spaces, are kept and never
    compared; a line of tabs is a line like any other. Texts and lines of any length are read whole. A null text has no
    row; an empty one has one line, blank. Rows with the same doc_id and text are one document and give one row; rows
    with the same doc_id and another text are documents of their own. Null ids are grouped the same way. An empty table
    gives no rows. Other columns are ignored.
    """
    r = kept_lines(docs).withColumn("runs", runs("kept"))
    return r.select("doc_id", "n_lines", F.size("kept").alias("n_kept"), F.concat_ws(",", F.transform("runs", lambda x: F.concat_ws("-", x["start"], x["end"]))).alias("bitmap"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with only the lines that line_bitmaps keeps; columns of documents, n_chars counted anew.

    A document that loses all its lines that aren't blank (as `line_bitmaps` has it) goes. Null texts and texts with blank
    lines only stay as they are. An empty table gives no rows. Rows with the same doc_id and text stay, each with the kept lines. Extra columns are dropped."""
    docs = pick(docs, *DOC_COLUMNS)
    bitmaps = kept_lines(docs).filter(F.size("kept") < F.col("n_lines")).select("doc_id", "dk", runs("kept").alias("runs"))
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["dk"] == b["dk"])
    left = docs.withColumn("dk", F.xxhash64("text"))
    joined = left.join(bitmaps, on(left, bitmaps), "left").select(*[left[c] for c in DOC_COLUMNS], "runs")
    parts = F.flatten(F.transform("runs", lambda x: F.slice(lines_of("text"), x["start"] + 1, x["end"] - x["start"] + 1)))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(parts, "\n"))
    done = joined.withColumn("new", text)
    done = done.filter(F.col("runs").isNull() | F.exists(lines_of("new"), lambda x: ~is_blank(x)))
    return done.select("doc_id", F.col("new").alias("text"), "lang", "source", F.when(F.col("runs").isNull(), F.col("n_chars")).otherwise(F.length("new")).cast("bigint").alias("n_chars"))


ship(__name__)
