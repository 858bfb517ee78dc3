"""Substring dedup by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import pick, ship
from tickweir.llm._runs import FOUND, PACKED, Bucket, by_bucket, layout, packer, spans
from tickweir.llm._text import U64, mix

SIZE, K, SPREAD = 50, 6, 16


def count_bucket(b: Bucket):
    """Sort the bucket's windows and count the equal ones."""
    h = b.grams(b.words(), b.size)[b.word]
    order = np.argsort(h)
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(new)
    alone = new & np.r_[new[1:], True]
    order, group = order[~alone], group[~alone]
    return b.found(order, b.verified(order, group))


def repeated_windows(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """Documents with windows of `size` words that occur more than once in the corpus (in one document or several).

    One row a document: doc_id, windows (its repeated windows), max_copies, spans ("start-end" in words, end not
    included, in order, comma-separated). Consecutive windows that share a minimiser (least hash among the window's
    k-word grams) travel as one packed string to the minimiser's bucket, where the windows are sorted and counted;
    equal neighbours are compared byte by byte.

    Words are runs of letters and digits, lower-cased. A null or empty text and one under `size` words has no windows
    and no row; an empty table gives no rows. A text of any length is read whole. Rows are told apart by doc_id (null
    like any other) and words: each such document has a row of its own, several texts of one doc_id several. Repeated
    rows are occurrences like any other, so a repeated long text is found, but they share one row and its places count
    once. Of equal minimisers in a window the leftmost is its anchor. Other columns are ignored.
    """
    if not 0 < k <= size:
        raise ValueError("k must be from 1 to size")
    docs = pick(docs, "doc_id", "text")
    _, n, many = layout(docs, SPREAD)
    bucket = lambda words, at, h: (mix(h.copy()) % U64(many)).astype(np.int64)
    packed = docs.mapInArrow(packer(size, k, bucket), PACKED)
    found = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(count_bucket, size), FOUND)
    merged = spans(found, size)
    return merged.groupBy("doc_id", "tag").agg(
        F.sum("windows").alias("windows"),
        F.max("copies").alias("max_copies"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))), lambda s: F.concat_ws("-", s["start_word"], s["end_word"]))).alias("spans"),
    ).drop("tag")


ship(__name__)
