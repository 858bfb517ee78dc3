"""Suffix-array dedup: range-partitioned suffixes, sorted bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import pick, ship
from tickweir.llm._runs import anchors, Bucket, by_bucket, FOUND, layout, PACKED, packer, spans
from tickweir.llm._text import blocks, Words

SIZE, K, SPREAD = 50, 6, 16
KEY = 48  # bytes of the leading tokens that order the suffixes


def leading(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """The first k words of the suffixes that start at words `at`, as byte strings of KEY bytes, cut or zero-padded."""
    out = np.zeros((len(at), KEY), np.uint8)
    length = np.minimum(words.end[at + k - 1] - words.start[at], KEY)
    for i in range(KEY):
        live = np.flatnonzero(length > i)
        out[live, i] = words.buf[words.start[at[live]] + i]
    return out.view(f"S{KEY}").ravel()


def every_word(words: Words, size: int, k: int) -> tuple[np.ndarray, ...]:
    """As `anchors`, with each window a run of its own that is anchored at its first word."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    first = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)
    return doc[first], first, np.ones(len(first), np.int64), first, np.zeros(len(first), np.uint64)


def multikey_sort(b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket's suffixes in lexicographic order of their first `size` words, as numbers; of each the bytes it has in
    common with the one before it; and its length in bytes.

    Multikey quicksort, all parts of a depth at a time: a part's suffixes are sorted by their next eight bytes, which
    parts them anew; parts of one suffix are done, as are suffixes that have ended, and a part whose suffixes all go on
    with the same eight bytes stays as it is. Zero bytes pad what ends, and no word holds one."""
    length = b.end - b.begin
    order, common = np.arange(len(length)), np.zeros(len(length), np.int64)
    wide = np.ndarray((max(0, len(b.buf) - 7),), ">u8", b.buf, strides=(1,))
    live = np.arange(len(order))  # places in the order whose part isn't done
    head = np.zeros(len(order), bool)  # which of them begin a part
    head[:1] = True
    for depth in range(0, int(length.max(initial=0)), 8):
        if not len(live):
            break
        s = order[live]
        left = np.clip(length[s] - depth, 0, 8)
        key = wide[np.minimum(b.begin[s] + depth, len(wide) - 1)].astype(np.uint64)
        key &= np.where(left < 8, ~(~np.uint64(0) >> (np.uint64(8) * left.astype(np.uint64) & np.uint64(63))), ~np.uint64(0))
        part = np.cumsum(head) - 1
        mixed = np.zeros(int(part[-1]) + 1, bool)
        mixed[part[key != key[np.flatnonzero(head)][part]]] = True
        if mixed.any():
            at = np.flatnonzero(mixed[part])
            by = at[np.argsort(key[at], kind="stable")] if len(mixed) == 1 else at[np.lexsort((key[at], part[at]))]
            s[at], key[at], left[at] = s[by], key[by], left[by]
            order[live] = s
            differ = np.flatnonzero((key[1:] != key[:-1]) & ~head[1:]) + 1
            head[differ] = True
            common[live[differ]] = depth + shared_bytes(key[differ - 1] ^ key[differ])
        ended = left < 8
        same = np.flatnonzero(ended & ~head)  # a part's suffixes that end here have the same bytes: they are equal
        common[live[same]] = depth + left[same]
        alone = head & np.r_[head[1:], True]
        go = ~(ended | alone)
        live, head = live[go], head[go]
    common[live[~head]] = length[order[live[~head]]]
    return order, common, length


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """How many leading bytes of eight are equal, where `diff` is their exclusive or."""
    return 7 - np.searchsorted(np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64), diff, "right")


def sort_bucket(b: Bucket):
    order, common, length = multikey_sort(b)
    equal = np.zeros(len(order), bool)  # to the suffix before
    equal[1:] = (common[1:] == length[order[1:]]) & (common[1:] == length[order[:-1]])
    group = np.cumsum(~equal)
    again = equal | np.r_[equal[1:], False]
    return b.found(order[again], group[again])


def splitters(docs: DataFrame, total: int, buckets: int, k: int = K, size: int = SIZE, seed: int = 11, runs: Callable = anchors) -> np.ndarray:
    """Leading tokens that part a sample of the suffixes evenly: of four documents a bucket, up to eight suffixes.

    They only balance the buckets; any splitters give the same result."""

    def keys(batches):
        for batch in batches:
            for a, z in blocks(batch.column(0)):
                words = Words(batch.column(0).slice(a, z - a))
                doc, _, _, at, _ = runs(words, size, k)
                if len(doc):
                    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    stride = np.maximum(1, np.bincount(doc)[doc] // 8)
                    yield pa.RecordBatch.from_arrays([pa.array(leading(words, at[nth % stride == 0], k).tolist(), pa.binary())], ["key"])

    if not total:
        return np.zeros(0, f"S{KEY}")
    sample = docs.select("text").sample(min(1.0, max(2000, 4 * buckets) / total), seed)
    rows = np.sort(np.array([bytes(r[0]) for r in sample.mapInArrow(keys, "key binary").collect()], f"S{KEY}"))
    return np.unique(rows[(np.arange(1, buckets) * len(rows)) // buckets]) if len(rows) else rows


def repeated_spans(docs: DataFrame, size: int = SIZE, k: int = K, every: bool = False) -> DataFrame:
    """Maximal spans of words covered by windows of `size` words that occur more than once in the corpus.

    One row a span: doc_id, start_word, n_words, first_doc_id (the least doc_id in which a window of the span occurs;
    a document may keep its span where that is itself). The suffix of every word is sorted by its first `size` words.
    Splitters from a sample part the suffixes into ranges of leading words: with `every` of their own first k, for which
    each suffix has to travel with all its words; without it of the k from the suffix's anchor on (of the k-word grams in
    its first `size` words the one of least hash, the leftmost of equal ones), so that consecutive suffixes with one
    anchor travel as one text. Both find the same. Each bucket is sorted in lexicographic order by multikey quicksort;
    suffixes that have all their `size` words in common with a neighbour, byte for byte, repeat. Splitters are whole
    leading words, so suffixes that are equal never lie on two sides of a boundary, and stretches of one document that
    come from different buckets are joined across their boundaries.

    Words are runs of letters and digits, lower-cased. A null or empty text and one under `size` words has no span; an
    empty table gives no rows; a text of any length is read whole. Rows are told apart by doc_id (null like any other)
    and words: several texts of one doc_id have spans of their own. Repeated rows are occurrences like any other and are
    reported once. first_doc_id is null where all documents of a span have a null doc_id. Other columns are ignored.
    """
    if not 0 < k <= size:
        raise ValueError("k must be from 1 to size")
    docs = pick(docs, "doc_id", "text")
    runs = every_word if every else anchors
    total, n, many = layout(docs, SPREAD)
    cuts = splitters(docs, total, many, k, size, runs=runs)
    bucket = lambda words, at, h: np.searchsorted(cuts, leading(words, at, k), "right")
    packed = docs.mapInArrow(packer(size, k, bucket, runs), PACKED)
    found = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(sort_bucket, size), FOUND)
    return spans(found, size).select("doc_id", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


ship(__name__)
