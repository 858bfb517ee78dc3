"""Runs of word windows that share an anchor, packed into one row per bucket and block.

Every window of `size` words has an anchor: of the k-word grams in it, the one whose hash is least (the leftmost of
equal ones). Equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are a *run*: its
text travels once, as a normalised string, instead of once for each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.llm._common import partitions, ship
from tickweir.llm._text import U64, Words, blocks, gather, gram_hash, ids_of, mix, span_hash

LOW = U64((1 << 24) - 1)  # a gram's place in its document, beside 40 bits of its hash
FLUSH = 8 << 20  # packed bytes that a task holds before it hands them on
NO_DOC = np.iinfo(np.int64).max
PACKED = "bucket int, meta binary, data binary"
FIELDS = 6  # of a run in meta: doc_id, whether that is null, the text's tag, first word, windows, bytes
FOUND = "doc_id bigint, tag bigint, start bigint, n bigint, copies bigint, first_doc_id bigint"
BUCKET = 8 << 20  # bytes of text for a bucket, on average at most; fewer where the session's shuffle partitions allow


def layout(docs: DataFrame, spread: int) -> tuple[int, int, int]:
    """Rows, partitions and buckets: the session's shuffle partitions and `spread` buckets for each, or as many more as
    the bytes of text ask for."""
    n = partitions(docs.sparkSession)
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    many = max(n * spread, -(-size // BUCKET))
    return rows, max(n, many // (4 * spread)), many


def least(m: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if span < width else m


def first_least(m: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every `width` neighbours, and the first place where it is."""
    at, span = np.arange(len(m)), 1

    def step(by: int):
        later = m[by:] < m[:-by]
        return np.where(later, m[by:], m[:-by]), np.where(later, at[by:], at[:-by])

    while span * 2 <= width:
        m, at = step(span)
        span *= 2
    return step(width - span) if span < width else (m, at)


def anchors(words: Words, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each run: document (in the block), first window's word, number of windows, anchor's word, anchor's hash."""
    h = words.hashes()
    n = len(h)
    if n < size:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pos = np.arange(n) - words.first[doc]
    m = gram_hash(h, k) & ~LOW
    if len(pos) and int(pos.max()) > int(LOW):  # the place doesn't fit beside the hash
        m, place = first_least(m, size - k + 1)
    else:
        m = least(m | pos[: n - k + 1].astype(U64), size - k + 1)
        place = None
    valid = doc[: n - size + 1] == doc[size - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (m[1:] != m[:-1] if place is None else place[1:] != place[:-1])
    first = np.flatnonzero(new)
    # a run ends where the next window is invalid or starts another
    stop = np.flatnonzero(~valid | new)
    nxt = np.searchsorted(stop, first, "right")
    end = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], n - size + 1)
    d = doc[first]
    at = words.first[d] + (m[first] & LOW).astype(np.int64) if place is None else place[first]
    return d, first, end - first, at, m[first] >> U64(24)


def tags(words: Words, docs: np.ndarray) -> np.ndarray:
    """A hash of each document's words; with the doc_id it tells rows apart."""
    s, e = words.start[words.first[docs]], words.end[words.first[docs + 1] - 1]
    return span_hash(words.buf, s, e).view(np.int64)


def packer(size: int, k: int, bucket_of: Callable[[Words, np.ndarray, np.ndarray], np.ndarray], runs: Callable = anchors):
    """A mapInArrow function from (doc_id, text) to PACKED. bucket_of gets the words, the anchors' words and hashes."""

    def flush(held: list) -> pa.RecordBatch:
        bucket = np.concatenate([h[0] for h in held])
        meta = np.concatenate([h[1] for h in held])
        data = np.concatenate([h[2] for h in held])
        off = np.concatenate([[0], np.cumsum(meta[:, -1])])
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        packed, where = gather(data, off[:-1][order], off[1:][order])
        ends = np.r_[cut[1:], len(b)]
        metas, datas = [], []
        for x, y in zip(cut, ends):
            metas.append(pa.compress(np.ascontiguousarray(meta[order[x:y]].T).tobytes(), "zstd", asbytes=True))
            datas.append(pa.compress(packed[where[x] : where[y]].tobytes(), "zstd", asbytes=True))
        sizes = [(int(y - x), int(where[y] - where[x])) for x, y in zip(cut, ends)]
        metas = [np.array(s, np.int64).tobytes() + m for s, m in zip(sizes, metas)]
        return pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array(metas, pa.binary()), pa.array(datas, pa.binary())], ["bucket", "meta", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            ids, null = ids_of(batch.column(0))
            for a, b in blocks(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a))
                d, first, count, at, h = runs(words, size, k)
                if not len(d):
                    continue
                bucket = bucket_of(words, at, h)
                data, off = gather(words.buf, words.start[first], words.end[first + count + size - 2])
                own, of = np.unique(d, return_inverse=True)
                meta = np.stack([ids[a + d], null[a + d].astype(np.int64), tags(words, own)[of], first - words.first[d], count, np.diff(off)], 1)
                held.append((bucket, meta, data))
                weight += len(data)
                if weight > FLUSH:
                    yield flush(held)
                    held, weight = [], 0
        if held:
            yield flush(held)

    return pack


class Bucket:
    """The windows of one bucket: window i's bytes are buf[begin[i] : end[i]]; run[i] is its run."""

    def __init__(self, parts: list[tuple[bytes, bytes]], size: int):
        metas, datas = [], []
        for meta, data in parts:
            n, length = np.frombuffer(meta, np.int64, 2)
            metas.append(np.frombuffer(pa.decompress(meta[16:], int(n) * 8 * FIELDS, "zstd"), np.int64).reshape(FIELDS, int(n)))
            datas.append(np.frombuffer(pa.decompress(data, int(length), "zstd"), np.uint8))
        self.doc, null, self.tag, self.first, self.count, length = np.concatenate(metas, 1)
        self.null = null.astype(bool)
        self.size = size
        self.buf = np.concatenate([*datas, np.zeros(16, np.uint8)])
        n = len(self.buf) - 16
        off = np.concatenate([[0], np.cumsum(length)])
        space = self.buf[:n] == 32
        head = np.zeros(n + 1, bool)
        head[1:] = np.r_[space]
        head[off] = True
        head[n] = False
        tail = np.zeros(n + 1, bool)
        tail[:n] = space
        tail[off[1:]] = True
        self.wstart, self.wend = np.flatnonzero(head), np.flatnonzero(tail)
        word0 = np.concatenate([[0], np.cumsum(self.count + size - 1)])
        self.off, self.word0 = off, word0
        total = int(self.count.sum())
        self.run = np.repeat(np.arange(len(self.count)), self.count)
        self.nth = np.arange(total) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.word = word0[:-1][self.run] + self.nth
        self.begin, self.end = self.wstart[self.word], self.wend[self.word + size - 1]

    def words(self, step: int = 1 << 20) -> np.ndarray:
        """The words' hashes, worked out block by block."""
        out, a = np.empty(len(self.wstart), U64), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.wstart, self.wstart[a] + step)))
            lo, hi = int(self.wstart[a]), int(self.wend[b - 1])
            out[a:b] = span_hash(self.buf[lo:hi], self.wstart[a:b] - lo, self.wend[a:b] - lo)
            a = b
        return out

    @staticmethod
    def grams(h: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
        """The hash of every n words in a row, worked out block by block."""
        return np.concatenate([gram_hash(h[a : a + step + n - 1], n) for a in range(0, len(h), step)])

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether windows x and y have the same bytes."""
        length = self.end[x] - self.begin[x]
        ok = length == self.end[y] - self.begin[y]
        wide = np.ndarray((len(self.buf) - 7,), np.uint64, self.buf, strides=(1,))
        for at in range(0, int(length.max(initial=0)), 8):
            live = np.flatnonzero(ok & (length > at))
            left = np.minimum(length[live] - at, 8)
            diff = wide[self.begin[x[live]] + at] ^ wide[self.begin[y[live]] + at]
            diff &= np.where(left < 8, (U64(1) << (U64(8) * left.astype(U64) % U64(64))) - U64(1), ~U64(0))
            ok[live[diff != 0]] = False
        return ok

    def verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Group numbers of windows in `order`, where neighbours in a group are byte for byte equal; groups of unequal
        ones (a hash collision) are told apart by their bytes."""
        eq = np.flatnonzero(group[1:] == group[:-1])
        bad = np.zeros(0, np.int64)
        for a in range(0, len(eq), 1 << 18):
            e = eq[a : a + (1 << 18)]
            bad = np.r_[bad, e[~self.same(order[e], order[e + 1])]]
        if len(bad):
            group = group.copy()
            fresh = int(group.max()) + 1
            for g in np.unique(group[bad]):
                names: dict[bytes, int] = {}
                for i in np.flatnonzero(group == g):
                    w = order[i]
                    group[i] = fresh + names.setdefault(self.buf[self.begin[w] : self.end[w]].tobytes(), len(names))
                fresh += len(names)
        return group

    def found(self, order: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        """Stretches of repeated windows in each run. order: windows that may repeat; group: their verified groups."""
        by = np.argsort(group, kind="stable")
        order, group = order[by], group[by]
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(group)])
        owner = np.where(self.null, NO_DOC, self.doc)[self.run[order]]
        least = np.minimum.reduceat(owner, cut) if len(cut) else np.zeros(0, np.int64)
        copies = np.ones(len(self.run), np.int64)
        first = np.full(len(self.run), NO_DOC, np.int64)
        copies[order] = np.repeat(size, size)
        first[order] = np.repeat(least, size)
        twice = np.flatnonzero(copies > 1)
        new = np.ones(len(twice), bool)
        new[1:] = (np.diff(twice) != 1) | (self.run[twice[1:]] != self.run[twice[:-1]])
        s = np.flatnonzero(new)
        n = np.diff(np.r_[s, len(twice)])
        r = self.run[twice[s]] if len(s) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(copies[twice], s) if len(s) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(first[twice], s) if len(s) else np.zeros(0, np.int64)
        start = self.first[r] + self.nth[twice[s]] if len(s) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.doc[r], mask=self.null[r]), pa.array(self.tag[r]), pa.array(start), pa.array(n), pa.array(most), pa.array(low, mask=low == NO_DOC)], ["doc_id", "tag", "start", "n", "copies", "first_doc_id"])


def by_bucket(work: Callable[[Bucket], pa.RecordBatch], size: int):
    """A mapInArrow function over PACKED, sorted by bucket: work on one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, meta, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield work(Bucket(held, size))
                    held = []
                now = bucket
                held.append((meta, data))
        if held:
            yield work(Bucket(held, size))

    return run


def spans(found: DataFrame, size: int) -> DataFrame:
    """Stretches of windows merged into spans of words: doc_id, tag, start_word, end_word, windows (places counted once),
    copies, first_doc_id."""
    w = W.partitionBy("doc_id", "tag").orderBy("start", "n")
    stop = F.col("start") + F.col("n")
    return (
        found.withColumn("before", F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("fresh", F.greatest(F.lit(0), stop - F.greatest("start", "before")))
        .withColumn("island", F.sum(F.when(F.col("start") <= F.col("before") + F.lit(size - 1), 0).otherwise(1)).over(w))
        .groupBy("doc_id", "tag", "island")
        .agg(F.min("start").alias("start_word"), F.max(stop + F.lit(size - 1)).alias("end_word"), F.sum("fresh").alias("windows"), F.max("copies").alias("copies"), F.min("first_doc_id").alias("first_doc_id"))
        .drop("island")
    )


ship(__name__)
