"""Quality by hashed n-gram likelihood ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import materialise, pick, ship
from tickweir.llm._text import MULT_B, U64, blocks, buffers, mix, span_hash

BITS = 18  # buckets of the multinomials
SMOOTH = 1.0  # added to every bucket's count
HELD = 4 << 20  # label rows that a broadcast may hold; more are joined by a shuffle
STEP = 0.01  # thresholds are multiples of it
FOLDS = 4  # of labelled documents, for the threshold: each is scored without the trusted ones of its own fold
GRAMS = U64(MULT_B)
TARGETS = [f"t{f}" for f in range(FOLDS)]


def token_kinds() -> np.ndarray:
    k = np.full(256, 2, np.int8)  # signs
    k[[*range(33)]] = 0
    k[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return k


def grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By block: its documents (from, to), and of each token and each two tokens in a row the document in the block and
    the bucket. Tokens are runs of letters and digits and runs of signs, their case kept."""
    kind = token_kinds()
    for a, b in blocks(col):
        raw, off = buffers(col.slice(a, b - a).cast(pa.large_string()).fill_null(""))
        if not len(raw):
            continue
        k = kind[raw]
        edge = np.ones(len(k) + 1, bool)
        np.not_equal(k[1:], k[:-1], out=edge[1:-1])
        edge[off] = True
        cut = np.flatnonzero(edge)
        inside = k[cut[:-1]] > 0
        start, end = cut[:-1][inside], cut[1:][inside]
        h = span_hash(raw, start, end)
        doc = np.searchsorted(off, start, "right") - 1
        pair = doc[1:] == doc[:-1]
        two = mix(h[:-1][pair] * GRAMS + h[1:][pair])
        shift = U64(64 - BITS)
        yield a, b, np.r_[doc, doc[1:][pair]], np.r_[h >> shift, two >> shift].astype(np.int64)


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, fold) to (bucket, raw, t0 ..): the partition's counts, over all texts and over the trusted ones by fold; the
    fold is -1 where the text isn't trusted."""
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros((FOLDS, 1 << BITS), np.int64)
    for batch in batches:
        fold = batch.column(1).to_numpy(zero_copy_only=False)
        for a, _, doc, bucket in grams(batch.column(0)):
            raw += np.bincount(bucket, minlength=1 << BITS)
            own = fold[a + doc]
            for f in range(FOLDS):
                target[f] += np.bincount(bucket[own == f], minlength=1 << BITS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), *[pa.array(t[at]) for t in target]], ["bucket", "raw", *TARGETS])


def ratios(bucket: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, log P(target) - log P(raw), both smoothed."""
    r, t = np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)
    r[bucket] += raw
    t[bucket] += target
    return np.log(t / t.sum()) - np.log(r / r.sum())


def scorer(ratio: np.ndarray, held_out: np.ndarray):
    """(doc_id, text, fold) to (doc_id, score, unseen): the score, and that by ratios without the document's fold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            total, unseen, n = (np.zeros(batch.num_rows) for _ in range(3))
            for a, b, doc, bucket in grams(batch.column(1)):
                total[a:b] = np.bincount(doc, ratio[bucket], b - a)
                unseen[a:b] = np.bincount(doc, held_out[fold[a + doc], bucket], b - a)
                n[a:b] = np.bincount(doc, minlength=b - a)
            none, n = n == 0, np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total / n, mask=none), pa.array(unseen / n, mask=none)], ["doc_id", "score", "unseen"])

    return score


def threshold(scored: DataFrame, known: DataFrame) -> float:
    """The multiple of STEP that best parts labelled documents of good and of low quality: the greatest sum of the
    share of good ones kept and the share of low ones left out; of the multiples that share it, the middle. 0 without
    documents of both kinds."""
    both = scored.join(known, "doc_id").filter("unseen is not null")
    bins = both.groupBy(F.floor(F.col("unseen") / STEP).alias("bin")).agg(F.sum("good").alias("good"), F.sum(F.lit(1) - F.col("good")).alias("low"))
    rows = sorted(map(tuple, bins.collect()))  # as many as score bins
    good, low = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not low:
        return 0.0
    best, lo, hi, kept, out = -1.0, 0, 0, good, 0
    for i, (k, g, b) in enumerate(rows):
        j = kept / good + out / low  # of the threshold k * STEP
        if j > best + 1e-12:
            best, lo, hi = j, rows[i - 1][0] + 1 if i else k, k
        kept, out = kept - g, out + b
    return round((lo + hi) / 2 * STEP, 6)


def quality(docs: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, score and keep of every document.

    Two multinomials over hashed single tokens and pairs of tokens: that of trusted documents (labelled as of good
    quality) and that of the raw corpus, every document. A document's score is the mean of its n-grams' log likelihood
    ratios; it is kept if the score is at least the threshold, which is set on all labelled documents (see threshold),
    each scored by a target without its own fold, as a trusted document's score by its own words would be too good.
    Nothing is drawn at random.

    A text without tokens, null or empty, has a null score and isn't kept. Repeated rows and null ids are scored as any
    (a null id has no label). Repeated labels of an id count as the worst of them. Without labels every ratio compares
    the smoothing to the corpus and the threshold is 0. An empty table gives no rows. Other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text")
    known = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    small = known.count() <= held
    good = known.filter("good = 1")
    fold = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)), F.lit(0)).cast("int")
    marked = docs.join(F.broadcast(good) if small else good, "doc_id", "left").select("text", F.when(F.col("good").isNotNull(), fold).otherwise(-1).alias("fold"))
    summed = marked.mapInArrow(counts, f"bucket int, raw bigint, {', '.join(f'{t} bigint' for t in TARGETS)}").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", *TARGETS)])
    got = summed.toPandas()  # a row a bucket
    bucket, raw, by = got["bucket"].to_numpy(int), got["raw"].to_numpy(float), got[TARGETS].to_numpy(float).T
    held_out = np.stack([ratios(bucket, raw, by.sum(0) - t) for t in by]).astype(np.float32)
    ratio = ratios(bucket, raw, by.sum(0))
    scored = materialise(docs.withColumn("fold", fold).mapInArrow(scorer(ratio, held_out), "doc_id bigint, score double, unseen double"), "scores")
    cut = threshold(scored, known)
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= F.lit(cut), F.lit(False)).alias("keep"))


ship(__name__)
