"""Toxicity by classifier chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickweir.llm._common import discard, DOC_COLUMNS, materialise, pick, ship
from tickweir.llm._text import blocks, buffers, BYTE_A, mix, MULT_A, Pair, powers, U64, Words

BITS = 18  # hashed features: words and their first 4 and 5 bytes
SAMPLE = 6000  # labelled documents that the models are fitted on, at most
SAMPLE_BYTES = 64 << 20  # of text in them, at most
HELD = 4 << 20  # label rows that a broadcast may hold; more are joined by a shuffle
CUT = 1e-4  # thresholds are multiples of it
SELECTED = 256  # hashed features of a model, those whose association with the category is strongest
MIN_Z = 4.5  # standard errors of the association that a feature must have, so that none is there by chance
FOLDS = 3
DENSE = 4  # shares of upper-case letters, of signs and of digits; documents with any word
PENALTY = 1.0


def kinds() -> np.ndarray:
    k = np.zeros(256, np.int8)
    k[65:91] = 1
    k[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
    k[48:58] = 3
    return k


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: its documents (from, to), the places of features (document in the block, hash) and DENSE shares."""
    kind = kinds()
    for a, b in blocks(col):
        part = col.slice(a, b - a)
        words = Words(part)
        doc = np.repeat(np.arange(b - a), np.diff(words.first))
        p, inv = powers(MULT_A, len(words.buf) + 1)
        acc = np.zeros(len(words.buf) + 1, U64)
        np.cumsum(BYTE_A[words.buf] * p[: len(words.buf)], dtype=U64, out=acc[1:])
        s, e = words.start, words.end
        hashed = [mix((acc[np.minimum(s + n, e)] - acc[s]) * inv[s] + U64(n)) >> U64(64 - BITS) for n in (1 << 30, 4, 5)]
        raw, off = buffers(part.cast(pa.large_string()).fill_null(""))
        dense = np.zeros((b - a, DENSE))
        n = np.maximum(np.diff(off), 1)
        for k in (1, 2, 3):
            run = np.concatenate([[0], np.cumsum(kind[raw] == k)])
            dense[:, k - 1] = (run[off[1:]] - run[off[:-1]]) / n
        dense[:, 3] = np.diff(words.first) > 0
        yield a, b, np.tile(doc, 3), np.concatenate(hashed).astype(np.int64), dense


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + ridge * w
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * v) @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


class Link:
    """One category's model: which hashed features it uses, and its coefficients."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, dense: np.ndarray, y: np.ndarray, selected: int):
        n, pos = len(y), max(1.0, y.sum())
        self.constant = None if 0 < y.sum() < n else float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        has = np.bincount(feature, minlength=1 << BITS)
        with_y = np.bincount(feature, y[doc], 1 << BITS)
        share = has / n
        z = (with_y / pos - share) / np.sqrt((share * (1 - share) + 1 / n) / pos)
        z[(has < 2) | (np.abs(z) < MIN_Z)] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:selected]
        best = best[z[best] != 0]
        self.at = np.full(1 << BITS, -1, np.int32)
        self.at[best] = np.arange(len(best))
        self.width = int(self.at.max() + 1)
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-2)
        if self.constant is None:
            self.w = logistic(np.c_[self.matrix(doc, feature, n), self.standard(dense)], y)

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -8, 8)

    def matrix(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, self.width))
        k = self.at[feature]
        x[doc[k >= 0], k[k >= 0]] = 1
        return x

    def logit(self, doc: np.ndarray, feature: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Log-odds of documents; a feature counts once however often it occurs. With one class to learn from, they are
        that class's everywhere."""
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        k = self.at[feature]
        use = k >= 0
        pair = np.unique(doc[use].astype(np.int64) * max(1, self.width) + k[use])
        z = np.bincount(pair // max(1, self.width), self.w[pair % max(1, self.width)], len(dense)) if len(pair) else np.zeros(len(dense))
        return np.clip(z + self.standard(dense) @ self.w[self.width : -1] + self.w[-1], -35, 35)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def cut_of(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1; of the stretch of thresholds that share it, the middle."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    last = np.r_[p[order][1:] != p[order][:-1], True]
    f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else 0.0)) / 2)


class Chain:
    """Models of categories in order; each has the probabilities of the earlier ones as features, in training those
    that models fitted on the other folds gave."""

    def __init__(self, texts: pa.Array, labels: dict[str, np.ndarray], selected: int = SELECTED, folds: int = FOLDS):
        docs, hashes, dense = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros((0, DENSE))]
        for a, _, d, h, x in features(texts):
            pair = np.unique((d + a) << BITS | h)
            docs.append((pair >> BITS).astype(np.int32))
            hashes.append((pair & ((1 << BITS) - 1)).astype(np.int32))
            dense.append(x)
        doc, feature, x = np.concatenate(docs), np.concatenate(hashes), np.concatenate(dense)
        twice = np.bincount(feature, minlength=1 << BITS)[feature] > 1  # a feature of one document is never selected
        docs, hashes, doc, feature = [], [], doc[twice], feature[twice]
        n = len(x)
        fold = np.arange(n) % folds
        self.names, self.links, self.cuts, self.out_of_fold = list(labels), [], [], {}
        for name, y in labels.items():
            y = y.astype(float)
            self.links.append(Link(doc, feature, x, y, selected) if n else None)
            oof = np.zeros(n)
            for f in range(folds):
                rows = fold != f
                if not rows.any() or rows.all():
                    continue
                mine = rows[doc]
                at = (np.cumsum(rows) - 1).astype(np.int32)
                link = Link(at[doc[mine]], feature[mine], x[rows], y[rows], selected)
                np.logical_not(mine, out=mine)
                at = (np.cumsum(~rows) - 1).astype(np.int32)
                oof[~rows] = link.logit(at[doc[mine]], feature[mine], x[~rows])
            self.out_of_fold[name] = sigmoid(oof)
            self.cuts.append(cut_of(sigmoid(oof), y))
            x = np.c_[x, sigmoid(oof)]

    def score(self, texts: pa.Array) -> Pair:
        """Probabilities, a row a document, a column a category; and which documents have words."""
        out, worded = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), bool)
        for a, b, d, h, x in features(texts):
            worded[a:b] = x[:, DENSE - 1] > 0
            for i, link in enumerate(self.links):
                if link is not None:
                    out[a:b, i] = sigmoid(link.logit(d, h, x))
                    x = np.c_[x, out[a:b, i]]
        return out, worded


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a text and labels, written once: doc_id, text, key (the text's hash), junk, toxic."""
    known = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.lit(1) - F.min("quality")).alias("junk"), F.max("toxic").alias("toxic"))
    small = known.count() <= HELD
    texts = pick(docs, "doc_id", "text").filter("text is not null and doc_id is not null")
    return materialise(texts.join(F.broadcast(known) if small else known, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("key"), "junk", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Chain:
    """Fit the chain low quality, toxic on at most `sample` labelled documents of at most `most` bytes of text, drawn by a
    hash of id and text; repeated rows count once. The threshold of toxic is the multiple of CUT with the best F1 over
    all labelled documents, those of the sample by their out-of-fold probabilities; of several, the middle."""
    known = labelled(docs, labels)
    by = ["hash", "doc_id", "key"]
    drawn = known.select("doc_id", "key", F.xxhash64("doc_id", "key").alias("hash"), F.octet_length("text").alias("bytes")).distinct().orderBy(*by).limit(sample)
    upto = F.sum("bytes").over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, 0))  # over the sample alone
    drawn = drawn.withColumn("upto", upto).filter(F.col("upto") <= most).select("doc_id", "key")
    got = known.join(F.broadcast(drawn), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "junk", "toxic").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
    col = got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string())
    chain = Chain(col, {k: got[k].to_numpy() if got.num_rows else np.zeros(0) for k in ("junk", "toxic")})
    if got.num_rows:
        chain.cuts[1] = threshold(known, chain, got.select(["doc_id", "key"]))
    discard(known)
    return chain


def threshold(known: DataFrame, chain: Chain, sampled: pa.Table) -> float:
    """See fit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, worded = chain.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(np.where(worded, p[:, 1], 0.0))], ["doc_id", "key", "toxic", "p"])

    spark = known.sparkSession
    own = spark.createDataFrame(sampled.append_column("own", pa.array(chain.out_of_fold["toxic"])))
    scored = known.select("doc_id", "key", "text", F.col("toxic").cast("int")).mapInArrow(work, "doc_id bigint, key bigint, toxic int, p double")
    p = F.coalesce("own", "p")
    bins = scored.join(F.broadcast(own), ["doc_id", "key"], "left").groupBy(F.floor(p / CUT).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("y"))
    return best_f1(sorted(map(tuple, bins.collect())))  # as many as bins


def best_f1(bins: list[tuple[int, int, int]]) -> float:
    """(bin, documents, toxic ones) in order to the threshold with the best F1, the middle of the stretch that shares it."""
    k, n, y = (np.array(x, float) for x in zip(*bins))
    total = y.sum()
    if not 0 < total < n.sum():
        return 0.5
    found, right = np.cumsum(n[::-1])[::-1], np.cumsum(y[::-1])[::-1]
    i = int(np.argmax(2 * right / (found + total)))
    return float(k[i] + (k[i - 1] + 1 if i else 0)) / 2 * CUT


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every document.

    Linear models over hashed words and word beginnings, chained: the toxicity model has the probability of low quality
    as a feature, in training out of fold. They are fitted on a bounded sample, the threshold is set on all labelled
    documents (see fit). Every document is scored whole, however long; a feature counts once, so that a text's length
    alone decides nothing.

    A null, empty or wordless text is never toxic and has null probabilities. Repeated rows and null ids are scored as
    any. Without labels nothing is toxic and probabilities are 0. Repeated labels of an id count as the worst of them; a
    label with a null in any column, or of no document, counts for nothing. A probability equal to the threshold is toxic.
    An empty table gives no rows. Other columns are ignored.
    """
    chain = fit(docs, labels, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield score_batch(chain, batch)

    return pick(docs, "doc_id", "text").mapInArrow(work, "doc_id bigint, p_low_quality double, p_toxic double, toxic boolean")


def score_batch(chain: Chain, batch: pa.RecordBatch) -> pa.RecordBatch:
    p, worded = chain.score(batch.column(1))
    toxic = (p[:, 1] >= chain.cuts[1]) & worded & (chain.links[1] is not None)
    bare = ~worded
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0], mask=bare), pa.array(p[:, 1], mask=bare), pa.array(toxic)], ["doc_id", "p_low_quality", "p_toxic", "toxic"])


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that `scores` doesn't call toxic, with the columns of documents; null and empty texts and null ids
    stay, and repeated rows share their fate. An empty table gives no rows."""
    docs = pick(docs, *DOC_COLUMNS)
    chain = fit(docs, labels, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = score_batch(chain, batch.select(["doc_id", "text"])).column(3).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(work, "doc_id bigint, text string, lang string, source string, n_chars bigint")


ship(__name__)
