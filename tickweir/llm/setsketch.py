"""Near-duplicate groups by SetSketch registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweir.llm._common import DOC_COLUMNS, discard, materialise, partitions, pick, ship
from tickweir.llm._text import blocks, BYTE_B, gram_hash, ids_of, mix, MULT_A, MULT_B, Pair, span_hash, U64, Words

SHINGLE = 3  # words
REGISTERS, BASE, RATE, TOP = 124, 1.001, 20.0, 65534
BAND = 4  # registers of a band
THRESHOLD = 0.6
MARGIN = 0.1  # candidates are pairs whose estimate is above the threshold less this
NODE = "node binary, sketch binary, n int"
MEMBER = "doc_id bigint, node binary, group_id bigint, group_size bigint, lead boolean"
CONTENT_SEED = U64(0x51ED270B0F1F3A77)


def parameters() -> Pair:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingles(words: Words) -> Pair:
    """Hashes of the word shingles of a block's documents, and where each document's begin. A document of fewer words
    has one, the whole of it; one without words has none."""
    h = words.hashes()
    count = np.diff(words.first)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    g = gram_hash(h, SHINGLE)
    at = np.repeat(words.first[:-1] - begin[:-1], size) + np.arange(begin[-1])
    out = np.empty(begin[-1], U64)
    if len(g):
        out[:] = g[np.minimum(at, len(g) - 1)]
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
        whole = np.zeros(1, U64)
        for x in h[words.first[d] : words.first[d + 1]]:
            whole = whole * U64(MULT_B) + x
        out[begin[d]] = mix(whole)[0]
    return out, begin


def distinct(h: np.ndarray, begin: np.ndarray) -> Pair:
    """Shingles as sets: each document's hashes in order, without repeats, and where each document's begin."""
    h = h.copy()
    for a, b in zip(begin[:-1], begin[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[begin]


def registers(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SetSketch registers of documents that have shingles, REGISTERS a row: a register is the floor of 1 - log_b of
    the least of as many exponential variables as there are shingles, cut to 0 .. TOP + 1. Registers of a union are the
    greater ones."""
    a, b = parameters()
    low = h.astype(np.uint32)
    first = begin[:-1]
    least = np.empty((len(first), REGISTERS), np.uint32)
    for j in range(REGISTERS):
        v = low * a[j]
        v += b[j]
        least[:, j] = np.minimum.reduceat(v, first)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketched sets by joint likelihood: the J that best explains how many registers of x are
    greater, smaller and equal, given the sets' sizes."""
    plus, minus = (x > y).sum(1).astype(float), (x < y).sum(1).astype(float)
    equal = x.shape[1] - plus - minus
    u = nx / (nx + ny)
    v = 1 - u
    lo, hi = np.zeros(len(x)), np.minimum(u / v, v / u)
    lb, c = np.log(BASE), (BASE - 1) / BASE

    def slope(j: np.ndarray) -> np.ndarray:
        pu, pv = -np.log1p(-np.maximum(u - v * j, 1e-12) * c) / lb, -np.log1p(-np.maximum(v - u * j, 1e-12) * c) / lb
        du, dv = -v * c / (1 - (u - v * j) * c) / lb, -u * c / (1 - (v - u * j) * c) / lb
        return plus * du / np.maximum(pu, 1e-12) + minus * dv / np.maximum(pv, 1e-12) - equal * (du + dv) / np.maximum(1 - pu - pv, 1e-12)

    for _ in range(24):  # the likelihood is concave in J
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def names(words: Words, full: np.ndarray) -> np.ndarray:
    """Names, a row of two hashes each, of the normalised texts of a block's documents that have words."""
    s, e = words.start[words.first[full]], words.end[words.first[full + 1] - 1]
    return np.stack([span_hash(words.buf, s, e), span_hash(words.buf, s, e, BYTE_B, MULT_B)], 1)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, node, sketch, n); node names the normalised text, n is how many distinct shingles it has.
    Texts without words give nothing."""
    for batch in batches:
        ids = batch.column(0)
        for a, b in blocks(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            h, begin = distinct(*shingles(words))
            full = np.flatnonzero(np.diff(begin))
            if not len(full):
                continue
            k = registers(h, np.r_[begin[:-1][full], begin[-1]])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + full)), fixed(names(words, full)), fixed(k), pa.array(np.diff(begin)[full].astype(np.int32))], ["doc_id", "node", "sketch", "n"])


def fixed(rows: np.ndarray) -> pa.Array:
    """A row of bytes for each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def rows_of(col: pa.Array) -> np.ndarray:
    """Sketches back as rows of registers."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) to (band, node), the band's number being part of its hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = rows_of(batch.column(1))
        n = REGISTERS // BAND
        h = np.zeros((len(k), n), U64) + np.arange(1, n + 1, dtype=U64) * CONTENT_SEED
        for j in range(BAND):
            h = mix(h ^ k[:, j : n * BAND : BAND].astype(U64)) * U64(MULT_A)
        node = batch.column(0).take(pa.array(np.repeat(np.arange(len(k)), n)))
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), node], ["band", "node"])


def linked(k: np.ndarray, n: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect just those rows which pairs with an estimate of `least` or more connect."""
    out, rest = [], np.arange(len(k))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = estimate(np.broadcast_to(k[i], (len(rest), REGISTERS)), k[rest], np.full(len(rest), n[i], float), n[rest].astype(float)) >= least
            found = rest[near].tolist()
            out += [(i, x) for x in found]
            front += found
            rest = rest[~near]
    return out


def bucket_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(band, node, sketch, n) sorted by band to edges (src, dst) between similar nodes of a bucket."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        band, nodes = t["band"].to_numpy(), t["node"].to_pylist()
        k, n = rows_of(t["sketch"]), t["n"].to_numpy()
        cut = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[cut, len(band)])
        lead = np.repeat(cut, size)
        near = np.zeros(len(band), bool)
        for a in range(0, len(band), 4096):
            z = slice(a, a + 4096)
            near[z] = estimate(k[z], k[lead[z]], n[z].astype(float), n[lead[z]].astype(float)) >= least
        near[cut] = True
        pairs = [(int(lead[i]), int(i)) for i in np.flatnonzero(near & (lead != np.arange(len(band))))]
        for c in np.unique(lead[~near]):  # not all are close to the first: connect them by any pair
            s = int(size[np.searchsorted(cut, c)])
            pairs += [(int(c) + i, int(c) + j) for i, j in linked(k[c : c + s], n[c : c + s], least)]
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.binary()), pa.array([nodes[j] for _, j in pairs], pa.binary())], ["src", "dst"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        band = batch.column(0).to_numpy()
        at = int(np.flatnonzero(band == band[-1])[0])  # the last bucket may go on
        if at:
            out = flush([*held, batch.slice(0, at)])
            held = []
            if out:
                yield out
        elif held and held[-1].column(0)[-1].as_py() != band[0]:
            out = flush(held)
            held = []
            if out:
                yield out
        held.append(batch.slice(at))
    if held and (out := flush(held)):
        yield out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge: comp is the least node it is connected with. Labels go along edges and
    are followed (label of the label) each round, so rounds are few even for long chains."""
    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both")
    label = materialise(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("comp")), "label")
    while True:
        seen = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = materialise(step.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp")), "label")
        discard(label)
        label = new.select("node", "comp")
        label._shared = new._shared
        if new.filter("old <> comp").isEmpty():
            discard(both)
            return label


def exact(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def clusters(texts: list[str], k: np.ndarray, n: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    """Cluster numbers of a component's texts, by exact similarity: those that pairs at the threshold or above connect
    share one. Estimates decide which pairs are worth comparing, and in which order."""
    words = Words(pa.array(texts, pa.large_string()))
    h, begin = shingles(words)
    sets = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    own = np.arange(len(texts))
    for i in range(1, len(texts)):
        seen = np.unique(own[:i])
        if len(seen) == 1 and exact(sets[i], sets[0]) >= threshold:
            own[i] = own[0]
            continue
        est = estimate(np.broadcast_to(k[i], (i, REGISTERS)), k[:i], np.full(i, n[i], float), n[:i].astype(float))
        joined: set[int] = set()
        for j in np.argsort(-est, kind="stable"):
            if est[j] < threshold - margin or len(joined) == len(seen):
                break
            if int(own[j]) not in joined and exact(sets[i], sets[j]) >= threshold:
                joined.add(int(own[j]))
        if joined:
            least = min(joined)
            own[np.isin(own, list(joined))] = least
            own[i] = least
    return own


def verify(batches: Iterator[pa.RecordBatch], threshold: float, margin: float) -> Iterator[pa.RecordBatch]:
    """(comp, node, sketch, n, ids, text) sorted by comp and first id to MEMBER rows."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        own = clusters(t["text"].to_pylist(), rows_of(t["sketch"]), t["n"].to_numpy(), threshold, margin)
        ids, nodes = t["ids"].to_pylist(), t["node"].to_pylist()
        doc, node, group, size, lead = [], [], [], [], []
        for c in np.unique(own):
            members = [(x, nodes[i]) for i in np.flatnonzero(own == c) for x in ids[i]]
            if len(members) > 1:
                first = min(members)
                doc += [x for x, _ in members]
                node += [x for _, x in members]
                group += [first[0]] * len(members)
                size += [len(members)] * len(members)
                lead += [x == first for x in members]
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(node, pa.binary()), pa.array(group, pa.int64()), pa.array(size, pa.int64()), pa.array(lead, pa.bool_())], ["doc_id", "node", "group_id", "group_size", "lead"]) if doc else None

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        comp = np.array(batch.column(0).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(comp[1:] != comp[:-1]) + 1).tolist(), len(comp)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != comp[a]:
                out, held = flush(held), []
                if out:
                    yield out
            held.append(batch.slice(a, b - a))
    if held and (out := flush(held)):
        yield out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, group_id (the group's least doc_id), group_size; documents without a
    near duplicate have no row.

    Two documents are near duplicates if the Jaccard similarity of their sets of word shingles is `threshold` or more;
    groups are what such pairs connect. Each distinct text has a SetSketch; its registers are banded, the members of a
    bucket are compared by the likelihood of their registers jointly, with no cap on a bucket; what that connects is
    brought together and verified on the whole texts. Every document is a query. Bands of 4 of 124 registers find a pair
    at the threshold with a probability of 0.985.

    Words are runs of letters and digits, lower-cased; texts of the same words are duplicates whatever lies between, and
    texts of any length are read whole. A pair at just the threshold is one of near duplicates. A
    text without words, null or empty, is in no group, nor is a null doc_id. Repeated rows are duplicates of each other:
    their doc_id appears as often as its rows. A doc_id with several texts may be in several groups. An empty table
    gives no rows. Other columns are ignored.
    """
    return members_of(docs, threshold, margin).select("doc_id", "group_id", "group_size")


def members_of(docs: DataFrame, threshold: float, margin: float) -> DataFrame:
    """The rows of `near_duplicates` with the member's node; `lead` are those of the group's least doc_id and, of several
    texts of that id, of the least node."""
    docs = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    parts = partitions(docs.sparkSession)
    sketched = docs.mapInArrow(sketch, f"doc_id bigint, {NODE}")
    nodes = materialise(sketched.groupBy("node").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "nodes")
    rows = nodes.select("node", "sketch").mapInArrow(bands, "band bigint, node binary")
    shared = rows.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("band"))).filter("size > 1").select("band", "node")
    least = threshold - margin
    ordered = shared.join(nodes.select("node", "sketch", "n"), "node").select("band", "node", "sketch", "n").repartition(parts, "band").sortWithinPartitions("band", "node")
    comp = components(ordered.mapInArrow(lambda it: bucket_edges(it, least), "src binary, dst binary"))
    members = nodes.join(comp, "node").withColumn("doc_id", F.col("ids")[0])
    texts = docs.join(members.select("doc_id", "node", "comp", "sketch", "n", "ids"), "doc_id")
    placed = texts.select("comp", "doc_id", "node", "sketch", "n", "ids", "text").repartition(parts, "comp").sortWithinPartitions("comp", "doc_id", "node")
    checked = placed.mapInArrow(lambda it: verify(_own_text(it), threshold, margin), MEMBER)
    alone = nodes.filter(F.size("ids") > 1).join(comp, "node", "left_anti")
    return checked.unionByName(alone.select(F.explode("ids").alias("doc_id"), "node", F.col("ids")[0].alias("group_id"), F.size("ids").cast("bigint").alias("group_size")).withColumn("lead", F.expr("doc_id = group_id")))


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, doc_id, node, sketch, n, ids, text): rows whose text is the node's, each node once."""
    last = None
    for batch in batches:
        keep, nodes = [], batch.column(2).to_pylist()
        for a, b in blocks(batch.column(6)):
            words = Words(batch.column(6).slice(a, b - a))
            full = np.flatnonzero(np.diff(words.first))
            named = dict(zip((a + full).tolist(), names(words, full)))
            for i in range(a, b):
                if i in named and named[i].tobytes() == nodes[i] and nodes[i] != last:
                    keep.append(i)
                    last = nodes[i]
        got = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([got.column(i) for i in (0, 2, 3, 4, 5, 6)], ["comp", "node", "sketch", "n", "ids", "text"])


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their node, null for texts without words."""
    for batch in batches:
        node: list[bytes | None] = [None] * batch.num_rows
        text = batch.column(1)
        for a, b in blocks(text):
            words = Words(text.slice(a, b - a))
            full = np.flatnonzero(np.diff(words.first))
            if len(full):
                for i, name in zip((a + full).tolist(), names(words, full)):
                    node[i] = name.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.binary())], [*batch.schema.names, "node"])


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group of near duplicates, that of the least doc_id (of several texts of that id, of
    one); of repeated rows one stays. A doc_id's other texts, which aren't in the group, stay. Columns of documents;
    documents in no group stay as they are, null ids and texts included."""
    docs = pick(docs, *DOC_COLUMNS)
    groups = materialise(members_of(docs, threshold, MARGIN), "groups")
    by = ["doc_id", "node"]
    verdict = groups.groupBy(*by).agg(F.bool_or(~F.col("lead")).alias("gone"), (F.count(F.lit(1)) > 1).alias("repeated"))
    rows = docs.mapInArrow(named, "doc_id bigint, text string, lang string, source string, n_chars bigint, node binary")
    left = rows.join(verdict, by, "left").filter(~F.coalesce("gone", F.lit(False)))
    own = F.when(F.coalesce("repeated", F.lit(False)), 0).otherwise(F.monotonically_increasing_id() + 1)  # no row but a repeated one is ranked with others
    order = W.partitionBy(*by, "own").orderBy("text", "lang", "source", "n_chars")
    return left.withColumn("own", own).withColumn("k", F.row_number().over(order)).filter("k = 1").select(*DOC_COLUMNS)


ship(__name__)
