"""Benchmark decontamination by n-gram overlap."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.llm._common import DOC_COLUMNS, pick, ship, worker_held
from tickweir.llm._text import U64, Words, blocks, gram_hash

N = 8  # words of a window
LEAST = 5  # words of an item that counts wherever the whole of it occurs; a shorter one has to be a line by itself
HELD = 32 << 20  # bytes of benchmark text broadcast at once; a larger benchmark takes several scans
WORD = re.compile("[A-Za-z0-9À-῿⁰-⿿぀-\U0010ffff]+")
HIT = "hits array<struct<start:int,n:int,item_id:bigint>>, n_words int"
TABLE = U64(44)  # a window's top 20 bits index the table of the filter


class Grams:
    """The windows of one length in a set of items, by hash. With `whole`, they count where they are the whole of a line."""

    def __init__(self, n: int, words: Words, rows: np.ndarray, ids: np.ndarray, whole: bool = False):
        h = gram_hash(words.hashes(), n)
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        ok = np.flatnonzero((doc[: len(h)] == doc[n - 1 :]) & np.isin(doc[: len(h)], rows)) if len(h) else np.zeros(0, np.int64)
        order = ok[np.argsort(h[ok], kind="stable")]
        self.n, self.hash, self.item, self.whole = n, h[order], ids[doc[order]], whole
        self.buf, self.start, self.end = words.buf, words.start[order], words.end[order + n - 1]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hash >> TABLE).astype(np.int64)] = True

    def hits(self, words: Words, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(word, item) of verified windows."""
        g = gram_hash(h, self.n)
        maybe = np.flatnonzero(self.table[(g >> TABLE).astype(np.int64)]) if len(self.hash) else np.zeros(0, np.int64)
        maybe = maybe[doc[maybe] == doc[maybe + self.n - 1]]
        if self.whole and len(maybe):
            last, line = maybe + self.n - 1, np.stack([words.lines(), doc])
            new = np.ones(line.shape[1] + 1, bool)  # whether a word begins a line, or a document
            new[1:-1] = (line[:, 1:] != line[:, :-1]).any(0)
            maybe = maybe[new[maybe] & new[last + 1] & (line[0][maybe] == line[0][last])]
        lo, hi = np.searchsorted(self.hash, g[maybe], "left"), np.searchsorted(self.hash, g[maybe], "right")
        out = []
        for i, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
            text = words.buf[words.start[i] : words.end[i + self.n - 1]]
            out += [(int(i), int(self.item[k])) for k in range(a, b) if np.array_equal(self.buf[self.start[k] : self.end[k]], text)]
        return out


def item_grams(texts: list[str], ids: list[int], n: int, least: int) -> list[Grams]:
    words = Words(pa.array(texts, pa.large_string()))
    count, ids = np.diff(words.first), np.array(ids, np.int64)
    out = [Grams(n, words, np.flatnonzero(count >= n), ids)] if (count >= n).any() else []
    for m in range(1, n):
        if (count == m).any():
            out.append(Grams(m, words, np.flatnonzero(count == m), ids, m < least))
    return out


def cut(text: str, hits: list[dict]) -> str:
    """The text without the words of the hits, nor the separators inside and after them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for s in sorted(hits, key=lambda s: s["start"]):
        a, b = at[s["start"]][0], s["start"] + s["n"]
        if a > done:
            out.append(text[done:a])
        done = max(done, at[b][0] if b < len(at) else len(text))
    return "".join(out) + text[done:]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, held: int = HELD, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """docs' columns, hits (verified windows: first word, words, item) and n_words. Documents without a hit have an
    empty list. Needs a column text. `finish` makes docs' columns of a batch of all these, within the last scan: a Python
    step of its own would take a second Python worker in each task, and workers stay."""
    items = pick(benchmark, "item_id", "text").filter("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // held))
    held_by = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    fields, run = docs.columns, uuid.uuid4().hex
    at = fields.index("text")
    out = docs
    for part in range(parts):
        rows = held_by.filter(F.col("part") == part).select("text", "item_id").distinct().collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        end = finish if part == parts - 1 else None

        def find(batches: Iterator[pa.RecordBatch], shared=shared, part=part, more=part > 0, end=end) -> Iterator[pa.RecordBatch]:
            sets = worker_held("items", (run, part), lambda: item_grams(*shared.value, n, least))
            for batch in batches:
                found: list[list] = batch.column(len(fields)).to_pylist() if more else [[] for _ in range(batch.num_rows)]
                count = np.zeros(batch.num_rows, np.int32)
                for a, b in blocks(batch.column(at)):
                    words = Words(batch.column(at).slice(a, b - a))
                    count[a:b] = np.diff(words.first)
                    h = words.hashes()
                    doc = np.repeat(np.arange(b - a), np.diff(words.first))
                    for s in sets:
                        for i, item in s.hits(words, h, doc):
                            found[a + doc[i]].append({"start": int(i - words.first[doc[i]]), "n": s.n, "item_id": item})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("item_id", pa.int64())]))
                seen = pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(found, kind), pa.array(count)], [*fields, "hits", "n_words"])
                yield end(seen) if end else seen

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        out = out.mapInArrow(find, schema if end else f"{schema}, {HIT}")
    return out


def covered(hits: str = "hits"):
    """Words that the hits cover, as a sorted array."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, held: int = HELD) -> DataFrame:
    """Documents that hold a window of `n` words of a benchmark item: doc_id, item_ids, windows, hit_words, n_words, action.

    Windows are compared by hash against a broadcast set, then word by word. item_ids are ascending, comma-separated;
    windows counts pairs of a place and an item; hit_words are the document's words that the windows cover; action is
    "document" where they are half its words or more, else "span" (see decontaminate). An item under n words counts
    where the whole of it occurs; one under `least` words, too common to tell otherwise, where it is the whole of a line.
    A benchmark over `held` bytes is scanned for in parts.

    Words are runs of letters and digits, lower-cased. Null and empty texts hold nothing, null items and ids are left
    out; texts of any length are scanned whole. Windows that several items share count for each of them. Repeated rows and null doc_ids are rows like any other. Empty tables give no rows. Other columns are ignored.
    """
    found = scan(pick(docs, "doc_id", "text"), benchmark, n, least, held).drop("text").filter(F.size("hits") > 0)
    words = F.size(covered())
    return found.select(
        "doc_id",
        F.concat_ws(",", F.transform(F.array_sort(F.array_distinct(F.transform("hits", lambda s: s["item_id"]))), lambda i: i.cast("string"))).alias("item_ids"),
        F.size(F.array_distinct("hits")).alias("windows"),
        words.alias("hit_words"),
        "n_words",
        F.when(words * 2 >= F.col("n_words"), "document").otherwise("span").alias("action"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, held: int = HELD) -> DataFrame:
    """The documents without what `contaminated` finds: documents with action "document" go, from the others the spans
    are cut, and n_chars is counted anew. Columns of documents; documents without a hit stay as they are, null and empty
    texts and repeated rows among them. An empty table gives no rows."""
    return scan(pick(docs, *DOC_COLUMNS), benchmark, n, least, held, without_hits)


def without_hits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """See decontaminate: what is left of a batch with the columns of documents, hits and n_words."""
    hits, left = batch.column(5).to_pylist(), batch.select(list(DOC_COLUMNS))
    if not any(hits):
        return left
    text, chars, n_words = (batch.column(i).to_pylist() for i in (1, 4, 6))
    stays = np.ones(batch.num_rows, bool)
    for i, h in enumerate(hits):
        if h:
            cover = {w for s in h for w in range(s["start"], s["start"] + s["n"])}
            stays[i] = len(cover) * 2 < n_words[i]
            if stays[i]:
                text[i] = cut(text[i], h)
                chars[i] = len(text[i])
    left = pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), batch.column(2), batch.column(3), pa.array(chars, pa.int64())], list(DOC_COLUMNS))
    return left.filter(pa.array(stays))


ship(__name__)
