"""Exact byte-pair token counts."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickweir.llm._common import pick, ship, worker_held

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation of the vocabulary's public tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HELD = 1 << 20  # pieces a worker remembers; beyond it starts anew (speed only)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: its symbols minus the merges made.

    A heap holds adjacent pairs by rank, then place; a linked list holds the symbols left. Each pop merges the lowest
    pair, unless one of its sides has changed since it was pushed."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # symbol i is piece[i : after[i]]
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = after[i]
        if mid >= n or after[mid] != end or mid < 0:
            continue
        after[i] = end
        after[mid] = -1  # gone
        left -= 1
        if end < n:
            before[end] = i
            stop = after[end]
            if (r := get(piece[i:stop])) is not None:
                heapq.heappush(heap, (r, i, stop))
        p = before[i]
        if p >= 0 and (r := get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return left


class Lengths(dict):
    """Token counts of pieces, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        if len(self) >= HELD:
            self.clear()
        n = merged_length(piece.encode("utf-8", "surrogatepass"), self.ranks)
        self[piece] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens of every row, exactly as the vocabulary's tokenizer counts them; no identifiers are made.

    A null text has a null count, an empty one 0, one of any length is read whole. Of pairs with one rank the leftmost
    merges first. Every row is counted by itself, so repeated rows and null ids give as many rows. An empty table gives no rows. Other columns are ignored. The vocabulary (of fixed size) is read on
    the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hashlib.md5(shared.value, usedforsecurity=False).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = worker_held("lengths", key, lambda: Lengths(read_ranks(shared.value)))
        pieces = regex.compile(pattern).findall
        for batch in batches:
            n = [None if t is None else sum(map(length.__getitem__, pieces(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


ship(__name__)
