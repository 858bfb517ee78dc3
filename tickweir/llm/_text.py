"""Vectorised text kernels over Arrow string arrays.

A *word* is a maximal run of ASCII letters and digits and of characters from U+00C0 on, without U+2000-206F and
U+3000-303F, after lower-casing. Texts are taken whole, in blocks of bounded size, so that memory does not depend on
how large a batch is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickweir.llm._common import ship

#: SQL regular expression (RE2) of the words of a lower-cased text.
WORD_RE = r"[a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"

U64 = np.uint64
Pair = tuple[np.ndarray, np.ndarray]
_RNG = np.random.default_rng(20240229)
BYTE_A = _RNG.integers(1, 2**64, 256, dtype=U64) | U64(1)
BYTE_B = _RNG.integers(1, 2**64, 256, dtype=U64) | U64(1)
MULT_A, MULT_B = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
WORDY[128:] = True
BLOCK = 1 << 20  # bytes of text handled at once


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Local(dict):
    """A cache that stays behind when the code that uses it is sent elsewhere."""

    def __reduce__(self):
        return Local, ()


_POWERS = Local()


def powers(base: int, n: int) -> Pair:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, BLOCK + 1024)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        held = _POWERS[base] = tuple(out)
    return held


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lut: np.ndarray = BYTE_A, base: int = MULT_A) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end) of buf."""
    p, inv = powers(base, len(buf) + 1)
    acc = np.empty(len(buf) + 1, U64)
    acc[0] = 0
    np.cumsum(lut[buf] * p[: len(buf)], dtype=U64, out=acc[1:])
    return mix((acc[end] - acc[start]) * inv[start])


def gram_hash(h: np.ndarray, n: int, base: int = MULT_B) -> np.ndarray:
    """A 64-bit hash of every n consecutive hashes; len(h) - n + 1 values, none where h is shorter."""
    if len(h) < n:
        return np.zeros(0, U64)
    p, inv = powers(base, len(h) + 1)
    acc = np.empty(len(h) + 1, U64)
    acc[0] = 0
    np.cumsum(h * p[: len(h)], dtype=U64, out=acc[1:])
    return mix((acc[n:] - acc[:-n]) * inv[: len(h) - n + 1])


def lower(col: pa.Array) -> pa.Array:
    """Lower-cased large strings; null becomes empty. Bytes that aren't UTF-8 are left as they are."""
    col = pc.fill_null(col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col, "")
    try:
        return pc.utf8_lower(col)
    except pa.ArrowInvalid:
        return pc.ascii_lower(col)


def buffers(col: pa.Array) -> Pair:
    """The bytes of a large string array and its offsets, from 0."""
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def word_mask(buf: np.ndarray) -> np.ndarray:
    """Which bytes of a lower-cased text belong to words."""
    m = WORDY[buf]
    if len(buf) > 1:
        c2 = np.flatnonzero(buf[:-1] == 0xC2)
        if len(c2):
            m[c2] = False
            m[c2 + 1] = False
        for lead, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            e = np.flatnonzero(buf[:-2] == lead)
            if len(e):
                second, third = buf[e + 1], buf[e + 2]
                bad = (second >= low) & (second <= high)
                if lead == 0xE2:  # U+2000-206F: E2 80 80 - E2 81 AF
                    bad &= (second == 0x80) | (third <= 0xAF)
                e = e[bad]
                for k in range(3):
                    m[e + k] = False
    return m


class Words:
    """The words of a block of documents, as one normalised buffer (single spaces between words).

    first[d] .. first[d + 1] are document d's words; word w's bytes are buf[start[w] : end[w]]."""

    def __init__(self, col: pa.Array):
        raw, off = buffers(lower(col))
        m = word_mask(raw)
        self.raw, self.at = raw, np.zeros(0, np.int64)
        edge = np.empty(len(m) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(m[1:], m[:-1], out=edge[1:-1]) if len(m) else None
        edge[off] = True
        cut = np.flatnonzero(edge)  # every run's start
        if len(raw) == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            self.buf = raw
            return
        inside = m[cut[:-1]]
        s, e = cut[:-1][inside], cut[1:][inside]
        self.first, self.at = np.searchsorted(s, off), s
        sep = e[e < len(raw)]
        # one separator byte after each word: the byte after it where that isn't a word byte
        gap = sep[~m[sep]]
        keep = m.copy()
        keep[gap] = True
        buf = np.where(m, raw, np.uint8(32))[keep]
        at = np.empty(len(raw) + 1, np.int64)
        at[0] = 0
        np.cumsum(keep, out=at[1:])
        self.buf, self.start, self.end = buf, at[s], at[e]

    def hashes(self) -> np.ndarray:
        return span_hash(self.buf, self.start, self.end)

    def lines(self) -> np.ndarray:
        """Each word's line, counted over the block."""
        return np.searchsorted(np.flatnonzero(self.raw == 10), self.at)


def blocks(col: pa.Array, size: int = BLOCK):
    """Slices (from, to) of a string array of about `size` bytes each, one document at least."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def ids_of(col: pa.Array) -> Pair:
    """An id column as int64, and which are null (0 there)."""
    null = pc.is_null(col).to_numpy(zero_copy_only=False)
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64), null


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Pair:
    """The spans one after another, and their offsets."""
    size = end - start
    off = np.empty(len(size) + 1, np.int64)
    off[0] = 0
    np.cumsum(size, out=off[1:])
    out = np.empty(off[-1], buf.dtype)
    a = 0
    while a < len(size):  # by parts, as places take more memory than bytes
        b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 20), "right")) - 1)
        idx = np.repeat(start[a:b] - off[a:b], size[a:b])
        idx += np.arange(off[a], off[b])
        out[off[a] : off[b]] = buf[idx]
        a = b
    return out, off


ship(__name__)
