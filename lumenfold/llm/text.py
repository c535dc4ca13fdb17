"""Vectorised word access to Arrow batches of texts.

All word classes used here split at ASCII bytes only, so they can be applied to UTF-8 bytes. Texts are
handled in blocks of a few MB; a longer text is a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used on lower-cased bytes.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[97:123] = PUNCT[128:] = False
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place on its own copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some rows of a batch: their texts' bytes, each followed by a space, and where each text starts."""

    def __init__(self, rows: pa.RecordBatch, texts: pa.Array, lower: bool):
        raw = texts.to_pylist()
        joined = b" ".join(raw) + b" "
        if lower:
            joined = joined.translate(LOWER)
        self.rows = rows
        self.bytes = joined
        self.buf = np.frombuffer(joined, np.uint8)
        self.at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in raw], out=self.at[1:])

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text its first word's number (one more entry at the end)."""
        gap = separators[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.at)

    def heads(self, starts: np.ndarray, skip: int = 0) -> np.ndarray:
        """Eight bytes at each start (zeros behind the end of the block)."""
        padded = getattr(self, "_padded", None)
        if padded is None:
            padded = self._padded = self.bytes + b"\0" * 8
            self._view = np.ndarray((len(self.bytes) + 1,), "<u8", padded, 0, (1,))
        return self._view[starts + skip]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words' bytes. Unequal words can have equal hashes; same() tells them apart."""
        n = ends - starts
        h = n.astype(np.uint64) * _C1
        h ^= self.heads(starts) & MASK[np.minimum(n, 8)]
        h *= _C1
        h ^= h >> np.uint64(32)
        k = 8
        left = np.flatnonzero(n > k)
        while len(left):
            w = self.heads(starts[left], k) & MASK[np.minimum(n[left] - k, 8)]
            x = (h[left] ^ w) * _C2
            h[left] = x ^ (x >> np.uint64(29))
            k += 8
            left = left[n[left] > k]
        return mix(h)


    def same(self, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i and j have the same bytes."""
        a, b, n = starts[i], starts[j], ends[i] - starts[i]
        out = n == ends[j] - b
        k, left = 0, np.flatnonzero(out)
        while len(left):
            mask = MASK[np.minimum(n[left] - k, 8)]
            ok = (self.heads(a[left], k) & mask) == (self.heads(b[left], k) & mask)
            out[left[~ok]] = False
            k += 8
            left = left[ok & (n[left] > k)]
        return out


def distinct_words(block: Block, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray]:
    """The block's distinct words as bytes, and for each word its number among them."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    letters = block.buf[~separators[block.buf]]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def word_hash(word: bytes) -> int:
    """The hash that Block.hashes() gives this word."""
    b = Block(None, pa.array([word], pa.binary()), False)
    return int(b.hashes(np.array([0]), np.array([len(word)]))[0])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _C1
        out ^= out >> np.uint64(29)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False, size: int = 1 << 22) -> Iterator[Block]:
    """Cuts batches into blocks of whole rows, each of about so many bytes; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_null(col.type):
            col = pa.array([""] * len(col))
        col = pc.fill_null(col, "").cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary())
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(col):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield Block(batch.slice(at, to - at), col.slice(at, to - at), lower)
            at = to


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0]..+counts[0]-1, starts[1].., and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift
