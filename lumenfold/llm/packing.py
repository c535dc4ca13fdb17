"""Packing of tokenised documents into sequences by bounded-space online best-fit.

Pieces arrive in hash order, in runs that each come longest first: best-fit leaves least room so, as long as a run
isn't much larger than the open bins. A fixed number of bins is open; a bitset has a bit for each amount of free space
that some open bin has, so the tightest bin that holds a piece is found by one shift and a lowest-bit. When no
bin fits, one is opened, and if that is one too many the fullest open bin closes. Only documents longer than a
sequence are cut; their first piece is the short one. Each task packs a hash share of the pieces by itself.

Null and empty texts are one piece of the end token alone. Repeated rows are packed each. An empty table gives
no rows. Other columns are ignored, whatever their names.

Token ids come from tiktoken with the same vocabulary's ranks, which gives the ids of the tokenizers file at
a quarter of the CPU time; texts with the special token's string, and texts which that library refuses (very
long runs of white space), go to the tokenizers library.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .text import column

#: Tokens in a sequence, bins open in a task, pieces in a run.
LENGTH, OPEN, RUN = 2048, 4096, 10_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of a text, as the tokenizers file gives them, then the end id."""

    def __init__(self, name: str = TOKENIZER, ranks: str = RANKS, end: int = 0):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(f"own-{name}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.path, self.slow, self.end = public_tokenizers.path(name), None, np.array([end], "<u4")

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if SPECIAL in text:
            ids = self.exact(text)
        else:
            try:
                ids = self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as error:  # a panic of the library isn't an Exception
                if type(error).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
                ids = self.exact(text)
        return np.concatenate([np.asarray(ids, "<u4"), self.end])


class Packer:
    """Open bins keyed by free space. put() gives the bin's number and the offset in it."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def put(self, n: int) -> tuple[int, int]:
        fits = self.free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = self.bins[f].pop()
            if not self.bins[f]:
                self.free ^= 1 << f
            self.open -= 1
        else:
            f, b = self.length, self.made
            self.made += 1
        left = f - n
        if left:
            if self.open == self.most:  # the fullest closes
                full = (self.free & -self.free).bit_length() - 1
                if full <= left:
                    self.bins[full].pop()
                    if not self.bins[full]:
                        self.free ^= 1 << full
                    self.open -= 1
                else:
                    return b, self.length - f
            self.bins[left].append(b)
            self.free |= 1 << left
            self.open += 1
        return b, self.length - f


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks)
        for batch in batches:
            out: list[tuple] = []
            texts = column(batch, "text")
            for i, text in zip(column(batch, "doc_id").to_pylist(), (x.as_py() for x in texts), strict=True):
                ids = encode(text)
                out += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), length))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def runs(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size`."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack_run(packer: Packer, lengths: np.ndarray) -> np.ndarray:
    """Bin and offset of each piece of a run."""
    out = np.empty((len(lengths), 2), np.int64)
    order = np.argsort(-lengths, kind="stable")
    out[order] = [packer.put(n) for n in lengths[order].tolist()]
    return out


def pack(rows: DataFrame, length: int = LENGTH, most: int = OPEN, tasks: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, high = Packer(length, most), TaskContext.get().partitionId() << 40
        for batch in runs(batches):
            got = pack_run(packer, column(batch, "length").to_numpy())
            yield pa.record_batch([*batch.columns, pa.array(high + got[:, 0]), pa.array(got[:, 1])], [*batch.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece")
    dealt = rows.repartition(tasks, order) if tasks else rows.repartition(order)
    return dealt.sortWithinPartitions(order, "doc_id", "piece", "ids_crc32").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, length), length, most)
