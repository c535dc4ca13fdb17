"""Removal of repeated passages by level-wise doubling.

Window lengths are halved (rounded up) from the wanted one while they are at least `shortest`: 10 and 20 words for
the 20 wanted here. The first level looks at the shortest windows. Of those in each window of the next length only
the one with the smallest hash is taken (so equal longer windows take equal ones), about a sixth of all. Windows that
occur once in the corpus end there; around those that are repeated the windows of the next length are formed, of
which again one stands for each of twice its length, and so on until the wanted length. Where no candidate survives a
level, the later ones have no rows. Of each repeated window of the wanted length every occurrence but the first
(smallest doc_id, then start) is removed.

Shorter levels compare 64-bit hashes, which can only let too much pass; the last one compares 96-bit BLAKE2b digests
of the windows' bytes. Documents with equal word sequences are one class by SHA-256; the smallest goes on, from the
others everything is removed if they hold a window at all. Within a batch of documents, of each window only the first
occurrence is dealt by its hash, so a passage that very many documents share costs a row per batch.

Null, empty and blank texts have no words. Documents shorter than a window are left alone. Very long texts are handled
whole. Rows that repeat a doc_id and its text have the same outcome; rows of one doc_id with different texts are
documents of their own, in the order of their texts' SHA-256; rows with a null doc_id are left whole. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .text import SPACE, Block, blocks, column, mix, windows

WINDOW, SHORTEST = 20, 10


class Seeds:
    """The windows of `half` words of a block that are smallest in some window of `full` words, and each of those's least hash."""

    def __init__(self, block: Block, full: int, half: int, live: np.ndarray | None = None):
        """live: the windows of half words that are still candidates; a longer window needs all of its own."""
        self.full, self.half = full, half
        self.starts, self.ends, self.first = block.words(SPACE)
        words = block.hashes(self.starts, self.ends)
        h = self.h = windows(words, half)
        n = len(words) - full + 1  # longer windows, some across documents
        if n < 1:
            self.least, self.picked = np.zeros(0, np.uint64), np.zeros(len(h), bool)
            return
        least = h[:n].copy()
        for j in range(1, full - half + 1):
            np.minimum(least, h[j : n + j], out=least)
        doc = np.repeat(np.arange(len(block)), np.diff(self.first))
        least[doc[:n] != doc[full - 1 :]] = 0
        if live is not None:
            dead = np.concatenate([[0], np.cumsum(~live)])
            least[dead[full - half + 1 :][:n] > dead[:n]] = 0
        self.least = least  # 0: no window of one document
        top = np.zeros(len(h), np.uint64)
        for j in range(full - half + 1):
            np.maximum(top[j : n + j], least, out=top[j : n + j])
        self.picked = (h == top) & (top > 0)

    def reached(self, at: pa.Array) -> np.ndarray:
        """Which of the longer windows have their least one at one of these places. at: places in each text."""
        live = np.zeros(len(self.least), bool)
        seed = self.first[:-1].repeat(at.value_lengths().to_numpy()) + at.flatten().to_numpy()
        for j in range(self.full - self.half + 1):
            p = seed[seed >= j]
            w = p[p - j < len(live)] - j
            live[w[self.least[w] == self.h[w + j]]] = True
        return live

    def places(self, start: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
        """doc_id, twin and word number of words of the block."""
        of = np.searchsorted(self.first, start, "right") - 1
        return column(block.rows, "doc_id").to_numpy()[of], column(block.rows, "twin").to_numpy()[of], start - self.first[of]


def first_in_batch(parts: list[tuple[np.ndarray, ...]], later_only: bool) -> pa.RecordBatch:
    """Rows key, more, doc_id, twin, pos, known from windows' keys (two numbers) and places in one batch.

    The first of each key is dealt by it; others get a key of their own and are known to be repeated. A first
    that has others is known too, unless only later ones count.
    """
    key, more, doc, twin, pos = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
    place = np.lexsort((pos, twin, doc))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    order = np.lexsort((rank, more, key))
    key, more, doc, twin, pos = key[order].astype(np.uint64), more[order].astype(np.uint64), doc[order], twin[order], pos[order]
    new, same = np.ones(len(key), bool), np.zeros(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    # repeated rows of one document and place count once
    same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (twin[1:] == twin[:-1]) & (pos[1:] == pos[:-1])
    key, more, doc, twin, pos, new = (x[~same] for x in (key, more, doc, twin, pos, new))
    known = ~new
    if not later_only and len(new):
        known[:-1] |= ~new[1:]
    key[~new] = mix(mix(doc[~new].astype(np.uint64)) + pos[~new].astype(np.uint64))
    more[~new] = 0
    return pa.record_batch(
        [pa.array(key.view(np.int64)), pa.array(more.view(np.int64)), pa.array(doc), pa.array(twin.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(known)],
        ["key", "more", "doc_id", "twin", "pos", "known"],
    )


PLACES = "key long, more long, doc_id long, twin int, pos int, known boolean"
ROW = ["doc_id", "twin"]


def seeds(docs: DataFrame, full: int, half: int) -> DataFrame:
    """docs: doc_id, twin, text. The places of the windows of `half` words that stand for one of `full` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in blocks([batch]):
                s = Seeds(block, full, half)
                at = np.flatnonzero(s.picked)
                parts.append((s.h[at], np.zeros(len(at), np.uint64), *s.places(at, block)))
            yield first_in_batch(parts, False)

    return docs.mapInArrow(run, PLACES)


def digests(block: Block, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each window of n words: BLAKE2b of its words joined by one space."""
    tidy, size = b" ".join(block.bytes.split()), np.concatenate([[0], np.cumsum(ends - starts + 1)])
    view, digest = memoryview(tidy), hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=12).digest() for a, b in zip(size[at].tolist(), (size[at + n] - 1).tolist(), strict=True)])
    two = np.frombuffer(found, [("key", "<u8"), ("more", "<u4")])
    return two["key"], two["more"].astype(np.uint64)


def extend(docs: DataFrame, full: int, half: int, longer: int | None) -> DataFrame:
    """docs: doc_id, twin, text, at (places of surviving windows of `half` words).

    Gives the windows of `full` words that have one of them as their least: all, by digest, or if there is a longer
    length those that stand for a window of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in blocks([batch]):
                s = Seeds(block, full, half)
                if not len(s.least):
                    continue
                live = s.reached(column(block.rows, "at"))
                if longer is None:
                    start = np.flatnonzero(live)
                    parts.append((*digests(block, s.starts, s.ends, start, full), *s.places(start, block)))
                else:
                    up = Seeds(block, longer, full, live)
                    at = np.flatnonzero(up.picked)
                    parts.append((up.h[at], np.zeros(len(at), np.uint64), *up.places(at, block)))
            yield first_in_batch(parts, longer is None)

    return docs.mapInArrow(run, PLACES)


def remove(docs: DataFrame, window: int) -> DataFrame:
    """docs: doc_id, twin, text, at (starts of windows to remove)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch]):
                gone, shas = [], []
                for k, at in enumerate(column(block.rows, "at")):
                    words = block.bytes[block.at[k] : block.at[k + 1]].split()
                    mark = np.zeros(len(words) + 1, np.int64)
                    starts = np.array(at.as_py(), np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    cover = np.cumsum(mark)[:-1] > 0
                    gone.append(int(cover.sum()))
                    shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~cover)])).hexdigest())
                yield pa.record_batch([*(column(block.rows, c) for c in ROW), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], [*ROW, "gone", "sha"])

    return docs.mapInArrow(run, "doc_id long, twin int, gone long, sha string")


def outline(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, n_words, sha of the words joined by one space, and where there is a window a key of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n, shas, keys = [], [], []
            for a, b in zip(block.at[:-1], block.at[1:], strict=True):
                words = block.bytes[a:b].split()
                sha = hashlib.sha256(b" ".join(words))
                n.append(len(words))
                shas.append(sha.hexdigest())
                keys.append(sha.digest() if len(words) >= window else None)
            yield pa.record_batch([column(block.rows, "doc_id"), column(block.rows, "key"), pa.array(n, pa.int64()), pa.array(shas), pa.array(keys, pa.binary())], ["doc_id", "key", "n_words", "sha", "seq"])

    return docs.mapInArrow(run, "doc_id long, key binary, n_words long, sha string, seq binary")


def find_twins(base: DataFrame, s: Scratch) -> DataFrame | None:
    """doc_id, key, twin: the place of a text among the different texts of its doc_id, where it isn't the first; None if there are none."""
    base = base.where("doc_id is not null").select("doc_id", "key")
    several = s.keep(base.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("doc_id"), "several")
    if several.isEmpty():
        return None
    pairs = base.join(several, "doc_id", "left_semi").distinct()
    return s.keep(pairs.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1).where("twin > 0"), "twins")


def numbered(rows: DataFrame, twins: DataFrame | None) -> DataFrame:
    """rows (doc_id, key, ...) with `twin`."""
    if twins is None:
        return rows.withColumn("twin", F.lit(0))
    return rows.join(twins, ["doc_id", "key"], "left").withColumn("twin", F.coalesce("twin", F.lit(0)))


def dedup_passages(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    s = Scratch(docs.sparkSession)
    lengths = [window]
    while (half := -(-lengths[0] // 2)) >= shortest and half < lengths[0] or len(lengths) == 1:
        lengths.insert(0, half)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("key"), text.alias("text"))
    base = s.keep(outline(docs, window), "outline")
    twins = find_twins(base, s)
    base = numbered(base, None) if twins is None else s.keep(numbered(base, twins), "base")
    first = base.where("seq is not null and doc_id is not null").groupBy("seq").agg(F.min(F.struct(*ROW)).alias("first"), F.count("*").alias("n"))
    # a table of its own, as a join can split a large group of copies only between two plain inputs
    first = s.keep(first.where("n > 1").select("seq", "first"), "first")
    copies = base.join(first, "seq").where(F.struct(*ROW) != F.col("first")).select(*ROW).distinct()
    copies = s.keep(copies, "copies")
    # the same exchange of whole texts serves all joins
    whole = numbered(docs, twins).where("doc_id is not null").select(*ROW, "text")
    by_key = Window.partitionBy("key", "more")
    gather = lambda level: level.groupBy(*ROW).agg(F.collect_set("pos").alias("at"))
    level = seeds(whole.join(copies, ROW, "left_anti"), lengths[1], lengths[0])
    for k in range(1, len(lengths)):
        at = gather(level.withColumn("n", F.count("*").over(by_key)).where("known or n > 1"))
        level = extend(whole.join(at, ROW), lengths[k], lengths[k - 1], lengths[k + 1] if k + 1 < len(lengths) else None)
    at = gather(level.withColumn("k", F.rank().over(by_key.orderBy(*ROW, "pos"))).where("known or k > 1"))
    gone = remove(whole.join(at, ROW), window).dropDuplicates(ROW)
    gone = gone.unionByName(copies.select(*ROW, F.lit(None).cast("long").alias("gone"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha")))
    gone = gone.select(*ROW, "gone", F.col("sha").alias("new"))
    return base.join(gone, ROW, "left").select(
        "doc_id", "n_words", F.when(F.col("new").isNull(), 0).otherwise(F.coalesce("gone", "n_words")).cast("long").alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256")
    )
