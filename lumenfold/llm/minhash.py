"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same text (by SHA-256) form a class at once; one of each goes on. Bands of its signature are
bucketed. In a bucket all members are paired with its hub only, the text of the smallest doc_id, never with each other.
Pairs are judged batch by batch of the signature: under a uniform prior, a pair is pruned once the posterior
probability of reaching the threshold is below `miss`; survivors are verified on whole texts. First
each document's likeliest hub is verified, then other hubs in other components. The documents of buckets that
still hold several components are joined by an exact prefix filter on their shingles. So every pair that shares
a bucket is either in one component already, ruled out by the filter, or judged.

A band has 4 of 128 hashes: a pair of similarity 0.75 shares none of 32 buckets with probability 5e-6. Hashes only
find candidates: sizes of sets are counted, and links confirmed, on the words' bytes.

Null, empty and blank texts have no shingles and are linked with nothing. Texts with fewer words than a
shingle have one, their whole sequence. Very long texts are handled whole. Rows that repeat a doc_id and its text
share its result. Rows of one doc_id with different texts are documents of their own; component_id is the smallest
doc_id of a component's rows, null only where none has one. An empty table gives no rows. Other columns are ignored
or carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .scratch import Scratch, chosen
from .text import SPACE, Block, blocks, column, mix, windows

WORDS, HASHES, ROWS, BATCH, MISS = 5, 128, 4, 16, 1e-6
PERCENT = 75
_rng = np.random.RandomState(7)
MUL = (_rng.randint(0, 2**31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
XOR = _rng.randint(0, 2**32, HASHES, np.uint64).astype(np.uint32)


class Shingles:
    """One text's distinct shingles: hashes (sorted), the word at which each first starts, and their exact number.

    A shingle is `words` words, or the whole text if it has fewer.
    """

    def __init__(self, block: Block, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, a: int, b: int, words: int):
        self.block, self.starts, self.ends, self.first, self.words = block, starts, ends, a, min(words, b - a)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        self.h, self.at, self.n, self.count = h[order[new]], order[new], int(new.sum()), len(h)
        i, j = order[1:][~new[1:]] + a, order[:-1][~new[1:]] + a
        self.plain = not len(i) or all(block.same(starts, ends, i + k, j + k).all() for k in range(self.words))
        if not self.plain:  # unequal shingles with one hash
            self.n = len(self.tuples())

    def text(self, at: int, n: int) -> list[bytes]:
        """n words from the given one."""
        return self.block.bytes[self.starts[self.first + at] : self.ends[self.first + at + n - 1]].split()

    def tuples(self) -> set[tuple[bytes, ...]]:
        w = self.text(0, self.count + self.words - 1) if self.count else []
        return {tuple(w[k : k + self.words]) for k in range(self.count)}

    def common(self, other: Shingles) -> int:
        """Number of shingles that both have."""
        if not (self.plain and other.plain):
            return len(self.tuples() & other.tuples())
        if self.words != other.words:
            return 0
        _, i, j = np.intersect1d(self.h, other.h, assume_unique=True, return_indices=True)
        i, j = self.at[i], other.at[j]
        order = np.argsort(i)
        i, j = i[order], j[order]
        cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1  # runs of neighbours are compared at once
        for x, y in zip(np.split(i, cut), np.split(j, cut), strict=True):
            if len(x) and self.text(x[0], len(x) + self.words - 1) != other.text(y[0], len(y) + self.words - 1):
                return len(self.tuples() & other.tuples())
        return len(i)


def shingle_sets(block: Block, words: int = WORDS) -> list[Shingles]:
    """The shingles of each text of a lower-cased block."""
    starts, ends, first = block.words(SPACE)
    h = block.hashes(starts, ends)
    w = windows(h, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            mine = w[a : b - words + 1]
        else:
            mine = windows(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64)
        out.append(Shingles(block, starts, ends, mine, a, b, words))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        y = (x[at : at + 4096, None] ^ XOR) * MUL
        np.minimum(best, (y ^ (y >> np.uint32(15))).min(axis=0), out=best)
    return best


SKETCH = "doc_id long, key binary, n_shingles long, sig binary, bands array<long>"


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, lower=True):
            sets = shingle_sets(block)
            full = np.array([len(s.h) > 0 for s in sets])
            sigs = np.array([signature(s.h) for s in sets if len(s.h)], np.uint32).reshape(-1, HASHES)
            keys = mix(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64))[None, :].repeat(len(sigs), 0)
            for k in range(ROWS):
                keys = mix(keys ^ sigs[:, k::ROWS].astype(np.uint64))
            at = np.concatenate([[0], np.cumsum(full * (HASHES // ROWS))]).astype(np.int32)
            short = iter(sigs.astype("<u2"))
            yield pa.record_batch(
                [
                    column(block.rows, "doc_id"), column(block.rows, "key"), pa.array([s.n for s in sets], pa.int64()),
                    pa.array([next(short).tobytes() if f else None for f in full], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64))),
                ],
                ["doc_id", "key", "n_shingles", "sig", "bands"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).mapInArrow(run, SKETCH)


def least_matches(n: int, miss: float = MISS, threshold: float = PERCENT / 100) -> int:
    """Fewest of n matching hashes at which the posterior of similarity >= threshold is at least `miss`.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail above t is P(Bin(n + 1, t) <= m).
    """
    total, t = 0.0, threshold
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def prune(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs a, b that survive all batches, and their matching hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [least_matches(n) for n in range(BATCH, HASHES + 1, BATCH)]
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
            live, m = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                s = slice(k * BATCH, (k + 1) * BATCH)
                m[live] += (x[live, s] == y[live, s]).sum(axis=1)
                live = live[m[live] >= need]
            yield pa.record_batch([column(batch, "a").take(pa.array(live)), column(batch, "b").take(pa.array(live)), pa.array(m[live])], ["a", "b", "m"])

    a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "sa", "b", "sb").mapInArrow(run, "a long, b long, m long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (column(batch, c).to_pylist() for c in "ab")
            sets: dict[int, Shingles | None] = {}
            for ids, name in ((a, "ta"), (b, "tb")):
                new = [k for k, i in enumerate(ids) if i not in sets and sets.setdefault(i, None) is None]
                some = pa.record_batch([pa.array([ids[k] for k in new], pa.int64()), column(batch, name).take(pa.array(new, pa.int64()))], ["i", "text"])
                for block in blocks([some], lower=True):
                    sets.update(zip(column(block.rows, "i").to_pylist(), shingle_sets(block), strict=True))
            ok = []
            for x, y in zip((sets[i] for i in a), (sets[i] for i in b), strict=True):
                near = 100 * min(x.n, y.n) >= PERCENT * max(x.n, y.n)
                both = x.common(y) if near else 0
                ok.append(near and 100 * both >= PERCENT * (x.n + y.n - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([column(batch, c).filter(keep) for c in "ab"], ["a", "b"])

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Those of a, b, ... in different components; a document without one is a component of its own."""
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def split_members(members: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp of the documents of buckets that hold more than one component."""
    m = members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    split = scratch.keep(m.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket"), "split")
    return m.join(split, "bucket", "left_semi").select("node", "comp").distinct()


def shingle_rows(texts: DataFrame) -> DataFrame:
    """texts: node, text, comp. A row for each distinct shingle of each document: token (its hash), node, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, lower=True):
            sets = [s.h for s in shingle_sets(block)]
            k = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            token = np.concatenate([np.zeros(0, np.uint64), *sets])
            yield pa.record_batch([pa.array(token.view(np.int64)), column(block.rows, "node").take(k), column(block.rows, "comp").take(k)], ["token", "node", "comp"])

    return texts.select("node", "text", "comp").mapInArrow(run, "token long, node long, comp long")


def prefixes(shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """shingles: token, node, comp. Each document's tokens of the prefix filter: token, node, comp, n (shingles), most.

    Shingles are ordered: first those of one component alone, then rarest first, by their exact number of documents. Two sets
    that reach the threshold share a shingle in the first n - ceil(0.75 n) + 1 of each, and behind their first common one
    both have enough left for the overlap that their sizes ask for: `most` is the largest partner for which this one
    has. Any order gives all pairs. Those of one component alone can't be shared by the pairs that are asked for, so they
    take up places without a row, and a document with more than a quarter of them has no row at all.
    """
    mixed = shingles.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("often"))
    mixed = scratch.keep(mixed.where("low < high").select("token", "often"), "mixed")
    held = shingles.select("token", "node").join(mixed, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    rows = held.join(shingles.groupBy("node").agg(F.first("comp").alias("comp"), F.count("*").alias("n")), "node")
    own = F.col("n") - F.size("t")
    rows = rows.withColumn("own", own).withColumn("left", (F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1 - own).cast("int"))
    rows = rows.where("left > 0").select("node", "comp", "n", "own", F.posexplode(F.slice("t", F.lit(1), F.col("left"))).alias("i", "t"))
    most = F.floor(((100 + PERCENT) * (F.col("n") - F.col("own") - F.col("i")) - PERCENT * F.col("n")) / PERCENT)
    return rows.select("t.token", "node", "comp", "n", most.alias("most"))


def prefix_pairs(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a, b of different components that a prefix filter can't rule out.

    Tokens are joined with the class of length, the smaller document's row standing in every class that its largest
    partner allows. So a token that very many documents hold costs pairs only where sizes and places leave room for the
    threshold, and is dealt by length; its rows are a plain table, so that the join can split it further.
    """
    rows = scratch.keep(prefixes(scratch.keep(shingle_rows(texts), "shingles"), scratch), "tokens")
    size = lambda n: F.floor(F.log(F.col(n)) / F.log(F.lit(1.1)) + 1e-9).cast("int")
    a, b = (rows.select("token", *[F.col(c).alias(c + x) for c in ("node", "comp", "n", "most")]) for x in "ab")
    a = a.where("mosta >= na").withColumn("size", F.explode(F.sequence(size("na"), size("mosta"))))
    b = b.withColumn("size", size("nb"))
    room = "nb <= mosta and na <= mostb and (na < nb or (na = nb and nodea < nodeb)) and compa != compb"
    pairs = a.join(b, ["token", "size"]).where(room)
    return pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def groups(docs: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, n_shingles of every row; key, rep (none, doc_id), comp of every text that has a word.

    rep is the smallest doc_id with the text, a null one last; comp is a number of the component.
    """
    all_ = s.keep(sketch(docs), "sketch")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep")
    classes = all_.where("n_shingles > 0").groupBy("key").agg(rep, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = s.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbered once
    bands = classes.select(F.explode("bands").alias("bucket"), "node", "rep.none", "rep.doc_id")
    first = F.min(F.struct("none", "doc_id", "node"))["node"]
    shared = bands.groupBy("bucket").agg(first.alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    # a table of its own, as a join can split a large bucket only between two plain inputs
    shared = s.keep(shared, "shared")
    members = s.keep(bands.select("bucket", "node").join(shared, "bucket"), "members")
    pool = classes.select("node", "key", "rep.*", "sig").join(members.select("node").distinct(), "node", "left_semi")
    pool = s.keep(pool.select("node", "key", F.coalesce("doc_id", F.lit(0)).alias("id"), "none", "sig"), "pool")
    sigs, row = pool.select("node", "sig"), ["key", "id", "none"]
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    texts = docs.select(text_key(text).alias("key"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), text.alias("text"))
    texts = s.keep(texts.join(pool.drop("sig"), row).dropDuplicates(row).select("node", "text"), "texts")
    star = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = s.keep(prune(star, sigs), "star")
    first = star.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("m"), "a"))).where("k = 1")
    links = s.keep(verify(first, texts), "links")
    comps = components(links, s)
    links = links.unionByName(s.keep(verify(across(star, comps), texts), "links"))
    comps = components(links, s)
    split = s.keep(texts.join(split_members(members, comps, s), "node"), "split")
    links = links.unionByName(s.keep(verify(prune(prefix_pairs(split, s), sigs), texts), "links"))
    comps = components(links, s)
    return all_.select("doc_id", "key", "n_shingles"), classes.select("key", "rep", "node").join(comps, "node", "left").select("key", "rep", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    s = Scratch(docs.sparkSession)
    rows, classes = groups(docs, s)
    least = classes.groupBy("comp").agg(F.min("rep").alias("least"))
    # a table of its own, so that the join on a text with very many copies can be split
    classes = s.keep(classes.join(least, "comp").select("key", F.col("least.doc_id").alias("component_id")), "least")
    rows = rows.join(classes.withColumn("some", F.lit(True)), "key", "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_near(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id (then of the smallest SHA-256), and all rows without words."""
    s = Scratch(docs.sparkSession)
    _, classes = groups(docs.select("doc_id", "text"), s)
    best = classes.groupBy("comp").agg(F.min(F.struct("rep.none", "rep.doc_id", "key")).alias("best"))
    keepers = s.keep(best.select("best.key", "best.doc_id"), "keepers")
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return chosen(docs.where(words), text_key(F.col("text").cast("string")), keepers).union(docs.where(~words))
