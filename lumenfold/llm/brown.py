"""Class-based bigram model: exchange clustering assigns words to classes.

Counts of all words of all training documents are a table by the words' bytes. Words seen at least LEAST times are
clustered; rarer ones are one item together, as usual for class models: a word seen a few times has no neighbours that
tell its class. The FREQUENT most frequent words get numbers that go to every task (a bounded table). Of these the
core, the TOP most frequent words with the document end and the rare item, is clustered on the driver by exchange (a
square of a parameter, not of the data). Pairs of neighbours with any other frequent word are counted in a table that
is dealt by that word, so sweeps over it move nothing: a word's counts by neighbour class come from its own part, and
it goes to the class that raises the class bigram likelihood most against the matrix of classes, which alone the driver
holds; before each sweep the core moves too, by all its neighbours. The words of one half move at a time; sweeps end when a round gains little, and a sweep that loses is undone.
Words of at least LEAST beyond the FREQUENT are then placed by one more pass over the texts, so every such word gets
its class by exchange, however many there are. A sieve of bounded size, two bits set for each of these words, goes to
every task: words that don't pass it are surely rare, so their neighbours need not be written. It only spares work: a
word that passes by chance is counted and found rare, and a full sieve lets all words pass.

A word's probability is P(class | class of the word before) * P(word | class). A word that training lacks has count 0
in the rare item's class, where a place is left for it; each class leaves one.

Null and empty texts have one token, the end. Very long texts are handled whole. Rows that repeat a doc_id are scored
each, by their own texts; a null doc_id is not held out. Without training documents all scores are finite: c, N and V
are 0. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .text import SPACE, Block, blocks, column, concat_ranges, distinct_words

TOP, CLASSES, FREQUENT, LEAST = 1000, 64, 1 << 18, 8
ROUNDS, GAIN = 3, 0.02  # most rounds of two sweeps, and the share of the mutual information that a round must gain
END, RARE, FIRST = 0, 1, 2  # numbers of the document end, of all words without a number, and of the first frequent word
BITS = 20  # of a number
SIEVE = 1 << 27  # most bits of the sieve
BLOCK, HELD, PART = 1 << 21, 1 << 19, 1 << 19  # bytes of text handled at once, pairs held by a task, training tokens for each part of the table


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: every distinct word's count; the empty word stands for the document end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, lower=True, size=BLOCK):
            starts, ends, _ = block.words(SPACE)
            words, i = distinct_words(block, starts, ends)
            words = pa.concat_arrays([words.cast(pa.binary()), pa.array([b""], pa.binary())])
            yield pa.record_batch([words, pa.array(np.append(np.bincount(i, minlength=len(words) - 1), len(block)).astype(np.int64))], ["word", "c"])

    return texts(docs).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def places(words: pa.Array, bits: int) -> np.ndarray:
    """The two bits of each word in a sieve of so many bits, a power of two."""
    block = Block(None, words, False)
    h = block.hashes(block.at[:-1], block.at[1:] - 1)
    return np.stack([h, h >> np.uint64(32)]).astype(np.int64) & (bits - 1)


def sieve(words: DataFrame, bits: int) -> np.ndarray:
    """The bits of all words of a table, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(places(column(batch, "word"), bits).ravel())], ["place"])

    rows = words.select("word").mapInArrow(run, "place long")
    found = rows.groupBy(F.shiftright("place", 15).alias("of")).agg(F.bitmap_construct_agg(F.col("place") % (1 << 15)).alias("bits")).toArrow()  # at most `bits` bits
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for i, x in zip(found["of"].to_pylist(), found["bits"], strict=True):
        out[i] = np.frombuffer(x.as_py(), np.uint8)
    return out.ravel()


class Words:
    """Numbers of the frequent words, most frequent first."""

    def __init__(self, words: pa.Array, c: np.ndarray, ends: int, rare: int, sieve: np.ndarray | None):
        """rare: all tokens of words that aren't frequent. sieve: of those of them that are to be placed, if any."""
        self.words, self.c, self.sieve = words, np.concatenate([[ends, rare], c]), sieve

    def unsure(self, ids: np.ndarray, distinct: pa.Array, which: np.ndarray) -> np.ndarray:
        """Which tokens' words may be among those to be placed. The arguments are what ids() returns."""
        out = np.zeros(len(ids), bool)
        rare = np.flatnonzero(ids == RARE)
        if self.sieve is not None and len(rare):
            passed = np.zeros(len(distinct), bool)
            words = np.unique(which[rare])
            at = places(distinct.take(pa.array(words)), 8 * len(self.sieve))
            passed[words] = (self.sieve[at >> 3] >> (at & 7) & 1).all(0)
            out[rare] = passed[which[rare]]
        return out

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of all tokens, ends included, where each document starts, the block's distinct words, and which each RARE token is."""
        starts, ends, first = block.words(SPACE)
        distinct, i = distinct_words(block, starts, ends)
        known = pc.index_in(distinct, value_set=self.words.cast(distinct.type)).fill_null(RARE - FIRST).to_numpy() + FIRST
        at = first + np.arange(len(first))  # one more token for each document before
        out, which = np.full(at[-1], END, np.int64), np.full(at[-1], -1, np.int64)
        place = concat_ranges(at[:-1], np.diff(first))
        out[place], which[place] = known[i], i
        return out, at, distinct, which


def before(ids: np.ndarray) -> np.ndarray:
    """Each token's neighbour to the left; before a document's first word stands an end, as before a block's first.
    Of marks of tokens, the neighbour's mark; an end has none."""
    return np.concatenate([np.full(1, END, ids.dtype), ids[:-1]])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at)


def squeeze(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their numbers as compressed bytes."""
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(keys, prepend=0), n)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps, n = (np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel().astype(np.int64) for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
    return np.cumsum(steps), n


def neighbours(docs: DataFrame, shared, few: int, parts: int) -> DataFrame:
    """part, blob: counts of pairs, keyed by the word (not of the core), the side of its neighbour and the neighbour.

    Side 0 is the neighbour to the right, 1 that to the left. Pairs inside the core are in parts below 0, keyed by both.
    Part p holds the words whose numbers leave p; equal keys of several tasks come in several blobs.
    """

    def deal(held: list[tuple[np.ndarray, np.ndarray]], core: np.ndarray | None) -> pa.RecordBatch:
        a_b, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 2
        a, b = a_b >> BITS, a_b & ((1 << BITS) - 1)
        right, left = a >= few, b >= few
        keys = np.concatenate([(a[right] << BITS + 1) | b[right], (b[left] << BITS + 1) | (1 << BITS) | a[left]])
        keys, n = summed(keys, np.concatenate([n[right], n[left]]))
        part = (keys >> BITS + 1) % parts
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, squeeze(keys[order[x:y]], n[order[x:y]])) for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y]
        if core is not None:
            cells = np.flatnonzero(core)
            rows += [(-1 - p, squeeze(cells[mine], core[cells[mine]])) for p in range(16) if (mine := cells // few % 16 == p).any()]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, core, held, size = shared.value, np.zeros(few * few, np.int64), [], 0
        for block in blocks(batches, lower=True, size=BLOCK):
            b = words.ids(block)[0]
            a = before(b)
            inside = (a < few) & (b < few)
            core += np.bincount(a[inside] * few + b[inside], minlength=few * few)
            keys, n = np.unique((a[~inside] << BITS) | b[~inside], return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > HELD:
                yield deal(held, None)
                held, size = [], 0
        yield deal(held, core)

    return texts(docs).mapInArrow(run, "part int, blob binary")


def merge(rows: DataFrame, parts: int) -> DataFrame:
    """One blob for each part, of distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(held):
            return summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def row(part, held):
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([squeeze(*total(held))], pa.binary())], ["part", "blob"])

        now, held, size = None, [], 0
        for batch in batches:
            for part, blob in zip(column(batch, "part").to_pylist(), column(batch, "blob"), strict=True):
                if part != now and held:
                    yield row(now, held)
                    held, size = [], 0
                now = part
                held.append(unsqueeze(blob.as_py()))
                size += len(held[-1][0])
                if size > 2 * HELD and len(held) > 1:
                    held = [total(held)]
                    size = len(held[0][0])
        if held:
            yield row(now, held)

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "part int, blob binary")


def g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(own: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the log likelihood gains if a word joins each class, having left its own (-1: none).

    word, cell, n: the words' counts in order of words, by the class of the right neighbour, or from len(m) on by that
    of the left one. A word's meetings with its own class are counted at the rows and columns of that class as they stand.
    """
    k = len(m)
    both = np.concatenate([m, m.T], axis=1).T  # by cell, then by the class to join
    out = np.zeros((len(own), k))
    if len(word):
        x = n[:, None]
        part = g(both[cell] + x) - g(both)[cell]
        had = np.flatnonzero(own[word] >= 0)  # where the word has to be taken out
        old = both[cell[had], own[word[had]]]
        part[had, own[word[had]]] = g(np.maximum(old - n[had], 0) + n[had]) - g(np.maximum(old - n[had], 0))
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[edge]] = np.add.reduceat(part, edge, axis=0)
    left = np.eye(k)[own] * (own >= 0)[:, None]
    for side, total in ((cell < k, m.sum(1)), (cell >= k, m.sum(0))):
        t = np.bincount(word[side], n[side], len(own))[:, None]
        base = np.maximum(total - left * t, 0)
        out -= g(base + t) - g(base)
    return out


def cells(keys: np.ndarray, n: np.ndarray, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a blob, and their counts by neighbour class: word (place among these), cell, n. Neighbours without a class count for none."""
    w, k = keys >> BITS + 1, of[keys & ((1 << BITS) - 1)]
    words, place = np.unique(w, return_inverse=True)
    some = k >= 0
    cell = place[some] * 2 * classes + (keys[some] >> BITS & 1) * classes + k[some]
    sums = np.bincount(cell, n[some], len(words) * 2 * classes)
    at = np.flatnonzero(sums)
    return words, at // (2 * classes), at % (2 * classes), sums[at]


def sweep(table: DataFrame, of: np.ndarray, m: np.ndarray, half: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Words of the table and their classes after the words of one half, or all, have moved."""
    shared, classes = table.sparkSession.sparkContext.broadcast((of, m)), len(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = shared.value
        for batch in batches:
            for blob in column(batch, "blob"):
                words, word, cell, n = cells(*unsqueeze(blob.as_py()), of, classes)
                own, k = of[words], np.empty(len(words), np.int64)
                for a in range(0, len(words), 1000):
                    i, j = np.searchsorted(word, (a, a + 1000))
                    mine = own[a : a + 1000]
                    gain = gains(mine, word[i:j] - a, cell[i:j], n[i:j], m)
                    best = gain.argmax(1)
                    stay = (mine >= 0) & (gain.max(1) <= gain[np.arange(len(mine)), mine] + 1e-6)
                    k[a : a + 1000] = np.where(stay, mine, best)
                if half is not None:
                    k = np.where((own >= 0) & (words % 2 != half), own, k)
                yield pa.record_batch([pa.array(words), pa.array(k)], ["w", "k"])

    found = table.where("part >= 0").mapInArrow(run, "w long, k long").toArrow()  # at most FREQUENT rows of two numbers
    return found["w"].to_numpy(), found["k"].to_numpy()


def matrix(table: DataFrame, core: np.ndarray, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each class follows each, over pairs of frequent words that both have a class, and the counts of
    each word of the core by the class of its neighbours outside it (to the right, then to the left)."""
    few, shared, square = len(core), table.sparkSession.sparkContext.broadcast(of), classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = shared.value, np.zeros(square + few * 2 * classes)
        for batch in batches:
            for blob in column(batch, "blob"):
                keys, n = unsqueeze(blob.as_py())
                w, other, left = of[keys >> BITS + 1], keys & ((1 << BITS) - 1), keys >> BITS & 1
                k = of[other]
                inner = (other < few) & (w >= 0)
                # a pair of two words of the table stands there twice; the row of its left word counts
                use = (w >= 0) & (k >= 0) & ((left == 0) | (other < few))
                a, b = np.where(left, k, w)[use], np.where(left, w, k)[use]
                sums += np.bincount(np.concatenate([a * classes + b, square + (2 * other + 1 - left)[inner] * classes + w[inner]]), np.concatenate([n[use], n[inner]]), len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at].astype(np.int64))], ["cell", "n"])

    sums = np.zeros(square + few * 2 * classes)
    rows = table.where("part >= 0").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # as many as `sums` has at most
    sums[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    m, (a, b) = sums[:square], np.nonzero(core)
    m = m + np.bincount(of[a] * classes + of[b], core[a, b], square)
    return m.reshape(classes, classes), sums[square:].reshape(few, 2 * classes)


def information(m: np.ndarray) -> float:
    """Mutual information of neighbouring classes: the log likelihood a pair, but for a part that no move changes."""
    total = m.sum()
    return float((g(m).sum() - g(m.sum(0)).sum() - g(m.sum(1)).sum()) / max(total, 1) + np.log(max(total, 1)))


def cluster(table: DataFrame, size: int, few: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the `size` numbers, and the matrix of classes. table: merged parts; few: numbers of the core."""
    core = np.zeros(few * few, np.int64)
    for blob in table.where("part < 0").select("blob").toArrow()["blob"]:  # at most a square of the core
        at, n = unsqueeze(blob.as_py())
        core[at] = n
    core = core.reshape(few, few)
    of = np.full(size, -1, np.int64)
    of[:few] = exchange(core, classes)
    best, last, k = None, None, 0
    while True:
        m, more = matrix(table, core, of, classes)
        now = information(m)
        # the first sweep gives classes to words that had none, so it has nothing to lose
        if k > 1 and now <= best[1]:
            return best[0], best[2]
        best = of, now, m
        if few == size or k > 2 * rounds:
            return of, m
        if k % 2 == 1:
            if last is not None and now - last < GAIN * now:
                return of, m
            last = now
        of, m = of.copy(), m.copy()
        if k:
            of[:few] = exchange(core, classes, 1, of[:few], more, m)
        words, new = sweep(table, of, m, None if k == 0 else k % 2)
        of[words] = new
        k += 1


def exchange(n: np.ndarray, classes: int = CLASSES, rounds: int = 6, of: np.ndarray | None = None, more: np.ndarray | None = None, m: np.ndarray | None = None) -> np.ndarray:
    """The class of each item. n: bigram counts of items.

    of: classes to start from; more: the items' counts by the class of neighbours that stay (to the right, then to the
    left); m: the matrix of classes with these, which follows the moves.
    """
    size, n = len(n), n.astype(float)
    if of is None:
        classes = min(classes, size)
    order = np.lexsort((np.arange(size), -(n.sum(0) + n.sum(1))))
    if of is None:
        of = np.empty(size, np.int64)
        of[order] = np.arange(size) % classes
    of, one = of.copy(), np.eye(classes)[of]
    left, right = n @ one, n.T @ one  # of each item, by the class of its right and left neighbour
    if m is None:
        m = one.T @ left
    if more is not None:
        left, right = left + more[:, :classes], right + more[:, classes:]
    eye = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            a = of[w]
            lw, rw, own = left[w].copy(), right[w].copy(), n[w, w]
            lw[a] -= own
            rw[a] -= own
            m[a] -= lw
            m[:, a] -= rw
            m[a, a] -= own
            rows, cols = g(m + lw), g(m.T + rw)
            old = g(m)
            # adding w to class b changes row b, column b and their crossing
            gain = (rows - old).sum(1) + (cols - old.T).sum(1)
            d = m[eye, eye]
            gain += g(d + lw + rw + own) - rows[eye, eye] - cols[eye, eye] + g(d)
            out, into = m.sum(1), m.sum(0)
            lt, rt = lw.sum() + own, rw.sum() + own
            gain -= g(out + lt) - g(out) + g(into + rt) - g(into)
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-6 else a
            m[b] += lw
            m[:, b] += rw
            m[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                left[:, a] -= n[:, w]
                left[:, b] += n[:, w]
                right[:, a] -= n[w]
                right[:, b] += n[w]
        if moved <= size // 200:
            break
    return of


def beyond(docs: DataFrame, words, of: np.ndarray, classes: int) -> DataFrame:
    """word, code, second: for words that may be placed their counts by neighbour, code being n * cells + cell, and for
    pairs of two such words code being n."""
    shared, cells = docs.sparkSession.sparkContext.broadcast((words.value, of)), 2 * classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value
        for block in blocks(batches, lower=True, size=BLOCK):
            b, _, distinct, which = words.ids(block)
            unsure = words.unsure(b, distinct, which)
            at = np.flatnonzero(unsure)
            right, left, twins = b[at + 1], before(b)[at], before(unsure)[at]  # an end stands last
            # the last two cells are neighbours that may be placed themselves
            keys = np.concatenate([which[at] * cells + np.where(unsure[at + 1], 2 * classes, of[right]), which[at] * cells + np.where(twins, 2 * classes + 1, classes + of[left])])
            keys, n = np.unique(keys, return_counts=True)
            twin = at[twins]
            pairs, times = np.unique(which[twin - 1] * max(len(distinct), 1) + which[twin], return_counts=True)
            first, second = (distinct.take(pa.array(x)).cast(pa.binary()) for x in (pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)))
            own = distinct.take(pa.array(keys // cells)).cast(pa.binary())
            code = np.concatenate([n * cells + keys % cells, times])
            yield pa.record_batch([pa.concat_arrays([own, first]), pa.array(code), pa.concat_arrays([pa.nulls(len(own), pa.binary()), second])], ["word", "code", "second"])

    return texts(docs).mapInArrow(run, "word binary, code long, second binary")


def place(rows: DataFrame, of: np.ndarray, m: np.ndarray, least: int) -> DataFrame:
    """word, c, k, cells: the class of each word that isn't frequent but has `least` counts, and its neighbours that had a class before by side and class."""
    classes = len(m)
    shared, cells = rows.sparkSession.sparkContext.broadcast((of, m)), 2 * classes + 2

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = shared.value
        to = np.append(np.arange(2 * classes), [of[RARE], classes + of[RARE]])
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                codes = column(rows, "codes")
                word, code = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy()), codes.flatten().to_numpy()
                sums = np.bincount(word * cells + code % cells, code // cells, len(codes) * cells).reshape(-1, cells)
                known, c = sums[:, : 2 * classes].astype(np.int64), (sums[:, classes : 2 * classes].sum(1) + sums[:, -1]).astype(np.int64)
                keys, n = summed(word * 2 * classes + to[code % cells], (code // cells).astype(float))
                k = gains(np.full(len(codes), -1), keys // (2 * classes), keys % (2 * classes), n, m).argmax(1)
                found = pa.record_batch([column(rows, "word"), pa.array(c), pa.array(k), pa.array(list(known), pa.list_(pa.int64()))], ["word", "c", "k", "cells"])
                yield found.filter(pa.array(c >= least))

    # summed by cell first, so a word's list has `cells` entries at most; both groupings use the one exchange by word
    sums = rows.where("second is null").repartition("word").groupBy("word", F.expr(f"code % {cells}").alias("cell")).agg(F.expr(f"sum(code div {cells})").alias("n"))
    lists = sums.groupBy("word").agg(F.collect_list(F.col("n") * cells + F.col("cell")).alias("codes"))
    return lists.mapInArrow(choose, "word binary, c long, k long, cells array<long>")


class Model:
    """Tables of log10 probabilities, by class."""

    def __init__(self, m: np.ndarray, of: np.ndarray, totals: np.ndarray, members: np.ndarray):
        self.of, self.rare = of, int(of[RARE])
        self.step = np.log10((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * len(m)))
        self.rest = np.log10(totals + 0.5 * (members + 1))  # one more for words of count 0


class Trained:
    """What training leaves: total and distinct tokens, numbers of the frequent words, the model, word, c, k of all other words, and whether any of these were placed."""

    def __init__(self, total: int, distinct: int, words, model: Model, others: DataFrame, placed: bool):
        self.total, self.distinct, self.words, self.model, self.others, self.placed = total, distinct, words, model, others, placed


def train(docs: DataFrame, s: Scratch, classes: int = CLASSES, frequent: int = FREQUENT, least: int = LEAST, top: int = TOP, bits: int = SIEVE) -> Trained:
    spark = docs.sparkSession
    counts = s.keep(count_words(docs), "counts")
    total, distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    total, ends = total or 0, ends or 0
    # where the counts of the most frequent words end, by classes of counts; of the last class a share by hash
    step, share = F.floor(F.log2("c") * 8), F.pmod(F.xxhash64("word"), F.lit(1 << 20))
    some = (F.length("word") > 0) & (F.col("c") >= least)
    low, part, left = 0, 1 << 20, frequent
    for r in counts.where(some).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if left > 0:
            low, part = r.step, min(1 << 20, (left << 20) // r["count"])
        left -= r["count"]
    more = max(0, -left)  # words of `least` counts that aren't frequent, but for chance
    often = some & ((step > low) | ((step == low) & (share < part)))
    found = counts.where(often).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    c = found["c"].to_numpy().astype(np.int64)
    room = min(bits, 1 << max(15, (16 * more).bit_length()))
    shared = spark.sparkContext.broadcast(Words(found["word"].combine_chunks(), c, ends, total - ends - int(c.sum()), sieve(counts.where(some & ~often), room) if more else None))
    size, few = FIRST + len(c), min(FIRST + top, FIRST + len(c))
    parts = max(1, min(1 << 16, -(-total // PART)))
    table = s.keep(merge(neighbours(docs, shared, few, parts), parts), "pairs")
    of, m = cluster(table, size, few, classes)
    others = counts.where((F.length("word") > 0) & ~often)
    k = int(of[RARE])
    members, totals = (np.bincount(of, x, classes) for x in (np.where(np.arange(size) == RARE, 0, 1), shared.value.c))
    members[k] += distinct - (ends > 0) - len(c)
    if more:
        rows = s.keep(beyond(docs, shared, of, classes), "beyond")
        placed = s.keep(place(rows, of, m, least), "placed")
        sums = placed.groupBy("k").agg(F.count("*").alias("members"), F.sum("c").alias("c"), *[F.sum(F.get("cells", F.lit(j))).alias(f"c{j}") for j in range(2 * classes)])
        m = m.copy()
        for r in sums.collect():
            here = np.array([r[f"c{j}"] for j in range(2 * classes)], float)
            for to, sign in ((r.k, 1), (k, -1)):
                members[to] += sign * r.members
                totals[to] += sign * r.c
                m[to] += sign * here[:classes]
                m[:, to] += sign * here[classes:]
        pairs = rows.where("second is not null").select("word", "second", F.col("code").alias("n"))
        for x, kx in (("word", "ka"), ("second", "kb")):
            pairs = pairs.join(placed.select(F.col("word").alias(x), F.col("k").alias(kx)), x, "left")
        for r in pairs.groupBy(F.coalesce("ka", F.lit(k)).alias("ka"), F.coalesce("kb", F.lit(k)).alias("kb")).agg(F.sum("n").alias("n")).collect():
            m[k, k] -= r.n
            m[r.ka, r.kb] += r.n
        others = others.join(placed.select("word", "k"), "word", "left")
    else:
        others = others.withColumn("k", F.lit(k).cast("long"))
    others = s.keep(others.select("word", "c", F.coalesce("k", F.lit(k).cast("long")).alias("k")), "others")
    return Trained(total, distinct, shared, Model(np.maximum(m, 0), of, totals, members), others, more > 0)


LOCAL = "doc_id long, uid long, n_tokens long, known long, logs double, model double, words array<binary>, sides array<int>, times array<int>, first array<binary>, second array<binary>, both array<int>"


def grouped(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Distinct keys of each document, where each document's start, and how often each stands. keys are below 2**40."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(keys)))
    return keys[at], pa.array(np.searchsorted(doc[at], np.arange(docs + 1)).astype(np.int32)), pa.array(times.astype(np.int32))


def local(docs: DataFrame, shared) -> DataFrame:
    """What a document's own task can tell; its words that are not frequent, and pairs of two that may have been placed.

    Those that may have been placed stand with the classes on both sides. All others have the rare item's class, and
    only their counts are left open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, _ = shared.value
        classes, uid = len(model.step), TaskContext.get().partitionId() << 40
        logs, emit = np.log10(words.c + 1.0), np.log10(words.c + 0.5) - model.rest[model.of]
        for block in blocks(batches, lower=True, size=BLOCK):
            b, at, distinct, which = words.ids(block)
            doc, n = np.repeat(np.arange(len(block)), np.diff(at)), len(block)
            hit, ka, kb = b != RARE, model.of[before(b)], model.of[b]
            unsure = words.unsure(b, distinct, which)
            after = before(unsure)
            sure = ~unsure & ~after
            score = np.bincount(doc, np.where(hit, emit[b], 0) + np.where(sure, model.step[ka, kb], 0), n)
            rare = np.flatnonzero(~hit)
            # 0: no class to meet there
            side = np.where(unsure[rare], np.where(after[rare], 0, ka[rare] + 1) * (classes + 1) + np.where(unsure[rare + 1], 0, kb[rare + 1] + 1), 0)
            size = (classes + 1) ** 2
            keys, to, times = grouped(which[rare] * size + side, doc[rare], n)
            lists = [(to, distinct.take(pa.array(keys // size)).cast(pa.binary())), (to, pa.array((keys % size).astype(np.int32))), (to, times)]
            twin = np.flatnonzero(unsure & after)
            keys, to, times = grouped(which[twin - 1] * len(distinct) + which[twin], doc[twin], n)
            lists += [(to, distinct.take(pa.array(x)).cast(pa.binary())) for x in (keys // max(len(distinct), 1), keys % max(len(distinct), 1))] + [(to, times)]
            known = np.bincount(doc, hit & (words.c[b] > 0), n).astype(np.int64)
            yield pa.record_batch(
                [column(block.rows, "doc_id"), pa.array(uid + np.arange(n)), pa.array(np.diff(at)), pa.array(known), pa.array(np.bincount(doc, np.where(hit, logs[b], 0), n)), pa.array(score), *(pa.ListArray.from_arrays(*x) for x in lists)],
                [x.split()[0] for x in LOCAL.split(", ")],
            )
            uid += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LOCAL)


def rare_scores(rows: DataFrame, others: DataFrame, shared) -> DataFrame:
    """uid, more, seen, add: what the words that are not frequent add. rows: those of local()."""
    word = lambda x: F.col(x).alias("word")
    some = rows.select("uid", F.explode(F.arrays_zip("words", "sides", "times")).alias("x")).select("uid", word("x.words"), "x.sides", "x.times").join(others, "word", "left")
    pairs = rows.select("uid", F.explode(F.arrays_zip("first", "second", "both")).alias("x")).select("uid", word("x.first"), "x.second", F.col("x.both").alias("times"))
    pairs = pairs.join(others.select("word", F.col("k").alias("ka")), "word", "left").select("uid", word("second"), "times", "ka").join(others, "word", "left")
    rows = some.select("uid", "times", "c", "k", "sides", F.lit(None).cast("long").alias("ka"))
    if shared.value[2]:
        rows = rows.unionByName(pairs.select("uid", "times", "c", "k", F.lit(-1).alias("sides"), "ka"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model, _ = shared.value
        rare, classes = int(model.of[RARE]), len(model.step)
        for batch in batches:
            uid, times, sides = (column(batch, x).to_numpy() for x in ("uid", "times", "sides"))
            c, k, ka = (column(batch, x).fill_null(none).to_numpy(zero_copy_only=False) for x, none in (("c", 0), ("k", rare), ("ka", rare)))
            own = sides >= 0
            left, right = sides // (classes + 1) - 1, sides % (classes + 1) - 1
            add = np.where(own, np.log10(c + 0.5) - model.rest[k], model.step[ka, k])
            add += np.where(own & (left >= 0), model.step[left, k], 0) + np.where(own & (right >= 0), model.step[k, right], 0)
            yield pa.record_batch([pa.array(uid), pa.array(np.where(own, times * np.log10(c + 1.0), 0)), pa.array((times * (own & (c > 0))).astype(np.int64)), pa.array(times * add)], ["uid", "more", "seen", "add"])

    return rows.mapInArrow(run, "uid long, more double, seen long, add double").groupBy("uid").agg(*[F.sum(x).alias(x) for x in ("more", "seen", "add")])


def class_scores(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark, s = docs.sparkSession, Scratch(docs.sparkSession)
    t = train(docs.where(~held_out()), s, **how)
    shared = spark.sparkContext.broadcast((t.words.value, t.model, t.placed))
    rows = s.keep(local(docs, shared), "local")
    more = rare_scores(rows, t.others, shared)
    rows = rows.select("doc_id", "uid", "n_tokens", "known", "logs", "model").join(more, "uid", "left")
    more, score = F.coalesce("more", F.lit(0.0)), F.col("model") + F.coalesce("add", F.lit(0.0))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(int(t.total)).alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(t.total + t.distinct + 1)))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
