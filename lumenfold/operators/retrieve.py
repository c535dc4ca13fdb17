"""Exact cosine Top-K of every query in a library.

Two physical forms give the same rows. `block`: the library's
matrix is broadcast and multiplied by batches of queries. `partitioned`: queries are dealt into blocks and the library
into packs of PACK bytes; a block is one task which all packs pass, so that it ends with its queries' whole Top-K and no partial
lists are written. `block` and `auto` broadcast while the
library's matrix is below LIMIT bytes, as each Python worker holds it, and are `partitioned` beyond. Beyond SIDE blocks,
blocks grow until they hold FULL vectors or HELD bytes, as the library is copied once for each block.

Products are made in single precision, for QUERIES queries and STEP vectors at a time. Those that can't be below the K-th
best so far, whatever their rounding, are made again in double precision, and only these are compared.

Vectors that are null or not finite are left out. Ties go to the smaller library_index. With K above the size of
the library every row is returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import all_finite

LIMIT, SHARED, BLOCK, SIDE = 32 << 20, 256 << 20, 20_000, 12
QUERIES, CHUNK = 256, 4_096
PACK, STEP, PAIRS, FULL, HELD = 1 << 20, 1_024, 16_384, 40_000, 64 << 20
NONE = np.iinfo(np.int64).min  # stands for a key that is null, and comes first as it does
SPARSE, SPARSE_SIDE, SPARSE_QUERIES = 8_000, 5, 1_000
ENTRIES, SPARSE_BINS, SPARSE_HELD, SPARSE_SLICE = 1 << 20, 2_048, 20_000_000, 56_000_000
PACKED = ("ids", "size", "bins", "place", "value")
OUT = "query_index long, library_index long, similarity double"
RANKED = "query_index long, rank long, library_index long, similarity double"


def _usable(df: DataFrame, key: str) -> DataFrame:
    """Single vectors stay single until a task multiplies them."""
    kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast(kind).alias("embedding")).where(all_finite(F.col("embedding")))


def _matrix(values) -> np.ndarray:
    if not len(values):
        return np.zeros((0, 0))
    x = np.stack([np.asarray(v, np.float64) for v in values])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _best(q: np.ndarray, ids: np.ndarray, lib: np.ndarray, lib_ids: np.ndarray, k: int, tiles: Iterable[tuple[np.ndarray, int, int]] | None = None, least: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of lib for each row of q. Rounded products below a query's k-th best so far are never listed.

    tiles: rows of q that meet lib from a first row to a last, all of them by default; least: a bound that is known for each row of q.
    """
    row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(q), -np.inf) if least is None else least.copy()
    every = np.arange(len(q))
    for rows, first, last in ((every, at, at + CHUNK) for at in range(0, len(lib_ids), CHUNK)) if tiles is None else tiles:
        s = (q if len(rows) == len(q) else q[rows]) @ lib[first:last].T
        new = least[rows] == -np.inf
        if s.shape[1] > k and new.any():
            least[rows[new]] = np.partition(s[new], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        # rounding moves a product by half of 1e-12
        r, c = np.nonzero(s >= least[rows][:, None] - 2e-12)
        if not len(r):
            continue
        row, col, sim = np.concatenate([row, rows[r]]), np.concatenate([col, c + first]), np.concatenate([sim, _products_of(q, lib, rows[r], c + first)])
        order = np.lexsort((lib_ids[col], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, sim, place = (x[place < k] for x in (row, col, sim, place))
        kth = place == k - 1
        least[row[kth]] = np.maximum(least[row[kth]], sim[kth])
    return pd.DataFrame({"query_index": ids[row], "library_index": lib_ids[col], "similarity": sim})


def _products_of(q: np.ndarray, lib: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, rounded; each is summed by itself, so that it doesn't depend on the matrix it is in."""
    return np.round(_sums_of(q, lib, row, col), 12)


def _sums_of(q: np.ndarray, lib: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    step = max(1, 64 * PAIRS // max(q.shape[1], 1))
    parts = [np.einsum("ij,ij->i", q[row[i : i + step]], lib[col[i : i + step]]) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Nearest:
    """The k best of all library vectors that have been shown, for each row of q: unit vectors in double precision."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.single = q, k, q.astype(np.float32)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.parts = [[none] for _ in range(0, len(q), QUERIES)]
        self.least, self.last = np.full(len(q), -np.inf), np.full(len(q), NONE)  # the k-th best so far and its key

    def show(self, lib: np.ndarray, lib_ids: np.ndarray) -> None:
        # a sum of n products of single precision is off by n half units at most, as vectors are of norm 1; taken twice
        off, single = (lib.shape[1] + 8) * 2.0**-23, lib.astype(np.float32)
        for at in range(0, len(lib_ids), STEP):
            step, some, ids = lib[at : at + STEP], single[at : at + STEP].T, lib_ids[at : at + STEP]
            for i in range(len(self.parts)):
                rows = slice(i * QUERIES, (i + 1) * QUERIES)
                s, least, last = self.single[rows] @ some, self.least[rows], self.last[rows]
                bound = least - off
                new = least == -np.inf
                if s.shape[1] > self.k and new.any():
                    bound[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * off
                r, c = divmod(_true(s >= bound.astype(np.float32)[:, None]), s.shape[1])
                if len(r):
                    self._add(i, r, ids[c], _products_of(self.q[rows], step, r, c), least, last)

    def _add(self, i: int, row: np.ndarray, ids: np.ndarray, sim: np.ndarray, least: np.ndarray, last: np.ndarray) -> None:
        keep = (sim > least[row]) | (sim == least[row]) & (ids < last[row])
        self.parts[i].append((row[keep], ids[keep], sim[keep]))
        if (least == -np.inf).any() or sum(len(x[0]) for x in self.parts[i][1:]) > max(QUERIES, self.k * len(least) // 2):
            self._merge(i)

    def _merge(self, i: int) -> None:
        row, ids, sim = (np.concatenate(x) for x in zip(*self.parts[i], strict=True))
        order = np.lexsort((ids, -sim, row))
        row, ids, sim = row[order], ids[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        self.least[i * QUERIES + row[kth]], self.last[i * QUERIES + row[kth]] = sim[kth], ids[kth]
        self.parts[i] = [tuple(x[place < self.k] for x in (row, ids, sim))]

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of q, in their order, and for each the library's keys and similarities, best first; a batch of rows at a time."""
        for i in range(len(self.parts)):
            self._merge(i)
            row, ids, sim = self.parts[i][0]
            yield i * QUERIES + row, ids, sim


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of a matrix, counted through its rows, where it is true; eight at a time, as few are."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    hit = np.flatnonzero(flat.view(np.uint64))
    word, place = np.nonzero(flat.reshape(-1, 8)[hit])
    return hit[word] * 8 + place


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, NONE).to_numpy()


def _rows(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(len(column), size)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of `rows` rows or more; the last one has fewer."""
    held, count = [], 0
    for b in batches:
        held, count = [*held, b], count + b.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _buffer(value: pa.Scalar, kind: str) -> np.ndarray:
    held = value.as_buffer()
    return np.frombuffer(held, kind) if held.size else np.zeros(0, kind)


def _ranked_lists(search: Nearest, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What search has found, with ranks; queries of one key share one list."""
    found = search.found()
    if len(np.unique(keys)) < len(keys):
        found = [tuple(np.concatenate(x) for x in zip(*found, strict=True))]
    for row, ids, sim in found:
        key = keys[row]
        order = np.lexsort((ids, -sim, key))
        key, ids, sim = key[order], ids[order], sim[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key) + 1
        held = [pa.array(v[rank <= search.k], mask=v[rank <= search.k] == NONE if v.dtype == np.int64 else None) for v in (key, rank, ids, sim)]
        yield pa.record_batch(held, ["query_index", "rank", "library_index", "similarity"])


def _block_pairs(queries: pd.DataFrame, library: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of one block of the library for each query of another block, a batch of queries at a time."""
    if not len(queries) or not len(library):
        return
    library = library.sort_values("library_index")
    lib, ids = _matrix(library["embedding"]), library["library_index"].to_numpy()
    for at in range(0, len(queries), QUERIES):
        part = queries.iloc[at : at + QUERIES]
        yield _best(_matrix(part["embedding"]), part["query_index"].to_numpy(), lib, ids, k)


def _joined(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    none = pd.DataFrame({"query_index": np.zeros(0, np.int64), "library_index": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    return pd.concat([none, *parts])


def _best_of(s: np.ndarray, ids: np.ndarray, lib_ids: np.ndarray, k: int) -> pd.DataFrame:
    """lib_ids ascend, so a stable sort breaks ties by id."""
    k = min(k, len(lib_ids))
    if k < len(lib_ids):
        least = np.partition(s, len(lib_ids) - k, axis=1)[:, len(lib_ids) - k]
        rows, cols = np.nonzero(s >= least[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(s, bool))
    order = np.lexsort((lib_ids[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, cols = rows[place < k], cols[place < k]
    return pd.DataFrame({"query_index": ids[rows], "library_index": lib_ids[cols], "similarity": s[rows, cols]})


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_index").orderBy(F.desc("similarity"), "library_index")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_index", "rank", "library_index", "similarity")


def _shape(*sides: DataFrame) -> tuple[int, list[int]]:
    """The dimension and the number of rows of each side, in one pass over them; raises unless all vectors have one size."""
    size = F.size("embedding")
    parts = [df.agg(F.lit(i).alias("side"), F.count("*").alias("n"), F.min(size).alias("a"), F.max(size).alias("b")) for i, df in enumerate(sides)]
    for more in parts[1:]:
        parts[0] = parts[0].unionByName(more)
    rows = sorted(parts[0].collect())
    sizes = {v for r in rows for v in (r.a, r.b) if v is not None}
    if len(sizes) > 1:
        raise ValueError(f"vectors have sizes {sorted(sizes)}")
    return next(iter(sizes), 0), [r.n for r in rows]


def share(library: DataFrame) -> Broadcast | None:
    """The library's matrix and ids, broadcast for topk_shared(); None if the matrix exceeds SHARED."""
    lib = _usable(library, "library_index")
    size, (n,) = _shape(lib)
    return _share(lib) if n * size * 8 <= SHARED else None


def _share(lib: DataFrame) -> Broadcast:
    held = lib.orderBy("library_index").toPandas()
    return lib.sparkSession.sparkContext.broadcast((_matrix(held["embedding"]), held["library_index"].to_numpy()))


def topk_shared(queries: DataFrame, shared: Broadcast, k: int = 100) -> DataFrame:
    """topk_cosine() in a library that share() has broadcast; many calls can use one."""
    rows = max(QUERIES, HELD // (16 * max(k, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib, ids = shared.value
        for b in batches if len(ids) else ():
            for at in range(0, len(b), rows):
                search, keys = Nearest(_matrix(b["embedding"].iloc[at : at + rows]), k), b["query_index"].to_numpy()[at : at + rows]
                search.show(lib, ids)
                for row, library, sim in search.found():
                    yield pd.DataFrame({"query_index": keys[row], "library_index": library, "similarity": sim})

    return _ranked(_usable(queries, "query_index").mapInPandas(run, OUT), k)


def topk_cosine(queries: DataFrame, library: DataFrame, k: int = 100, strategy: str = "auto", block: int = BLOCK) -> DataFrame:
    """queries: query_index, embedding; library: library_index, embedding. Gives query_index, rank, library_index, similarity."""
    q, lib = _usable(queries, "query_index"), _usable(library, "library_index")
    size, (n_queries, n_library) = _shape(q, lib)
    if strategy not in ("auto", "block", "partitioned"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy != "partitioned" and n_library * size * 8 <= LIMIT:
        # vectors are few in bytes but dear in time, so their number decides how many tasks search
        tasks = min(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_queries // QUERIES))
        return topk_shared(q.repartition(max(1, tasks)), _share(lib), k)
    full = max(QUERIES, min(FULL, HELD // (12 * max(size, 1)), HELD // (16 * max(k, 1))))
    return _streamed(q, lib, k, size, blocks(n_queries, min(block, STEP), full, 2 * SIDE))


def _streamed(q: DataFrame, lib: DataFrame, k: int, size: int, n: int) -> DataFrame:
    """The Top-K of n blocks of queries, each in a task of its own which the whole library passes, packed."""
    kind, wide = q.schema["embedding"].dataType, "f4" if lib.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    rows = max(1, PACK // (8 * max(size, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, rows):
            ids, x = _keys(t["library_index"]), _rows(t["embedding"], size)
            packed = [[v[i : i + rows].tobytes() for i in range(0, len(ids), rows)] for v in (ids, x)]
            yield pa.record_batch([pa.array(v, pa.binary()) for v in packed], ["ids", "x"])

    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("qb")
    packs = lib.mapInArrow(pack, "ids binary, x binary").select(every, F.lit(1).alias("side"), F.lit(None).cast("long").alias("query_index"), F.lit(None).cast(kind).alias("embedding"), "ids", "x")
    none = F.lit(None).cast("binary")
    asked = q.select(F.pmod(F.xxhash64("query_index"), F.lit(n)).cast("int").alias("qb"), F.lit(0).alias("side"), "query_index", "embedding", none.alias("ids"), none.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, search, keys = [], None, None
        for b in batches:
            first = int(np.searchsorted(b.column("side").to_numpy(), 1))
            if first:
                queries.append(b.slice(0, first).select(["query_index", "embedding"]))
            if first < b.num_rows and queries:
                if search is None:
                    t = pa.Table.from_batches(queries).combine_chunks()
                    keys, search = _keys(t["query_index"]), Nearest(_unit(_rows(t["embedding"], size)), k)
                for ids, x in zip(*(b.column(c).slice(first) for c in ("ids", "x")), strict=True):
                    ids = _buffer(ids, "i8")
                    search.show(_unit(_buffer(x, wide).reshape(len(ids), size)), ids)
        if search is not None:
            yield from _ranked_lists(search, keys)

    return asked.unionByName(packs).repartitionById(n, "qb").sortWithinPartitions("side").mapInArrow(run, RANKED)


def blocks(rows: int, block: int, full: int = BLOCK, side: int = SIDE) -> int:
    """How many blocks: of `block` rows up to `side` of them, then of larger ones up to `full` rows."""
    return max(1, min(-(-rows // block), max(side, -(-rows // max(block, full)))))


def topk_sparse(queries: DataFrame, library: DataFrame, k: int = 100, all_queries: DataFrame | None = None, all_library: DataFrame | None = None, block: int = 2_000) -> DataFrame:
    """Exact Top-K over sparse rows (query_index | library_index, bin, value); every query gets min(k, library) rows, those without a common bin score 0.

    Both sides are packed, SPARSE_QUERIES vectors or ENTRIES values a pack. Packs of queries are dealt into blocks, which grow beyond
    2 * SPARSE_SIDE of them until they hold SPARSE_HELD values; packs of the library into slices of SPARSE_SLICE values. A task holds a block
    while a slice passes, a pair of packs multiplied at a time over the bins they share, so that a bin which all vectors have costs no
    more than others. all_queries and all_library (the key columns) bring back keys without any bin, as zero vectors.
    """
    q, lib = _lists(queries, "query_index", all_queries), _lists(library, "library_index", all_library)
    sides = [df.agg(F.lit(i).alias("side"), F.approx_count_distinct(c).alias("n"), F.count("*").alias("values")) for i, (df, c) in enumerate(((queries, "query_index"), (library, "library_index")))]
    (_, rows, values), (_, _, more) = sorted(sides[0].unionByName(sides[1]).collect())
    n, m = sparse_deal(rows, values, more, block)
    to = lambda first, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(first)
    asked = _packed(q, "query_index", n, block).select("*", F.lit(0).alias("side"), to("other", m)).withColumn("to", F.col("dealt") * m + F.col("other"))
    packs = _packed(lib, "library_index", m, block).select("*", F.lit(1).alias("side"), to("other", n)).withColumn("to", F.col("other") * m + F.col("dealt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = []
        for b in batches:
            for side, *held in zip(b.column("side").to_pylist(), *(b.column(c) for c in PACKED), strict=True):
                pack = Sparse(*held)
                if side:
                    for search in searches:
                        search.show(pack)
                else:
                    searches.append(NearestSparse(pack, k))
        for search in searches:
            for row, ids, sim in search.found():
                keys = search.pack.ids[row]
                yield pa.record_batch([pa.array(keys, mask=keys == NONE), pa.array(ids, mask=ids == NONE), pa.array(sim)], ["query_index", "library_index", "similarity"])

    dealt = asked.unionByName(packs).select("to", "side", *PACKED).repartitionById(n * m, "to")
    return _ranked(dealt.sortWithinPartitions("side").mapInArrow(run, OUT), k)


def sparse_deal(rows: int, values: int, library: int, block: int) -> tuple[int, int]:
    """How many blocks of queries and slices of the library, whose packs are copied once for each slice and for each block."""
    return max(1, min(-(-rows // min(block, SPARSE_QUERIES)), max(2 * SPARSE_SIDE, -(-values // SPARSE_HELD)))), max(1, -(-library // SPARSE_SLICE))


def _packed(lists: DataFrame, key: str, n: int, block: int) -> DataFrame:
    """Packs of sparse vectors, dealt to 0 .. n-1: keys, lengths, the bins that occur, and of each value its bin's place among these."""
    rows = min(block, SPARSE_QUERIES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for t in _gathered(batches, rows):
            size = pc.list_value_length(t["bin"]).to_numpy().astype(np.int64)
            every, ends = np.arange(len(size)), np.cumsum(size)
            cuts = np.flatnonzero((np.diff(every // rows) > 0) | (np.diff((ends - size) // ENTRIES) > 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
                some = t.slice(a, b - a)
                bins, place = np.unique(pc.list_flatten(some["bin"]).to_numpy(), return_inverse=True)
                # values of one bin of a vector are one
                entry, back = np.unique(np.repeat(np.arange(b - a), size[a:b]) * max(len(bins), 1) + place, return_inverse=True)
                value = np.bincount(back, pc.list_flatten(some["value"]).to_numpy(), len(entry))
                row, place = divmod(entry, max(len(bins), 1))
                held = (_keys(some[key]), np.bincount(row, minlength=b - a).astype(np.int32), bins.astype(np.int64), place.astype(np.uint32 if len(bins) > 1 << 16 else np.uint16), value.astype(np.float64))
                yield pa.record_batch([pa.array([number % n], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in held)], ["dealt", *PACKED])
                number += 1

    return lists.mapInArrow(pack, ", ".join(["dealt int", *(f"{c} binary" for c in PACKED)]))


class Sparse:
    """A pack of sparse vectors."""

    def __init__(self, *held: pa.Scalar):
        # copied, as buffers hold the whole batch
        self.ids, self.size, self.bins = (_buffer(v, kind).copy() for v, kind in zip(held[:3], ("i8", "i4", "i8"), strict=True))
        self.place, self.value = (_buffer(v, kind).copy() for v, kind in zip(held[3:], ("u4" if len(self.bins) > 1 << 16 else "u2", "f8"), strict=True))
        self.norm = np.sqrt(np.bincount(self._row(), self.value**2, len(self.ids)))
        self.kept = None
        self.longest, self.positive = self.size.max(initial=0), bool((self.value >= 0).all())

    def _row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.size)

    def dense(self, at: np.ndarray, width: int, values: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """Values in columns: at[i] is the i-th bin's, or -1; of all vectors or of some."""
        column, row, values = at[self.place], self._row(), self.value if values is None else values
        if rows is not None:
            number = np.full(len(self.ids), -1)
            number[rows] = np.arange(len(rows))
            row = number[row]
        if (rows is not None) or at.min(initial=0) < 0:
            hit = np.flatnonzero((column >= 0) & (row >= 0))
            column, row, values = column[hit], row[hit], values[hit]
        out = np.zeros((len(self.ids) if rows is None else len(rows), width), values.dtype)
        out.ravel()[row * width + column] = values
        return out

    def scaled(self, by: np.ndarray | float) -> np.ndarray:
        """Values in single precision, divided by a number for each vector."""
        return (self.value / (np.repeat(by, self.size) if np.ndim(by) else by)).astype(np.float32)

    def columns(self, first: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some of the pack's bins, and its vectors in these, in both precisions; the last ones are kept, as many queries ask for them."""
        if self.kept is None or self.kept[0] != first:
            at = np.arange(len(self.bins)) - first
            at[(at < 0) | (at >= SPARSE_BINS)] = -1
            bins = self.bins[first : first + SPARSE_BINS]
            self.kept = first, (bins, self.dense(at, len(bins)), self.dense(at, len(bins), self.scaled(most)).T)
        return self.kept[1]


def _places(bins: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of bins stands among others, which ascend; -1 where it doesn't."""
    at = np.minimum(np.searchsorted(among, bins), len(among) - 1)
    return np.where(among[at] == bins, at, -1)


class NearestSparse(Nearest):
    """The k best of all packs that have been shown, for each vector of a pack."""

    def __init__(self, pack: Sparse, k: int):
        super().__init__(np.zeros((0, 0)), k)
        self.pack, self.parts = pack, [[(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]]
        self.least, self.last = np.full(len(pack.ids), -np.inf), np.full(len(pack.ids), NONE)

    def show(self, lib: Sparse) -> None:
        x, least, last, size = self.pack, self.least.copy(), self.last.copy(), (len(self.pack.ids), len(lib.ids))
        firsts = [i for i in range(0, len(lib.bins), SPARSE_BINS) if len(x.bins)]
        # vectors of x are brought to norm 1, those of lib to norms of 1 at most; zeros don't round
        norm, most = np.where(x.norm > 0, x.norm, 1.0), lib.norm.max() or 1.0
        off = (min(x.longest, lib.longest) + len(firsts) + 8) * 2.0**-23
        s, unit = np.zeros(size, np.float32), x.scaled(norm)
        for first in firsts:
            bins, _, single = lib.columns(first, most)
            s += x.dense(_places(x.bins, bins), len(bins), unit) @ single
        bound, new = least / (norm * most) - off, least == -np.inf
        if size[1] > self.k and new.any():
            bound[new] = np.partition(s[new], size[1] - self.k, axis=1)[:, size[1] - self.k] - 2 * off
        r, c = divmod(_true(s >= bound.astype(np.float32)[:, None]), size[1])
        sim = np.zeros(len(r))
        # without negative values a product is 0 only where no bin is shared
        some = np.flatnonzero(s[r, c] != 0) if x.positive and lib.positive and norm.max() * most < 1e9 else np.arange(len(r))
        if len(some):
            rows, back = np.unique(r[some], return_inverse=True)
            for first in firsts:
                bins, double, _ = lib.columns(first, most)
                sim[some] += _sums_of(x.dense(_places(x.bins, bins), len(bins), rows=rows), double, back, c[some])
        if len(r):
            self._add(0, r, lib.ids[c], np.round(sim, 12), least, last)


def _lists(rows: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """One row per key with its bins and their values."""
    entry = F.struct(F.col("bin").cast("long").alias("bin"), F.col("value").cast("double").alias("value"))
    listed = rows.groupBy(F.col(key).cast("long").alias(key)).agg(F.collect_list(entry).alias("e"))
    if keys is not None:
        listed = keys.select(F.col(key).cast("long").alias(key)).distinct().join(listed, key, "left")
    each = lambda name, kind: F.coalesce(F.transform("e", lambda x: x[name]), F.array().cast(kind)).alias(name)
    return listed.select(key, each("bin", "array<bigint>"), each("value", "array<double>"))
