"""Exact cosine Top-K with pruning: library vectors in cells around pivots, visited by bounds on the angle.

An index holds some sqrt(n) pivots (library vectors with the smallest hash of their id), each vector's nearest pivot as
its cell, and each cell's largest angle to its pivot. A query of angle t to a pivot has at least the angle t - radius to
all of the cell, so a cell whose bound lies beyond the K-th best so far can't hold a result. Two rounds of joins: first
each query meets the nearest cells that hold K vectors, then the cells that the K-th similarity of the first round can't
exclude.

Cells are dealt into parts, and the queries of a part into blocks; a task multiplies each cell of its part by those of its
queries that visit it. So a query is copied once for each part that it visits, with its cells there as bits, and a vector
once for each block of queries. There are at most SIDE parts, and blocks of a part, until they hold `block` vectors (by
default as many as take PART_BYTES), so copies grow with the rows until then. Larger cells are dealt over several parts, so
many equal vectors don't meet in one task. Pivots take at most PIVOT_BYTES, as they and the cells' sizes go to every task.
Results equal those of topk_cosine(): vectors that are null or not finite are left out, zero vectors score 0, ties go to
the smaller library_index, and with K above the size of the library every row is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.cache import settled
from .retrieve import CHUNK, OUT, QUERIES, _best, _joined, _matrix, _ranked, _shape, _usable, blocks

PIVOT_BYTES, PART_BYTES, SLACK = 64 << 20, 64 << 20, 1e-6
STEP, SIDE = 2_000, 8  # parts have STEP vectors until there are SIDE of them


class PivotIndex:
    """A library's vectors by cell, in a written table, with pivots, radii and sizes."""

    def __init__(self, library: DataFrame, pivots: int | None = None, block: int | None = None):
        lib = _usable(library, "library_index")
        self.spark, kind = library.sparkSession, lib.schema["embedding"].dataType.simpleString()
        self.size, (self.n,) = _shape(lib)
        self.block = block or max(1, PART_BYTES // (8 * max(1, self.size)))
        most = max(1, PIVOT_BYTES // (8 * max(1, self.size)))
        wanted = min(most, pivots or max(1, math.isqrt(self.n)))
        order = [F.xxhash64("library_index"), "library_index"]
        # at most PIVOT_BYTES
        rows = lib.orderBy(*order).limit(wanted).select("embedding").collect()
        self.pivots = _matrix([r.embedding for r in rows])
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    s = _matrix(b["embedding"]) @ shared.value.T
                    cell = s.argmax(axis=1)
                    yield b.assign(cell=cell, angle=np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1)))

        self.cells = settled(lib.mapInPandas(assign, f"library_index long, embedding {kind}, cell long, angle double")) if rows else None
        self.radius, self.count = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        # a row a pivot
        for r in self.cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect() if rows else ():
            self.radius[r.cell], self.count[r.cell] = r.radius, r.n
        # units: cells, or shares of a cell larger than a part; a part is a run of units
        self.rows = max(1, -(-self.n // self._blocks(self.n)))
        shares = np.maximum(1, -(-self.count // self.rows))
        self.cell = np.repeat(np.arange(len(rows)), shares)
        each = self.count[self.cell] / shares[self.cell]
        self.part = ((np.cumsum(each) - each) // self.rows).astype(np.int64)
        self.first = np.searchsorted(self.part, self.part)
        self.shares = shares

    def _blocks(self, rows: int) -> int:
        return blocks(rows, min(STEP, self.block), self.block, SIDE)

    def _visits(self, queries: DataFrame, k: int, second: bool) -> DataFrame:
        """A row per query: the cells of the first round, or with `least` (a query's K-th similarity so far) those of the second, as bits of each part's units."""
        shared = self.spark.sparkContext.broadcast((self.pivots, self.radius, self.count, self.cell, self.part))
        kind = queries.schema["embedding"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, radius, count, unit_cell, unit_part = shared.value
            parts, starts = np.unique(unit_part, return_index=True)
            ends = np.append(starts[1:], len(unit_part))
            for b in batches:
                for at in range(0, len(b), QUERIES):
                    part = b.iloc[at : at + QUERIES]
                    angle = np.arccos(np.clip(_matrix(part["embedding"]) @ pivots.T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    take = np.zeros(angle.shape, bool)
                    np.put_along_axis(take, order, before < k, axis=1)
                    if second:
                        far = np.arccos(np.clip(part["least"].fillna(-1.0).to_numpy(), -1, 1))
                        take = ~take & (angle - radius - SLACK <= far[:, None])
                    take &= count > 0
                    asked, bits = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
                    for p, first, last in zip(parts, starts, ends, strict=True):
                        mine = take[:, unit_cell[first:last]]
                        packed = np.packbits(mine, axis=1)
                        for i in np.flatnonzero(mine.any(axis=1)):
                            asked[i].append(p)
                            bits[i].append(packed[i].tobytes())
                    yield pd.DataFrame({"query_index": part["query_index"].to_numpy(), "embedding": part["embedding"].to_numpy(), "least": part["least"].to_numpy(), "parts": asked, "bits": bits, "cells": take.sum(axis=1), "vectors": take @ count})

        return queries.mapInPandas(run, f"query_index long, embedding {kind}, least double, parts array<long>, bits array<binary>, cells long, vectors long")

    def _meet(self, visits: DataFrame, k: int) -> DataFrame:
        """The best k of each part for each block of the queries that visit it; visits: written."""
        a = visits.select("query_index", "embedding", "least", F.explode(F.arrays_zip("parts", "bits")).alias("v")).select("query_index", "embedding", "least", F.col("v.parts").alias("part"), F.col("v.bits").alias("bits"))
        # a row a part, a row a cell, a row a unit
        asked = {r.part: self._blocks(r.n) for r in visits.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
        made = lambda rows, kind: F.broadcast(self.spark.createDataFrame(rows, kind))
        deal = made(list(asked.items()), "part long, qn long")
        cells = made([(i, int(u), int(n)) for i, (u, n) in enumerate(zip(np.cumsum(self.shares) - self.shares, self.shares, strict=True))], "cell long, start long, shares long")
        units = made([(u, int(p), int(u - f)) for u, (p, f) in enumerate(zip(self.part, self.first, strict=True))], "unit long, part long, place long")
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
        a = a.join(deal, "part").withColumn("qb", own("query_index", "qn")).drop("qn")
        b = self.cells.drop("angle").join(cells, "cell").withColumn("unit", F.col("start") + own("library_index", "shares")).join(units, "unit").join(deal, "part")
        b = b.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("qb"), "library_index", "embedding", "place")

        def part(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            return _joined(_meetings(x, y, k))

        return a.groupBy("part", "qb").cogroup(b.groupBy("part", "qb")).applyInPandas(part, OUT)

    def search(self, queries: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
        """The Top-K (query_index, rank, library_index, similarity), and per query the cells and vectors it visited (query_index, cells, vectors)."""
        q = _usable(queries, "query_index")
        if self.cells is None:
            none = self.spark.createDataFrame([], OUT)
            return _ranked(none, k), q.select("query_index", F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("vectors"))
        size, _ = _shape(q)
        if size not in (0, self.size):
            raise ValueError(f"vectors have sizes {sorted((size, self.size))}")
        first = settled(self._visits(q.withColumn("least", F.lit(None).cast("double")), k, False))
        found = settled(_ranked(self._meet(first, k), k))
        least = found.where(F.col("rank") == k).select("query_index", F.col("similarity").alias("least"))
        again = settled(self._visits(q.join(least, "query_index", "left"), k, True))
        rows = found.select("query_index", "library_index", "similarity").unionByName(self._meet(again, k))
        seen = first.select("query_index", "cells", "vectors").unionByName(again.select("query_index", "cells", "vectors"))
        return _ranked(rows, k), seen.groupBy("query_index").agg(F.sum("cells").alias("cells"), F.sum("vectors").alias("vectors"))


def _meetings(x: pd.DataFrame, y: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """A batch of queries at a time, each unit of the part with those queries whose bit it has."""
    if not len(x) or not len(y):
        return
    y = y.sort_values(["place", "library_index"])
    lib, ids = _matrix(y["embedding"]), y["library_index"].to_numpy()
    places, starts = np.unique(y["place"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(y))
    for at in range(0, len(x), QUERIES):
        part = x.iloc[at : at + QUERIES]
        bits = np.unpackbits(np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1), axis=1)
        met = ((np.flatnonzero(bits[:, p]), a, b) for p, a, b in zip(places, starts, ends, strict=True))
        tiles = ((rows, i, min(b, i + CHUNK)) for rows, a, b in met if len(rows) for i in range(a, b, CHUNK))
        yield _best(_matrix(part["embedding"]), part["query_index"].to_numpy(), lib, ids, k, tiles, part["least"].fillna(-np.inf).to_numpy())


def topk_pivot(queries: DataFrame, library: DataFrame, k: int = 100, pivots: int | None = None, block: int | None = None) -> DataFrame:
    """topk_cosine() by a pivot index made for this call."""
    return PivotIndex(library, pivots, block).search(queries, k)[0]
