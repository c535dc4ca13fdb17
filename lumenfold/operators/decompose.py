"""Per-query decomposition of a candidate list: adaptive K, precursor groups, embedding clusters.

The kernels are numpy on one query's candidates (at most K rows). Their definitions are this library's own where
only parameters and intent were given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..schemas import NEIGHBORS
from .filters import real_neighbors

COLUMNS = [c.split()[0] for c in NEIGHBORS.split(", ")]
ROWS = 200_000  # candidates that are counted at once


def adaptive_k(scores: np.ndarray, k_min: int = 12, k_max: int = 100, max_segments: int = 4, min_size: int = 8, fallback: int = 100, min_range: float = 0.03) -> tuple[int, int]:
    """Candidates to keep, and segments chosen: piecewise lines over ranks by BIC; what lies before the last segment stays."""
    n = len(scores)
    clamp = lambda k: max(1, min(max(k_min, min(k, k_max)), n)) if n else 0
    if n < 2 * min_size or scores.max() - scores.min() < min_range:
        return clamp(fallback), 1
    y, (x, m, sx, vxx, sure, short) = np.asarray(scores, float), _ranks(n, min_size)
    # cost[b, a]: squared error of the best line through ranks a..b-1
    sy, sxy, syy = ((c := np.concatenate([[0.0], np.cumsum(v)]))[:, None] - c for v in (y, x * y, y * y))
    vxy, vyy = sxy - sx * sy / m, syy - sy * sy / m
    cost = np.maximum(0.0, vyy - np.where(sure, vxy * vxy / vxx, 0.0))
    cost[short] = np.inf
    total, cut, found = cost[:, 0], {}, []
    for k in range(1, max_segments + 1):
        if k > 1:
            # what lies behind the last cut needs the last row alone
            cut[k] = int((total + cost[n]).argmin())
            last = total[cut[k]] + cost[n, cut[k]]
            total = (total + cost).min(axis=1) if k < max_segments else total
        else:
            last = total[n]
        if np.isfinite(last):
            found.append((n * np.log(max(last / n, 1e-12)) + (3 * k - 1) * np.log(n), k))
    m = min(found)[1]
    return clamp(fallback if m == 1 else cut[m]), m


@lru_cache(maxsize=256)
def _ranks(n: int, min_size: int) -> tuple[np.ndarray, ...]:
    """What adaptive_k() needs of ranks a..b-1 alone, by [b, a]: sizes, sums, whether a line can be laid and whether they are too few."""
    x = np.arange(n, dtype=float)
    sx, sxx = ((c := np.concatenate([[0.0], np.cumsum(v)]))[:, None] - c for v in (x, x * x))
    size = np.arange(n + 1)[:, None] - np.arange(n + 1)
    m = np.maximum(size, 1)
    vxx = sxx - sx * sx / m
    return x, m, sx, np.where(vxx > 0, vxx, 1), vxx > 0, size < min_size


def precursor_groups(values: np.ndarray, most: int = 20, floor: float = 1e-3) -> int:
    """Number of groups of precursor m/z: one-dimensional Gaussian mixtures by EM from quantiles, least BIC, fewer on ties."""
    return int(groups_of([values], most, floor)[0])


def groups_of(lists: list[np.ndarray], most: int = 20, floor: float = 1e-3, block: int = 512) -> np.ndarray:
    """precursor_groups() of many lists; a block of lists goes through EM together, and those that have settled leave it.

    Equal values of a list are one value with a weight, a block holds lists of about as many distinct values, and a list
    leaves when no mixture of so many groups, whatever its parameters, could have a lower BIC than the best so far.
    """
    lists = [np.sort(v[np.isfinite(v)]) for v in (np.asarray(v, float) for v in lists)]
    distinct = [np.unique(v, return_counts=True) for v in lists]
    order = np.argsort([len(v) for v, _ in distinct], kind="stable")
    found = np.ones(len(lists), int)
    for i in range(0, len(lists), block):
        some = order[i : i + block]
        found[some] = _groups_of_block([lists[j] for j in some], [distinct[j] for j in some], most, floor)
    return found


def _most_likely(values: np.ndarray, counts: np.ndarray, floor: float) -> float:
    """No mixture of normals with variances of floor or more has a greater log-likelihood.

    Values are cut where neighbours lie 40 least deviations apart or more, into parts with shares p of n values. With c the
    largest density of a normal, sum log(f(x)) is at most sum log(c p(x)) + n log(max over normals of mean(density / (c p))) by
    Jensen's inequality, and that maximum is at most 1 + sqrt(2 pi) deviations / the least cut.
    """
    if not len(values):
        return 0.0
    gaps, n, deviation = np.diff(values), counts.sum(), np.sqrt(floor)
    cuts = np.flatnonzero(gaps >= 40 * deviation)
    share = np.add.reduceat(counts, np.concatenate([[0], cuts + 1])) / n
    more = np.sqrt(2 * np.pi) * deviation / gaps[cuts].min() + 1e-20 if len(cuts) else 0.0
    return n * ((share * np.log(share)).sum() - 0.5 * np.log(2 * np.pi * floor) + np.log1p(more))


def _groups_of_block(lists: list[np.ndarray], distinct: list[tuple[np.ndarray, np.ndarray]], most: int, floor: float) -> np.ndarray:
    n, d = (np.array([len(v) for v in x]) for x in (lists, [v for v, _ in distinct]))
    found, best = np.ones(len(lists), int), np.full(len(lists), np.inf)
    x, values, counts = np.zeros((len(lists), max(n.max(), 1))), *np.zeros((2, max(d.max(), 1), len(lists)))
    for i, (v, (u, w)) in enumerate(zip(lists, distinct, strict=True)):
        x[i, : n[i]], values[: d[i], i], counts[: d[i], i] = v, u, w
    limit = np.where(n > 1, np.minimum(most, d), 0)
    spread = np.array([v.var() if len(v) else 0.0 for v in lists])
    penalty, least = np.log(np.maximum(n, 1)), np.array([-2 * _most_likely(u, w, floor) for u, w in distinct])
    for k in range(1, limit.max() + 1):
        asked = on = np.flatnonzero((limit >= k) & (least + (3 * k - 1) * penalty <= best + 1e-6))
        if not len(on):
            break
        at = (np.arange(k) + 0.5) / k * (n[on, None] - 1)
        low = at.astype(int)
        left, right = (np.take_along_axis(x[on], np.minimum(j, n[on, None] - 1), axis=1) for j in (low, low + 1))
        # by component, value, list: the lists, of which there are most, come last
        mean = np.ascontiguousarray((left + (right - left) * (at - low)).T)
        var, share = np.repeat(np.maximum(spread[on] / k**2, floor)[None], k, axis=0), np.full((k, len(on)), 1 / k)
        like, v, w = np.zeros(len(lists)), values[:, on], counts[:, on]
        for _ in range(100):
            r = v - mean[:, None]
            np.square(r, out=r)
            r *= (-0.5 / var)[:, None]
            r += (np.log(share) - 0.5 * np.log(2 * np.pi * var))[:, None]
            top = r.max(axis=0)
            r -= top
            np.maximum(r, -600, out=r)  # shares of 1e-260 add nothing, and numbers that have no full precision are slow
            np.exp(r, out=r)
            total = r.sum(axis=0)
            like[on] = ((top + np.log(total)) * w).sum(axis=0)
            r *= w / total
            mass = r.sum(axis=1) + 1e-9
            new = (r * v).sum(axis=1) / mass
            off = v - new[:, None]
            np.square(off, out=off)
            off *= r
            var = np.maximum(off.sum(axis=1) / mass, floor)
            share = mass / mass.sum(axis=0)
            moving = np.abs(new - mean).max(axis=0) >= 1e-6
            mean = new
            if not moving.all():
                on, mean, var, share, v, w = on[moving], mean[:, moving], var[:, moving], share[:, moving], v[:, moving], w[:, moving]
                if not len(on):
                    break
        bic = -2 * like[asked] + (3 * k - 1) * penalty[asked]
        better = bic < best[asked] - 1e-9
        found[asked[better]], best[asked[better]] = k, bic[better]
    return found


def cosine_distances(x: np.ndarray) -> np.ndarray:
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.clip(1 - u @ u.T, 0, 2)


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Average linkage on cosine distance to exactly k clusters, numbered by their best-ranked member."""
    n = len(x)
    k = max(1, min(k, n)) if n else 0
    if k <= 1:
        return np.zeros(n, int)
    d = cosine_distances(np.asarray(x, float))
    np.fill_diagonal(d, np.inf)
    size, of = np.ones(n), np.arange(n)
    for _ in range(n - k):
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        size[a] += size[b]
        of[of == b] = a
    _, first, back = np.unique(of, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def _whole(batches: Iterator[pa.RecordBatch], least: int = 0) -> Iterator[pa.Table]:
    """Batches ordered by query_index as tables which hold whole queries, of `least` rows or more but for the last."""
    held, count = [], 0
    for b in batches:
        if b.num_rows:
            last = int(_starts(b)[-1])
            if (last or (held and held[-1]["query_index"][-1] != b["query_index"][0])) and count + last >= least:
                yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
                held, count, b = [], 0, b.slice(last)
            held, count = [*held, b], count + b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where each query begins."""
    key, none = rows["query_index"], pc.is_null(rows["query_index"]).cast(pa.int8())
    key = np.stack([pc.fill_null(key, 0).to_numpy(), none.to_numpy()])
    return np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])


def _listed(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt by query, with the rows of a query in one place and order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that rows few in bytes but dear in time aren't gathered in one task
    # by a hash of its own: dealing that rows have already would be taken as it is, and then be gathered by bytes
    return rows.repartition(tasks, F.xxhash64("query_index")).sortWithinPartitions("query_index", *order)


def kept(topk: DataFrame, library: DataFrame, most: int = 20, k_min: int = 12, k_max: int = 100, adaptive: bool = True, groups: bool = True, candidates: bool = False, **how) -> DataFrame:
    """One row per query: adaptive_k, original_knn_k, selected_segments and, with `groups`, estimated_n_precursor_groups; with
    `candidates` one row per kept candidate, with rank, library_index, similarity, library_precursor_mz.

    What decompose() says of a query, from scores and precursors alone; no vector is read.
    """
    light = real_neighbors(topk).join(library.select("library_index", F.col("precursor_mz").cast("double").alias("library_precursor_mz")), "library_index")
    own = ["library_index", "similarity", "library_precursor_mz"]
    listed = _listed(light.select("query_index", "rank", *own), "rank", *own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, ROWS):
            starts = _starts(t)
            scores, precursors = (pc.fill_null(t[c].cast(pa.float64()), np.nan).to_numpy() for c in ("similarity", "library_precursor_mz"))
            n = np.diff([*starts, t.num_rows])
            found = [adaptive_k(v, k_min=k_min, k_max=min(k_max, len(v)), **how) if adaptive else (len(v), 1) for v in np.split(scores, starts[1:])]
            keep = np.array([k for k, _ in found])
            one = {"adaptive_k": keep, "original_knn_k": n, "selected_segments": np.array([m for _, m in found])}
            if groups:
                one["estimated_n_precursor_groups"] = np.clip(groups_of([precursors[i : i + k] for i, k in zip(starts, keep, strict=True)], most), 1, np.maximum(keep, 1))
            at, repeat = starts, np.ones(len(starts), int)
            if candidates:
                repeat = keep
                place = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
                at = np.repeat(starts, keep) + place
            columns = {"query_index": t["query_index"].take(pa.array(at)).combine_chunks()} | {name: pa.array(np.repeat(v, repeat)) for name, v in one.items()}
            if candidates:
                columns |= {"rank": pa.array(place + 1)} | {name: t[name].take(pa.array(at)).combine_chunks() for name in own}
            yield pa.record_batch(list(columns.values()), list(columns))

    kinds = {c: listed.schema[c].dataType.simpleString() for c in ("query_index", *own)}
    names = ["query_index", "adaptive_k", "original_knn_k", "selected_segments", *["estimated_n_precursor_groups"] * groups, *["rank", *own] * candidates]
    return listed.mapInArrow(cut, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))


def decompose(topk: DataFrame, library: DataFrame, method: str = "", most: int = 20, k_min: int = 12, k_max: int = 100, adaptive: bool = True, **how) -> DataFrame:
    """Neighbour rows of every query: kept candidates, their cluster and the estimated component count.

    topk: query_index, rank, library_index, similarity; library: library_index, precursor_mz, embedding. Candidates
    are cut and counted from scores and precursors alone, many queries a batch; only those kept by queries with several groups
    fetch their vectors for clustering, and a task takes its queries one after another. adaptive=False keeps every candidate.
    """
    rows = kept(topk, library, most, k_min, k_max, adaptive, candidates=True, **how)
    vectors = rows.join(library.select("library_index", "embedding"), "library_index").withColumn("embedding", F.when(F.col("estimated_n_precursor_groups") > 1, F.col("embedding")))
    names = [c for c in COLUMNS if c not in ("method", "cluster")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            starts = _starts(t)
            groups, cluster = t["estimated_n_precursor_groups"].to_numpy(), np.zeros(t.num_rows, int)
            values, size = pc.list_flatten(t["embedding"]).to_numpy(), pc.fill_null(pc.list_value_length(t["embedding"]), 0).to_numpy()
            ends = np.cumsum(size, dtype=int)
            for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if groups[a] > 1:
                    cluster[a:b] = clusters(values[ends[a] - size[a] : ends[b - 1]].reshape(b - a, -1), int(groups[a]))
            columns = {c: t[c].combine_chunks() for c in names} | {"method": pa.array([method] * t.num_rows, pa.string()), "cluster": pa.array(cluster)}
            yield pa.record_batch([columns[c] for c in COLUMNS], COLUMNS)

    return _listed(vectors.select(*names, "embedding"), "rank").mapInArrow(label, NEIGHBORS)


def with_metadata(neighbors: DataFrame, library: DataFrame) -> DataFrame:
    """Adds smiles, inchikey, name, formula where the library has them, under both names, and its scaffold columns."""
    names = [c for c in ("smiles", "inchikey", "name", "formula") if c in library.columns]
    scaffolds = [c for c in ("candidate_scaffold", "candidate_scaffold_atoms") if c in library.columns]
    meta = library.select("library_index", *names, *scaffolds)
    return neighbors.join(meta, "library_index", "left").withColumns({f"library_{c}": F.col(c) for c in names})


def summarize_k(neighbors: DataFrame) -> DataFrame:
    """Per method, over queries: count, least, mean, median, largest kept K."""
    one = neighbors.groupBy("method", "query_index").agg(F.max("adaptive_k").alias("k"))
    return one.groupBy("method").agg(F.count("*").alias("n_queries"), F.min("k").alias("min_k"), F.avg("k").alias("mean_k"), F.percentile("k", F.lit(0.5)).alias("median_k"), F.max("k").alias("max_k"))
