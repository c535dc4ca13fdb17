"""Simulated mixtures of two or three spectra with known truth.

Every random choice is seeded by the output's index, so results don't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.metadata import chimera_id, joined
from ..functions.peaks import first_valid, pack
from ..sources.cache import settled

SHIFT = 100_000  # added to the seed for mixtures of three
DRAWS = 2_000  # mixtures that a task draws


def windows(df: DataFrame, width: float = 20.0, least: int = 3) -> DataFrame:
    """Adds window_id = floor(precursor / width) and keeps rows of windows with at least three members."""
    dealt = df.withColumn("window_id", F.floor(F.col("precursor_mz") / width))
    full = dealt.groupBy("window_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("window_id")
    return dealt.join(full, "window_id", "left_semi")


def merge_peaks(rows: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Pools weighted components. rows: key, component, weight, mz, intensity. Gives key, mz, intensity.

    Weights sum to 1 per key; each component's largest becomes 1000 times its weight; a peak joins the group of
    the peak before it if their gap is at most the tolerance; a group has its weighted mean m/z and its sum; the
    largest of the result is 1000.
    """
    one = Window.partitionBy(key, "component")
    rows = rows.where((F.col("intensity") > 0) & (F.col("mz") > 0)).withColumn("x", F.col("intensity") / F.max("intensity").over(one) * 1000)
    shares = rows.groupBy(key, "component").agg(F.first("weight").alias("weight"))
    shares = shares.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(key))).select(key, "component", "share")
    rows = rows.join(shares, [key, "component"]).withColumn("x", F.col("x") * F.col("share"))
    return chain(rows.select(key, "mz", F.col("x").alias("intensity")), key, tolerance)


def chain(rows: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Chain grouping by gaps, largest to 1000. rows: key, mz, intensity."""
    order = Window.partitionBy(key).orderBy("mz", "intensity")
    gap = F.col("mz") - F.lag("mz").over(order)
    rows = rows.withColumn("new", F.when(gap.isNull() | (gap > tolerance), 1).otherwise(0)).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "group").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"), F.sum("intensity").alias("intensity")).where("intensity > 0")
    return merged.select(key, "mz", (F.col("intensity") / F.max("intensity").over(Window.partitionBy(key)) * 1000).alias("intensity"))


def weights(k: int, rng: np.random.Generator, mode: str = "dirichlet", least: float = 0.05) -> list[float]:
    """equal, dirichlet or uniform; drawn again while one is below the least, equal after a hundred draws."""
    if mode not in ("equal", "dirichlet", "uniform"):
        raise ValueError(f"unknown weight mode {mode}")
    for _ in range(100 if mode != "equal" else 0):
        w = rng.dirichlet(np.ones(k)) if mode == "dirichlet" else rng.uniform(0.2, 1.0, k)
        w = w / w.sum()
        if w.min() >= least:
            return w.tolist()
    return [1.0 / k] * k


def places(df: DataFrame, parts: int = 256) -> DataFrame:
    """Numbers the members of each window from 1 as `place`; a window's members are ordered in `parts` tasks, not in one."""
    dealt = df.withColumn("part", F.pmod(F.xxhash64("library_index"), F.lit(parts)))
    before = F.sum("n").over(Window.partitionBy("window_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = dealt.groupBy("window_id", "part").agg(F.count("*").alias("n")).select("window_id", "part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("window_id", "part").orderBy("library_index"))
    return dealt.join(base, ["window_id", "part"]).withColumn("place", (own + F.col("base")).cast("long")).drop("part", "base")


def draw(df: DataFrame, n_two: int, n_three: int, seed: int = 42, mode: str = "dirichlet", tries: int = 1000) -> DataFrame:
    """query_index, kind, slot, weight, window_id, place: which members of which window make each mixture.

    df: window_id, place (from 1 in its window), inchikey. A window is drawn uniformly over windows, then distinct
    members; where these repeat an inchikey, window and members are drawn again. It fails if an output finds none in
    all tries. Each round of draws is written, and the next is over what it left. Members are drawn by their number
    alone and only those drawn are looked up, so no task holds a window. Each draw is seeded by the output's index
    and the attempt.
    """
    sizes = df.groupBy("window_id").agg(F.count("*").alias("n"))
    numbered = sizes.withColumn("w", F.row_number().over(Window.orderBy("window_id")) - 1)  # one row per window
    n_windows = numbered.count()
    if not n_windows:
        raise ValueError("no window has enough spectra")
    left = df.sparkSession.range(n_two + n_three).withColumnRenamed("id", "query_index")
    shifted = F.lit(seed) + F.when(F.col("query_index") >= n_two, SHIFT).otherwise(0)
    pick = F.pmod(F.xxhash64(shifted, "query_index", "attempt"), F.lit(n_windows))
    own = F.coalesce(F.when(F.col("inchikey") != "", F.concat(F.lit("k"), "inchikey")), F.concat(F.lit("#"), F.col("place").cast("string")))
    keys = df.select("window_id", "place", own.alias("key"))
    kind = "query_index long, attempt int, kind string, slot int, weight double, window_id long, place long"

    def members(batches):
        for b in batches:
            out = []
            for i, t, window, n in zip(b["query_index"], b["attempt"], b["window_id"], b["n"], strict=True):
                k = 2 if i < n_two else 3
                if n < k:
                    continue
                rng = np.random.default_rng([seed + (SHIFT if k == 3 else 0), int(i), int(t)])
                at = rng.choice(int(n), k, replace=False) + 1
                out += [(i, t, "AB" if k == 2 else "ABC", s, w, window, p) for s, (p, w) in enumerate(zip(at, weights(k, rng, mode), strict=True))]
            yield pd.DataFrame(out, columns=["query_index", "attempt", "kind", "slot", "weight", "window_id", "place"])

    found, missing = [], None
    tasks = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n_two + n_three) // DRAWS)))
    # nearly all succeed at once
    for first, last in ((0, 1), (1, 30), (30, tries)):
        if first >= min(last, tries):
            break
        tried = left.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(min(last, tries) - 1)))).withColumn("w", pick)
        # few bytes but dear in time, so the number of mixtures decides how many tasks draw
        dealt = tried.join(numbered, "w").select("query_index", "attempt", "window_id", "n").repartition(tasks, "query_index", "attempt")
        drawn = dealt.mapInPandas(members, kind).join(keys, ["window_id", "place"])
        slot = F.struct("slot", "kind", "weight", "window_id", "place")
        good = drawn.groupBy("query_index", "attempt").agg(F.collect_list(slot).alias("slots"), F.count_distinct("key").alias("kinds")).where(F.col("kinds") == F.size("slots"))
        good = settled(good.groupBy("query_index").agg(F.min_by("slots", "attempt").alias("slots")))
        found.append(good.select("query_index", F.explode("slots").alias("s")).select("query_index", "s.kind", "s.slot", "s.weight", "s.window_id", "s.place"))
        left = left.join(good.select("query_index"), "query_index", "left_anti")
        missing = left.first()
        if missing is None:
            break
    if missing is not None:
        raise RuntimeError(f"{tries} tries gave no members with distinct keys for mixture {missing.query_index}")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def simulate(library: DataFrame, n_two: int, n_three: int, seed: int = 42, width: float = 20.0, tolerance: float = 0.01, mode: str = "dirichlet", size: int = 128) -> DataFrame:
    """Mixtures with their truth. library: library_index (unique), precursor_mz, charge, peaks, inchikey, smiles, name, adduct.

    Numbers of members are written without their spectra; only those drawn fetch these.
    """
    held = settled(places(windows(library.select("library_index", "precursor_mz", "inchikey"), width)))
    drawn = draw(held.select("window_id", "place", "inchikey"), n_two, n_three, seed, mode)
    drawn = drawn.join(held.select("window_id", "place", "library_index"), ["window_id", "place"])
    parts = drawn.join(library.select("library_index", "precursor_mz", "charge", "peaks", "inchikey", "smiles", "name", "adduct"), "library_index")
    peaks = parts.select("query_index", F.col("slot").alias("component"), "weight", F.explode(first_valid(F.col("peaks"))).alias("p")).select("query_index", "component", "weight", "p.mz", "p.intensity")
    merged = merge_peaks(peaks, "query_index", tolerance).groupBy("query_index").agg(F.collect_list(F.struct("mz", "intensity")).alias("peaks")).withColumn("peaks", pack(F.col("peaks"), size))
    slots = F.array_sort(F.collect_list(F.struct("slot", "weight", "precursor_mz", "charge", "library_index", "inchikey", "smiles", "name", "adduct")))
    truth = parts.groupBy("query_index", "kind", "window_id").agg(slots.alias("s"))
    get = lambda name: F.transform("s", lambda x: x[name])
    text = lambda name, sep=" | ": joined(get(name), sep).alias(name)
    truth = truth.select(
        "query_index", chimera_id(F.col("kind"), F.col("query_index")).alias("chimera_id"), F.col("kind").alias("chimera_type"), F.size("s").cast("long").alias("component_count"),
        F.col("window_id").alias("dia_window_id"), (F.col("window_id") * width).alias("dia_window_lower"), ((F.col("window_id") + 1) * width).alias("dia_window_upper"),
        F.col("s")[0]["precursor_mz"].alias("precursor_mz"), F.col("s")[0]["charge"].alias("charge"), get("precursor_mz").alias("precursor_mz_list"), get("weight").alias("mixing_weights"), get("library_index").alias("source_index"),
        text("smiles"), text("inchikey"), text("name", " + "), text("adduct"),
    )
    return truth.join(merged, "query_index").withColumn("num_peaks", F.size("peaks").cast("long"))
