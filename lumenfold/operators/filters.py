"""Row filters of the library and of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metadata import structure
from ..functions.peaks import finite


def valid_spectra(df: DataFrame, min_precursor: float = 50.0, min_peaks: int = 10, need: tuple[str, ...] = (), ion_modes: tuple[str, ...] = (), adducts: tuple[str, ...] = ()) -> DataFrame:
    """Usable library spectra: precursor, peak count, non-blank structures, allow-lists without regard to case."""
    keep: Column = finite(F.col("precursor_mz")) & (F.col("precursor_mz") >= min_precursor) & (F.col("num_peaks") >= min_peaks)
    for name in need:
        keep = keep & (structure(F.col(name)) != "")
    for name, allowed in (("ION_MODE", ion_modes), ("adduct", adducts)):
        if allowed:
            keep = keep & F.lower(F.trim(F.col(name))).isin(*[a.strip().lower() for a in allowed])
    return df.where(keep)


def real_neighbors(df: DataFrame) -> DataFrame:
    return df.where(F.col("library_index") >= 0)


def confident(df: DataFrame, least: float = 0.40) -> DataFrame:
    return df.where(F.col("backbone_confidence") >= least)


def methods(df: DataFrame, allowed: tuple[str, ...] | None) -> DataFrame:
    return df.where(F.col("method").isin(*allowed)) if allowed else df


def first_queries(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.where(F.col("query_index") < n)


def run_spectra(df: DataFrame, ms_level: int | None = 2, min_peaks: int = 1, most: int | None = None) -> DataFrame:
    """Spectra of a run by level and peak count; with `most`, the first so many by scan index."""
    kept = df.where(F.size("peaks") >= min_peaks)
    if ms_level is not None:
        kept = kept.where(F.col("ms_level") == ms_level)
    return kept if most is None else kept.orderBy("scan_index").limit(most)
