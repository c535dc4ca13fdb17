"""Peak-list functions: columns in, columns out. A peak list is array<struct<mz,intensity>>.

Ties in intensity are broken by m/z, so results don't depend on row order. Null lists stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row; an expression inside a lambda would be computed again for every element."""
    return F.transform(F.array(value), f)[0]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def peak(mz: Column, intensity: Column) -> Column:
    return F.struct(mz.cast("double").alias("mz"), intensity.cast("double").alias("intensity"))


def from_arrays(mz: Column, intensity: Column) -> Column:
    """Zips two arrays, cut to the shorter."""
    n = F.least(F.size(mz), F.size(intensity))
    return F.zip_with(F.slice(mz, F.lit(1), n), F.slice(intensity, F.lit(1), n), peak)


def valid_peaks(peaks: Column, positive_mz: bool = True) -> Column:
    """Finite peaks of positive intensity, and of positive m/z unless told otherwise."""
    return F.filter(peaks, lambda p: finite(p.mz) & finite(p.intensity) & (p.intensity > 0) & ((p.mz > 0) if positive_mz else F.lit(True)))


def in_range(peaks: Column, low: float, high: float) -> Column:
    return F.filter(peaks, lambda p: (p.mz >= low) & (p.mz <= high))


def by_mz(peaks: Column) -> Column:
    return F.array_sort(F.transform(peaks, lambda p: F.struct(p.mz.alias("mz"), p.intensity.alias("intensity"))))


def by_intensity(peaks: Column) -> Column:
    """Largest first."""
    keyed = F.array_sort(F.transform(peaks, lambda p: F.struct((-p.intensity).alias("k"), p.mz.alias("mz"), p.intensity.alias("intensity"))))
    return F.transform(keyed, lambda p: F.struct(p.mz.alias("mz"), p.intensity.alias("intensity")))


def top_peaks(peaks: Column, n: int, by: str = "intensity") -> Column:
    return F.slice(by_intensity(peaks) if by == "intensity" else by_mz(peaks), 1, n)


def _map(peaks: Column, f) -> Column:
    return F.transform(peaks, lambda p: F.struct(p.mz.alias("mz"), f(p.intensity).alias("intensity")))


def largest(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p.intensity))


def total(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p.intensity)


def over(peaks: Column, by: Callable[[Column], Column], to: float = 1.0) -> Column:
    """Intensities divided by by(peaks); unchanged where it is not positive."""
    return let(peaks, lambda p: let(by(p), lambda d: F.when(d > 0, _map(p, lambda x: x / d * to)).otherwise(p)))


def normalize(peaks: Column, mode: str = "max") -> Column:
    """max: the largest becomes 1000; sum: they sum to 1; none."""
    if mode == "max":
        return over(peaks, largest, 1000.0)
    if mode == "sum":
        return over(peaks, total)
    if mode == "none":
        return peaks
    raise ValueError(f"unknown mode {mode}")


def scale(peaks: Column, mode: str = "max", power: float = 1.0) -> Column:
    """Not below 0, to a power, then none, sqrt, log1p, sum (or tic) or max; sqrt and log1p are divided by their largest."""
    x = _map(peaks, lambda v: F.pow(F.greatest(v, F.lit(0.0)), F.lit(power)) if power != 1.0 else F.greatest(v, F.lit(0.0)))
    if mode == "none":
        return x
    if mode in ("sum", "tic"):
        return over(x, total)
    if mode == "sqrt":
        x = _map(x, F.sqrt)
    elif mode in ("log", "log1p"):
        x = _map(x, F.log1p)
    elif mode != "max":
        raise ValueError(f"unknown mode {mode}")
    return over(x, largest)


def clean_peaks(peaks: Column, top: int = 200, power: float = 0.5) -> Column:
    """Valid peaks, the most intense, relative to the largest, to a power, by m/z."""
    return by_mz(_map(over(top_peaks(valid_peaks(peaks), top), largest), lambda x: F.pow(x, F.lit(power))))


def first_valid(peaks: Column, num_peaks: Column | None = None) -> Column:
    """Valid ones among the first num_peaks stored (all if that is not positive), by m/z."""
    held = peaks if num_peaks is None else F.when(num_peaks > 0, F.slice(peaks, F.lit(1), num_peaks.cast("int"))).otherwise(peaks)
    return by_mz(valid_peaks(held))


def pack(peaks: Column, size: int = 128) -> Column:
    return by_mz(top_peaks(valid_peaks(peaks), size))


def padded(peaks: Column, size: int) -> Column:
    """For export: m/z and intensity arrays of fixed size, zeros behind."""
    fill = F.array_repeat(F.lit(0.0), F.lit(size) - F.size(peaks))
    return F.struct(F.concat(F.transform(peaks, lambda p: p.mz), fill).alias("mz"), F.concat(F.transform(peaks, lambda p: p.intensity), fill).alias("intensity"))


def padding_mask(peaks: Column, size: int, unmask_empty: bool = True) -> Column:
    """True at padding; an empty list leaves slot 0 open if asked."""
    n = F.greatest(F.size(peaks), F.lit(1 if unmask_empty else 0))
    return F.concat(F.array_repeat(F.lit(False), n), F.array_repeat(F.lit(True), F.lit(size) - n))


def select_peaks(peaks: Column, low: float = 50.0, high: float = 1200.0, top: int = 100, by: str = "intensity", mode: str = "max", power: float = 1.0, order: str = "mz") -> Column:
    """Range, selection, then scaling of what was selected, then order."""
    kept = scale(top_peaks(in_range(valid_peaks(peaks), low, high), top, by), mode, power)
    return by_mz(kept) if order == "mz" else by_intensity(kept)


def neutral_losses(peaks: Column, precursor: Column) -> Column:
    """precursor - m/z; no losses without a finite precursor."""
    return F.when(finite(precursor), F.transform(peaks, lambda p: peak(precursor - p.mz, p.intensity))).otherwise(F.slice(peaks, 1, 0))


def token_ids(mz: Column, low: float = 50.0, size: float = 1.0, rounding: str = "round", offset: int = 0) -> Column:
    """Token of an m/z: raw for bins of 1, else (mz - low) / size; rounding is half to even."""
    x = mz if size == 1.0 else (mz - low) / size
    f = {"round": F.rint, "floor": F.floor, "ceil": F.ceil}[rounding]
    return f(x).cast("long") + offset


def merge_tokens(rows: DataFrame, key: str, mode: str = "max") -> DataFrame:
    """key, token, intensity: one row per token, by max or sum."""
    return rows.groupBy(key, "token").agg((F.max if mode == "max" else F.sum)("intensity").alias("intensity"))


def token_inputs(
    peaks: DataFrame, key: str, low: float = 50.0, high: float = 1000.0, size: float = 1.0, vocabulary: int = 1002, power: float = 1.0, mode: str = "max", again: bool = True, top: int = 100,
    by: str = "intensity", rounding: str = "round", offset: int = 0,
) -> DataFrame:
    """Library-side token rows: range, tokens in [2, vocabulary - 1], relative to the largest, power, merged, again relative, the top ones.

    peaks: key, mz, intensity. Gives key, token, intensity. by: the top ones are the most intense, or (mz) the smallest tokens.
    """
    rows = peaks.where(finite(F.col("mz")) & finite(F.col("intensity")) & (F.col("intensity") > 0) & F.col("mz").between(low, high))
    rows = rows.withColumn("token", token_ids(F.col("mz"), low, size, rounding, offset)).where(F.col("token").between(2, vocabulary - 1))
    rows = rows.withColumn("intensity", F.pow(F.col("intensity") / F.max("intensity").over(Window.partitionBy(key)), F.lit(power)))
    rows = merge_tokens(rows, key, mode)
    if again:
        rows = rows.withColumn("intensity", F.col("intensity") / F.max("intensity").over(Window.partitionBy(key)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*([F.desc("intensity")] if by == "intensity" else []), "token"))
    return rows.withColumn("k", rank).where(F.col("k") <= top).drop("k")


def padded_tokens(spectra: DataFrame, key: str, length: int = 100, min_peaks: int = 1, skip_invalid: bool = False, order: str = "token", low: float = 50.0, high: float = 1000.0, **how) -> DataFrame:
    """token_inputs() of each spectrum as arrays token and intensity of fixed length, zeros behind, by token or by intensity.

    Spectra with fewer than min_peaks peaks in range, or without a token, are left out only if skip_invalid is
    set; else they are encoded as they are, without tokens as zeros.
    """
    rows = spectra.select(key, F.explode("peaks").alias("p")).select(key, "p.mz", "p.intensity")
    sorted_by = F.struct("token", "intensity") if order == "token" else F.struct((-F.col("intensity")).alias("k"), "token", "intensity")
    tokens = token_inputs(rows, key, low, high, **how).groupBy(key).agg(F.slice(F.array_sort(F.collect_list(sorted_by)), 1, length).alias("t"))
    held = spectra.select(key, F.size(in_range(valid_peaks(F.col("peaks"), False), low, high)).alias("n")).join(tokens, key, "left")
    if skip_invalid:
        held = held.where((F.col("n") >= min_peaks) & F.col("t").isNotNull())
    fill = lambda name, zero, kind: F.concat(F.coalesce(F.transform("t", lambda p: p[name]), F.array().cast(kind)), F.array_repeat(zero, F.lit(length) - F.coalesce(F.size("t"), F.lit(0)))).cast(kind).alias(name)
    return held.select(key, fill("token", F.lit(0).cast("long"), "array<bigint>"), fill("intensity", F.lit(0.0), "array<double>"))


def masked_inputs(spectra: DataFrame, key: str, length: int = 100, clean: bool = True, **how) -> DataFrame:
    """Library-side padded input: cleaned peaks, select_peaks(), arrays mz and intensity of fixed length and their mask (true: padding)."""
    peaks = select_peaks(clean_peaks(F.col("peaks")) if clean else F.col("peaks"), top=length, **how)
    return _masked(spectra.select(key, peaks.alias("p")), key, length, True)


def raw_masked_inputs(spectra: DataFrame, key: str, length: int = 200) -> DataFrame:
    """The same on a run's peaks by raw_tensor(); an empty spectrum has all slots masked."""
    return _masked(spectra.select(key, raw_tensor(F.col("peaks"), length).alias("p")), key, length, False)


def _masked(rows: DataFrame, key: str, length: int, unmask_empty: bool) -> DataFrame:
    return rows.select(key, padded(F.col("p"), length).alias("x"), padding_mask(F.col("p"), length, unmask_empty).alias("mask")).select(key, "x.mz", "x.intensity", "mask")


def raw_tokens(peaks: Column, low: float = 0.0, size: float = 1.0, vocabulary: int = 1002, top: int = 100) -> Column:
    """Run-side tokens: valid peaks, the most intense, floor + 1 clipped to [1, vocabulary - 1], repeats kept."""
    kept = by_mz(top_peaks(valid_peaks(peaks), top))
    return F.transform(kept, lambda p: F.struct(F.least(F.greatest(F.floor((p.mz - low) / size) + 1, F.lit(1)), F.lit(vocabulary - 1)).cast("long").alias("token"), p.intensity.alias("intensity")))


def raw_tensor(peaks: Column, top: int = 200) -> Column:
    """Run-side padded input: valid peaks without a range, the most intense, relative to the largest, by m/z."""
    return by_mz(over(top_peaks(valid_peaks(peaks), top), largest))


def words(peaks: Column, decimals: int = 2) -> Column:
    """Words peak@m/z with their weights."""
    return F.transform(peaks, lambda p: F.struct(F.format_string(f"peak@%.{decimals}f", p.mz).alias("word"), p.intensity.alias("weight")))


def spectrum_record(peaks: Column, precursor: Column, ion_mode: Column) -> Column:
    """A spectrum for an external encoder: valid peaks (any m/z sign) and its metadata."""
    return F.struct(by_mz(valid_peaks(peaks, False)).alias("peaks"), precursor.alias("precursor_mz"), precursor.alias("parent_mass"), ion_mode.alias("ionmode"))
