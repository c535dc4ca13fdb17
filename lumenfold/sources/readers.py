"""Sources: tables of spectra, embedding files, runs, file pairs. All paths go through Spark's readers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.metadata import method_name
from ..functions.peaks import from_arrays, peak
from ..schemas import SPECTRA
from .cache import settled
from .matrices import Matrices
from .runs import Runs, parse_mzml


#: Names of columns with peak lists, m/z and intensities, in the order in which they are tried.
PEAK_COLUMNS = ("peaks", "spectrum", "peak_array", "mz_intensity_array", "mz_intensity")
MZ_COLUMNS = ("mz", "mzs", "mz_array", "mz_values", "peak_mz")
INTENSITY_COLUMNS = ("intensity", "intensities", "intensity_array", "intensity_values", "peak_intensity")


def coerced(column: Column, kind: DataType) -> Column:
    """A stored peak list as array<struct<mz,intensity>>: structs (by name, else their first two fields), two rows of m/z and intensities, or pairs.

    A list of exactly two arrays counts as two rows.
    """
    inner = kind.elementType if isinstance(kind, ArrayType) else None
    if isinstance(inner, StructType) and len(inner.names) > 1:
        a, b = ("mz", "intensity") if {"mz", "intensity"} <= set(inner.names) else inner.names[:2]
        return F.transform(column, lambda p: peak(p[a], p[b]))
    if isinstance(inner, ArrayType):
        rows = from_arrays(F.get(column, 0), F.get(column, 1))
        return F.when(F.size(column) == 2, rows).otherwise(F.transform(column, lambda p: peak(F.get(p, 0), F.get(p, 1))))
    raise ValueError(f"{kind.simpleString()} is no peak list")


def with_peaks(df: DataFrame, names: tuple[str, ...] = PEAK_COLUMNS, mz: tuple[str, ...] = MZ_COLUMNS, intensity: tuple[str, ...] = INTENSITY_COLUMNS) -> DataFrame:
    """Adds `peaks` from the first peak list among the names, else from the first pair of arrays; what it was made of goes."""
    held = {f.name.lower(): f for f in reversed(df.schema.fields)}  # names count without regard to case
    first = lambda among: next((held[n.lower()] for n in among if n.lower() in held), None)
    one, a, b = first(names), first(mz), first(intensity)
    if one is not None:
        made, gone = coerced(df[f"`{one.name}`"], one.dataType), [one.name]
    elif a is not None and b is not None:
        made, gone = from_arrays(df[f"`{a.name}`"], df[f"`{b.name}`"]), [a.name, b.name]
    else:
        raise ValueError("the table has neither peaks nor m/z and intensity arrays")
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in gone], made.alias("peaks"))


def read_library(spark: SparkSession, path: str, **names: tuple[str, ...]) -> DataFrame:
    """Parquet spectra with `peaks` (with_peaks() takes the names). Refuses a table without peaks or precursor."""
    df = spark.read.parquet(path)
    if "precursor_mz" not in df.columns:
        raise ValueError("the table has no precursor_mz")
    return with_peaks(df, **names)


def resolve(spark: SparkSession, source) -> DataFrame:
    """Spectra of a table, of a path or of an object with a `path`: mzML and HDF5 by their endings, else Parquet."""
    if isinstance(source, DataFrame):
        return source
    path = source if isinstance(source, (str, os.PathLike)) else getattr(source, "path", None)
    if path is None:
        raise TypeError(f"{type(source).__name__} is neither a table nor a path nor has a path")
    path = os.fspath(path)
    end = path.lower().rpartition(".")[2]
    return read_mzml(spark, path) if end == "mzml" else read_h5(spark, path) if end in ("h5", "hdf5") else read_library(spark, path)


def load_library(spark: SparkSession, settings: dict) -> tuple[DataFrame, str | None]:
    """The library the settings name, and its column of stored vectors; None where there is none or it holds no vectors."""
    df = resolve(spark, library_path(settings))
    vectors = (f.name for f in df.schema.fields if f.name.lower() == "dreams_embedding" and isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, (ArrayType, StructType)))
    return df, next(vectors, None)


def library_path(settings: dict) -> str:
    """The library's path, flat or under library, data or mona."""
    #: Names of the setting; the last three are this library's own.
    keys = ("source_path", "mona_hdf5_path", "mona_path", "library_path", "lib_path", "library_h5", "h5_path", "path")
    for part in (settings, *(settings.get(k) or {} for k in ("library", "data", "mona"))):
        if isinstance(part, dict):
            for k in keys:
                if part.get(k):
                    return str(part[k])
    raise ValueError(f"no path under {keys}")


def read_h5(spark: SparkSession, path: str) -> DataFrame:
    """Root datasets of an HDF5 file that share their first dimension, as rows. Needs h5py, and a path that workers can open."""
    try:
        import h5py
    except ImportError as error:
        raise ImportError("HDF5 needs h5py; convert the file to Parquet first") from error
    with h5py.File(path) as f:
        sizes = {k: v.shape[0] for k, v in f.items() if hasattr(v, "shape") and v.shape}
        if len(set(sizes.values())) != 1 or len(sizes) != len(f):
            raise ValueError("datasets differ in their first dimension, or there are groups")
        n, kinds = next(iter(sizes.values())), {k: column_type(f[k].dtype, f[k].ndim) for k in f if k != "spectrum"}
        if f["spectrum"].ndim != 3 or f["spectrum"].shape[1] != 2:
            raise ValueError("the spectrum dataset holds no rows of m/z and intensities")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with h5py.File(path) as f:
            for b in batches:
                lo, hi = int(b["id"].min()), int(b["id"].max()) + 1
                out = {"library_index": b["id"], "peaks": [[{"mz": float(m), "intensity": float(i)} for m, i in zip(*s, strict=True) if i > 0] for s in f["spectrum"][lo:hi]]}
                yield pd.DataFrame(out | {k: column_values(f[k][lo:hi]) for k in kinds})

    return spark.range(n).mapInPandas(run, "library_index long, peaks array<struct<mz:double,intensity:double>>" + "".join(f", `{k}` {t}" for k, t in kinds.items()))


def column_type(dtype: np.dtype, dimensions: int) -> str:
    """The Spark type of a dataset's column: whole numbers, floats, truth values, else text; in arrays for each further dimension."""
    one = {"i": "bigint", "u": "bigint", "b": "boolean", "f": "float" if dtype.itemsize <= 4 else "double"}.get(dtype.kind, "string")
    for _ in range(dimensions - 1):
        one = f"array<{one}>"
    return one


def column_values(rows: np.ndarray) -> list:
    """A slice of a dataset as Python values; bytes are read as UTF-8 without what is none."""
    text = lambda v: [text(x) for x in v] if isinstance(v, list) else v.decode("utf-8", "ignore") if isinstance(v, bytes) else str(v)
    return rows.tolist() if rows.dtype.kind in "iubf" else [text(v) for v in rows.tolist()]


def read_embeddings(spark: SparkSession, path: str, key: str = "query_index") -> DataFrame:
    """Rows of .npy matrices, or of .npz bundles (embeddings or embedding, with optional columns), of unit norm nowhere. Pickles are refused.

    Gives key, embedding, method, precursor_mz, smiles, inchikey, name, formula, file. The key numbers the rows of all
    files, by path and row. A bundle's method overrides that of the file name. A three-dimensional array loses axes of size one.
    """
    spark.dataSource.register(Matrices)
    rows = spark.read.format(Matrices.name()).load(path)
    method = F.coalesce("bundle_method", method_name(F.col("file")))
    return rows.select(F.col("row").alias(key), "embedding", method.alias("method"), "precursor_mz", "file", "smiles", "inchikey", "name", "formula")


def join_metadata(matrix: DataFrame, metadata: DataFrame) -> DataFrame:
    """Library vectors with the metadata of the same library_index."""
    return matrix.select("library_index", "embedding").join(metadata, "library_index", "left")


def read_positional(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV rows with `position`: their numbers over all files, by path and place in the file, from 0.

    A row's place is told by its split (file and first byte) and by its number among the rows that a task has read, which
    are consecutive inside a split. Splits are counted, their counts summed up in order (a row a split), and added; rows
    are written once, so both numbers are of one reading, and are not moved. Lines without any value are no rows.
    """
    raw = spark.read.options(**({"header": True} | options)).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("byte"))
    rows = settled(raw.select("*", place.alias("_split"), F.monotonically_increasing_id().alias("_row")))
    splits = rows.groupBy("_split").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_split", "_first", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    return rows.join(splits, "_split").withColumn("position", F.col("_row") - F.col("_first") + F.col("_before")).drop("_split", "_row", "_first", "_before")


def join_positional(matrix: DataFrame, metadata: DataFrame) -> DataFrame:
    """Library vectors with the metadata row of the same number; a vector without one keeps nulls."""
    return matrix.join(metadata.withColumnRenamed("position", "library_index"), "library_index", "left")


def match_files(queries: DataFrame, libraries: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """All query and library files of one method. Both: path. Gives method, query_file, library_file, pair_id."""
    named = lambda df, c: df.select(method_name(F.col("path")).alias("method"), F.col("path").alias(c))
    q = named(queries.where(F.col("path").rlike(r"\.(npy|npz)$")), "query_file")
    lib = named(libraries.where(F.col("path").rlike(r"(^|/)library_[^/]*\.npy$")), "library_file")
    pairs = q.join(lib, "method").where("method <> ''")
    if allowed:
        pairs = pairs.where(F.col("method").isin(*allowed))
    return pairs.withColumn("pair_id", F.substring(F.md5(F.concat_ws("|", "query_file", "library_file")), 1, 12))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """All spectra of mzML files, with the file's own scan index. Filter with operators.filters.run_spectra."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, raw in zip(b["path"], b["content"], strict=True):
                rows = [r | {"file": file} for r in parse_mzml(raw)]
                yield pd.DataFrame(rows, columns=["scan_index", "scan_id", "ms_level", "precursor_mz", "ionmode", "peaks", "file"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SPECTRA)


def read_mzml_pieces(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """read_mzml() of a file or a folder by ranges of `size` bytes, for large files: many tasks a file, none of which holds it whole."""
    spark.dataSource.register(Runs)
    reader = spark.read.format(Runs.name())
    return (reader if size is None else reader.option("bytes", size)).load(path)


def true_counts(df: DataFrame, n: int | None = None) -> DataFrame | None:
    """query_index, component_count; None where the table has no such column."""
    if "component_count" not in df.columns:
        return None
    rows = df.select("query_index", F.col("component_count").cast("long").alias("component_count"))
    return rows if n is None else rows.where(F.col("query_index") < n)
