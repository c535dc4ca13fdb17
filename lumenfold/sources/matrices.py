"""A data source for folders of .npy matrices and .npz bundles: ranges of rows as partitions, one numbering over all files.

Partitions are planned from the files' headers alone: a .npy file in row order is dealt into ranges of about `bytes`
bytes, so a large file is read by many tasks; a bundle, and a matrix in column order, is one range. Of very many ranges
neighbours are one partition. Rows are numbered
over all files by path, then row, from 0. Paths are those that pyarrow's file systems open (local or shared folders, HDFS,
object stores); a path can be a file or a folder. Pickled contents are refused.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import gathered

BYTES, CHUNK = 64 << 20, 4096
TEXTS = ("smiles", "inchikey", "name", "formula")
SCHEMA = "row long, embedding array<float>, bundle_method string, precursor_mz double, file string, " + ", ".join(f"{k} string" for k in TEXTS)
ARROW = pa.schema([("row", pa.int64()), ("embedding", pa.list_(pa.float32())), ("bundle_method", pa.string()), ("precursor_mz", pa.float64()), ("file", pa.string()), *((k, pa.string()) for k in TEXTS)])


def header(f) -> tuple[tuple[int, int], bool, np.dtype]:
    """Rows and columns, whether by columns, and type of the matrix; f stands at the first value afterwards."""
    version = np.lib.format.read_magic(f)
    shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError("pickled values are refused")
    flat = tuple(n for n in shape if n != 1) if len(shape) == 3 else shape
    if len(shape) == 3 and len(flat) < 2:  # axes of size one go, but not both of a single row
        flat = (shape[0], int(np.prod(shape[1:])))
    if len(flat) != 2:
        raise ValueError(f"shape {shape} is no matrix")
    return flat, by_columns, dtype


def member(names: list[str]) -> str:
    """The bundle's matrix."""
    for k in ("embeddings", "embedding"):
        if f"{k}.npy" in names:
            return f"{k}.npy"
    raise ValueError("the bundle has neither embeddings nor embedding")


@dataclass
class Rows:
    file: str
    first: int
    low: int
    high: int


@dataclass
class Parts(InputPartition):
    parts: list[Rows]


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("bytes", BYTES))

    def partitions(self) -> list[Parts]:
        store, path = fs.FileSystem.from_uri(self.root)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        out, sizes, first = [], [], 0
        for file in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".npy", ".npz"))):
            try:
                with store.open_input_file(file) as f:
                    if file.endswith(".npz"):
                        with zipfile.ZipFile(f) as z, z.open(member(z.namelist())) as m:
                            ((n, width), _, dtype), step = header(m), None
                    else:
                        (n, width), by_columns, dtype = header(f)
                        step = None if by_columns else max(1, self.size // max(1, width * dtype.itemsize))
            except ValueError as error:
                raise ValueError(f"{file}: {error}") from error
            for low in range(0, n, step or max(n, 1)):
                out.append(Rows(file, first, low, min(n, low + (step or n))))
                sizes.append((out[-1].high - low) * width * dtype.itemsize)
            first += n
        return [Parts(parts) for parts in gathered(out, sizes)]

    def read(self, part: Parts) -> Iterator[pa.RecordBatch]:
        for one in part.parts:
            yield from self.rows(one)

    def rows(self, part: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(part.file) as f:
            if part.file.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    side = {}
                    for name in z.namelist():
                        if name != member(z.namelist()) and name[:-4] in ("method", "precursor_mz", *TEXTS):
                            side[name[:-4]] = np.ravel(np.load(io.BytesIO(z.read(name)), allow_pickle=False))
                    with z.open(member(z.namelist())) as m:
                        yield from self.batches(m, part, side)
            else:
                yield from self.batches(f, part, {})

    def batches(self, f, part: Rows, side: dict) -> Iterator[pa.RecordBatch]:
        (n, width), by_columns, dtype = header(f)
        whole = np.frombuffer(f.read(n * width * dtype.itemsize), dtype).reshape(width, n).T if by_columns else None
        if not by_columns and part.low:
            f.seek(f.tell() + part.low * width * dtype.itemsize)
        method = str(side["method"][0]) if len(side.get("method", ())) else None
        for at in range(part.low, part.high, CHUNK):
            to = min(part.high, at + CHUNK)
            x = whole[at:to] if by_columns else np.frombuffer(f.read((to - at) * width * dtype.itemsize), dtype).reshape(to - at, width)
            values = pa.array(np.ascontiguousarray(x, np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at + 1) * width, width, dtype=np.int32) if width else np.zeros(to - at + 1, np.int32)), values)
            text = lambda k: pa.array([str(v) for v in side[k][at:to]] if k in side else [None] * (to - at), pa.string())  # noqa: B023, E731
            mass = pa.array(np.asarray(side["precursor_mz"][at:to], float) if "precursor_mz" in side else np.full(to - at, np.nan))
            columns = [pa.array(np.arange(part.first + at, part.first + to)), lists, pa.array([method] * (to - at), pa.string()), mass, pa.array([part.file] * (to - at)), *map(text, TEXTS)]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


class Matrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenfold_matrices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def write_matrices(rows: DataFrame, path: str, prefix: str = "library_") -> DataFrame:
    """Writes file, number (row order in the file), embedding as `prefix`000000000000.npy and so on; gives the files and their rows.

    A file is made whole by one task, so `file` numbers should come in groups that fit a task. A task that runs again writes the same bytes.
    """

    def write(part: pd.DataFrame) -> pd.DataFrame:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part = part.sort_values("number")
        name = f"{folder}/{prefix}{int(part['file'].iloc[0]):012d}.npy"
        held = io.BytesIO()
        np.save(held, np.stack(part["embedding"].to_list()).astype(np.float32))
        with store.open_output_stream(name) as out:
            out.write(held.getvalue())
        return pd.DataFrame({"path": [name], "n": [len(part)]})

    return rows.select("file", "number", "embedding").groupBy("file").applyInPandas(write, "path string, n long")
