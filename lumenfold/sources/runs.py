"""mzML runs: a parser for whole files, and a data source that reads ranges of bytes as partitions.

A spectrum belongs to the range in which its start tag begins, so a large file is read by many tasks and each holds
one spectrum and a chunk at a time. Of very many ranges neighbours go to one task. Groups of terms stand before the run; each task reads that head of its file. Paths
are those that pyarrow's file systems open; a path can be a file or a folder. Files must be in an encoding that keeps
ASCII's bytes (UTF-8, Latin). A start tag of a spectrum inside a comment isn't told apart from others.
"""

from __future__ import annotations

import base64
import io
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SPECTRA
from .ranges import gathered

BYTES, CHUNK, TAIL = 64 << 20, 4 << 20, 256
OPEN = re.compile(rb"<(?:[\w.-]+:)?spectrum(?=[\s/>])")
TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
CLOSE = re.compile(rb"</(?:[\w.-]+:)?spectrum\s*>")
PEAK = pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])
ARROW = pa.schema([("scan_index", pa.int64()), ("scan_id", pa.string()), ("ms_level", pa.int32()), ("precursor_mz", pa.float64()), ("ionmode", pa.string()), ("peaks", pa.list_(PEAK)), ("file", pa.string())])

#: Accessions of the controlled vocabulary.
LEVEL, SELECTED, ISOLATION, NEGATIVE, POSITIVE = "MS:1000511", "MS:1000744", "MS:1000827", "MS:1000129", "MS:1000130"
MZ_ARRAY, INTENSITY_ARRAY, DOUBLE, ZIPPED = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574"


def local(node) -> str:
    return node.tag.rpartition("}")[2]


def params(node, groups: dict[str, list[tuple]]) -> list[tuple]:
    """Terms below a node in order, those of groups it refers to in their places."""
    found = []
    for p in node.iter():
        if local(p) == "cvParam":
            found.append((p.get("accession"), p.get("value")))
        elif local(p) == "referenceableParamGroupRef":
            found += groups.get(p.get("ref"), [])
    return found


def spectrum(node, groups: dict[str, list[tuple]]) -> dict:
    """A spectrum's values; its valid peaks as arrays mz and intensity."""
    ions = params(node, groups)
    terms, arrays = dict(ions), {}
    for part in node.iter():
        if part.tag.endswith("binaryDataArray"):
            own = {name for name, _ in params(part, groups)}
            data = base64.b64decode(next((p.text or "" for p in part.iter() if local(p) == "binary"), ""))
            data = zlib.decompress(data) if ZIPPED in own and data else data
            for name in (MZ_ARRAY, INTENSITY_ARRAY):
                if name in own:
                    arrays[name] = np.frombuffer(data, "<f8" if DOUBLE in own else "<f4").astype(float)
    # of several precursors the first
    precursor = next((float(v) for a in (SELECTED, ISOLATION) for name, v in ions if name == a and v), float("nan"))
    mode = "negative" if NEGATIVE in terms else "positive" if POSITIVE in terms else None
    mz, intensity = arrays.get(MZ_ARRAY, np.zeros(0)), arrays.get(INTENSITY_ARRAY, np.zeros(0))
    ok = np.isfinite(mz) & np.isfinite(intensity) & (mz > 0) & (intensity > 0) if len(mz) == len(intensity) else None
    mz, intensity = (np.zeros(0), np.zeros(0)) if ok is None else (mz[ok], intensity[ok])
    return {"scan_index": int(node.get("index", 0)), "scan_id": node.get("id", ""), "ms_level": int(terms.get(LEVEL) or 0), "precursor_mz": precursor, "ionmode": mode, "mz": mz, "intensity": intensity}


def parse_mzml(raw: bytes) -> Iterator[dict]:
    """The spectra of an mzML file."""
    groups: dict[str, list[tuple]] = {}
    for _, node in ET.iterparse(io.BytesIO(raw)):
        if local(node) == "referenceableParamGroup":
            groups[node.get("id")] = params(node, groups)
        elif local(node) == "spectrum":
            row = spectrum(node, groups)
            yield {k: v for k, v in row.items() if k not in ("mz", "intensity")} | {"peaks": [{"mz": m, "intensity": i} for m, i in zip(row["mz"], row["intensity"], strict=True)]}
            node.clear()


def head(f) -> tuple[dict[str, list[tuple]], bytes]:
    """Groups of terms before the run, and a start tag that gives pieces of the file their encoding and name spaces."""
    parser, groups, spaces, first = ET.XMLPullParser(("start", "end", "start-ns")), {}, {}, b""
    while block := f.read(1 << 16):
        first = first or block
        parser.feed(block)
        for event, node in parser.read_events():
            if event == "start-ns":
                spaces[node[0]] = node[1]
            elif event == "end" and local(node) == "referenceableParamGroup":
                groups[node.get("id")] = params(node, groups)
            elif event == "start" and local(node) in ("run", "spectrumList", "spectrum"):
                block = b""
                break
        if not block:
            break
    if first[:2] in (b"\xfe\xff", b"\xff\xfe"):
        raise ValueError("UTF-16 can't be read in pieces")
    coded = re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding=[\"']([\w.-]+)", first)
    declared = f'<?xml version="1.0" encoding="{coded[1].decode() if coded else "UTF-8"}"?>'
    return groups, (declared + "<piece" + "".join(f' xmlns{":" if k else ""}{k}="{v}"' for k, v in spaces.items()) + ">").encode()


def pieces(f, low: int, high: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of each spectrum whose start tag begins in [low, high); f holds the file, of which a chunk is read at a time."""
    f.seek(low)
    held, base, at = b"", low, 0  # base: where held begins in the file; at: where the search goes on in it

    def more(keep: int) -> bool:
        nonlocal held, base, at
        read = f.read(chunk)
        held, base, at = held[keep:] + read, base + keep, at - keep
        return bool(read)

    while True:
        begun = OPEN.search(held, at)
        if begun is None:
            at = max(at, len(held) - TAIL)  # a tag can be cut by the chunk's end
            if base + at >= high or not more(at):
                return
            continue
        at = begun.start()
        if base + at >= high:
            return
        while (tag := TAG.match(held, at)) is None:
            if not more(at):
                raise ValueError("the file ends inside a spectrum")
        if tag[0].endswith(b"/>"):
            yield tag[0]
            at = tag.end()
            continue
        seek = tag.end() - at
        while (closed := CLOSE.search(held, at + seek)) is None:
            seek = max(seek, len(held) - at - TAIL)
            if not more(at):
                raise ValueError("the file ends inside a spectrum")
        yield held[at : closed.end()]
        at = closed.end()


@dataclass
class Range:
    file: str
    low: int
    high: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def joined(ranges: list[Range]) -> list[Range]:
    """Neighbours in one file as one range."""
    out: list[Range] = []
    for r in ranges:
        if out and (out[-1].file, out[-1].high) == (r.file, r.low):
            out[-1] = Range(r.file, out[-1].low, r.high)
        else:
            out.append(r)
    return out


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size, self.chunk = options["path"], int(options.get("bytes", BYTES)), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Ranges]:
        store, path = fs.FileSystem.from_uri(self.root)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        files = [f for f in found if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(".mzml"))]
        ranges = [Range(f.path, low, min(f.size, low + self.size)) for f in sorted(files, key=lambda f: f.path) for low in range(0, f.size, self.size)]
        return [Ranges(joined(part)) for part in gathered(ranges, [r.high - r.low for r in ranges])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for one in part.ranges:
            yield from self.spectra(one)

    def spectra(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(part.file) as f:
            groups, begin = head(f)
            end, rows, peaks = b"</piece>", [], 0
            for piece in pieces(f, part.low, part.high, self.chunk):
                rows.append(spectrum(ET.fromstring(begin + piece + end)[0], groups))
                peaks += len(rows[-1]["mz"])
                if len(rows) == 4_096 or peaks > 1_000_000:
                    yield batch(rows, part.file)
                    rows, peaks = [], 0
            if rows:
                yield batch(rows, part.file)


def batch(rows: list[dict], file: str) -> pa.RecordBatch:
    """Rows of one file in SPECTRA's columns; a precursor that is not a number is null, as in whole files."""
    ends = np.concatenate([[0], np.cumsum([len(r["mz"]) for r in rows])]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([r[c] for r in rows])) for c in ("mz", "intensity")], fields=list(PEAK))
    one = [pa.array([r[f.name] for r in rows], f.type, from_pandas=True) for f in ARROW if f.name not in ("peaks", "file")]
    return pa.RecordBatch.from_arrays([*one, pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([file] * len(rows))], schema=ARROW)


class Runs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumenfold_runs"

    def schema(self) -> str:
        return SPECTRA

    def reader(self, schema) -> RunReader:
        return RunReader(self.options)


def write_runs(rows: DataFrame, path: str, prefix: str = "run_", zipped: bool = True) -> DataFrame:
    """Writes file, number, precursor_mz, peaks as MS2 spectra of `prefix`000000000000.mzML and so on, in the order of number; gives the files and their spectra.

    A file is made whole by one task, so `file` numbers should come in groups that fit a task. A task that runs again writes the same bytes.
    """

    def term(name: str, value: str = "") -> str:
        return f'<cvParam accession="{name}" value="{value}"/>'

    def array(values: list[float], *names: str) -> str:
        data = np.asarray(values, "<f8").tobytes()
        data = base64.b64encode(zlib.compress(data) if zipped else data).decode()
        return f"<binaryDataArray>{''.join(map(term, names))}{term(ZIPPED) if zipped else ''}<binary>{data}</binary></binaryDataArray>"

    def write(part: pd.DataFrame) -> pd.DataFrame:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{prefix}{int(part['file'].iloc[0]):012d}.mzML"
        with store.open_output_stream(name) as to:
            to.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList count="1"><referenceableParamGroup id="ms2">{term(LEVEL, "2")}</referenceableParamGroup></referenceableParamGroupList><run><spectrumList count="{len(part)}">\n'.encode())
            for i, r in enumerate(part.sort_values("number").itertuples(index=False)):
                ion = "" if pd.isna(r.precursor_mz) else f"<precursorList><precursor><selectedIonList><selectedIon>{term(SELECTED, repr(float(r.precursor_mz)))}</selectedIon></selectedIonList></precursor></precursorList>"
                lists = array([p["mz"] for p in r.peaks], MZ_ARRAY, DOUBLE) + array([p["intensity"] for p in r.peaks], INTENSITY_ARRAY, DOUBLE)
                to.write(f'<spectrum index="{i}" id="number={int(r.number)}" defaultArrayLength="{len(r.peaks)}"><referenceableParamGroupRef ref="ms2"/>{ion}<binaryDataArrayList count="2">{lists}</binaryDataArrayList></spectrum>\n'.encode())
            to.write(b"</spectrumList></run></mzML>\n")
        return pd.DataFrame({"path": [name], "n": [len(part)]})

    return rows.select("file", "number", "precursor_mz", "peaks").groupBy("file").applyInPandas(write, "path string, n long")
