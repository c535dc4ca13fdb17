"""Signature sniffing of media columns.

One Aho-Corasick automaton over all magic bytes scans a value; at each hit the format's validator confirms
structure and tells the length. A valid hit at the start gives the value's type, which corrects the declared
one; valid hits further on are embedded media and are carved. Formats: PNG, GIF, BMP, WAVE, JPEG, gzip, ZIP, PDF,
FLAC. A validator never reads outside the value, and a hit that fails it is no media. Values are never copied for a
hit; end marks are located once for a value, and gzip members are inflated in pieces that are thrown away. Places
that heads lead to are inflated once; beyond WASTE inflated bytes in vain, heads are listed without a length (bytes null).

For documents, the UTF-8 bytes, padded with 255 to a positive multiple of 576, are stored as 8-bit grey samples
of a 24-wide PNG (equal texts give equal bytes), then sniffed, carved, decoded and described. The payload itself is
sniffed too: media that a text holds (ASCII-only ones such as a PDF) are given by type, start and length.

Null and empty texts are 576 bytes of padding. Values that are null or no media have type null and no parts.
Rows that repeat a doc_id are handled each. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import columns
from .text import column

UNIT, WIDTH = 576, 24
PIECE = 1 << 20  # bytes of a gzip member taken and inflated at once
#: Bytes that gzip heads of one value that prove to be none may inflate, and for each byte of the value; heads after that are told unconfirmed.
WASTE, WASTE_RATE = 1 << 25, 8

#: Magic bytes of formats, where in the value they stand, and media types.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVE", 8, "audio/wav"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"fLaC", 0, "audio/flac"),
)


def png_length(v: memoryview) -> int:
    at, names = 8, []
    if v[8:16] != b"\0\0\0\rIHDR":
        return 0
    while at + 12 <= len(v):
        (n,) = struct.unpack_from(">I", v, at)
        name, end = v[at + 4 : at + 8], at + 12 + n
        if end > len(v) or zlib.crc32(v[at + 4 : end - 4]) != struct.unpack_from(">I", v, end - 4)[0]:
            return 0
        names.append(bytes(name))
        if name == b"IEND":
            return end if names[0] == b"IHDR" and b"IDAT" in names else 0
        at = end
    return 0


def gif_length(v: memoryview) -> int:
    if len(v) < 14:
        return 0
    at = 13 + (3 << (v[10] & 7) + 1 if v[10] & 128 else 0)
    frames = 0
    while at < len(v):
        if v[at] == 0x3B:
            return at + 1 if frames else 0
        if v[at] == 0x21:
            at += 2
        elif v[at] == 0x2C and at + 10 < len(v):
            at += 10 + (3 << (v[at + 9] & 7) + 1 if v[at + 9] & 128 else 0) + 1
            frames += 1
        else:
            return 0
        while at < len(v) and v[at]:
            at += 1 + v[at]
        at += 1
    return 0


def bmp_length(v: memoryview) -> int:
    if len(v) < 54:
        return 0
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", v, 2)
    ok = not zero and head in (40, 108, 124) and 14 + head <= start <= size <= len(v) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if ok and size - start >= (width * bits + 31) // 32 * 4 * abs(height) else 0


def wav_length(v: memoryview) -> int:
    if len(v) < 44 or v[:4] != b"RIFF" or v[8:12] != b"WAVE":
        return 0
    end, at, names = 8 + struct.unpack_from("<I", v, 4)[0], 12, set()
    if end > len(v):
        return 0
    while at + 8 <= end:
        n = struct.unpack_from("<I", v, at + 4)[0]
        names.add(bytes(v[at : at + 4]))
        at += 8 + n + (n & 1)
    return end if names >= {b"fmt ", b"data"} and at == end else 0


class Marks:
    """Where the formats that are told by marks further on can end; each mark of a value is found once."""

    def __init__(self, value: bytes):
        self.value, self.zips, self.pdf, self.dead = value, None, None, set()
        self.zeros, self.bad, self.spent = None, set(), 0

    def all(self, mark: bytes) -> list[int]:
        out, at = [], self.value.find(mark)
        while at >= 0:
            out.append(at)
            at = self.value.find(mark, at + 1)
        return out

    def after_zero(self, at: int) -> int:
        """The place behind the next zero byte from `at` on; 0 where there is none."""
        if self.zeros is None:
            self.zeros = np.flatnonzero(np.frombuffer(self.value, np.uint8) == 0)
        k = int(np.searchsorted(self.zeros, at))
        return int(self.zeros[k]) + 1 if k < len(self.zeros) else 0

    def gzip(self, start: int) -> int:
        """A member whose data, sum and size hold; -1 where too much was inflated in vain before."""
        v, at = self.value, start + 10
        if start + 18 > len(v) or v[start + 3] & 0xE0:
            return 0
        flags = v[start + 3]
        if flags & 4:
            at += 2 + struct.unpack_from("<H", v, at)[0]
        for flag in (8, 16):
            if flags & flag and not (at := self.after_zero(at)):
                return 0
        if at in self.bad or at + 8 > len(v):
            return 0
        if self.spent > WASTE + WASTE_RATE * len(v):
            return -1
        if flags & 2:
            self.spent += at - start
            if zlib.crc32(memoryview(v)[start:at]) & 0xFFFF != struct.unpack_from("<H", v, at)[0]:
                return 0
            at += 2
        end = self.inflated(at)
        if not end:
            self.bad.add(at)
        return max(end - start, 0)

    def inflated(self, at: int) -> int:
        """The end of the member whose deflated data start here, or 0; what is inflated for nothing is counted."""
        v, one, crc, size, i, step = memoryview(self.value), zlib.decompressobj(-15), 0, 0, at, 1 << 12
        try:
            while i < len(v) and not one.eof:
                part = v[i : i + step]
                i, step = i + len(part), min(2 * step, PIECE)
                while len(part) and not one.eof:
                    piece = one.decompress(part, PIECE)
                    crc, size, part = zlib.crc32(piece, crc), size + len(piece), one.unconsumed_tail
            end = i - len(one.unused_data)
            if one.eof and end + 8 <= len(v) and struct.unpack_from("<II", v, end) == (crc, size & 0xFFFFFFFF):
                return end + 8
        except zlib.error:
            pass
        self.spent += size + i - at
        return 0

    def jpeg(self, start: int) -> int:
        """Segments from one place are the same for every start that reaches it, so a place that fails is looked at once."""
        v, at, been = self.value, start + 2, []
        while at + 4 <= len(v) and v[at] == 0xFF and at not in self.dead:
            been.append(at)
            marker = v[at + 1]
            at += 2 + struct.unpack_from(">H", v, at + 2)[0]
            if marker == 0xDA:  # entropy-coded data up to the end marker
                while (at := v.find(b"\xff", at)) >= 0 and at + 1 < len(v):
                    if v[at + 1] == 0xD9:
                        return at + 2 - start
                    if v[at + 1] not in (0, *range(0xD0, 0xD8)):
                        break
                    at += 2
                else:
                    break
        self.dead.update(been)
        return 0

    def zip(self, start: int) -> int:
        """By the end records: each tells where its archive starts."""
        v = self.value
        if self.zips is None:
            self.zips = {}
            for at in self.all(b"PK\x05\x06"):
                if at + 22 <= len(v):
                    _, size, before, note = struct.unpack_from("<HIIH", v, at + 10)
                    first = at - size - before
                    if first >= 0 and v[first + before : first + before + 4] in (b"PK\x01\x02", b"PK\x05\x06") and at + 22 + note <= len(v):
                        self.zips.setdefault(first, at + 22 + note)
        return self.zips.get(start, start) - start

    def pdf_end(self, start: int) -> int:
        """Up to the last end mark with a startxref of its own before the next header; later revisions add such marks."""
        if self.pdf is None:
            ends, tables = self.all(b"%%EOF"), self.all(b"startxref")
            own = [(e, tables[k - 1]) for e, before in zip(ends, [-1, *ends], strict=False) if (k := bisect(tables, e)) and tables[k - 1] > before]
            self.pdf = self.all(b"%PDF-"), own
        heads, own = self.pdf
        k = bisect(heads, start)
        e = bisect(own, (heads[k] if k < len(heads) else len(self.value),))
        return own[e - 1][0] + 5 - start if e and own[e - 1][1] > start else 0


def flac_length(v: memoryview) -> int:
    """Frames have no total length: the stream reaches to the end of the value if its metadata is sound."""
    at = 4
    while at + 4 <= len(v):
        kind, n = v[at], int.from_bytes(v[at + 1 : at + 4], "big")
        if at == 4 and (kind & 127 or n != 34):
            return 0
        at += 4 + n
        if kind & 128:
            return len(v) if at + 2 <= len(v) and v[at] == 0xFF and v[at + 1] & 0xFC == 0xF8 else 0
    return 0


#: By the bytes from the start on, and by the marks of the whole value.
LENGTHS: dict[str, Callable[[memoryview], int]] = {"image/png": png_length, "image/gif": gif_length, "image/bmp": bmp_length, "audio/wav": wav_length, "audio/flac": flac_length}
MARKED: dict[str, Callable[[Marks, int], int]] = {"image/jpeg": Marks.jpeg, "application/gzip": Marks.gzip, "application/zip": Marks.zip, "application/pdf": Marks.pdf_end}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, before, kind in SIGNATURES:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic) + before, kind))
        self.automaton.make_automaton()

    def parts(self, value: bytes) -> list[tuple[str, int, int]]:
        """Type, start and length of each media part; parts inside a part before them are not looked at. Length 0: unconfirmed."""
        out, free, view, marks = [], 0, memoryview(value), Marks(value)
        for last, (back, kind) in self.automaton.iter(value.decode("latin-1")):
            start = last + 1 - back
            if start >= free and (n := LENGTHS[kind](view[start:]) if kind in LENGTHS else MARKED[kind](marks, start)):
                out.append((kind, start, max(n, 0)))
                free = start + max(n, 0)
        return out


def sniff(media: DataFrame, value: str = "value", declared: str = "declared") -> DataFrame:
    """`doc`, a struct of all columns of the table, media_type (of a part at the start), corrected, parts (type, start, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        part = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("bytes", pa.binary())]))
        for batch in batches:
            values = [v or b"" for v in column(batch, "value").to_pylist()]
            found = [sniffer.parts(v) for v in values]
            kinds = [p[0][0] if p and p[0][1] == 0 and p[0][2] else None for p in found]
            said = column(batch, "declared").to_pylist()
            cut = [[{"type": k, "start": s, "bytes": v[s : s + n] if n else None} for k, s, n in p] for p, v in zip(found, values, strict=True)]
            yield pa.record_batch([column(batch, "doc"), pa.array(kinds, pa.string()), pa.array([k is not None and k != d for k, d in zip(kinds, said, strict=True)], pa.bool_()), pa.array(cut, part)], ["doc", "media_type", "corrected", "parts"])

    given = dict(zip(media.columns, columns(media), strict=True))
    rows = media.select(F.struct(*given.values()).alias("doc"), given[value].cast("binary").alias("value"), given[declared].cast("string").alias("declared"))
    found = T.StructType.fromDDL("media_type string, corrected boolean, parts array<struct<type:string,start:long,bytes:binary>>")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *found.fields]))


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey, no filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """Samples by row of a PNG written by to_png()."""
    at, data, width, height = 8, [], 0, 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        name, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def describe(kind: str, samples: np.ndarray) -> str:
    flat = samples.ravel().astype(np.float64)
    steps = np.abs(np.diff(flat))
    share = np.bincount(samples.ravel() >> 5, minlength=8) / len(flat)
    return f"{kind};{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};step={steps.mean():.4f};hist=" + ",".join(f"{x:.4f}" for x in share)


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean, text_type string, embedded string"


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, corrected.

    text_type and embedded tell what the text itself is, and which media stand in it (type@start+length, comma-joined).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            out = []
            for text in column(batch, "text"):
                raw = (text.as_py() or "").encode()
                payload = raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)
                stored = to_png(payload)  # declared as plain bytes
                kind, start, n = sniffer.parts(stored)[0]
                media = stored[start : start + n]
                samples = from_png(media)
                back = samples.tobytes()
                inside = sniffer.parts(payload)
                of_text = inside[0][0] if inside and not inside[0][1] else None
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(kind, samples), kind != "application/octet-stream", of_text, ",".join(f"{k}@{s}+{m}" for k, s, m in inside)))
            cols = list(zip(*out, strict=True)) or [[]] * 10
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.record_batch([column(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
