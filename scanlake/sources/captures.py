"""Capture files, 8 and 16 bit, as a Spark data source.

``register(spark)`` makes the format ``captures`` known. It reads PNG files (gray or colour, 8 or 16 bit, not interlaced) below ``path`` as rows of
tiles, values unchanged: ``file, scan, x, y, height, width, n_channels, ch, tr, tc, kind, data`` (see ``operators.tiles``). Options: ``tile``, the
side of a tile (256), and ``filesPerTask`` (64). Filters on ``scan``, ``x`` and ``y`` are decided by the files' names, so files that are
not asked for are not opened. Files are reached through ``pyarrow.fs``: local folders, HDFS and object stores.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# The format of scan folders and of the places in file names, and the signature of PNG files.
_NAME = re.compile(r"(?:^|/)(?:(wafer_scan_[0-9]{8}_[0-9]{6})/)?[^/]*X([+-][0-9.]+)_Y([+-][0-9.]+)\.png$")
_PNG = b"\x89PNG\r\n\x1a\n"
#: Colour types of PNG files (fixed values): gray, colour, gray with alpha, colour with alpha, and how many of their channels are kept.
_CHANNELS = {0: (1, 1), 2: (3, 3), 4: (2, 1), 6: (4, 3)}
SCHEMA = "file string, scan string, x double, y double, height int, width int, n_channels int, ch int, tr int, tc int, kind string, data binary"


def encode_png(image: np.ndarray) -> bytes:
    """PNG bytes of a height x width x channels array in blue, green, red order, 8 or 16 bit."""
    h, w, n = image.shape
    wide = image[:, :, ::-1].astype(">u2" if image.dtype.itemsize == 2 else np.uint8)
    lines = b"".join(b"\0" + line.tobytes() for line in wide)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8 * image.dtype.itemsize, 2 if n == 3 else 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Image of PNG bytes: height x width x channels in blue, green, red order, ``uint8`` or ``uint16``; alpha is left out."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
        elif name == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError(f"PNG files of {bits} bits, colour type {colour}, interlaced {interlaced} are not read")
    n, kept = _CHANNELS[colour]
    step = n * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for r in range(height):
        out[r] = above = _unfilter(raw[r, 0], raw[r, 1:], above, step)
    image = out.view(">u2").astype("<u2") if bits == 16 else out
    return np.ascontiguousarray(image.reshape(height, width, n)[:, :, :kept][:, :, ::-1])


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG image from its differences: to nothing, the left, the line above, the mean of both, or the nearest of three."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate((np.zeros(step, np.int64), above.astype(np.int64)))
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (int(line[k - step]) + guess) & 0xFF
    return out[step:].astype(np.uint8)


def place_of(file: str) -> tuple[str | None, float, float] | None:
    """(scan, x, y) that a file's name gives; none for other files."""
    found = _NAME.search(file)
    return (found[1], float(found[2]), float(found[3])) if found else None


_HOLDS = {
    EqualTo: lambda v, f: v == f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, In: lambda v, f: v in f.value,
}


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tile, self.per_task = options["path"], int(options.get("tile", 256)), int(options.get("filespertask", 64))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _HOLDS and f.attribute in (("scan",), ("x",), ("y",)):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, file: str) -> bool:
        place = place_of(file)
        if place is None:
            return False
        known = dict(zip(("scan", "x", "y"), place))
        return all(known[f.attribute[0]] is not None and _HOLDS[type(f)](known[f.attribute[0]], f) for f in self.filters)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        listed = store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in listed if i.type == fs.FileType.File and self.wanted(i.path))
        return [Files(names[k : k + self.per_task]) for k in range(0, len(names), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(_uri(self.path))
        for file in partition.files:
            with store.open_input_stream(file) as f:
                image = decode_png(f.read())
            scan, x, y = place_of(file)
            h, w, n = image.shape
            rows = []
            for ch in range(n):
                for r in range(0, h, self.tile):
                    for c in range(0, w, self.tile):
                        part = np.ascontiguousarray(image[r : r + self.tile, c : c + self.tile, ch])
                        rows.append((file, scan, x, y, h, w, n, ch, r // self.tile, c // self.tile, part.dtype.str, part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


_ARROW = pa.schema(
    [(k, t) for k, t in zip([c.split()[0] for c in SCHEMA.split(", ")], [pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int32()] * 6, pa.string(), pa.binary()])]
)


def _uri(path: str) -> str:
    """URI that ``pyarrow.fs`` understands; Spark also writes local ones with a single slash."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``captures`` known, with its filters pushed down to file names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def write_captures(frames, path: str) -> None:
    """Write frames (file, height, width, n_channels, data) as PNG files below ``path``, each where it is; a task that runs again writes the same files."""
    from scanlake.operators import frames as packed

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(path))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                target = f"{root}/{row.file}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as f:
                    f.write(encode_png(packed.as_array(row.data, row.height, row.width, row.n_channels)))
            yield pdf[["file"]].assign(n=1)[["n"]]

    frames.select("file", "height", "width", "n_channels", "data").mapInPandas(write, "n long").agg({"n": "sum"}).collect()
