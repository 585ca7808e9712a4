"""Grids in files: GeoTIFF, ASCII grids, arrays of NumPy; read as cells by many tasks, a part of the file each."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fernbrand.sources.tables import read_ascii_grid, read_cells

CELLS = "grid_row int, grid_col int, x double, y double, value double"
# Bytes and letters of the types of a tag.
TAG_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q")}
SAMPLES = {1: "u", 2: "i", 3: "f"}
MISSING_CODE = -9999


def unpack_lzw(data: bytes) -> bytes:
    """Bytes of an LZW strip: codes of 9 to 12 bits, high bits first, each widened one code early."""
    out, table, before = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            if code < len(table):
                entry = table[code]
                if before:
                    table.append(before + entry[:1])
            else:
                entry = before + before[:1]
                table.append(entry)
            out += entry
            before = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of ``unpack_lzw``."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    fresh = {bytes([i]): i for i in range(256)}
    table, size, width, word = dict(fresh), 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = size
        size += 1
        if size >= 1 << width:
            width += 1
        if size >= 4094:
            put(256, width if width <= 12 else 12)
            table, size, width = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


@dataclass
class Layout:
    """What a GeoTIFF's first directory says."""

    order: str
    width: int
    height: int
    kind: str
    samples: int
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: list[int]
    counts: list[int]
    transform: tuple[float, float, float, float]
    nodata: float | None
    epsg: int | None
    planar: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block[0])


def read_layout(path: str) -> Layout:
    """The layout of a GeoTIFF (not BigTIFF), from a few reads of its head."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} isn't a TIFF file")
        f.seek(struct.unpack(order + "I", head[4:])[0])
        tags = {}
        for entry in [f.read(12) for _ in range(struct.unpack(order + "H", f.read(2))[0])]:
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind not in TAG_TYPES:
                continue
            size, letter = TAG_TYPES[kind]
            raw = entry[8:]
            if size * count > 4:
                here = f.tell()
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size * count)
                f.seek(here)
            raw = raw[: size * count]
            tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count * len(letter)}{letter[0]}", raw)
    width, height = tags[256][0], tags[257][0]
    tiled = 322 in tags
    block = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (height,))[0], height), width)
    if 34264 in tags:
        m = tags[34264]
        transform = (m[3], m[0], m[7], m[5])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = (x - i * sx, sx, y + j * sy, -sy)
    else:
        transform = (0.0, 1.0, 0.0, -1.0)
    keys = tags.get(34735, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = None
    if 42113 in tags:
        try:
            nodata = float(tags[42113])
        except ValueError:
            pass
    bits, samples = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: {bits} bits a value aren't read")
    return Layout(
        order, width, height, f"{SAMPLES.get(tags.get(339, (1,))[0], 'u')}{bits // 8}", samples, tags.get(259, (1,))[0], tags.get(317, (1,))[0], block,
        list(tags[324 if tiled else 273]), list(tags[325 if tiled else 279]), transform, nodata, found.get(3072) or found.get(2048), tags.get(284, (1,))[0] == 2,
    )


def read_block(path: str, layout: Layout, number: int, band: int = 1) -> np.ndarray:
    """Values of a block (strip or tile) of a band, cut to the grid."""
    row, col = divmod(number, layout.across)
    at = number + (band - 1) * layout.blocks if layout.planar else number
    with open(path, "rb") as f:
        f.seek(layout.offsets[at])
        raw = f.read(layout.counts[at])
    if layout.compression == 5:
        raw = unpack_lzw(raw)
    elif layout.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif layout.compression != 1:
        raise ValueError(f"{path}: compression {layout.compression} isn't read")
    samples = 1 if layout.planar else layout.samples
    wide = layout.block[1]
    kind = np.dtype(layout.order + layout.kind)
    high = len(raw) // (wide * samples * kind.itemsize)
    if layout.predictor == 3:
        # Floating values: bytes of a row by significance, each less the one before.
        parts = np.cumsum(np.frombuffer(raw, np.uint8)[: high * wide * samples * kind.itemsize].reshape(high, -1, samples), axis=1, dtype=np.uint8)
        parts = parts.reshape(high, kind.itemsize, wide * samples).transpose(0, 2, 1)
        values = np.ascontiguousarray(parts).view(kind.newbyteorder(">")).reshape(high, wide, samples)
    else:
        values = np.frombuffer(raw, kind)[: high * wide * samples].reshape(high, wide, samples)
        if layout.predictor == 2:
            values = np.cumsum(values.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    top, left = row * layout.block[0], col * wide
    return values[: layout.height - top, : layout.width - left, 0 if layout.planar else band - 1].astype(float)


class _Blocks(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff")``: options ``band``, and ``cells`` for about how many cells a task reads."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _GeoTiffReader(self.options)


class _GeoTiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.band, self.cells = options["path"].removeprefix("file://"), int(options.get("band", "1")), int(options.get("cells", "1000000"))

    def partitions(self) -> list[InputPartition]:
        layout = read_layout(self.path)
        step = max(1, self.cells // (layout.block[0] * layout.block[1]))
        return [_Blocks(i, min(i + step, layout.blocks)) for i in range(0, layout.blocks, step)]

    def read(self, partition: _Blocks):
        layout = read_layout(self.path)
        x0, dx, y0, dy = layout.transform
        for number in range(partition.first, partition.last):
            values = read_block(self.path, layout, number, self.band)
            row, col = divmod(number, layout.across)
            r = np.repeat(np.arange(values.shape[0]) + row * layout.block[0], values.shape[1])
            c = np.tile(np.arange(values.shape[1]) + col * layout.block[1], values.shape[0])
            flat = values.reshape(-1)
            missing = np.isnan(flat) if layout.nodata is None else np.isnan(flat) | (flat == layout.nodata)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(x0 + (c + 0.5) * dx), pa.array(y0 + (r + 0.5) * dy), pa.array(flat, mask=missing)],
                names=["grid_row", "grid_col", "x", "y", "value"],
            )


def read_geotiff(spark: SparkSession, path: str, value: str = "value", band: int = 1, integer: bool = False) -> DataFrame:
    """A band as cells; what has no data is null, or ``MISSING_CODE`` if ``integer``."""
    spark.dataSource.register(GeoTiffSource)
    cells = spark.read.format("geotiff").option("band", band).load(path)
    held = F.coalesce(F.col("value").cast("int"), F.lit(MISSING_CODE)) if integer else F.col("value")
    return cells.select("grid_row", "grid_col", "x", "y", held.alias(value))


def crs_of(path: str) -> str | None:
    """The system of a GeoTIFF's coordinates (``EPSG:n``), if it names one."""
    epsg = read_layout(path).epsg
    return f"EPSG:{epsg}" if epsg else None


def write_geotiff(cells: DataFrame, value: str, path: str, box: dict, epsg: int | None = None, nodata: float = -9999.0, rows: int = 64, compression: str = "deflate") -> None:
    """A grid (``box`` as ``cells.bounds`` gives it) as a GeoTIFF of 32-bit values.

    Strips of ``rows`` rows are made by many tasks; the driver puts one after another into the file.
    """
    width, height = box["cols"], box["rows"]
    pack = {"deflate": zlib.compress, "lzw": pack_lzw, "none": bytes}[compression]

    def strip(key, table):
        first = key[0].as_py() * rows
        grid = np.full((min(rows, height - first), width), nodata, "<f4")
        held = table.column("v").fill_null(nodata).to_numpy()
        grid[table.column("grid_row").to_numpy() - first, table.column("grid_col").to_numpy()] = np.where(np.isnan(held), nodata, held)
        return pa.table({"strip": pa.array([first // rows], pa.int32()), "data": pa.array([pack(grid.tobytes())], pa.binary())})

    numbered = cells.select(F.floor(F.col("grid_row") / rows).cast("int").alias("strip"), "grid_row", "grid_col", F.col(value).cast("double").alias("v"))
    strips = numbered.groupBy("strip").applyInArrow(strip, "strip int, data binary").orderBy("strip")
    count = -(-height // rows)
    offsets, counts = [0] * count, [0] * count
    empty = lambda i: pack(np.full((min(rows, height - i * rows), width), nodata, "<f4").tobytes())
    with open(path, "wb") as f:
        f.write(b"II*\0\0\0\0\0")
        wanted = 0

        def put(i: int, data: bytes) -> None:
            offsets[i], counts[i] = f.tell(), len(data)
            f.write(data + b"\0" * (len(data) % 2))

        for r in strips.toLocalIterator():
            while wanted < r["strip"]:
                put(wanted, empty(wanted))
                wanted += 1
            put(r["strip"], bytes(r["data"]))
            wanted = r["strip"] + 1
        for i in range(wanted, count):
            put(i, empty(i))
        degrees = epsg in (4326, 4269)
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg] if epsg else []
        text = f"{nodata:g}".encode() + b"\0"
        size = box["size"]
        entries = [
            (256, 4, [width]), (257, 4, [height]), (258, 3, [32]), (259, 3, [{"deflate": 8, "lzw": 5, "none": 1}[compression]]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [rows]),
            (279, 4, counts), (339, 3, [3]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, box["left"], box["top"], 0.0]), *([(34735, 3, keys)] if keys else []), (42113, 2, text),
        ]
        packed = []
        for tag, kind, values in entries:
            raw = values if kind == 2 else struct.pack(f"<{len(values)}{TAG_TYPES[kind][1]}", *values)
            if len(raw) > 4:
                at = f.tell()
                f.write(raw + b"\0" * (len(raw) % 2))
                raw = struct.pack("<I", at)
            packed.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        at = f.tell()
        f.write(struct.pack("<H", len(packed)) + b"".join(packed) + b"\0\0\0\0")
        f.seek(4)
        f.write(struct.pack("<I", at))


def read_grid(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Cells of a GeoTIFF, an ASCII grid, a table of tiles or a plain table of cells, by its ending."""
    name = path.lower().rstrip("/")
    if name.endswith((".tif", ".tiff")):
        return read_geotiff(spark, path, value)
    if name.endswith((".asc", ".agr")):
        return read_ascii_grid(spark, path, value)
    return read_cells(spark, path) if name.endswith(".cells") else spark.read.parquet(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of NPZ files, a row a number: ``file``, ``name``, ``at`` (its place along each axis), ``value``."""

    def opened(batches):
        import io

        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with np.load(io.BytesIO(data), allow_pickle=False) as held:
                    for name in held.files:
                        array = np.asarray(held[name], float)
                        flat, shape = array.reshape(-1), array.shape
                        for begin in range(0, max(len(flat), 1), 100_000):
                            part = flat[begin : begin + 100_000]
                            at = np.stack(np.unravel_index(np.arange(begin, begin + len(part)), shape), 1) if shape and len(part) else np.zeros((len(part), 0), int)
                            places = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.reshape(-1).astype(np.int32)))
                            yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array([name] * len(part), pa.string()), places, pa.array(part)], names=["file", "name", "at", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(opened, "file string, name string, at array<int>, value double")


def write_arrays(cells: DataFrame, values: list[str], path: str, rows: int, cols: int) -> None:
    """Values of a grid as one compressed NPZ file of arrays (``rows``, ``cols``), NaN where there is none. For exports: cells pass the driver part by part."""
    out = {v: np.full((rows, cols), np.nan) for v in values}
    for r in cells.select("grid_row", "grid_col", *values).toLocalIterator():
        for v in values:
            if r[v] is not None:
                out[v][r["grid_row"], r["grid_col"]] = r[v]
    np.savez_compressed(path, **out)
