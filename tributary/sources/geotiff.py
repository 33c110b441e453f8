"""GeoTIFF rasters as a data source that reads the blocks of a window only.

``spark.read.format("geotiff").option("window", "west,south,east,north").load(path)`` gives
(file, row, col, x, y, z), a row for each cell whose middle lies in the window; cells without
a value are left out.  Filters on ``row``, ``col``, ``x`` and ``y`` are pushed down as a window
is.  The driver reads the heads of files; a task reads the bytes of a few strips or tiles.

``df.write.format("geotiff")`` takes rows of tiles as ``tiles`` makes them; each is a file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tributary.sources.folders import Bytes, FolderWriter, found, opened

# Fixed values of the format: tags, sizes and codes of types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)

COLUMNS = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")])
ARROW = pa.schema([("file", pa.string()), ("row", pa.int32()), ("col", pa.int32()), *((c, pa.float64()) for c in "xyz")])


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


@dataclass
class Raster:
    """What a file's head says of its first image."""

    order: str
    tags: dict[int, tuple]

    @classmethod
    def of(cls, read: Bytes) -> Raster:
        begin = read(0, 8)
        order = {b"II": "<", b"MM": ">"}.get(begin[:2])
        if order is None or struct.unpack(order + "H", begin[2:4])[0] != 42:
            raise ValueError("no TIFF, or one of more than 4 GB")
        at = struct.unpack(order + "I", begin[4:8])[0]
        n = struct.unpack(order + "H", read(at, 2))[0]
        raw, tags = read(at + 2, 12 * n), {}
        for i in range(n):
            tag, kind, count, value = struct.unpack(order + "HHI4s", raw[12 * i : 12 * i + 12])
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            data = value[: size * count] if size * count <= 4 else read(struct.unpack(order + "I", value)[0], size * count)
            tags[tag] = (data,) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", data)
        return cls(order, tags)

    def tag(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def width(self) -> int:
        return self.tag(WIDTH)

    @property
    def height(self) -> int:
        return self.tag(HEIGHT)

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a strip or tile."""
        return (self.tag(TILE_HEIGHT), self.tag(TILE_WIDTH)) if TILES in self.tags else (min(self.tag(STRIP_ROWS, self.height), self.height), self.width)

    @property
    def places(self) -> list[tuple[int, int]]:
        return list(zip(self.tags.get(TILES, self.tags.get(STRIPS)), self.tags.get(TILE_SIZES, self.tags.get(STRIP_SIZES))))

    @property
    def origin(self) -> tuple[float, float, float, float]:
        """West and north of the grid, and a cell's width and height."""
        dx, dy = self.tags.get(SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y, _ = self.tags.get(TIE, (0.0,) * 6)[:6]
        return x - i * dx, y + j * dy, dx, dy

    def window(self, limits: dict[str, tuple[float, float]]) -> tuple[int, int, int, int]:
        """First and last row and column whose middles lie within limits of row, col, x, y."""
        west, north, dx, dy = self.origin
        low = lambda c: limits.get(c, (-np.inf, np.inf))[0]
        high = lambda c: limits.get(c, (-np.inf, np.inf))[1]
        cap = lambda v, most: int(min(max(v, -1), most + 1))
        slack = 1e-9
        row0 = max(0, cap(np.ceil(low("row")), self.height), cap(np.ceil((north - high("y")) / dy - 0.5 - slack), self.height))
        row1 = min(self.height - 1, cap(np.floor(high("row")), self.height), cap(np.floor((north - low("y")) / dy - 0.5 + slack), self.height))
        col0 = max(0, cap(np.ceil(low("col")), self.width), cap(np.ceil((low("x") - west) / dx - 0.5 - slack), self.width))
        col1 = min(self.width - 1, cap(np.floor(high("col")), self.width), cap(np.floor((high("x") - west) / dx - 0.5 + slack), self.width))
        return row0, row1, col0, col1

    def blocks(self, window: tuple[int, int, int, int]) -> list[int]:
        """The strips or tiles that a window touches."""
        (h, w), across = self.block, -(-self.width // self.block[1])
        row0, row1, col0, col1 = window
        if row0 > row1 or col0 > col1:
            return []
        return [r * across + c for r in range(row0 // h, row1 // h + 1) for c in range(col0 // w, col1 // w + 1)]

    def values(self, data: bytes, number: int) -> tuple[int, int, np.ndarray]:
        """First row and column of a block, and its values, NaN where there is none."""
        (h, w), across = self.block, -(-self.width // self.block[1])
        row, col = number // across * h, number % across * w
        rows = h if TILES in self.tags else min(h, self.height - row)
        packing, samples = self.tag(COMPRESSION, PLAIN), self.tag(SAMPLES, 1)
        if packing in DEFLATE:
            data = zlib.decompress(data)
        elif packing == LZW:
            data = unpacked_lzw(data)
        elif packing != PLAIN:
            raise ValueError(f"compression {packing} is not known")
        bits, kind = self.tag(BITS, 1), self.tag(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
            raise ValueError(f"values of {bits} bits of kind {kind} are not known")
        form = f"{self.order}{'uif'[kind - 1]}{bits // 8}"
        how = self.tag(PREDICTOR, 1)
        if how == 3:  # bytes of a row, highest of all values first, each less the one before
            raw = np.frombuffer(data, np.uint8)[: rows * w * samples * bits // 8].reshape(rows, -1)
            raw = np.add.accumulate(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, w * samples)
            grid = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{bits // 8}").reshape(rows, w, samples)
        else:
            grid = np.frombuffer(data, form)[: rows * w * samples].reshape(rows, w, samples)
            if how == 2:  # each value less the one before
                grid = grid.astype(form.replace(self.order, "="))
                grid = np.add.accumulate(grid, axis=1, dtype=grid.dtype)
        grid = grid[: self.height - row, : self.width - col, 0].astype(float)
        if NODATA in self.tags and (text := self.tag(NODATA).strip(b"\0 ")):
            grid = np.where(grid == float(text), np.nan, grid)
        return row, col, grid


class Blocks(InputPartition):
    def __init__(self, path: str, numbers: list[int]):
        super().__init__((path, numbers))
        self.path, self.numbers = path, numbers


class Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.limits = path, {}
        self.cells = int(options.get("cellspertask", 4 << 20))
        if options.get("window"):
            west, south, east, north = map(float, options["window"].split(","))
            self.limits = {"x": (west, east), "y": (south, north)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute[0] in ("row", "col", "x", "y") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, (int, float)):
                low, high = self.limits.get(f.attribute[0], (-np.inf, np.inf))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, float(f.value))
                self.limits[f.attribute[0]] = (low, high)
            yield f  # Spark looks at the cells of the window again

    def partitions(self) -> list[Blocks]:
        system, _ = opened(self.path)
        out = []
        for path in found(self.path, ".tif"):
            raster = Raster.of(Bytes(system, path))
            numbers = raster.blocks(raster.window(self.limits))
            n = max(1, self.cells // (raster.block[0] * raster.block[1]))
            out += [Blocks(path, numbers[at : at + n]) for at in range(0, len(numbers), n)]
        return out or [Blocks("", [])]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if not part.numbers:
            return
        system, _ = opened(self.path)
        read = Bytes(system, part.path)
        raster = Raster.of(read)
        row0, row1, col0, col1 = raster.window(self.limits)
        west, north, dx, dy = raster.origin
        places = raster.places
        for number in part.numbers:
            at, size = places[number]
            if not size:  # a block without data
                continue
            row, col, grid = raster.values(read(at, size), number)
            rows, cols = np.nonzero(~np.isnan(grid))
            inside = (rows + row >= row0) & (rows + row <= row1) & (cols + col >= col0) & (cols + col <= col1)
            rows, cols = rows[inside], cols[inside]
            z, r, c = grid[rows, cols], (rows + row).astype(np.int32), (cols + col).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(r), pa.string()), pa.array(r), pa.array(c), pa.array(west + (c + 0.5) * dx), pa.array(north - (r + 0.5) * dy), pa.array(z)], schema=ARROW)


TILE = "tile_row int, tile_col int, height int, width int, west double, north double, degrees double, cells binary"


def tiles(cells: DataFrame, west: float, north: float, degrees: float, side: int = 256) -> DataFrame:
    """Cells (row, col, z) as square tiles with their places; of repeated cells the lowest."""
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    names = [c.split(" ")[0] for c in TILE.split(", ")]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = int(pdf["tile_row"].iloc[0]), int(pdf["tile_col"].iloc[0])
        grid = np.full((side, side), np.inf)
        np.minimum.at(grid, (pdf["row"].to_numpy() - r * side, pdf["col"].to_numpy() - c * side), pdf["z"].to_numpy(float))
        grid[np.isinf(grid)] = np.nan
        return pd.DataFrame([[r, c, side, side, west + c * side * degrees, north - r * side * degrees, degrees, grid.astype("<f8").tobytes()]], columns=names)

    t = cells.where("z is not null").select("row", "col", "z", tile("row").alias("tile_row"), tile("col").alias("tile_col"))
    return t.groupBy("tile_row", "tile_col").applyInPandas(work, TILE)


def written(height: int, width: int, west: float, north: float, degrees: float, values: np.ndarray, strip: int = 16) -> bytes:
    """A file of doubles in deflated strips; NaN is the value of cells without one."""
    blocks = [zlib.compress(values[r : r + strip].astype("<f8").tobytes()) for r in range(0, height, strip)]
    pack = lambda kind, *v: struct.pack(f"<{len(v)}{kind}", *v)
    entries = [
        (WIDTH, 4, 1, pack("I", width)), (HEIGHT, 4, 1, pack("I", height)), (BITS, 3, 1, pack("H", 64)), (COMPRESSION, 3, 1, pack("H", DEFLATE[0])), (262, 3, 1, pack("H", 1)),
        (STRIPS, 4, len(blocks), b""), (SAMPLES, 3, 1, pack("H", 1)), (STRIP_ROWS, 4, 1, pack("I", strip)), (STRIP_SIZES, 4, len(blocks), pack("I", *map(len, blocks))), (FORMAT, 3, 1, pack("H", 3)),
        (SCALE, 12, 3, pack("d", degrees, degrees, 0)), (TIE, 12, 6, pack("d", 0, 0, 0, west, north, 0)), (KEYS, 3, 16, pack("H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)), (NODATA, 2, 4, b"nan\0"),
    ]
    at = 8 + 2 + 12 * len(entries) + 4
    longer = {tag: 4 * len(blocks) if tag == STRIPS else len(data) for tag, _, _, data in entries}
    begin = at + sum(n for n in longer.values() if n > 4)
    offsets = np.cumsum([begin, *map(len, blocks)])[:-1]
    head, more = b"", b""
    for tag, kind, count, data in entries:
        data = pack("I", *offsets.tolist()) if tag == STRIPS else data
        head += struct.pack("<HHI", tag, kind, count) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(more)))
        more += data if len(data) > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + head + b"\0" * 4 + more + b"".join(blocks)


class Writer(FolderWriter):
    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        for t in rows:
            values = np.frombuffer(bytes(t.cells), "<f8").reshape(t.height, t.width)
            yield f"tile_{t.tile_row}_{t.tile_col}.tif", written(t.height, t.width, t.west, t.north, t.degrees, values)


class GeotiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> T.StructType:
        return COLUMNS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderWriter:
        return Writer(self.options["path"], overwrite)


def read_raster(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None, **options) -> DataFrame:
    """(file, row, col, x, y, z) of a file or of all files of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeotiffSource)
    reader = spark.read.format("geotiff").options(**options)
    return (reader.option("window", ",".join(map(repr, map(float, window)))) if window else reader).load(path)


def write_raster(cells: DataFrame, path: str, west: float, north: float, degrees: float, side: int = 256, mode: str = "append") -> None:
    cells.sparkSession.dataSource.register(GeotiffSource)
    tiles(cells, west, north, degrees, side).write.format("geotiff").mode(mode).save(path)
