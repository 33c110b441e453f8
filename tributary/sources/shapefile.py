"""Shapefiles as a data source: tasks read ranges of records, tasks write files of their own.

``spark.read.format("shapefile").load(path)`` gives a row for each record: the columns of its
table, ``file``, ``shape`` (null, point, line, polygon, points), ``parts`` (rings or lines of
points), and its bounds.  Filters on the bounds are pushed down: shapes outside are not
decoded.  A deleted row of the table is left out.

``df.write.format("shapefile").mode("append").save(path)`` writes rows with ``shape`` and
``parts``; other columns go to the table.  Each task writes as many files as their size asks.
"""

from __future__ import annotations

import datetime
import operator
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tributary.sources.folders import Bytes, FolderWriter, found, opened

# Fixed values of the format.
KINDS = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "points"}
CODES = {name: code for code, name in KINDS.items()}
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
MAGIC, VERSION, HEAD = 9994, 1000, 100
TEXT_BYTES = 254

BOUNDS = ["xmin", "ymin", "xmax", "ymax"]
POINTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
SHAPE = [T.StructField("file", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("parts", POINTS), *(T.StructField(b, T.DoubleType()) for b in BOUNDS)]


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if not self.decimals and self.size <= 20 and self.kind == "N" else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw.strip(b" \0")
        if self.kind in "NF":
            if not text or text.startswith(b"*"):
                return None
            return int(text) if isinstance(self.type(), T.LongType) else float(text)
        if self.kind == "L":
            return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(text)
        if self.kind == "D":
            return datetime.datetime.strptime(text.decode("ascii"), "%Y%m%d").date() if len(text) == 8 and text.isdigit() and text != b"0" * 8 else None
        return raw.rstrip(b" \0").decode(encoding, "replace")


@dataclass
class Table:
    """What a table's head says."""

    rows: int
    begin: int
    row_size: int
    fields: list[Field]

    @classmethod
    def of(cls, read: Bytes) -> Table:
        head = read(0, 32)
        rows, begin, size = struct.unpack("<IHH", head[4:12])
        raw, fields = read(32, begin - 32), []
        for at in range(0, len(raw) - 31, 32):
            if raw[at] == 0x0D:
                break
            name = raw[at : at + 11].split(b"\0")[0].decode("utf-8", "replace").strip()
            fields.append(Field(name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        return cls(rows, begin, size, fields)

    def values(self, row: bytes, encoding: str) -> list | None:
        """None for a deleted row."""
        if row[:1] == b"*":
            return None
        out, at = [], 1
        for f in self.fields:
            out.append(f.value(row[at : at + f.size], encoding))
            at += f.size
        return out


def decoded(content: bytes, wanted) -> tuple | None:
    """(shape, parts, bounds) of a record, None where its bounds are not ``wanted``."""
    code = struct.unpack_from("<i", content)[0]
    base = code % 10  # shapes with heights or measures begin like those without
    if base == 0:
        return ("null", None, *[None] * 4) if wanted(*[None] * 4) else None
    if base == 1:
        x, y = struct.unpack_from("<2d", content, 4)
        return ("point", [[(x, y)]], x, y, x, y) if wanted(x, y, x, y) else None
    bounds = struct.unpack_from("<4d", content, 4)
    if not wanted(*bounds):
        return None
    if base == 8:
        n = struct.unpack_from("<i", content, 36)[0]
        points = np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2)
        return ("points", [[tuple(p)] for p in points.tolist()], *bounds)
    if base not in (3, 5):
        raise ValueError(f"shapes of type {code} are not known")
    parts, n = struct.unpack_from("<2i", content, 36)
    begins = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    points = list(map(tuple, np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).tolist()))
    return (KINDS[base], [points[a:b] for a, b in zip(begins, begins[1:])], *bounds)


def encoded(shape: str, parts) -> tuple[bytes, tuple | None]:
    """A record's content and its bounds."""
    points = [(float(p[0]), float(p[1])) for part in parts or () for p in part]
    if shape == "null" or not points:
        return struct.pack("<i", 0), None
    xs, ys = zip(*points)
    bounds = (min(xs), min(ys), max(xs), max(ys))
    flat = np.array(points, "<f8").tobytes()
    if shape == "point":
        return struct.pack("<i", 1) + flat[:16], bounds
    if shape == "points":
        return struct.pack("<i4di", 8, *bounds, len(points)) + flat, bounds
    begins = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4").tobytes()
    return struct.pack("<i4d2i", CODES[shape], *bounds, len(parts), len(points)) + begins + flat, bounds


def _head(words: int, code: int, bounds: tuple) -> bytes:
    return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, code, *bounds, 0, 0, 0, 0)


class Part(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        super().__init__((path, first, rows))
        self.path, self.first, self.rows = path, first, rows


COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, options: dict):
        self.path, self.schema = path, schema
        self.rows = int(options.get("rowsperpartition", 50_000))
        self.encoding = options.get("encoding")
        self.filters: list[tuple[str, Callable, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and f.attribute[0] in BOUNDS and isinstance(f.value, (int, float)):
                self.filters.append((f.attribute[0], COMPARED[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Ranges of records, from the sizes of the index files alone."""
        system, _ = opened(self.path)
        out = []
        for path in found(self.path, ".shp"):
            n = (system.get_file_info(path[:-4] + ".shx").size - HEAD) // 8
            out += [Part(path, at, min(self.rows, n - at)) for at in range(0, n, self.rows)]
        return out or [Part("", 0, 0)]

    def wanted(self, *bounds) -> bool:
        named = dict(zip(BOUNDS, bounds))
        return all(named[c] is not None and op(named[c], v) for c, op, v in self.filters)

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.rows:
            return
        system, _ = opened(self.path)
        stem = part.path[:-4]
        index = np.frombuffer(Bytes(system, stem + ".shx")(HEAD + 8 * part.first, 8 * part.rows), ">i4").reshape(-1, 2).astype(np.int64) * 2
        shapes, rows = Bytes(system, part.path), Bytes(system, stem + ".dbf")
        table, encoding = Table.of(rows), self.encoding or "utf-8"
        names = [f.name for f in table.fields]
        for at in range(0, part.rows, 1024):  # ranges of bytes that hold so many records
            some = index[at : at + 1024]
            begin, end = int(some[:, 0].min()), int((some[:, 0] + 8 + some[:, 1]).max())
            data = shapes(begin, end - begin)
            lines = rows(table.begin + (part.first + at) * table.row_size, len(some) * table.row_size)
            for i, (offset, size) in enumerate(some.tolist()):
                values = table.values(lines[i * table.row_size : (i + 1) * table.row_size], encoding)
                shape = None if values is None else decoded(data[offset - begin + 8 : offset - begin + 8 + size], self.wanted)
                if shape is not None:
                    named = {**dict(zip(names, values)), "file": part.path, **dict(zip(["shape", "parts", *BOUNDS], shape))}
                    yield tuple(named.get(f.name) for f in self.schema.fields)


def fields_of(schema: T.StructType) -> list[Field]:
    """Fields for the columns other than the shape's; names are cut to ten bytes and numbered
    where that makes them alike."""
    out: list[Field] = []
    taken = {f.name for f in SHAPE}
    for f in schema.fields:
        if f.name in taken:
            continue
        name = f.name.encode()[:10].decode("utf-8", "ignore")
        k = 1
        while name in [x.name for x in out]:
            name, k = f.name.encode()[: 9 - len(str(k))].decode("utf-8", "ignore") + f"_{k}", k + 1
        kind = f.dataType
        if isinstance(kind, T.BooleanType):
            out.append(Field(name, "L", 1, 0))
        elif isinstance(kind, T.DateType):
            out.append(Field(name, "D", 8, 0))
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(Field(name, "N", 11, 0))
        elif isinstance(kind, T.LongType):
            out.append(Field(name, "N", 20, 0))
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            out.append(Field(name, "N", 24, 15))
        elif isinstance(kind, T.StringType):
            out.append(Field(name, "C", TEXT_BYTES, 0))
        else:
            raise ValueError(f"column {f.name} of type {kind.simpleString()} has no place in a shapefile")
    return out


def _cell(f: Field, value) -> bytes:
    if value is None:
        return b" " * f.size if f.kind != "L" else b"?"
    if f.kind == "L":
        return b"T" if value else b"F"
    if f.kind == "D":
        return value.strftime("%Y%m%d").encode()
    if f.kind == "N":
        text = (repr(float(value)) if f.decimals else str(int(value))).encode()
    else:
        text = str(value).encode()
    if len(text) > f.size:
        raise ValueError(f"{f.name}: {len(text)} bytes are more than the {f.size} that a shapefile holds")
    return text.rjust(f.size) if f.kind == "N" else text.ljust(f.size)


class Writer(FolderWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, options: dict):
        super().__init__(path, overwrite)
        self.schema, self.most, self.name = schema, int(options.get("maxbytes", 64 << 20)), options.get("filecolumn")
        if not {"shape", "parts"} <= set(schema.fieldNames()):
            raise ValueError("rows of shapefiles have columns shape and parts")

    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        """Rows are encoded as they come; a file ends where its shapes and its table together
        reach ``maxbytes``."""
        fields = fields_of(self.schema) or [Field("id", "N", 11, 0)]
        names = [f.name for f in self.schema.fields if f.name not in {s.name for s in SHAPE}]
        open_, number = None, 0
        for row in rows:
            content, bounds = encoded(row["shape"] or "null", row["parts"])
            if open_ and (self.name or open_.size() + len(content) > self.most or row["shape"] not in (open_.shape, "null", None)):
                yield from open_.files(self._stem(open_, task, number), fields)
                open_, number = None, number + 1
            open_ = open_ or Held(row["shape"], str(row[self.name]) if self.name else None)
            open_.add(content, bounds, b" " + b"".join(_cell(f, row[n] if names else open_.rows) for f, n in zip(fields, names or ["id"])))
        if open_:
            yield from open_.files(self._stem(open_, task, number), fields)

    def _stem(self, held: Held, task: int, number: int) -> str:
        named = "".join(c if c.isalnum() or c in "_-" else "_" for c in held.name) if self.name else ""
        return named or f"part-{task:05d}-{number:04d}-{self.run[:8]}"


class Held:
    """A file's records as bytes, the first one's shape and name, and the bounds of all."""

    def __init__(self, shape: str | None, name: str | None):
        self.shape, self.name, self.rows, self.code, self.bounds = shape, name, 0, 0, None
        self.shapes, self.index, self.lines = bytearray(), bytearray(), bytearray()

    def size(self) -> int:
        return len(self.shapes) + len(self.index) + len(self.lines)

    def add(self, content: bytes, bounds: tuple | None, line: bytes) -> None:
        self.index += struct.pack(">2i", (HEAD + len(self.shapes)) // 2, len(content) // 2)
        self.rows += 1
        self.shapes += struct.pack(">2i", self.rows, len(content) // 2) + content
        self.lines += line
        if bounds:
            self.code = self.code or struct.unpack("<i", content[:4])[0]
            self.bounds = tuple(f(c) for f, c in zip((min, min, max, max), zip(self.bounds or bounds, bounds)))

    def files(self, stem: str, fields: list[Field]) -> Iterator[tuple[str, bytes]]:
        whole = self.bounds or (0.0,) * 4
        yield f"{stem}.shp", _head((HEAD + len(self.shapes)) // 2, self.code, whole) + self.shapes
        yield f"{stem}.shx", _head((HEAD + len(self.index)) // 2, self.code, whole) + self.index
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, self.rows, 33 + 32 * len(fields), 1 + sum(f.size for f in fields))
        described = b"".join(struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.size, f.decimals) for f in fields)
        yield f"{stem}.dbf", head + described + b"\r" + self.lines + b"\x1a"
        yield f"{stem}.prj", WGS84.encode()
        yield f"{stem}.cpg", b"UTF-8"


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        """Columns of all tables, by name."""
        system, _ = opened(self.options["path"])
        kinds: dict[str, T.DataType] = {}
        taken = {f.name for f in SHAPE}
        for path in found(self.options["path"], ".dbf"):
            for f in Table.of(Bytes(system, path)).fields:
                if f.name not in taken and kinds.setdefault(f.name, f.type()) != f.type():
                    raise ValueError(f"{f.name} differs in type between files; read them apart")
        return T.StructType([*(T.StructField(n, k) for n, k in kinds.items()), *SHAPE])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderWriter:
        return Writer(self.options["path"], schema, overwrite, self.options)


def read_shapes(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").options(**options).load(path)


def write_shapes(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """``fileColumn`` names a column whose value is each row's own file's name; it should be
    different in each row."""
    df.sparkSession.dataSource.register(ShapefileSource)
    df.write.format("shapefile").mode(mode).options(**options).save(path)
