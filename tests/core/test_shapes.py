"""Shapefiles and rasters: round trips, files laid out by hand, damaged bytes outside windows."""

import datetime
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import outlines
from tributary.sources import geotiff, shapefile
from tributary.sources.folders import Bytes, found, opened

SCHEMA = "id int, name string, area double, big long, fine boolean, day date, shape string, parts array<array<struct<x: double, y: double>>>"


def shapes():
    square = [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]]
    rows = [(i, f"é station {i}", i / 7, 10**15 + i, i % 2 == 0, datetime.date(2020, 1, 1 + i % 28), "polygon", [[(x + i, y) for x, y in ring] for ring in square]) for i in range(200)]
    return rows + [(900, None, None, None, None, None, "null", None)]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(shapes(), SCHEMA).repartition(3)
    shapefile.write_shapes(df, path, maxBytes=2000)
    assert len(found(path, ".shp")) > 6 and not [f for f in os.listdir(path) if "staging" in f]
    got = shapefile.read_shapes(spark, path, rowsPerPartition=7)
    rows = sorted(got.collect(), key=lambda r: r.id)
    assert [(r.id, r.name or None, r.area, r.big, r.fine, r.day, r.shape, r.parts and [[tuple(p) for p in part] for part in r.parts]) for r in rows] == shapes()
    assert (rows[5].xmin, rows[5].ymin, rows[5].xmax, rows[5].ymax) == (5.0, 0.0, 7.0, 2.0) and got.rdd.getNumPartitions() > 30
    near = got.where((F.col("xmin") >= 100) & (F.col("xmax") < 110.0) & (F.col("id") != 103))
    assert sorted(r.id for r in near.collect()) == [100, 101, 102, 104, 105, 106, 107]
    shapefile.write_shapes(df.where("id < 3"), path, "overwrite", fileColumn="id")
    assert sorted(os.path.basename(f) for f in found(path, ".shp")) == ["0.shp", "1.shp", "2.shp"]
    assert shapefile.read_shapes(spark, path).count() == 3


def test_files_end_by_their_tables_too(spark, tmp_path):
    """Points are small and their rows large: both count, so a task holds what a file may have."""
    path = str(tmp_path / "points")
    df = spark.range(400).coalesce(1).selectExpr("id", "concat('n', id) as name", "'point' as shape", "array(array(struct(double(id) as x, 1d as y))) as parts")
    shapefile.write_shapes(df, path, maxBytes=20_000)
    assert len(found(path, ".shp")) >= 5 and max(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < 21_000
    assert sorted((r.id, r.name, r.xmin) for r in shapefile.read_shapes(spark, path).collect()) == [(i, f"n{i}", float(i)) for i in range(400)]


def test_pushed_bounds_skip_shapes(tmp_path):
    reader = shapefile.Reader(str(tmp_path), shapefile.T.StructType(shapefile.SHAPE), {})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([GreaterThan(("xmax",), 5.0), EqualTo(("id",), 3)]))
    assert len(left) == 1 and reader.wanted(0, 0, 6, 1) and not reader.wanted(0, 0, 5, 1) and not reader.wanted(None, None, None, None)


def test_other_kinds_and_deleted_rows(spark, tmp_path):
    rows = [(1, "point", [[(1.5, 2.5)]]), (2, "line", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 7.0)]]), (3, "points", [[(0.0, 1.0)], [(2.0, 3.0)]])]
    df = spark.createDataFrame(rows, "a_long_name_1 int, shape string, parts array<array<struct<x: double, y: double>>>").coalesce(1)
    shapefile.write_shapes(df.withColumn("a_long_name_2", F.lit("z")), str(tmp_path / "k"))
    got = shapefile.read_shapes(spark, str(tmp_path / "k"))
    assert {"a_long_nam", "a_long_n_1"} <= set(got.columns)
    assert sorted((r.a_long_nam, r.shape, [[tuple(p) for p in part] for part in r.parts]) for r in got.collect()) == rows
    table = next(f for f in found(str(tmp_path / "k"), ".dbf"))
    data = bytearray(open(table, "rb").read())
    begin, size = struct.unpack("<HH", data[8:12])
    data[begin] = ord("*")
    open(table, "wb").write(data)
    assert got.count() == 2
    with pytest.raises(Exception, match="more than the"):
        shapefile.write_shapes(df.withColumn("t", F.lit("x" * 300)), str(tmp_path / "long"))
    assert not [f for f in os.listdir(tmp_path / "long")] if (tmp_path / "long").exists() else True


def test_head_laid_out_by_hand(tmp_path):
    """A point file written field by field from the format's description."""
    content = struct.pack("<i2d", 1, 77.5, 12.25)
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 64) + struct.pack("<2i8d", 1000, 1, 77.5, 12.25, 77.5, 12.25, 0, 0, 0, 0) + struct.pack(">2i", 1, 10) + content
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.shx").write_bytes(shp[:24] + struct.pack(">i", 54) + shp[28:100] + struct.pack(">2i", 50, 10))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 99, 1, 1, 1, 65, 9) + struct.pack("<11sc4xBB14x", b"NAME", b"C", 8, 0) + b"\r" + b" Khadka  \x1a")
    reader = shapefile.Reader(str(tmp_path), shapefile.T.StructType([shapefile.T.StructField("NAME", shapefile.T.StringType()), *shapefile.SHAPE]), {})
    (row,) = [r for p in reader.partitions() for r in reader.read(p)]
    assert row[0] == "Khadka" and row[2:] == ("point", [[(77.5, 12.25)]], 77.5, 12.25, 77.5, 12.25)
    assert shapefile.encoded("point", [[(77.5, 12.25)]])[0] == content and shapefile._head(64, 1, (77.5, 12.25, 77.5, 12.25)) == shp[:100]


def test_outlines_as_shapes(spark, tmp_path):
    cells = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(5) if (r, c) != (1, 2)] + [(2, 9, 9)], "name int, row int, col int")
    parts = outlines.as_parts(outlines.rings(cells, ["name"]), ["name"], 70.0, 20.0, 0.5)
    shapefile.write_shapes(parts.withColumn("shape", F.lit("polygon")), str(tmp_path / "o"))
    for r in shapefile.read_shapes(spark, str(tmp_path / "o")).collect():
        area = sum(sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:])) / 2 for p in r.parts)
        assert -area == pytest.approx({1: 19, 2: 1}[r.name] * 0.25)  # outer rings go clockwise


# --- rasters


def tiff(values, tile=None, strip=3, order="<", packing=1, predictor=1, nodata=None):
    """A file of the given layout; values of any type."""
    h, w = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    if tile:
        th, tw = tile
        padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw), values.dtype)
        padded[:h, :w] = values
        blocks = [padded[r : r + th, c : c + tw] for r in range(0, h, th) for c in range(0, w, tw)]
    else:
        blocks = [values[r : r + strip] for r in range(0, h, strip)]

    def packed(b):
        b = b.astype(b.dtype.newbyteorder(order))
        if predictor == 2:
            b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(b.dtype)
        data = b.tobytes()
        if predictor == 3:
            raw = b.astype(b.dtype.newbyteorder(">")).reshape(b.shape[0], b.shape[1], 1).view(np.uint8).transpose(0, 2, 1).reshape(b.shape[0], -1)
            data = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], axis=1).astype(np.uint8).tobytes()
        if packing == 5:  # codes of 9 bits with a clear code often enough
            bits = "".join(format(c, "09b") for i in range(0, len(data), 200) for c in [256, *data[i : i + 200]]) + format(257, "09b")
            return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return zlib.compress(data) if packing == 8 else data

    blocks = [packed(b) for b in blocks]
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [values.dtype.itemsize * 8]), 259: (3, [packing]), 277: (3, [1]), 317: (3, [predictor]), 339: (3, [kind]), 33550: (12, [0.5, 0.25, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])}
    tags |= {322: (3, [tile[1]]), 323: (3, [tile[0]])} if tile else {278: (3, [strip])}
    where, sizes = (324, 325) if tile else (273, 279)
    tags |= {where: (4, [0] * len(blocks)), sizes: (4, list(map(len, blocks)))}
    if nodata is not None:
        tags[42113] = (2, nodata)
    begin = 8 + 2 + 12 * len(tags) + 4
    code = {3: "H", 4: "I", 12: "d"}

    def raw(t):
        k, v = tags[t]
        return v.encode() + b"\0" if k == 2 else struct.pack(f"{order}{len(v)}{code[k]}", *v)

    size = begin + sum(len(raw(t)) for t in tags if len(raw(t)) > 4)
    tags[where] = (4, [size + sum(map(len, blocks[:i])) for i in range(len(blocks))])
    head, more = b"", b""
    for t in sorted(tags):
        data = raw(t)
        head += struct.pack(order + "HHI", t, tags[t][0], len(data) if tags[t][0] == 2 else len(tags[t][1]))
        head += data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", begin + len(more))
        more += data if len(data) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(tags)) + head + b"\0" * 4 + more + b"".join(blocks), tags[where][1], list(map(len, blocks))


@pytest.mark.parametrize("layout", [
    dict(), dict(order=">"), dict(tile=(4, 5)), dict(packing=8), dict(packing=8, predictor=2, tile=(4, 4), order=">"), dict(packing=5), dict(strip=100),
    dict(dtype="f4", packing=8, predictor=3), dict(dtype="f8", nodata="-9999"), dict(dtype="u1"), dict(dtype="i4", predictor=2, packing=8),
])
def test_layouts(tmp_path, layout):
    layout = dict(layout)
    rng = np.random.default_rng(1)
    values = (rng.random((11, 13)) * 200).astype(layout.pop("dtype", "i2"))
    if layout.get("nodata"):
        values[2, 3] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(values, **layout)[0])
    reader = geotiff.Reader(str(tmp_path / "a.tif"), {"cellspertask": "30"})
    got = {(r, c): (x, y, z) for p in reader.partitions() for b in reader.read(p) for _, r, c, x, y, z in zip(*(col.to_pylist() for col in b.columns))}
    want = {(r, c): (10 + (c + 0.5) * 0.5, 50 - (r + 0.5) * 0.25, float(values[r, c])) for r in range(11) for c in range(13) if values[r, c] != -9999}
    assert got == want


def test_lzw_of_growing_codes():
    """Codes that grow from 9 to 12 bits, from a plain packer."""
    data = bytes(np.random.default_rng(2).integers(0, 4, 9000).astype(np.uint8))
    table, width, bits, word = {bytes([i]): i for i in range(256)}, 9, "100000000", b""
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits += format(table[word], f"0{width}b")
        table[word + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes([b])
    bits += format(table[word], f"0{width}b") + format(257, f"0{width}b")
    assert size < 4095
    assert geotiff.unpacked_lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == data


def test_only_the_window_is_read(spark, tmp_path):
    values = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    data, offsets, sizes = tiff(values, tile=(16, 16), packing=8)
    data = bytearray(data)
    inside = {5, 6}  # rows 16 to 31, columns 16 to 47
    for i, (at, n) in enumerate(zip(offsets, sizes)):
        if i not in inside:
            data[at : at + n] = b"?" * n
    (tmp_path / "a.tif").write_bytes(data)
    window = (10 + 20 * 0.5, 50 - 30 * 0.25, 10 + 40 * 0.5, 50 - 20 * 0.25)
    got = {(r.row, r.col): r.z for r in geotiff.read_raster(spark, str(tmp_path), window).collect()}
    assert got == {(r, c): float(values[r, c]) for r in range(20, 30) for c in range(20, 40)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = geotiff.read_raster(spark, str(tmp_path)).where("row between 17 and 18 and col = 33 and z > 0")
    assert [(r.row, r.col) for r in pushed.collect()] == [(17, 33), (18, 33)]
    system, path = opened(str(tmp_path / "a.tif"))
    read = Bytes(system, path)
    raster = geotiff.Raster.of(read)
    assert raster.blocks(raster.window({"x": (window[0], window[2]), "y": (window[1], window[3])})) == [5, 6]
    assert raster.blocks(raster.window({"x": (900, 901)})) == []


def test_written_tiles(spark, tmp_path):
    cells = [(r, c, float(r * 100 + c)) for r in range(40) for c in range(50) if (r, c) != (3, 3)]
    df = spark.createDataFrame([*cells, (3, 3, None)], "row int, col int, z double").repartition(3)
    geotiff.write_raster(df, str(tmp_path / "t"), 70.0, 30.0, 0.01, side=16)
    assert len(found(str(tmp_path / "t"), ".tif")) == 12
    got = geotiff.read_raster(spark, str(tmp_path / "t"))
    place = lambda r: (round((30.0 - r.y) / 0.01 - 0.5), round((r.x - 70.0) / 0.01 - 0.5), r.z)
    assert sorted(map(place, got.collect())) == cells
    window = geotiff.read_raster(spark, str(tmp_path / "t"), (70.10, 29.75, 70.20, 29.90))
    assert sorted(map(place, window.collect())) == [x for x in cells if 10 <= x[0] < 25 and 10 <= x[1] < 20]
    assert all(not f.startswith("_staging") for f in os.listdir(tmp_path / "t"))
