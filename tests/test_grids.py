import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import registry
from gridweave.functions import kernels, sphere, systems
from gridweave.functions.projections import forward, inverse, parse
from gridweave.model import BadArgument, EllipsoidNotSupported, Grid, GridIOError, ProjectionError, Resampler, cell_type
from gridweave.operators import geometry as geo
from gridweave.operators import reproject as rp
from gridweave.operators import tiles as tl
from gridweave.operators import tilewise as tw
from gridweave.plans import compare
from gridweave.plans.job import parse_args, run
from gridweave.sources import bigtiff, codecs, store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("rows", "cols", "n"), [(180, 360, 1), (21600, 43200, 946), (104424, 161190, 16116)])
def test_block_counts(spark, rows, cols, n):
    df = geo.block_partition(spark, rows, cols, 1024, 1, 1000)
    assert df.count() == n
    assert df.where("worker = 0").count() == math.ceil(n / 1000)


@pytest.mark.parametrize(("size", "h", "w"), [(4, 2, 2), (5, 2, 2), (6, 2, 3), (2, 1, 2)])
def test_block_shapes(spark, size, h, w):
    r = geo.block_partition(spark, 100, 100, 10, size).where("part_id = 0").first()
    assert (r.lr_row + 1, r.lr_col + 1) == (10 * h, 10 * w)


def test_b8_last_cell_is_inside(spark):
    assert geo.block_partition(spark, 15, 15, 4).agg(F.max("lr_row")).first()[0] == 14


def test_cell_corner(spark):
    g = Grid("+proj=aea", -2493045.0, 3310005.0, 30.0, 10, 10)
    x, y = geo.to_projected(g)
    assert tuple(spark.sql("SELECT 33 AS col, 150 AS row").selectExpr(x, y).first()) == (-2492055.0, 3305505.0)


def test_kernels(spark):
    one = lambda k, x: spark.range(1).selectExpr(f"{k(f'({x}e0)')} AS v").first().v
    assert one(kernels.bilinear, 0.5) == 0.5
    assert [round(one(kernels.bicubic, x), 6) for x in (0.0, 0.5, 1.0, 1.5, 2.0)] == [1, 0.5625, 0, -0.0625, 0]
    assert [round(one(kernels.lanczos, x), 4) for x in (0.0, 1.5, 3.1)] == [1, -0.1351, 0]


@pytest.mark.parametrize("proj", [*registry.PROJECTIONS, *registry.PARAMETER])
def test_projection_round_trips(spark, proj):
    there = registry.queries()[f"proj_{proj}_roundtrip"](spark, SF).agg(F.count_if(F.col("inside")), F.count_if("same"))  # no filter: it would be pushed into the formulas
    inside, same = there.first()
    assert inside == same > (0 if proj == "gnom" else 140)


def test_projection_origin_and_parameters(spark):
    x, y = forward("+proj=sinu +lon_0=10 +x_0=500", "radians(10e0)", "0e0")
    assert tuple(spark.range(1).selectExpr(x, y).first()) == (500.0, 0.0)
    with pytest.raises(EllipsoidNotSupported):
        parse("+proj=merc +datum=NAD27")
    with pytest.raises(EllipsoidNotSupported):  # the expressions are of the sphere
        forward("+proj=merc +ellps=WGS84", "0e0", "0e0")
    with pytest.raises(ProjectionError):
        parse("+proj=nothing")
    assert spark.range(1).selectExpr(inverse("moll", "0e0", "1e9")[1]).first()[0] is None


def test_b3_mean_wraps_in_strict_form_only(spark):
    df = spark.createDataFrame([(0, 200), (0, 100)], "cell int, value int")
    assert rp.wrapping_mean(df, ["cell"], cell_type("Byte")).first().value == 22
    assert df.groupBy("cell").agg(F.avg("value").alias("v")).first().v == 150


def test_compare(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, float("nan"))], "row int, col int, value double")
    b = spark.createDataFrame([(0, 0, 1.0005), (0, 1, 2.01), (0, 2, 5.0)], "row int, col int, value double")
    assert tuple(rp.compare(a, b).first()) == (3, 0, 1)


def test_b19_nan_takes_no_part_in_extremes(spark):
    g = Grid("+proj=cea", 0.0, 100.0, 10.0, 4, 4)
    p = geo.cells(spark, 4, 4).withColumn("value", F.when(F.col("col") == 1, float("nan")).otherwise(F.lit(3.0)))
    got = rp.reproject(p, g, Grid("+proj=cea", 1.0, 99.0, 10.0, 2, 2), Resampler.MAX)
    assert {r.value for r in got.collect()} == {3.0}


def test_types(spark):
    for bad in ("CInt16", "CFloat64", "x"):
        with pytest.raises(BadArgument):
            cell_type(bad)
    g = Grid("+proj=cea", 0.0, 1.0, 1.0, 1, 1, "Byte")
    with pytest.raises(BadArgument):
        rp.reproject(geo.cells(spark, 1, 1).withColumn("value", F.lit(1)), g, Grid("+proj=cea", 0.0, 1.0, 1.0, 1, 1, "Int16"))


def test_weighted_resampler_of_a_constant_is_that_constant(spark):
    g = Grid("+proj=cea", 0.0, 200.0, 10.0, 20, 20)
    p = geo.cells(spark, 20, 20).withColumn("value", F.lit(7.0))
    for r in ("bilinear", "bicubic", "lanczos", "mean"):
        got = rp.reproject(p, g, Grid("+proj=cea", 60.0, 140.0, 12.0, 3, 3), r)
        assert {round(x.value, 9) for x in got.collect()} == {7.0}


def test_weights_that_are_all_zero_give_the_fill(spark):
    """Cells at whole distances from the centre are zeros of the narrowed cubic kernel."""
    g = Grid("+proj=cea", 0.0, 200.0, 10.0, 20, 20)
    got = rp.reproject(geo.cells(spark, 20, 20).withColumn("value", F.lit(7.0)), g, Grid("+proj=cea", 50.0, 150.0, 10.0, 3, 3), "bicubic", fill=-1.0)
    assert {x.value for x in got.collect()} == {-1.0}


@pytest.mark.parametrize(("kind", "bands", "ts"), [("Byte", 1, 16), ("UInt16", 2, 16), ("Float64", 1, 64)])
def test_tiled_file(spark, tmp_path, kind, bands, ts):
    g = Grid("+proj=longlat", -180.0, 90.0, 10.0, 18, 36, kind, bands, 0.0, ts)
    p = geo.cells(spark, 18, 36).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands)))).withColumn("value", ((F.col("row") * 36 + F.col("col") + F.col("band")) % 251).cast("double"))
    bigtiff.register(spark)
    path = str(tmp_path / "a.tif")
    tl.to_tiles(p, g).write.format("gridtiff").options(**bigtiff.options(g)).mode("overwrite").save(path)
    assert bigtiff.read_header(path).grid == g
    back = spark.read.format("gridtiff").load(path)
    assert tl.to_pixels(back).exceptAll(p.select("band", "row", "col", "value")).count() == 0
    assert back.where("tile_row = 0 AND tile_col = 0").count() == bands


def lzw_codes(raw):
    """Codes of a block, written apart from the reader: high bits first, wider one code early, emptied when full."""
    table, out, width, code = {bytes((i,)): i for i in range(256)}, [(256, 9)], 9, b""
    for x in raw:
        if code + bytes((x,)) in table:
            code += bytes((x,))
            continue
        out.append((table[code], width))
        table[code + bytes((x,))] = len(table) + 2
        if len(table) + 2 == 4095:
            out.append((256, 12))
            table, width = {bytes((i,)): i for i in range(256)}, 9
        else:
            width = max(9, (len(table) + 2).bit_length())
        code = bytes((x,))
    out += [(table[code], width)] if code else []
    # the end mark follows one more entry of the reader's table
    out.append((257, max(9, (len(table) + 3).bit_length()) if code else width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packed(raw):
    """Runs of three and more, and what stands between them."""
    out, i = b"", 0
    while i < len(raw):
        n = 1
        while i + n < len(raw) and n < 128 and raw[i + n] == raw[i]:
            n += 1
        if n > 2:
            out += bytes((257 - n,)) + raw[i : i + 1]
        else:
            n = min(3, len(raw) - i)
            out += bytes((n - 1,)) + raw[i : i + n]
        i += n
    return out + bytes((128,))


def tiff(cells, tile=None, rows_per_strip=None, big=False, order="<", deflate=False, predictor=1, drop=(), extra=(), codec=1, apart=False, without=()):
    """A file made by hand: ``cells`` [row, col, band] in tiles or strips."""
    rows, cols, bands = cells.shape
    coded = {1: bytes, 5: lzw_codes, 32773: packed, 8: zlib.compress}
    codec = 8 if deflate else codec
    if apart:
        extra = [*extra, (284, 3, [2])]
    kind = cells.dtype.newbyteorder(order)
    high, wide = (tile, tile) if tile else (rows_per_strip, cols)
    blocks = []
    for band in range(bands) if apart else [slice(None)]:
        for r in range(0, rows, high):
            for c in range(0, cols, wide):
                part = cells[r : r + high, c : c + wide, band].reshape(min(high, rows - r), -1, 1 if apart else bands)
                a = np.zeros((high if tile else min(high, rows - r), wide, part.shape[2]), cells.dtype)
                a[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    a = np.diff(a, axis=1, prepend=np.zeros_like(a[:, :1]))
                raw = a.astype(kind).tobytes()
                blocks.append(b"" if len(blocks) in drop else coded[codec](raw))
    long = 16 if big else 4
    tags = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [cells.itemsize * 8] * bands), (259, 3, [codec]), (277, 3, [bands]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[cells.dtype.kind]] * bands), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, -180.0, 90.0, 0.0]), (42113, 2, b"7\0"), *extra]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, long, None), (325, long, [len(b) for b in blocks])] if tile else [(273, long, None), (278, 4, [rows_per_strip]), (279, long, [len(b) for b in blocks])]
    tags = [t for t in tags if t[0] not in without]
    code = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
    count, offset, room = ("Q", "Q", 8) if big else ("H", "I", 4)
    start = 16 if big else 8
    data = start + struct.calcsize(order + count) + len(tags) * (20 if big else 12) + room
    size = lambda kind, v: len(v) if kind == 2 else struct.calcsize(order + code[kind]) * (len(blocks) if v is None else len(v))
    at = data + sum(size(k, v) for _, k, v in tags if size(k, v) > room)
    offsets = []
    for b in blocks:
        offsets.append(at if b else 0)
        at += len(b)
    ifd, tail = struct.pack(order + count, len(tags)), b""
    for tag, k, v in sorted(tags):
        v = offsets if v is None else v
        raw = v if k == 2 else struct.pack(f"{order}{len(v)}{code[k]}", *v)
        value = raw.ljust(room, b"\0")
        if len(raw) > room:
            value, tail = struct.pack(order + offset, data + len(tail)), tail + raw
        ifd += struct.pack(order + "HH" + offset, tag, k, len(v)) + value
    head = struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start)
    return (b"II" if order == "<" else b"MM") + head + ifd + b"\0" * room + tail + b"".join(blocks)


@pytest.mark.parametrize(
    "form",
    [dict(tile=16), dict(tile=16, big=True, order=">"), dict(tile=16, deflate=True, predictor=2), dict(rows_per_strip=5), dict(rows_per_strip=7, deflate=True, order=">"), dict(rows_per_strip=40, big=True, predictor=2), dict(tile=16, drop=(1, 4), big=True),
     dict(tile=16, codec=5), dict(rows_per_strip=11, codec=5, predictor=2, order=">"), dict(tile=32, codec=5, big=True), dict(tile=16, codec=32773), dict(rows_per_strip=6, codec=32773, predictor=2), dict(tile=16, apart=True), dict(rows_per_strip=9, apart=True, codec=5, predictor=2)],
)
@pytest.mark.parametrize(("kind", "bands"), [("u1", 1), ("i2", 3), ("u4", 1)])
def test_files_of_others(spark, tmp_path, form, kind, bands):
    cells = np.random.default_rng(1).integers(0, 120, (40, 37, bands)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff(cells, **form))
    bigtiff.register(spark)
    h = bigtiff.read_header(str(tmp_path / "a.tif"))
    assert (h.grid.n_rows, h.grid.n_cols, h.grid.n_bands, h.grid.pixel_size, h.grid.ulx, h.grid.nodata) == (40, 37, bands, 10.0, -180.0, 7.0)
    rows = spark.read.format("gridtiff").option("tilesize", 9).load(str(tmp_path / "a.tif")).collect()
    got = np.full(cells.shape, np.nan)
    for t in rows:
        got[t.row0 : t.row0 + t.n_rows, t.col0 : t.col0 + t.n_cols, t.band - 1] = np.array(t.data).reshape(t.n_rows, t.n_cols)
    want = cells.astype(float)
    for k in form.get("drop", ()):
        want[k // 3 * 16 : k // 3 * 16 + 16, k % 3 * 16 : k % 3 * 16 + 16] = 7  # sparse: nodata
    assert (got == want).all()


def test_long_lzw_blocks(tmp_path):
    """All widths of codes, and tables that are emptied."""
    for raw in (np.random.default_rng(2).integers(0, 256, 40_000).astype("u1").tobytes(), b"ab" * 30_000, b"", b"x"):
        assert codecs.lzw(lzw_codes(raw)) == raw
        assert codecs.packbits(packed(raw)) == raw
    with pytest.raises(GridIOError):
        codecs.lzw(bytes((0x80, 0x7F, 0xFF, 0xFF)))


@pytest.mark.parametrize("form", [dict(tile=16), dict(rows_per_strip=7), dict(tile=16, deflate=True), dict(tile=16, codec=5)])
def test_a_file_that_is_cut_off_raises(tmp_path, form):
    cells = np.random.default_rng(1).integers(0, 120, (40, 37, 1)).astype("u1")
    whole = tiff(cells, **form)
    (tmp_path / "a.tif").write_bytes(whole[:-30])
    with pytest.raises(GridIOError), bigtiff.TileFile(str(tmp_path / "a.tif")) as f:
        f.window(0, 0, 40, 37)
    (tmp_path / "b.tif").write_bytes(whole[:60])
    with pytest.raises(GridIOError):
        bigtiff.read_header(str(tmp_path / "b.tif"))


def test_a_block_with_too_few_cells_raises(tmp_path):
    cells = np.zeros((16, 16, 1), "u1")
    raw = tiff(cells, tile=16)
    (tmp_path / "a.tif").write_bytes(raw.replace(struct.pack("<HHII", 325, 4, 1, 256), struct.pack("<HHII", 325, 4, 1, 200)))
    with pytest.raises(GridIOError, match="200 of 256"), bigtiff.TileFile(str(tmp_path / "a.tif")) as f:
        f.tile(0, 0)


def test_georeferencing_is_honoured_or_refused(tmp_path):
    cells = np.zeros((4, 4, 1), "u1")
    place = lambda **form: bigtiff.read_header(_file(tmp_path, tiff(cells, rows_per_strip=4, **form))).grid
    assert (place().ulx, place().uly, place().pixel_size) == (-180, 90, 10)
    point = place(extra=[(34735, 3, [1, 1, 0, 1, 1025, 0, 1, 2])])  # the tie is a cell's centre
    assert (point.ulx, point.uly) == (-185, 95)
    turn = [5.0, 0.0, 0.0, 7.0, 0.0, -5.0, 0.0, 8.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    moved = place(without=(33550, 33922), extra=[(34264, 12, turn)])
    assert (moved.ulx, moved.uly, moved.pixel_size) == (7, 8, 5)
    for bad in (
        dict(without=(33550, 33922)),  # no place at all
        dict(without=(33922,)),
        dict(without=(33550,), extra=[(33550, 12, [10.0, 5.0, 0.0])]),  # cells that are not square
        dict(without=(33550, 33922), extra=[(34264, 12, [5.0, 1.0, *turn[2:]])]),  # turned
    ):
        with pytest.raises(GridIOError):
            place(**bad)


def _file(folder, raw):
    (folder / "g.tif").write_bytes(raw)
    return str(folder / "g.tif")


def test_keys_of_a_file_name_its_system(tmp_path):
    cells = np.zeros((4, 4, 1), "u1")
    for keys, want in (([1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326], "EPSG:4326"), ([1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 6933], "EPSG:6933")):
        (tmp_path / "k.tif").write_bytes(tiff(cells, rows_per_strip=4, extra=[(34735, 3, keys)]))
        assert bigtiff.read_header(str(tmp_path / "k.tif")).grid.srs == want
    (tmp_path / "x.tif").write_bytes(b"no such thing at all")
    for name in ("x.tif", "missing.tif"):
        with pytest.raises(GridIOError):
            bigtiff.read_header(str(tmp_path / name))


# Numerical examples on the sphere of Snyder's manual: system, longitude and latitude in degrees, x and y.
EXAMPLES = [
    ("+proj=merc +R=1 +lon_0=-180", -75, 35, 1.8325957, 0.6528366),
    ("+proj=cea +R=1 +lat_ts=30 +lon_0=-75", 80, 35, 2.3428242, 0.6623090),
    ("+proj=mill +R=1", -75, 50, -1.3089969, 0.9536371),
    ("+proj=aea +R=1 +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", -75, 35, 0.2952720, 0.2416774),
    ("+proj=laea +R=3 +lat_0=40 +lon_0=-100", 100, -20, -4.2339303, 4.0257775),
    ("+proj=gnom +R=1 +lat_0=40 +lon_0=-100", -110, 30, -0.1542826, -0.1694739),
    ("+proj=sinu +R=1 +lon_0=-90", -75, -50, 0.1682814, -0.8726646),
    ("+proj=moll +R=1 +lon_0=-90", -75, -50, 0.1788845, -0.9208758),
    ("+proj=vandg +R=1 +lon_0=-85", -160, -50, -1.1954154, -0.9960733),
]


@pytest.mark.parametrize(("srs", "lon", "lat", "x", "y"), EXAMPLES)
def test_worked_examples(spark, srs, lon, lat, x, y):
    got = sphere.forward(srs, np.radians([lon]), np.radians([lat]))
    assert (got[0][0], got[1][0]) == pytest.approx((x, y), abs=2e-4)
    back = sphere.inverse(srs, *got)
    assert np.degrees([back[0][0], back[1][0]]) == pytest.approx((lon, lat), abs=1e-7)
    sql = forward(srs, "lam", "phi")
    row = spark.sql(f"SELECT radians({lon}e0) AS lam, radians({lat}e0) AS phi").selectExpr(*sql).first()
    assert tuple(row) == pytest.approx((got[0][0], got[1][0]), abs=1e-9)


# Numerical examples on the ellipsoid of the same manual (Clarke 1866, International), of the notes on EPSG 3035, and of EPSG 6933.
CLARKE = "+a=6378206.4 +es=0.00676866"
ELLIPSOID_EXAMPLES = [
    (f"+proj=merc +lon_0=-180 {CLARKE}", -75, 35, 11688673.7, 4139145.6),
    (f"+proj=cea +lat_ts=5 +lon_0=-75 {CLARKE}", -78, 5, -332699.8, 554248.5),
    (f"+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 {CLARKE}", -75, 35, 1885472.7, 1535925.0),
    (f"+proj=laea +lat_0=40 +lon_0=-100 {CLARKE}", -110, 30, -965932.1, -1056814.9),
    ("+proj=laea +lat_0=90 +lon_0=-100 +ellps=intl", 5, 80, 1077459.7, 288704.5),
    (f"+proj=sinu +lon_0=-90 {CLARKE}", -75, -50, 1075471.5, -5540628.0),
    ("EPSG:3035", 5, 50, 3962799.45, 2999718.85),
    ("EPSG:6933", 100, 45, 9648628.0, 5180102.3),
]


@pytest.mark.parametrize(("srs", "lon", "lat", "x", "y"), ELLIPSOID_EXAMPLES)
def test_worked_examples_on_the_ellipsoid(srs, lon, lat, x, y):
    got = sphere.forward(srs, np.radians([lon]), np.radians([lat]))
    assert (got[0][0], got[1][0]) == pytest.approx((x, y), abs=0.1)
    back = sphere.inverse(srs, *got)
    assert np.degrees([back[0][0], back[1][0]]) == pytest.approx((lon, lat), abs=1e-10)


@pytest.mark.parametrize("proj", ["merc +lat_ts=20", "cea +lat_ts=30", "sinu", "aea +lat_1=20 +lat_2=60", "aea +lat_1=-20 +lat_2=-20", "laea +lat_0=-35", "laea +lat_0=90", "laea +lat_0=-90"])
def test_ellipsoids_there_and_back(proj):
    lam, phi = (x.ravel() for x in np.meshgrid(np.radians(np.arange(-170, 171, 10.0)), np.radians(np.arange(-89.5, 90, 2.5))))
    x, y = sphere.forward(f"+proj={proj} +ellps=WGS84", lam, phi)
    back = sphere.inverse(f"+proj={proj} +ellps=WGS84", x, y)
    far = np.abs(phi) > 1.5 if proj.startswith("merc") else (np.abs(back[1] - phi) > 1) | np.isnan(x)
    assert far.mean() < 0.1
    assert np.abs(back[1] - phi)[~far].max() < 1e-10
    assert np.abs(np.angle(np.exp(1j * (back[0] - lam))))[~far].max() < 1e-9
    # a flattening of next to nothing is a sphere
    near = sphere.forward(f"+proj={proj} +a=6370997 +es=1e-14", lam, phi)
    ball = sphere.forward(f"+proj={proj} +R=6370997", lam, phi)
    assert np.nanmax(np.abs(near[0] - ball[0])) < 1e-2 and np.nanmax(np.abs(near[1] - ball[1])) < 1e-2
    assert np.isnan(sphere.inverse("+proj=sinu +ellps=WGS84", np.array([0.0]), np.array([2e7]))[1][0])


GEOGCS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
# Systems in three notations: proj string, projection and parameters of the text, and keys of a file.
NOTATIONS = [
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", "Albers_Conic_Equal_Area", {"standard_parallel_1": 29.5, "standard_parallel_2": 45.5, "latitude_of_center": 23, "longitude_of_center": -96}, 11, {3078: 29.5, 3079: 45.5, 3081: 23.0, 3080: -96.0}),
    ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000", "Lambert_Azimuthal_Equal_Area", {"latitude_of_center": 52, "longitude_of_center": 10, "false_easting": 4321000, "false_northing": 3210000}, 10, {3088: 10.0, 3089: 52.0, 3082: 4321000.0, 3083: 3210000.0}),
    ("+proj=cea +lat_ts=30", "Cylindrical_Equal_Area", {"standard_parallel_1": 30, "central_meridian": 0}, 28, {3078: 30.0, 3080: 0.0}),
    ("+proj=sinu +lon_0=15", "Sinusoidal", {"longitude_of_center": 15, "false_easting": 0}, 24, {3088: 15.0}),
    ("+proj=merc +lon_0=5", "Mercator_1SP", {"central_meridian": 5, "scale_factor": 1, "latitude_of_origin": 0}, 7, {3080: 5.0, 3092: 1.0}),
    ("+proj=moll +lon_0=0", "Mollweide", {"central_meridian": 0}, None, {}),
]


@pytest.mark.parametrize(("srs", "name", "parameters", "code", "keys"), NOTATIONS)
def test_notations_of_a_system_agree(spark, srs, name, parameters, code, keys):
    """Text, keys and proj string: the same grid, and the same points."""
    want = parse(f"{srs} +a=6378137 +rf=298.257223563")
    text = f'PROJCS["x",{GEOGCS},PROJECTION["{name}"],' + "".join(f'PARAMETER["{k}",{v}],' for k, v in parameters.items()) + 'UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST]]'
    assert parse(text) == want
    source = Grid("+proj=longlat +ellps=WGS84", -30.0, 60.0, 1.0, 40, 50)
    size = lambda s: geo.output_grid(spark, source, s, 16)
    one, two = size(f"{srs} +ellps=WGS84"), size(text)
    assert (one.ulx, one.uly, one.pixel_size, one.n_rows, one.n_cols) == pytest.approx((two.ulx, two.uly, two.pixel_size, two.n_rows, two.n_cols))
    if code:
        fixed = [(1024, 0, 1, 1), (2048, 0, 1, 32767), (2057, 34736, 1, 0), (2059, 34736, 1, 1), (3072, 0, 1, 32767), (3074, 0, 1, 32767), (3075, 0, 1, code), (3076, 0, 1, 9001)]
        numbers = [6378137.0, 298.257223563]
        for k, v in keys.items():
            fixed.append((k, 34736, 1, len(numbers)))
            numbers.append(v)
        directory = [1, 1, 0, len(fixed), *(x for e in sorted(fixed) for x in e)]
        assert parse(systems.from_keys(tuple(directory), tuple(numbers))) == want
    directory, numbers, cited = systems.to_keys(f"{srs} +ellps=WGS84")  # what is written is read
    assert parse(cited.split(b"|")[0].decode()) == want
    bare = systems.from_keys(directory, numbers, "" if code else cited.decode())
    assert parse(bare) == pytest.approx(want) if not code else _close(parse(bare), want)


def _close(a, b):
    return a.proj == b.proj and all(getattr(a, k) == pytest.approx(getattr(b, k), abs=1e-12) for k in ("radius", "lon_0", "lat_0", "lat_ts", "x_0", "y_0", "es")) and (a.proj != "aea" or (a.lat_1, a.lat_2) == (b.lat_1, b.lat_2))


def test_text_that_is_not_read_raises():
    good = f'PROJCS["x",{GEOGCS},PROJECTION["Sinusoidal"],UNIT["metre",1]]'
    assert parse(good).proj == "sinu" and parse(GEOGCS).proj == "longlat"
    assert parse(f'PROJCS["w",{GEOGCS},PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["Auxiliary_Sphere_Type",0],UNIT["Meter",1]]').es == 0
    for bad in (
        good[:-1], good + "]", good.replace('"metre",1', '"foot",0.3048'), good.replace("Sinusoidal", "Robinson"), good.replace("UNIT[", "EXTENSION["), good.replace('"Greenwich",0', '"Paris",2.33'),
        good.replace(",AUTHORITY[\"EPSG\",\"6326\"]", ",TOWGS84[1,2,3]"), good.replace("PROJCS", "COMPD_CS"), good.replace('PROJECTION["Sinusoidal"]', 'PROJECTION["Sinusoidal"],PARAMETER["azimuth",3]'), good.replace("degree", "grad").replace("0.0174532925199433", "0.0157"), "PROJCS[]", '"x"[',
    ):
        with pytest.raises(ProjectionError):
            parse(bad)
    for keys in ([(1024, 0, 1, 3)], [(1024, 0, 1, 1), (3072, 0, 1, 32767), (3075, 0, 1, 1)], [(1024, 0, 1, 2), (2048, 0, 1, 32767)], [(1024, 0, 1, 1), (2056, 0, 1, 7030), (3072, 0, 1, 32767), (3075, 0, 1, 24), (3076, 0, 1, 9003)]):
        with pytest.raises(ProjectionError):
            systems.from_keys((1, 1, 0, len(keys), *(x for k in keys for x in k)))


def test_longitudes_beyond_the_seam():
    x, y = sphere.forward("+proj=sinu +R=1 +lon_0=10", np.radians([-175.0]), np.array([0.0]))
    assert x[0] == pytest.approx(math.radians(175))
    assert np.degrees(sphere.inverse("+proj=sinu +R=1 +lon_0=10", x, y)[0][0]) == pytest.approx(-175)


@pytest.mark.parametrize("bad", ["+proj=aea", "+proj=merc +units=us-ft", "+proj=sinu +zone=3", "+proj=laea +pm=paris", "+proj=merc +datum=NAD27", "+proj=aea +lat_1=20", "+proj=merc +k=0.9", "+proj=merc +ellps=nothing", "+proj=laea +towgs84=1,0,0", "EPSG:2154"])
def test_parameters_that_are_not_read_raise(bad):
    with pytest.raises(ProjectionError):
        parse(bad)


def test_tiles_equal_cells(spark):
    """Tile by tile and cell by cell: two ways to the same result, whatever the tile sizes."""
    g = Grid("+proj=longlat", -180.0, 90.0, 10.0, 18, 36, "Byte", tile_size=7)
    out = Grid("+proj=moll", -18_000_000.0, 9_000_000.0, 777_777.7, 22, 45, "Byte", tile_size=6)
    p = geo.cells(spark, 18, 36).withColumn("value", ((F.col("row") * 36 + F.col("col")) % 251).cast("double"))
    for r in Resampler:
        cells = {(x.row, x.col): x.value for x in rp.reproject(p, g, out, r, 9.0).collect()}
        tiles = {(x.row, x.col): x.value for x in tl.to_pixels(tw.reproject_tiles(tl.to_tiles(p, g), g, out, r, 9.0)).collect()}
        assert cells.keys() == tiles.keys() and len(cells) == 22 * 45
        assert all(abs(cells[k] - tiles[k]) <= (1 if r.support else 0) for k in cells), r  # sums in another order, truncated


def test_weighted_and_large_rectangles_in_two_ways():
    """Partial results of cut rectangles, by offsets and by cells, add up to those of the whole."""
    rng = np.random.default_rng(3)
    cells = rng.normal(size=(60, 70))
    cells[rng.random(cells.shape) < 0.1] = np.nan
    box = tuple(np.array(x) for x in zip(*[(c, r, c + rng.integers(0, 25), r + rng.integers(0, 25)) for c in range(0, 45, 5) for r in range(0, 35, 5)], strict=True))
    for r in Resampler:
        weigh = (lambda at, lo, hi, r=r: tw.KERNELS[r.value]((at + 0.5 - (lo + (hi - lo) / 2)) * r.support / 3) * r.support / 3) if r.support else None
        whole = tw.partial(cells, box, r, 3.0)
        if r is not Resampler.NEAREST:
            for way in (tw._by_offset, tw._by_cell):
                got = way(cells, box, box, r, weigh)
                assert all(np.allclose(g, w, equal_nan=True) for g, w in zip(got, whole, strict=True))
        total, weight = np.full(box[0].size, np.nan), np.zeros(box[0].size)
        for top in range(0, 60, 20):
            for left in range(0, 70, 35):
                tw.add(r, total, weight, *tw.partial(cells[top : top + 20, left : left + 35], (box[0] - left, box[1] - top, box[2] - left, box[3] - top), r, 3.0))
        assert np.allclose(total, whole[0], equal_nan=True) and np.allclose(weight, whole[1]), r


@pytest.mark.parametrize("fan", [1, 256])
def test_an_output_tile_of_many_source_tiles_is_merged_from_small_parts(spark, monkeypatch, fan):
    """No group has the source tiles; in two steps, none has more than a neighbourhood's partial results."""
    monkeypatch.setattr(tw, "FAN", fan)
    monkeypatch.setattr(tw, "HELD", 0)
    g = Grid("+proj=longlat", -180.0, 90.0, 1.0, 180, 360, "Float64", tile_size=6)
    out = Grid("+proj=cea", -20_000_000.0, 6_300_000.0, 2_500_000.0, 5, 16, "Float64", tile_size=16)
    p = geo.cells(spark, 180, 360).withColumn("value", ((F.col("row") * 7 + F.col("col") * 3) % 251).cast("double"))
    assert tw.needed_tiles(spark, g, out).count() > 1000
    for r in ("mean", "max", "bicubic", "nearest"):
        want = {(x.row, x.col): x.value for x in rp.reproject(p, g, out, r, 9.0).collect()}
        got = {(x.row, x.col): x.value for x in tl.to_pixels(tw.reproject_tiles(tl.to_tiles(p, g), g, out, r, 9.0)).collect()}
        assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), r


def test_the_job_reads_only_tiles_it_needs(spark, tmp_path):
    """An output across the seam needs both ends of a global grid, and nothing between them."""
    g = Grid("+proj=longlat", -180.0, 90.0, 1.0, 180, 360, "Byte", tile_size=10)
    bigtiff.register(spark)
    path = str(tmp_path / "in.tif")
    bigtiff.write_grid(tl.to_tiles(geo.cells(spark, 180, 360).withColumn("value", F.when(F.col("col") < 180, 1.0).otherwise(2.0)), g), g, path)
    out = Grid("+proj=cea +lon_0=180", -1_000_000.0, 500_000.0, 100_000.0, 10, 20, "Byte", tile_size=16)
    spent = tw.Seconds(spark)
    got = tl.to_pixels(tw.reproject_file(spark, path, g, out, spent=spent)).drop("band").collect()
    assert {1.0, 2.0} <= {r.value for r in got}
    needed = {(r.tile_row, r.tile_col) for r in tw.needed_tiles(spark, g, out, Resampler.NEAREST).collect()}
    assert len(needed) <= 8 and {c for _, c in needed} == {0, 35}
    assert sum(x.get("tiles", 0) for x in spent.value.values()) == len(needed)  # each once, none besides
    cells = {(r.row, r.col): r.value for r in got}
    tiles = tw.reproject_tiles(spark.read.format("gridtiff").load(path).drop("band"), g, out)
    assert cells == {(r.row, r.col): r.value for r in tl.to_pixels(tiles).collect()}


def test_job(spark, tmp_path):
    g = Grid("+proj=longlat", -180.0, 90.0, 10.0, 18, 36, "Byte", tile_size=16)
    bigtiff.register(spark)
    source, out, timing = (str(tmp_path / n) for n in ("in.tif", "out.tif", "t"))
    p = geo.cells(spark, 18, 36).withColumn("value", F.col("row").cast("double"))
    tl.to_tiles(p, g).write.format("gridtiff").options(**bigtiff.options(g)).mode("overwrite").save(source)
    grid = run(spark, parse_args(["-p", "+proj=sinu", "-r", "nearest", "-x", "16", "-c", timing, source, out]))
    assert bigtiff.read_header(out).grid.n_cols == grid.n_cols
    # rectangles that end below the source are filled, so its last row gives no value
    assert tl.to_pixels(spark.read.format("gridtiff").load(out)).agg(F.max("value")).first()[0] == 16
    assert spark.read.csv(f"{timing}/average", header=True).count() == 1
    each = spark.read.csv(f"{timing}/processes", header=True, inferSchema=True).collect()
    for r in each:  # measured, and together the whole
        assert r.total == pytest.approx(r.preloop + r.minbox + r.read + r.resample + r.write + r.misc, rel=1e-6)
    assert all(sum(r[c] for r in each) > 0 for c in rp.TIMES)


@pytest.mark.parametrize(("layout", "bands"), [("tile", 1), ("tile", 3), ("strip", 1), ("strip", 2)])
@pytest.mark.parametrize("srs", ["+proj=longlat", "EPSG:6933", "+proj=moll +lon_0=10 +ellps=WGS84"])
def test_layouts_bands_and_systems_of_a_written_file(spark, tmp_path, layout, bands, srs):
    """Read again by a plain reader of the test's own: order of tags, keys, blocks, nodata and cells."""
    g = Grid(srs, 10.0, 90.0, 2.0, 37, 53, "UInt16", bands, 9.0, 16)
    p = geo.cells(spark, 37, 53).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands)))).withColumn("value", F.when(F.col("col") != 20, (F.col("row") * 53 + F.col("col") + F.col("band")).cast("double")))
    tiles = tl.to_tiles(p.fillna(float("nan"), ["value"]), g).where("NOT (tile_row = 1 AND tile_col = 2)")
    bigtiff.register(spark)
    path = str(tmp_path / "a.tif")
    bigtiff.write_grid(tiles, g, path, layout)
    want = np.array([[[9 if c == 20 or (16 <= r < 32 and 32 <= c < 48) else r * 53 + c + b for b in range(1, bands + 1)] for c in range(53)] for r in range(37)])
    tags = plain_tags(path)
    assert list(tags) == sorted(tags) and tags[277] == (bands,) and tags[42113].startswith(b"9")
    assert tags[33550][:2] == (2.0, 2.0) and tags[33922][3:5] == (10.0, 90.0)
    keys = tags[34735]
    assert keys[:3] == (1, 1, 0) and len(keys) == 4 + 4 * keys[3] and list(keys[4::4]) == sorted(keys[4::4])
    assert parse(tags[34737].split(b"|")[0].decode()) == parse(srs)
    raw, got = open(path, "rb").read(), np.full(want.shape, 9)
    high, wide = (tags[278][0], 53) if layout == "strip" else (tags[323][0], tags[322][0])
    for i, (at, n) in enumerate(zip(tags[273 if layout == "strip" else 324], tags[279 if layout == "strip" else 325], strict=True)):
        r, c = (i * high, 0) if layout == "strip" else (i // -(-53 // wide) * high, i % -(-53 // wide) * wide)
        if n:
            a = np.frombuffer(raw[at : at + n], "<u2").reshape(-1, wide, bands)[: 37 - r, : 53 - c]
            got[r : r + high, c : c + wide] = a
    assert (got == want).all()
    back = tl.to_pixels(spark.read.format("gridtiff").option("tilesize", 16).load(path))
    assert {(x.band, x.row, x.col): x.value for x in back.collect()} == {(b + 1, r, c): want[r, c, b] for b in range(bands) for r in range(37) for c in range(53)}
    assert bigtiff.read_header(path, 16).grid == g


def plain_tags(path):
    """The tags of a little-endian BigTIFF file, one by one."""
    raw = open(path, "rb").read()
    at = struct.unpack("<Q", raw[8:16])[0]
    out = {}
    for k in range(struct.unpack("<Q", raw[at : at + 8])[0]):
        e = at + 8 + 20 * k
        tag, kind, n = struct.unpack("<HHQ", raw[e : e + 12])
        size = {2: 1, 3: 2, 4: 4, 12: 8, 16: 8}[kind] * n
        value = raw[e + 12 : e + 12 + size] if size <= 8 else raw[(o := struct.unpack("<Q", raw[e + 12 : e + 20])[0]) : o + size]
        out[tag] = value if kind == 2 else struct.unpack(f"<{n}{ {3: 'H', 4: 'I', 12: 'd', 16: 'Q'}[kind] }", value)
    return out


def test_parts_of_a_block_in_several_tasks_are_refused(spark, tmp_path):
    g = Grid("+proj=longlat", 0.0, 0.0, 1.0, 32, 32, "Byte", 2, tile_size=16)
    p = geo.cells(spark, 32, 32).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.lit(1.0))
    bigtiff.register(spark)
    apart = tl.to_tiles(p, g).repartitionByRange(2, "band")
    with pytest.raises(Exception, match="dealt to several tasks"):
        apart.write.format("gridtiff").options(**bigtiff.options(g)).mode("overwrite").save(str(tmp_path / "a.tif"))
    assert list(tmp_path.iterdir()) == []


def test_colours_stay(spark, tmp_path):
    colors = tuple((k * 257, 65535 - k * 257, k) for k in range(256))
    g = Grid("+proj=longlat", -180.0, 90.0, 10.0, 18, 36, "Byte", tile_size=16, colors=colors)
    source, out = str(tmp_path / "in.tif"), str(tmp_path / "out.tif")
    bigtiff.register(spark)
    bigtiff.write_grid(tl.to_tiles(geo.cells(spark, 18, 36).withColumn("value", F.lit(3.0)), g), g, source)
    assert plain_tags(source)[320] == tuple(c[k] for k in range(3) for c in colors) and plain_tags(source)[262] == (3,)
    run(spark, parse_args(["-p", "+proj=sinu", "-r", "nearest", "-x", "16", "--layout", "strip", source, out]))
    assert bigtiff.read_header(out).grid.colors == colors
    with pytest.raises(BadArgument):
        Grid("", 0.0, 0.0, 1.0, 1, 1, "Float32", colors=colors)


def test_a_window_of_a_store_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    g = Grid("+proj=cea", 0.0, 0.0, 1.0, 512, 512, "Float64", tile_size=8)
    p = geo.cells(spark, 512, 512).withColumn("value", (F.col("row") * 512 + F.col("col")).cast("double"))
    path = str(tmp_path / "store")
    store.write_store(tl.to_tiles(p, g), path, group_bytes=8_000, partitions=4)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in tmp_path.glob("store/*.parquet")]
    assert len(groups) == 4
    window = (203, 100, 260, 141)
    tiles = store.read_window(spark, path, 8, *window)
    got = store.window_cells(tiles, *window)
    assert {(r.row, r.col): r.value for r in got.collect()} == {(r, c): r * 512 + c for r in range(203, 261) for c in range(100, 142)}
    tiles.collect()
    leaf = tiles._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = leaf.metrics().apply("numOutputRows").value()
    assert tiles.count() == 8 * 6 <= read < 64 * 64 / 4, read
    assert store.curve(5, 9) == spark.sql(f"SELECT {tw.spread('5', '9')} AS z").first().z
    with pytest.raises(Exception, match="beyond the curve"):
        store.write_store(tl.to_tiles(p.limit(1), g).withColumn("tile_row", F.lit(1 << 24)), path)


def test_files_are_compared_with_a_verdict(spark, tmp_path, capsys):
    bigtiff.register(spark)
    paths = {}
    for name, rows, bands, shift, layout in (("a", 300, 2, 0.0, "tile"), ("b", 300, 2, 0.0005, "strip"), ("c", 300, 2, 0.5, "tile"), ("d", 299, 2, 0.0, "tile"), ("e", 300, 1, 0.0, "tile")):
        g = Grid("+proj=cea", 0.0, 0.0, 1.0, rows, 20, "Float64", bands, tile_size=64 if name == "a" else 16)
        p = geo.cells(spark, rows, 20).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands)))).withColumn("value", F.col("row") + F.when((F.col("row") == 270) & (F.col("band") == bands), shift).otherwise(0.0))
        paths[name] = str(tmp_path / f"{name}.tif")
        bigtiff.write_grid(tl.to_tiles(p, g), g, paths[name], layout)
    verdict = lambda x, y: compare.compare_files(spark, paths[x], paths.get(y, "missing"))
    assert verdict("a", "a") == verdict("a", "b") == 0
    assert verdict("a", "c") == 1 and "20 cells differ" in capsys.readouterr().out
    assert verdict("a", "d") == 1 and "300 rows, the test grid 299" in capsys.readouterr().out
    assert verdict("a", "e") == 1 and verdict("a", "missing") == 1
    assert compare.main(["--delta", "0.6", paths["a"], paths["c"]]) == 0


def test_sizes_of_many_grids_are_those_of_each(spark):
    grids = spark.createDataFrame([(1, -80.0, 40.0, 1.5, 20, 30), (2, 10.0, 85.0, 0.5, 5, 4)], "id int, ulx double, uly double, pixel_size double, n_rows int, n_cols int")
    for mode in ("strict", "corrected"):
        for r in geo.output_sizes(grids, "+proj=longlat +ellps=WGS84", "EPSG:3035", mode=mode).collect():
            one = geo.output_size(spark, Grid("+proj=longlat +ellps=WGS84", r.ulx, r.uly, r.pixel_size, r.n_rows, r.n_cols), "EPSG:3035", mode=mode).first()
            assert (one.ulx, one.uly, one.pixel_size, one.n_rows, one.n_cols) == pytest.approx((r.out_ulx, r.out_uly, r.out_pixel_size, r.out_n_rows, r.out_n_cols))
    out = geo.output_sizes(grids.withColumn("uly", F.lit(-40.0)), "+proj=longlat", "+proj=gnom +lat_0=90").collect()
    assert all(r.out_ulx is None and r.out_n_rows is None for r in out)
    blocks = geo.block_partitions(grids.select("id", "n_rows", "n_cols"), 4, 6).where("id = 1").drop("id")
    assert blocks.exceptAll(geo.block_partition(spark, 20, 30, 4, 6).drop("worker")).count() == 0 and blocks.count() == 3 * 3


def test_rules_of_the_kernel(spark):
    """Outside blocks have no box (F6), rectangles that end below give the fill and those to the right are cut (F4), one cell at least (F5)."""
    g = Grid("+proj=cea", 0.0, 100.0, 10.0, 4, 4)
    far = Grid("+proj=cea", 1e6, 1e6, 10.0, 2, 2)
    assert geo.raster_minbox(geo.block_partition(spark, 2, 2, 2), far, g).count() == 0
    ok, c0, r0, c1, r1 = tw.sources(Grid("+proj=cea", 1.0, 99.0, 10.0, 5, 5), g, np.array([0, 0, 3, 4]), np.array([0, 3, 0, 0]))
    assert ok.tolist() == [True, True, False, False] and c1[1] == 3
    assert ((c1 >= c0) & (r1 >= r0))[ok].all()
    assert g == Grid("+proj=cea", 0.0, 100.0, 10.0, 4, 4) != far  # O1
    assert parse_args(["-f", "7.5", "a", "b"]).fill_value == 7.5 and parse_args(["a", "b"]).fill_value == 0.0  # O4


def test_command_line_defaults():
    job = parse_args(["a", "b"])
    assert (job.resampler, job.partition_size, job.tile_size, job.output_ratio) == (Resampler.BILINEAR, 1, 1024, 1.0)


@pytest.mark.parametrize("name", ["geotiff_roundtrip", "geotiff_roundtrip_all", "tile_roundtrip", "raster_compare_badpixels", "reproject_mean_sinu", "reproject_nearest_cea_all", "reproject_file_mean_sinu", "tile_store_window"])
def test_all_vectors_are_in_grids(spark, name, tmp_path):
    import duckdb

    rows = [(i, [float(i * 64 + k) / 7 for k in range(64)]) for i in range(32 + 5)]  # 5 rows of an incomplete grid
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]}) q").fetchall()
    got = sorted(map(tuple, got.collect()))
    assert len(got) == len(want) and got[0][0] == 0 or name.startswith("raster_compare")
    assert all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got, sorted(want), strict=True))
