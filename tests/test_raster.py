import math

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fieldmosaic.functions import geo, naming
from fieldmosaic.operators import raster, tiles


# A second opinion on the transverse Mercator: the meridian arc by numerical integration.
def meridian_arc(lat, a=geo.WGS84_A, f=geo.WGS84_F, steps=20_000):
    e2 = f * (2 - f)
    at = (np.arange(steps) + 0.5) * lat / steps
    return float(np.sum(a * (1 - e2) / (1 - e2 * np.sin(at) ** 2) ** 1.5) * lat / steps)


def degrees(spark, rows):
    df = spark.createDataFrame(rows, "lat double, lon double, code int")
    return df.withColumns({"lat": F.radians("lat"), "lon": F.radians("lon")})


def test_laea_known_points(spark):
    rows = [(50.0, 5.0, 0), (52.0, 10.0, 0)]
    got = geo.geographic_to_laea(degrees(spark, rows), "lat", "lon", "x", "y").select("x", "y").collect()
    assert tuple(got[0]) == pytest.approx((3962799.451, 2999718.853), abs=1e-3)
    assert tuple(got[1]) == pytest.approx((4321000, 3210000), abs=1e-6)


def test_laea_is_equal_area(spark):
    """A degree cell keeps its ellipsoidal area, wherever it lies."""
    rows = [(lat + i * 1e-3, lon + j * 1e-3, 0) for lat, lon in ((40, 0), (65, 28)) for i in (0, 1) for j in (0, 1)]
    xy = geo.geographic_to_laea(degrees(spark, rows), "lat", "lon", "x", "y").select("x", "y").collect()
    e2 = geo.GRS80_F * (2 - geo.GRS80_F)
    for k, (lat, _) in enumerate(((40, 0), (65, 28))):
        p = np.array(xy[4 * k : 4 * k + 4])
        area = abs(np.linalg.det(np.array([p[1] - p[0], p[2] - p[0]])))
        mid = math.radians(lat + 5e-4)
        w2 = 1 - e2 * math.sin(mid) ** 2
        step = math.radians(1e-3)
        exact = geo.GRS80_A**2 * (1 - e2) / w2**2 * math.cos(mid) * step * step
        assert area == pytest.approx(exact, rel=1e-4)


def test_utm_on_the_central_meridian_is_the_meridian_arc(spark):
    rows = [(float(lat), 3.0, 32631) for lat in (1, 30, 52, 80)] + [(-33.0, 21.0, 32734)]
    got = geo.geographic_to_utm(degrees(spark, rows), "lat", "lon", "code", "x", "y").select("x", "y").collect()
    for (lat, _, code), (x, y) in zip(rows, got):
        north = 10_000_000 if code > 32700 else 0
        assert x == pytest.approx(500000, abs=1e-6)
        assert y == pytest.approx(north + 0.9996 * meridian_arc(math.radians(lat)), abs=2e-3)


def test_utm_is_conformal(spark):
    """Small steps north and east turn into equally long, perpendicular steps."""
    d, lat, lon = 1e-5, 48.0, 6.2
    rows = [(lat, lon, 32631), (lat + d, lon, 32631), (lat, lon + d, 32631)]
    o, n, e = np.array(geo.geographic_to_utm(degrees(spark, rows), "lat", "lon", "code", "x", "y").select("x", "y").collect())
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    w2 = 1 - e2 * math.sin(math.radians(lat)) ** 2
    north = (n - o) / (geo.WGS84_A * (1 - e2) / w2**1.5 * math.radians(d))
    east = (e - o) / (geo.WGS84_A / w2**0.5 * math.cos(math.radians(lat)) * math.radians(d))
    assert np.linalg.norm(north) == pytest.approx(np.linalg.norm(east), rel=1e-5)
    assert float(north @ east) == pytest.approx(0, abs=1e-5)


def test_projections_invert(spark):
    rows = [(lat + 0.37, lon + 0.11, 32633) for lat in range(35, 71, 7) for lon in range(8, 23, 4)]
    start = degrees(spark, rows)
    there = geo.geographic_to_utm(geo.geographic_to_laea(start, "lat", "lon", "tx", "ty"), "lat", "lon", "code", "x", "y")
    back = geo.utm_to_geographic(geo.laea_to_geographic(there, "tx", "ty", "la", "lo"), "x", "y", "code", "lb", "mb")
    gap = back.agg(*(F.max(F.abs(F.col(a) - F.col(b))) for a, b in (("lat", "la"), ("lon", "lo"), ("lat", "lb"), ("lon", "mb")))).first()
    assert max(gap) < 1e-10  # under a millimetre


def test_systems_besides_utm_on_wgs84(spark):
    zones = ["unknown", None, "EPSG32631", "EPSG25831", "EPSG3035"]
    df = spark.createDataFrame([(z,) for z in zones], "zone string").withColumns({"x": F.lit(500000.0), "y": F.lit(5e6)})
    got = raster.reproject(df).collect()
    assert [r.tx is None for r in got] == [True, True, False, False, False]
    # The two ellipsoids differ by less than a millimetre; the target system stays as it is.
    assert abs(got[2].tx - got[3].tx) < 1e-3 and abs(got[2].ty - got[3].ty) < 1e-3
    assert (got[4].tx, got[4].ty) == (500000.0, 5e6)


@pytest.mark.parametrize("zone", ["EPSG3857", "EPSG32661", "EPSG25839"])
def test_a_system_without_a_way_stops_the_job(spark, zone):
    df = spark.createDataFrame([(zone, 1, 1, 1.0)], "zone string, px long, py long, value double")
    with pytest.raises(Exception, match="no way from this coordinate system"):
        raster.warp_zones(df, 10.0, 10.0).collect()
    points = df.select("zone", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(Exception, match="no way from this coordinate system"):
        raster.reproject(points).collect()


def test_points_in_degrees(spark):
    """The published worked example of the target system."""
    df = spark.createDataFrame([("EPSG4326", 5.0, 50.0), ("EPSG4326", 10.0, 52.0)], "zone string, x double, y double")
    got = [(r.tx, r.ty) for r in raster.reproject(df).orderBy("x").collect()]
    assert got[0] == pytest.approx((3962799.451, 2999718.853), abs=1e-3)
    assert got[1] == pytest.approx((4321000, 3210000), abs=1e-6)


def test_warp_of_degrees_leaves_no_hole(spark):
    """Every target cell whose centre lies in the source holds the source cell there."""
    r, t = 0.02, 700.0
    cells = [("EPSG4326", px, py, float(px * 1000 + py)) for px in range(250, 270) for py in range(2500, 2520)]
    df = spark.createDataFrame(cells, "zone string, px long, py long, value double")
    got = {(x.cx, x.cy): x.value for x in raster.warp_zones(df, r, t).collect()}
    grid = spark.range(5600, 5740).selectExpr("id AS cx").crossJoin(spark.range(4270, 4370).selectExpr("id AS cy"))
    centres = grid.withColumns({"tx": (F.col("cx") + 0.5) * t, "ty": (F.col("cy") + 0.5) * t})
    expected = {}
    for x in geo.laea_to_geographic(centres, "tx", "ty", "lat", "lon").collect():
        px, py = math.floor(math.degrees(x.lon) / r), math.floor(math.degrees(x.lat) / r)
        if 250 <= px < 270 and 2500 <= py < 2520:
            expected[x.cx, x.cy] = float(px * 1000 + py)
    assert len(expected) > 2000 and got == expected


def test_ties_go_by_the_whole_cell_number(spark):
    rows = [("EPSG32631", 4096, 1, 6.0, 60.0, 50.0), ("EPSG32631", 4095, 1, 5.0, 40.0, 50.0)]
    schema = "zone string, px long, py long, value double, tx double, ty double"
    got = raster.regrid_nearest(spark.createDataFrame(rows, schema), 100.0).collect()
    assert [r.value for r in got] == [5.0]


@pytest.mark.parametrize("levels", [(0,), (4, -1), ()])
def test_levels_below_one_are_an_error(spark, levels):
    with pytest.raises(ValueError, match="levels from 1 on"):
        raster.overview_pyramid(spark.createDataFrame([(0, 0, 1.0)], "px long, py long, value double"), levels)


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_means_of_whole_values_are_exact(spark, partitions):
    cells = [(i, 0, v) for i, v in enumerate((177829, 1, 2**40, 7))]
    df = spark.createDataFrame(cells, "px long, py long, value long").repartition(partitions)
    (row,) = raster.overview_pyramid(df, (4,), "average").collect()
    assert row.value == (177829 + 1 + 2**40 + 7) / 4


def test_a_filter_on_projected_coordinates_stays_above_the_formula(spark):
    df = spark.range(10).select(F.lit("EPSG32631").alias("zone"), F.lit(500000.0).alias("x"), (F.col("id") * 1e5 + 5e6).alias("y"))
    plan = plan_of(raster.reproject(df).filter("tx > 0 and ty > 0"))
    assert len(plan) < 20_000 and "Generate inline" in plan


def test_last_source_with_data_wins(spark):
    rows = [("z", 0, 0, 1.0, 1), ("z", 0, 0, 2.0, 2), ("z", 0, 0, None, 3), ("z", 0, 0, float("nan"), 4),
            ("z", 0, 0, -9.0, 5), ("y", 0, 0, 7.0, 1), ("z", 1, 0, None, 1)]
    df = spark.createDataFrame(rows, "zone string, px int, py int, value double, seq int")
    got = {(r.zone, r.px): r.value for r in raster.mosaic_pixels(df, nodata=-9.0).collect()}
    assert got == {("z", 0): 2.0, ("y", 0): 7.0}


def test_a_hot_cell_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 200_000, 1, 4).select(
        F.lit("z").alias("zone"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("px"),
        F.lit(0).alias("py"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"),
    )
    out = raster.mosaic_pixels(df)
    plan = plan_of(out)
    assert "partial_max_by" in plan and "SortAggregate" not in plan
    assert out.filter("px = 0").first().value == 199_998.0


def brute_warp(pixels, r, t, spark):
    """Every target cell around, its centre projected back, one by one."""
    cells = {(z, x, y): v for z, x, y, v in pixels}
    near = raster.reproject(
        spark.createDataFrame([(z, (x + 0.5) * r, (y + 0.5) * r) for z, x, y in cells], "zone string, x double, y double")
    ).collect()
    out = {}
    for zone in {z for z, _, _ in cells}:
        xs = [p.tx for p in near if p.zone == zone]
        ys = [p.ty for p in near if p.zone == zone]
        grid = [
            (zone, i, j, (i + 0.5) * t, (j + 0.5) * t, int(zone[4:]))
            for i in range(math.floor((min(xs) - 2 * r) / t), math.ceil((max(xs) + 2 * r) / t))
            for j in range(math.floor((min(ys) - 2 * r) / t), math.ceil((max(ys) + 2 * r) / t))
        ]
        df = spark.createDataFrame(grid, "zone string, i long, j long, tx double, ty double, code int")
        back = geo.geographic_to_utm(geo.laea_to_geographic(df, "tx", "ty", "lat", "lon"), "lat", "lon", "code", "x", "y")
        for p in back.collect():
            key = (zone, math.floor(p.x / r), math.floor(p.y / r))
            if key in cells:
                out[(zone, p.i, p.j)] = cells[key]
    return out


@pytest.mark.parametrize("r,t", [(10_000, 10_000), (10_000, 3_000), (5_000, 12_000)])
def test_warp_equals_brute_force_and_leaves_no_holes(spark, r, t):
    pixels = [
        (zone, x, y, float(1000 * x + y))
        for zone, x0, y0 in (("EPSG32631", 400_000, 5_500_000), ("EPSG32635", 250_000, 4_200_000), ("EPSG32733", 500_000, 6_000_000))
        for x in range(x0 // r, x0 // r + 9)
        for y in range(y0 // r, y0 // r + 9)
    ]
    df = spark.createDataFrame(pixels, "zone string, px long, py long, value double")
    out = raster.warp_zones(df, r, t)
    got = {(p.zone, p.cx, p.cy): p.value for p in out.collect()}
    assert got == brute_warp(pixels, r, t, spark)
    assert out.count() == len(got)
    assert "Exchange" not in plan_of(out)


def test_regrid_takes_the_nearest_and_breaks_ties_alike(spark):
    rows = [("EPSG32631", 1, 1, 5.0, 40.0, 50.0), ("EPSG32631", 2, 1, 6.0, 60.0, 50.0), ("EPSG32631", 3, 1, 7.0, 90.0, 10.0)]
    schema = "zone string, px long, py long, value double, tx double, ty double"
    for order in (rows, rows[::-1]):
        got = raster.regrid_nearest(spark.createDataFrame(order, schema), 100.0).collect()
        assert [tuple(r) for r in got] == [("EPSG32631", 0, 0, 5.0)]


@pytest.mark.parametrize("small", [10_000, 1])
def test_later_zones_cover_earlier_ones(spark, small, monkeypatch):
    monkeypatch.setattr(raster, "broadcast_if_small", lambda df: df if small == 1 else F.broadcast(df))
    cells = spark.createDataFrame(
        [("a", 0, 0, 1.0), ("b", 0, 0, 2.0), ("a", 1, 0, 3.0), ("b", 2, 0, None)], "zone string, cx long, cy long, value double"
    )
    order = spark.createDataFrame([("a", 9), ("b", 4)], "zone string, zone_seq long")
    got = {(r.cx, r.cy): r.value for r in raster.combine_zones(cells, order).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 3.0}


def brute_pyramid(cells, levels, average):
    out = {}
    for level in set(levels):
        blocks = {}
        for (x, y), v in sorted(cells.items(), key=lambda c: (c[0][1], c[0][0])):
            blocks.setdefault((level, x // level, y // level), []).append(v)
        out.update({k: (sum(v) / len(v) if average else v[0]) for k, v in blocks.items()})
    return out


@pytest.mark.parametrize("levels", [(32, 64, 128), (128, 32, 32), (1, 4, 6), (3, 4), (1,), (5,)])
@pytest.mark.parametrize("resampling", ["nearest", "average"])
def test_pyramid_equals_brute_force(spark, levels, resampling):
    rng = np.random.default_rng(7)
    cells = {(int(x), int(y)): float(v) for x, y, v in zip(rng.integers(-150, 150, 900), rng.integers(-150, 150, 900), rng.random(900))}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "px long, py long, value double")
    got = {(r.level, r.bx, r.by): r.value for r in raster.overview_pyramid(df, levels, resampling).collect()}
    expected = brute_pyramid(cells, levels, resampling == "average")
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_pyramid_reads_pixels_once(spark, tmp_path):
    path = str(tmp_path / "pixels")
    spark.range(1000).select(F.col("id").alias("px"), F.col("id").alias("py"), F.rand(1).alias("value")).write.parquet(path)
    plan = plan_of(raster.overview_pyramid(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan


def test_zone_names(spark):
    df = spark.createDataFrame([("EPSG: 32631\n",), ("",), (None,), ("no such thing",)], "srs string")
    got = df.select(naming.normalise_epsg(F.col("srs")), naming.zone_of(F.col("srs"))).collect()
    assert tuple(got[0]) == ("EPSG32631", "EPSG32631")
    assert [r[1] for r in got[1:]] == ["unknown"] * 3
    urls = spark.createDataFrame([("http://h/dir.vrt/EPSG32631.vrt",), ("plain.tif",)], "u string")
    got = urls.select(naming.reprojected_output_name(F.col("u"))).collect()
    assert [r[0] for r in got] == ["EPSG32631_EPSG3035.vrt", "plain.tif"]


def tile_rows(spark, n=1000):
    """Two thirds of the tiles lie in one zone."""
    return spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("u"), "id").alias("url"),
        F.when(F.col("id") % 3 < 2, "EPSG:32631").when(F.col("id") % 3 == 2, " EPSG: 32632\n").alias("srs"),
        (F.col("id") * 10.0).alias("xmin"), F.lit(0.0).alias("ymin"),
        (F.col("id") * 10.0 + 10).alias("xmax"), F.lit(10.0).alias("ymax"),
    )


def test_zone_lists_are_whole_ordered_and_bounded(spark):
    lists = tiles.group_tiles_by_zone(tile_rows(spark).repartition(7), per_list=64).collect()
    assert max(len(r.urls) for r in lists) <= 64
    for zone, keep in (("EPSG32631", lambda i: i % 3 < 2), ("EPSG32632", lambda i: i % 3 == 2)):
        whole = [u for r in sorted((r for r in lists if r.zone == zone), key=lambda r: r.part) for u in r.urls]
        assert whole == [f"u{i}" for i in range(1000) if keep(i)]


def test_zone_mosaic_and_unknown_tiles(spark):
    lost = spark.createDataFrame([(5000, "x", "", 0.0, -99.0, 1.0, 99.0)], tile_rows(spark).schema)
    got = {r.zone: r for r in tiles.zone_mosaic(tile_rows(spark).unionByName(lost)).collect()}
    assert set(got) == {"EPSG32631", "EPSG32632"}
    assert tuple(got["EPSG32632"])[1:] == (20.0, 0.0, 9_990.0, 10.0, 333, 2)  # last tile is 998
    whole = tiles.combine_extents(tiles.zone_mosaic(tile_rows(spark))).first()
    assert tuple(whole) == (0.0, 0.0, 10_000.0, 10.0, 1000)


def test_skip_existing(spark):
    wanted = spark.createDataFrame([("a.vrt",), ("b.vrt",)], "output string")
    there = spark.createDataFrame([("a.vrt", 1), ("a.vrt", 2)], "output string, size int")
    assert [r.output for r in tiles.skip_existing(wanted, there).collect()] == ["b.vrt"]
    assert tiles.skip_existing(wanted, there, overwrite=True).count() == 2


def test_overlaps_of_boxes_of_all_sizes(spark):
    """Every pair once, whatever the sizes: against all pairs by hand."""
    rng = np.random.default_rng(4)

    def boxes(n, name):
        at = rng.uniform(-300, 300, (n, 2)).round(1)
        size = (2.0 ** rng.uniform(-3, 9, (n, 2))).round(1)
        rows = [(i, f"z{i % 2}", *map(float, (*at[i], *(at[i] + size[i])))) for i in range(n)]
        rows += [(n, "z0", 0.0, 0.0, 0.0, 0.0), (n + 1, "z0", 5.0, 0.0, 1.0, 9.0), (n + 2, "z1", None, 0.0, 1.0, 9.0), (n + 3, "z0", -1e6, -1e6, 1e6, 1e6)]
        return rows, spark.createDataFrame(rows, f"{name} long, zone string, xmin double, ymin double, xmax double, ymax double")

    (a, sources), (b, windows) = boxes(150, "seq"), boxes(40, "window")
    for cell in (1.0, 16.0, 1000.0):
        got = sorted((r.window, r.seq) for r in tiles.overlaps(sources, windows, cell).collect())
        expected = sorted(
            (w[0], s[0]) for w in b for s in a
            if w[1] == s[1] and None not in (*w, *s) and s[2] <= s[4] and w[2] <= w[4]
            and s[2] < w[4] and s[4] > w[2] and s[3] < w[5] and s[5] > w[3]
        )
        assert got == expected
    plan = tiles.overlaps(sources, windows, 16.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert tiles.overlaps(sources.limit(0), windows.limit(0), 1.0).count() == 0


def test_few_sources_beside_a_window_are_held_against_it(spark):
    """Small sources all over a zone: the pairs tried are at most three times those that overlap."""
    sources = spark.range(40_000).selectExpr(
        "id AS seq", "'z' AS zone", "id % 200 + 0.2 AS xmin", "floor(id / 200) + 0.2 AS ymin", "id % 200 + 0.8 AS xmax", "floor(id / 200) + 0.8 AS ymax"
    )
    windows = spark.createDataFrame(
        [(w, "z", 10.0 * w, 70.0, 10.0 * w + 66, 136.0) for w in range(12)], "window int, zone string, xmin double, ymin double, xmax double, ymax double"
    )
    a, b = tiles._sides(sources, windows, 4.0, ("seq",), "window")
    assert a.join(b, tiles._MEETING).count() <= 3 * tiles.overlaps(sources, windows, 4.0).count()


def test_window_pixels_merge_sources_first(spark):
    """A window meets a cell once, however many sources cover it; repeated windows, those of one
    name in two boxes and sources without data change nothing."""
    pixels = spark.range(6000).selectExpr(
        "id AS seq", "'z' AS zone", "id % 5 AS px", "floor(id / 5) % 4 AS py", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS value"
    )
    boxes = [(1, "z", 0.0, 0.0, 30.0, 20.0), (1, "z", 0.0, 0.0, 30.0, 20.0), (1, "z", 20.0, 10.0, 50.0, 40.0), (None, "z", 0.0, 0.0, 10.0, 10.0), (3, "y", 0.0, 0.0, 50.0, 40.0)]
    windows = spark.createDataFrame(boxes, "window int, zone string, xmin double, ymin double, xmax double, ymax double")
    found = tiles.window_pixels(pixels, windows, 10.0)
    last = {}
    for i in range(6000):
        if i % 7:
            last[i % 5, i // 5 % 4] = i
    cells = {(w, *c) for w, z, *e in boxes if z == "z" for c in last if c[0] * 10 < e[2] and c[0] * 10 + 10 > e[0] and c[1] * 10 < e[3] and c[1] * 10 + 10 > e[1]}
    expected = [(w, x, y, float(last[x, y]), last[x, y]) for w, x, y in cells]
    by = lambda r: (r[0] or 0, *r[1:])
    assert sorted(((r.window, r.px, r.py, r.value, r.seq) for r in found.collect()), key=by) == sorted(expected, key=by)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("max_by")
