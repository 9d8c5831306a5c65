"""Pixel tables: mosaics, reprojection to the target grid and overviews.

A pixel row is ``(zone, px, py, value, seq)``: integer cell of the zone's grid,
the value (null means no data) and the position of its source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmosaic.functions.geo import (
    DEGREE,
    LAEA_FALSE_EASTING,
    LAEA_FALSE_NORTHING,
    LAEA_RADIUS,
    from_geographic,
    geographic_to_laea,
    is_geographic,
    is_target,
    laea_to_geographic,
    source_code,
    to_geographic,
)
from fieldmosaic.session import broadcast_if_small


def _has_data(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def mosaic_pixels(
    pixels: DataFrame, keys: Sequence[str] = ("zone", "px", "py"), nodata: float | None = None
) -> DataFrame:
    """One value per cell: that of the last source which has data there.

    ``max_by`` over fixed-width values hashes and combines before the shuffle,
    so a cell covered by very many sources stays one row per task.
    """
    valid = _has_data("value")
    if nodata is not None:
        valid = valid & (F.col("value") != nodata)
    return (
        pixels.filter(valid)
        .groupBy(*keys)
        .agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    )


def reproject(points: DataFrame, x: str = "x", y: str = "y", zone: str = "zone") -> DataFrame:
    """Add EPSG:3035 coordinates ``tx, ty`` to points of UTM zones and to points in
    geographic degrees (EPSG:4326, longitude first).

    The zone parameters follow from the code, so this is a map over columns. Points
    that are in EPSG:3035 keep their coordinates, points of the unknown zone get nulls,
    and those of any other system stop the job.
    """
    keep = points.columns
    located = to_geographic(
        points.withColumn("_code", source_code(F.col(zone))), x, y, "_code", "_lat", "_lon"
    )
    same = is_target(F.col("_code"))
    return geographic_to_laea(located, "_lat", "_lon", "_tx", "_ty").select(
        *keep, *(F.when(same, F.col(a)).otherwise(F.col(f"_{b}")).alias(b) for a, b in ((x, "tx"), (y, "ty")))
    )


def regrid_nearest(points: DataFrame, resolution: float) -> DataFrame:
    """Point gridding: reprojected points to the cells they fall in; the point nearest the
    cell centre wins. Cells without a point stay empty; ``warp_zones`` leaves no holes.

    The order is one fixed-width decimal: distance in millimetres, then source cell, so
    equal distances always resolve alike and the aggregate stays a hash aggregate. It
    holds cells from -5e9 to 5e9 and distances below 1e15.
    """
    c = F.col
    centred = points.filter(source_code(c("zone")).isNotNull()).withColumns(
        {"cx": F.floor(c("tx") / resolution), "cy": F.floor(c("ty") / resolution)}
    ).withColumns(
        {
            "_dx": c("tx") - (c("cx") + 0.5) * resolution,
            "_dy": c("ty") - (c("cy") + 0.5) * resolution,
        }
    )
    millimetres = F.floor(F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy")) * 1000)
    cell = [(c(p) + 5_000_000_000).cast("decimal(11,0)") for p in ("px", "py")]
    width = F.lit(100_000_000_000).cast("decimal(12,0)")
    order = ((millimetres.cast("decimal(15,0)") * width + cell[0]).cast("decimal(27,0)") * width + cell[1]).cast("decimal(38,0)")
    return (
        centred.withColumn("_order", order)
        .groupBy("zone", "cx", "cy")
        .agg(F.min_by("value", "_order").alias("value"))
    )


def warp_zones(pixels: DataFrame, source_resolution: float, target_resolution: float) -> DataFrame:
    """Zone mosaics on the target grid without holes: ``(zone, cx, cy, value)``.

    Every target cell takes the source cell that contains its centre. Turned
    round, each source cell proposes the few target cells near it and keeps those
    whose centre, projected back, lies in it. That is a map: no shuffle, and no
    cell is produced twice within a zone. How far a source cell may reach follows
    from the largest scale of the target projection there, the secant of half the
    angle to its centre, with 5 percent to spare. The source resolution is in the units
    of the zone, so geographic zones are warped by a call of their own, in degrees.
    """
    c = F.col
    r, t = float(source_resolution), float(target_resolution)
    centres = pixels.filter(source_code(c("zone")).isNotNull()).select(
        "zone", "px", "py", "value",
        ((c("px") + 0.5) * r).alias("x"), ((c("py") + 0.5) * r).alias("y"),
    )
    away = F.hypot(c("tx") - LAEA_FALSE_EASTING, c("ty") - LAEA_FALSE_NORTHING) / (2 * LAEA_RADIUS)
    metres = F.when(is_geographic(source_code(c("zone"))), F.lit(r * DEGREE)).otherwise(F.lit(r))
    moved = reproject(centres).withColumn(
        "_reach", metres * math.sqrt(0.5) * 1.05 / F.sqrt(1 - away * away)
    )

    def cells_near(at: str):
        # Cell i has its centre at (i + 0.5) * t.
        low = F.ceil((c(at) - c("_reach")) / t - 0.5)
        high = F.floor((c(at) + c("_reach")) / t - 0.5)
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    near = (
        moved.select("zone", "px", "py", "value", "ty", "_reach", cells_near("tx").alias("cx"))
        .select("zone", "px", "py", "value", "cx", cells_near("ty").alias("cy"))
        .withColumns(
            {"_tx": (c("cx") + 0.5) * t, "_ty": (c("cy") + 0.5) * t, "_code": source_code(c("zone"))}
        )
    )
    back = from_geographic(
        laea_to_geographic(near, "_tx", "_ty", "_lat", "_lon"), "_lat", "_lon", "_code", "_x", "_y"
    )
    same = is_target(c("_code"))
    x, y = F.when(same, c("_tx")).otherwise(c("_x")), F.when(same, c("_ty")).otherwise(c("_y"))
    return back.filter((F.floor(x / r) == c("px")) & (F.floor(y / r) == c("py"))).select("zone", "cx", "cy", "value")


def zone_order(tiles: DataFrame) -> DataFrame:
    """Zones by first appearance, the order in which their mosaics are stacked."""
    return tiles.groupBy("zone").agg(F.min("seq").alias("zone_seq"))


def combine_zones(cells: DataFrame, order: DataFrame) -> DataFrame:
    """All zones on the target grid as one mosaic; a later zone covers an earlier one."""
    ranked = cells.join(broadcast_if_small(order), "zone")
    return (
        ranked.filter(F.col("value").isNotNull())
        .groupBy("cx", "cy")
        .agg(F.max_by("value", "zone_seq").alias("value"))
    )


def overview_pyramid(
    pixels: DataFrame,
    levels: Sequence[int] = (32, 64, 128),
    resampling: str = "nearest",
) -> DataFrame:
    """Reduced copies ``(level, bx, by, value)``, one per level, empty blocks absent.

    ``nearest`` takes a block's first pixel in row order, ``average`` the mean of
    its pixels. Whole and decimal values are summed exactly and divided once, doubles in
    whatever order rows arrive. Level 1 is the grid itself; a level below 1 is an error.
    Null and NaN hold no data, as in ``mosaic_pixels``. Pixels are first reduced to blocks of the levels' greatest common
    divisor; only those few blocks are copied once per level, so the pixels are
    read and shuffled once, however many levels there are.
    """
    if resampling not in ("nearest", "average"):
        raise ValueError(f"unknown resampling: {resampling}")
    c = F.col
    wanted = sorted(set(levels))
    if not wanted or wanted[0] < 1:
        raise ValueError(f"levels from 1 on are asked for: {list(levels)}")
    whole = isinstance(pixels.schema["value"].dataType, T.IntegralType)
    valued = pixels.filter(_has_data("value")).select(
        "px", "py", c("value").cast("decimal(20,0)") if whole else c("value")
    )
    full = valued.select(
        F.lit(1).alias("level"), c("px").cast("bigint").alias("bx"), c("py").cast("bigint").alias("by"),
        c("value").cast("double").alias("value"),
    )
    coarse = [level for level in wanted if level > 1]
    if not coarse:
        return full
    base = math.gcd(*coarse)

    def reduce(*keys: str):
        # "at" is the row-major place, inside its block, of the pixel a value came from.
        if resampling == "nearest":
            return lambda df: df.groupBy(*keys).agg(
                F.min_by("value", "at").alias("value"), F.min("at").alias("at")
            )
        return lambda df: df.groupBy(*keys).agg(
            F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("at").alias("at")
        )

    blocks = valued.select(
        F.floor(c("px") / base).alias("ux"), F.floor(c("py") / base).alias("uy"),
        (F.pmod("py", F.lit(base)) * base + F.pmod("px", F.lit(base))).cast("bigint").alias("at"),
        "value", c("value").alias("total"), F.lit(1).cast("bigint").alias("n"),
    )
    if base > 1:
        blocks = blocks.transform(reduce("ux", "uy"))
    payload = ["value"] if resampling == "nearest" else ["total", "n"]
    level = c("level")
    step = F.floor(level / base)
    row = F.pmod(c("uy"), step) * base + F.floor(c("at") / base)
    column = F.pmod(c("ux"), step) * base + F.pmod(c("at"), F.lit(base))
    reduced = (
        blocks.withColumn("level", F.explode(F.array(*map(F.lit, coarse))))
        .select(
            "level", F.floor(c("ux") / step).alias("bx"), F.floor(c("uy") / step).alias("by"),
            (row * level + column).alias("at"), *payload,
        )
        .transform(reduce("level", "bx", "by"))
    )
    shown = c("value").cast("double") if resampling == "nearest" else c("total").cast("double") / c("n")
    reduced = reduced.select("level", "bx", "by", shown.alias("value"))
    return full.unionByName(reduced) if 1 in wanted else reduced
