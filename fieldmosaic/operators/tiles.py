"""Tile indexes: zones, mosaics of extents and work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.geo import geographic_to_laea, is_target, source_code, to_geographic
from fieldmosaic.functions.naming import UNKNOWN_ZONE, zone_of
from fieldmosaic.operators.raster import mosaic_pixels


def with_zone(tiles: DataFrame, srs: str = "srs") -> DataFrame:
    """Add ``zone``; tiles whose system cannot be read go to the unknown zone."""
    return tiles.withColumn("zone", zone_of(F.col(srs)))


def zone_sources(tiles: DataFrame) -> DataFrame:
    """The mosaic index in long form: one row per zone and source, unknown zone left out."""
    return with_zone(tiles).filter(F.col("zone") != UNKNOWN_ZONE)


def group_tiles_by_zone(tiles: DataFrame, per_list: int = 10_000) -> DataFrame:
    """Zone -> URLs in input order, as numbered lists of bounded length.

    ``seq`` is the unique input position. List ``part`` of a zone holds its tiles
    with ``seq`` in one span of ``per_list`` positions, so no list and no task
    grows with a large zone; lists of a zone put together by ``part`` give the
    zone's whole list in order.
    """
    return (
        with_zone(tiles)
        .withColumn("part", F.floor(F.col("seq") / per_list))
        .groupBy("zone", "part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("members"))
        .select("zone", "part", F.transform("members", lambda m: m["url"]).alias("urls"))
    )


def zone_mosaic(tiles: DataFrame) -> DataFrame:
    """Per zone: extent of all its tiles, their number, and when the zone first appeared."""
    return zone_sources(tiles).groupBy("zone").agg(*_extent())


def combine_extents(mosaics: DataFrame) -> DataFrame:
    """One extent over zone mosaics that share a coordinate system."""
    return mosaics.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.sum("n_tiles").alias("n_tiles"),
    )


def _extent():
    return (
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.count(F.lit(1)).alias("n_tiles"), F.min("seq").alias("first_seq"),
    )


def reproject_extents(boxes: DataFrame) -> DataFrame:
    """Boxes of zones as enclosing EPSG:3035 boxes of their four corners. The unknown zone
    is left out; a system that is neither UTM nor EPSG:3035 stops the job."""
    boxes = boxes.withColumn("_code", source_code(F.col("zone"))).filter(F.col("_code").isNotNull())
    keep = [c for c in boxes.columns if c != "_code"]
    out = boxes
    for i, (x, y) in enumerate((x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")):
        out = to_geographic(out, x, y, "_code", f"_lat{i}", f"_lon{i}")
        out = geographic_to_laea(out, f"_lat{i}", f"_lon{i}", f"_x{i}", f"_y{i}")
    corners = range(4)
    moved = {
        "xmin": F.least(*(f"_x{i}" for i in corners)),
        "ymin": F.least(*(f"_y{i}" for i in corners)),
        "xmax": F.greatest(*(f"_x{i}" for i in corners)),
        "ymax": F.greatest(*(f"_y{i}" for i in corners)),
    }
    same = is_target(F.col("_code"))
    moved = {c: F.when(same, F.col(c)).otherwise(value) for c, value in moved.items()}
    return out.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in keep))


def skip_existing(
    wanted: DataFrame, existing: DataFrame, overwrite: bool = False, name: str = "output"
) -> DataFrame:
    """Outputs still to be made: all of them, or those not there yet."""
    return wanted if overwrite else wanted.join(existing.select(name), name, "left_anti")


def _placed_boxes(boxes: DataFrame, cell: float, levels: list[int] | None, carry: list[str], as_: str, finer: int = 0) -> DataFrame:
    """Boxes in the cells that they touch, on their own level and on each coarser one in use.

    A cell of level n is 2 ** n cells wide; a box's own level is the least whose cells are as
    wide as the box, so it touches four cells of a level at most. With ``finer`` it is so many
    levels lower, and a box touches (2 ** finer + 1) ** 2 cells at most."""
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, F.lit(cell)) / F.lit(cell))) - finer).cast("int")
    kept = boxes.select("zone", *carry, *(F.col(c).cast("double").alias(f"{as_}_{c}") for c in _BOX), own.alias(f"{as_}_own"))
    if levels is None:
        return kept
    at = kept.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("level") >= F.col(f"{as_}_own"))
    wide = F.lit(float(cell)) * F.pow(F.lit(2.0), "level")
    for axis in "xy":
        low, high = (F.floor(F.col(f"{as_}_{axis}{end}") / wide) for end in ("min", "max"))
        at = at.withColumn(f"cell_{axis}", F.explode(F.sequence(low, high)))
    return at


_BOX = ("xmin", "ymin", "xmax", "ymax")
_MEETING = ["zone", "level", "cell_x", "cell_y"]


def overlaps(sources: DataFrame, windows: DataFrame, cell: float, keep: tuple[str, ...] = ("seq",), name: str = "window") -> DataFrame:
    """``name, zone`` and the ``keep`` columns of sources: every window with every source of its
    zone whose box shares more than an edge with it, each pair once.

    Both sides have ``zone, xmin, ymin, xmax, ymax``. Boxes meet in the cells of a grid, on the
    coarser one of their levels, so no pair of boxes in different places is ever formed, and a
    large box is in few cells. Windows meet in cells of an eighth of their width, so that few
    sources beside a window are held against it. A pair counts in the cell that holds the lower
    left corner of what both share. Cells with very many boxes are keys of an inner join, which
    adaptive execution splits. A box with a missing or reversed side overlaps nothing.
    """
    return _pairs(*_sides(sources, windows, cell, keep, name), cell, keep, name)


def _sides(sources: DataFrame, windows: DataFrame, cell: float, keep: tuple[str, ...], name: str, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sources and windows in the cells where they meet; ``small`` says that no source is wider
    than a cell."""
    good = F.expr("xmin <= xmax AND ymin <= ymax")
    sources, windows = sources.where(good), windows.where(good)
    used = _placed_boxes(windows, cell, None, [], "b", WINDOW_FINER).select("b_own").distinct()
    if not small:
        used = used.union(_placed_boxes(sources, cell, None, [], "b").select("b_own").distinct()).distinct()
    levels = {r["b_own"] for r in used.limit(MAX_LEVELS + 1).collect()}
    if len(levels) > MAX_LEVELS:
        raise ValueError("boxes are too unlike in size")
    levels = sorted(levels | {0} if small or not levels else levels)
    return _placed_boxes(sources, cell, levels, list(keep), "s"), _placed_boxes(windows, cell, levels, [name], "w", WINDOW_FINER)


def _pairs(a: DataFrame, b: DataFrame, cell: float, keep: tuple[str, ...], name: str) -> DataFrame:
    """Pairs of boxes that overlap, of the two ``_sides``."""
    wide = F.lit(float(cell)) * F.pow(F.lit(2.0), "level")
    corner = [F.floor(F.greatest(f"s_{c}min", f"w_{c}min") / wide) == F.col(f"cell_{c}") for c in "xy"]
    meet = F.expr("s_xmin < w_xmax AND s_xmax > w_xmin AND s_ymin < w_ymax AND s_ymax > w_ymin")
    joined = a.join(b, _MEETING).where((F.col("level") == F.greatest("s_own", "w_own")) & corner[0] & corner[1] & meet)
    return joined.select(name, "zone", *keep)


#: Different levels of boxes at most, each twice as wide as the one before.
MAX_LEVELS = 64
#: Levels that windows meet sources below the one as wide as they are.
WINDOW_FINER = 3


def window_pixels(pixels: DataFrame, windows: DataFrame, size: float, name: str = "window") -> DataFrame:
    """``name, zone, px, py, value, seq``: the mosaic of each window, from the pixels of zones
    (``zone, px, py, value, seq``, ``size`` wide) that it overlaps; the last source with data
    gives the value. Sources are merged first, so a window meets a cell once, however many
    sources cover it; windows of one name and zone share their cells."""
    edges = {"xmin": F.col("px"), "ymin": F.col("py"), "xmax": F.col("px") + 1, "ymax": F.col("py") + 1}
    boxes = mosaic_pixels(pixels).withColumns({k: v * F.lit(float(size)) for k, v in edges.items()})
    keep = ("px", "py", "value", "seq")
    found = _pairs(*_sides(boxes, windows, 8 * size, keep, name, small=True), 8 * size, keep, name)
    return found.dropDuplicates([name, "zone", "px", "py"])
