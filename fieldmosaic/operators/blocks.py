"""Block rasters: squares of cells as arrays, a row per block and source.

A block row is ``(keys, bx, by, seq, values)``: the cells of a square of ``side`` by ``side``
in row order, null where the source has no data. Block ``(bx, by)`` starts at cell
``(bx * side, by * side)``; a negative cell lies in a negative block. Merged blocks hold
``values`` and, cell by cell, the ``seqs`` of the sources that they come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.session import broadcast_if_small

SIDE = 128
#: Blocks of one place that a group merges at once; its square is the span of positions
#: that one task merges.
FAN = 16


def to_blocks(
    pixels: DataFrame, keys: Sequence[str] = ("zone",), side: int = SIDE, nodata: float | None = None
) -> DataFrame:
    """Pixels ``(keys, px, py, value, seq)`` as blocks; empty blocks are absent.

    Null, NaN and ``nodata`` are no data. Of several values of a source in one cell the
    largest stands. One shuffle, on block and source: the rows of one source in one block
    meet in a task, where repeated cells merge first, so no array exceeds ``side * side``.
    """
    if side < 1:
        raise ValueError(f"blocks have a side from 1 on: {side}")
    c = F.col
    valid = c("value").isNotNull() & ~F.isnan("value")
    if nodata is not None:
        valid = valid & (c("value") != nodata)
    place = [*keys, "bx", "by", "seq"]
    cells = pixels.filter(valid).select(
        *keys,
        F.floor(c("px") / side).alias("bx"),
        F.floor(c("py") / side).alias("by"),
        "seq",
        (F.pmod("py", F.lit(side)) * side + F.pmod("px", F.lit(side))).cast("int").alias("at"),
        "value",
    )
    listed = (
        cells.repartition(*place)
        .groupBy(*place, "at")
        .agg(F.max("value").alias("value"))
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    )
    return listed.select(*place, _filled(c("cells"), side).alias("values"))


def _filled(cells: Column, side: int) -> Column:
    """Sorted ``(at, value)`` as an array with a null for each place between and after."""

    def with_gap(cell: Column, i: Column) -> Column:
        before = F.when(i > 0, cells[i - 1]["at"]).otherwise(-1)
        return F.concat(F.array_repeat(_null_of(cell["value"]), cell["at"] - before - 1), F.array(cell["value"]))

    after = side * side - 1 - F.element_at(cells, -1)["at"]
    return F.concat(F.flatten(F.transform(cells, with_gap)), F.array_repeat(_null_of(cells[0]["value"]), after))


def _null_of(value: Column) -> Column:
    return F.when(F.lit(False), value)


def merge_blocks(blocks: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """``(keys, bx, by, values, seqs)``: in each cell the last source with data there.

    The greater of two cells by position is the same in whatever order blocks meet, so a
    place is merged in steps: spans of ``FAN`` positions, spans of ``FAN * FAN``, then
    what is left. The first two share one shuffle on place and span, which deals out a
    place under very many sources; merged blocks alone take the second shuffle.
    """
    c = F.col
    place = [*keys, "bx", "by"]
    stacked = blocks.select(
        *place,
        F.floor(c("seq") / (FAN * FAN)).alias("_span"),
        F.floor(c("seq") / FAN).alias("_part"),
        F.transform("values", lambda v: F.when(v.isNotNull(), F.struct(c("seq"), v.alias("value")))).alias("cells"),
    ).repartition(*place, "_span")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        stack = df.groupBy(*by).agg(F.collect_list("cells").alias("stack"))
        top = F.reduce(
            F.slice("stack", 2, F.size("stack")),
            c("stack")[0],
            lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)),
        )
        return stack.select(*by, top.alias("cells"))

    return (
        stacked.transform(merged, *place, "_span", "_part")
        .transform(merged, *place, "_span")
        .transform(merged, *place)
        .select(
            *place,
            F.transform("cells", lambda x: x["value"]).alias("values"),
            F.transform("cells", lambda x: x["seq"]).alias("seqs"),
        )
    )


def from_blocks(blocks: DataFrame, keys: Sequence[str] = ("zone",), side: int = SIDE) -> DataFrame:
    """Blocks, merged or not, as pixels again: ``(keys, px, py, value, seq)``. A map."""
    c = F.col
    seqs = c("seqs") if "seqs" in blocks.columns else F.transform("values", lambda _: c("seq"))
    cells = blocks.select(*keys, "bx", "by", F.posexplode(F.arrays_zip(c("values").alias("value"), seqs.alias("seq"))))
    return cells.filter(c("col.value").isNotNull()).select(
        *keys,
        (c("bx") * side + c("pos") % side).alias("px"),
        (c("by") * side + F.floor(c("pos") / side)).alias("py"),
        c("col.value").alias("value"),
        c("col.seq").alias("seq"),
    )


def block_overviews(
    blocks: DataFrame,
    levels: Sequence[int] = (32, 64, 128),
    resampling: str = "nearest",
    side: int = SIDE,
) -> DataFrame:
    """Reduced copies ``(level, bx, by, value)`` of merged blocks, as ``overview_pyramid``.

    Every level divides the side, so a reduced cell lies in one block and its pixels are in
    one array: a map, without a shuffle at any size.
    """
    if resampling not in ("nearest", "average"):
        raise ValueError(f"unknown resampling: {resampling}")
    wanted = sorted(set(levels))
    if not wanted or wanted[0] < 1 or any(side % level for level in wanted):
        raise ValueError(f"levels that divide the side {side} are asked for: {list(levels)}")
    c = F.col

    def reduced(level: int) -> Column:
        across = side // level

        def value(k: Column) -> Column:
            start = F.floor(k / across) * (level * side) + k % across * level
            lines = F.transform(
                F.sequence(F.lit(0), F.lit(level - 1)),
                lambda line: F.slice("values", (start + line * side + 1).cast("int"), level),
            )
            data = F.filter(F.flatten(lines), lambda v: v.isNotNull())
            if resampling == "nearest":
                return F.get(data, F.lit(0)).cast("double")
            total = F.reduce(data, F.lit(0.0), lambda a, v: a + v.cast("double"))
            return F.when(F.size(data) > 0, total / F.size(data))

        cells = F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), lambda k: F.struct(k.alias("k"), value(k).alias("value")))
        present = F.filter(cells, lambda cell: cell["value"].isNotNull())
        return F.transform(
            present,
            lambda cell: F.struct(
                F.lit(level).alias("level"),
                (c("bx") * across + cell["k"] % across).alias("bx"),
                (c("by") * across + F.floor(cell["k"] / across)).alias("by"),
                cell["value"].alias("value"),
            ),
        )

    return blocks.select(F.inline(F.concat(*map(reduced, wanted))))


def combine_blocks(zone_blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks ``(zone, bx, by, values)`` of all zones on the target grid as one mosaic,
    ``(bx, by, values, seqs)``; a later zone covers an earlier one, ``seqs`` names it."""
    ranked = zone_blocks.join(broadcast_if_small(order), "zone")
    return merge_blocks(ranked.withColumnRenamed("zone_seq", "seq"), ())


def touched_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(bx, by)`` of the blocks that a remade zone had or has: what has to be combined anew."""
    return before.select("bx", "by").union(after.select("bx", "by")).distinct()


def patch_blocks(combined: DataFrame, zone_blocks: DataFrame, order: DataFrame, touched: DataFrame) -> DataFrame:
    """The combined mosaic after some zones were remade: touched blocks are combined anew
    from the blocks of all zones there, all others are taken over as they are.

    ``zone_blocks`` holds all zones as they are now. A touched block without data is gone.
    """
    place = ["bx", "by"]
    anew = combine_blocks(zone_blocks.join(touched, place, "left_semi"), order)
    return combined.join(touched, place, "left_anti").unionByName(anew)
