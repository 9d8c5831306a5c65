import math
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fieldmosaic.operators import blocks, raster

SCHEMA = "zone string, px int, py int, value double, seq long"


def scattered(n=3000, sources=600, seed=1):
    """Pixels around the origin, with repeated cells, nulls, NaN and a nodata value."""
    pick = random.Random(seed)
    values = [None, math.nan, -9.0]
    return [
        (pick.choice("yz"), pick.randint(-20, 20), pick.randint(-20, 20),
         pick.choice(values) if pick.random() < 0.1 else float(pick.randint(0, 1000)), pick.randint(-5, sources))
        for _ in range(n)
    ]


def last_with_data(rows):
    best = {}
    for zone, px, py, value, seq in rows:
        if value is not None and not math.isnan(value) and value != -9.0:
            best[zone, px, py] = max(best.get((zone, px, py), (seq, value)), (seq, value))
    return {(*cell, value, seq) for cell, (seq, value) in best.items()}


@pytest.mark.parametrize("side", [1, 5, 16, 64])
def test_blocks_equal_cells(spark, side):
    rows = scattered()
    table = blocks.to_blocks(spark.createDataFrame(rows, SCHEMA), side=side, nodata=-9.0)
    assert {r.n for r in table.select(F.size("values").alias("n")).collect()} == {side * side}
    got = blocks.from_blocks(blocks.merge_blocks(table), side=side).collect()
    assert len(got) == len(last_with_data(rows))
    assert {tuple(r) for r in got} == last_with_data(rows)


def test_blocks_hold_one_row_for_a_full_square(spark):
    """A source that fills its square is cut to one row from side * side."""
    cells = spark.range(64 * 64).select(
        F.lit("z").alias("zone"), (F.col("id") % 64).alias("px"), F.floor(F.col("id") / 64).alias("py"),
        F.col("id").cast("double").alias("value"), F.lit(3).alias("seq"),
    )
    assert blocks.to_blocks(cells, side=64).count() == 1 and blocks.to_blocks(cells, side=32).count() == 4
    (row,) = blocks.to_blocks(cells, side=64).collect()
    assert row["values"] == [float(i) for i in range(64 * 64)] and (row.bx, row.by, row.seq) == (0, 0, 3)
    back = blocks.from_blocks(blocks.to_blocks(cells, side=32), side=32)
    assert back.exceptAll(cells.select(back.columns)).count() == 0 and back.count() == 4096


def test_empty_tables_and_sources_without_data(spark):
    empty = blocks.to_blocks(spark.createDataFrame([("z", 0, 0, None, 1)], SCHEMA), side=4)
    assert empty.count() == 0
    merged = blocks.merge_blocks(empty)
    assert merged.columns == ["zone", "bx", "by", "values", "seqs"] and merged.count() == 0
    assert blocks.from_blocks(merged, side=4).count() == 0
    assert blocks.block_overviews(merged, (2,), side=4).count() == 0


def test_a_place_under_many_sources_is_dealt_out(spark):
    """Ten thousand sources of one block: spans of positions meet in tasks of their own."""
    pixels = spark.createDataFrame([("z", i % 4, 0, float(i), i) for i in range(10_000)], SCHEMA)
    merged = blocks.merge_blocks(blocks.to_blocks(pixels, side=4))
    got = blocks.from_blocks(merged, side=4).collect()
    assert {(r.px, r.seq) for r in got} == {(0, 9996), (1, 9997), (2, 9998), (3, 9999)}
    # cells to blocks, blocks by place and span, merged blocks by place
    assert plan_of(merged).count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("resampling", ["nearest", "average"])
def test_overviews_of_blocks_equal_the_pyramid(spark, resampling):
    grid = spark.createDataFrame(sorted((x, y, v, 0) for _, x, y, v, _ in last_cells(scattered())), "px int, py int, value double, seq int")
    cells = blocks.merge_blocks(blocks.to_blocks(grid, (), side=16), ())
    small = blocks.block_overviews(cells, (1, 2, 8, 16), resampling, side=16)
    wanted = raster.overview_pyramid(grid, (1, 2, 8, 16), resampling)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in wanted.collect()}


def last_cells(rows):
    return {(x, y): ("z", x, y, v, s) for _, x, y, v, s in sorted(last_with_data(rows))}.values()


def test_overviews_need_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "blocks")
    grid = spark.createDataFrame([("z", 0, 0, 1.0, 1)], SCHEMA)
    blocks.merge_blocks(blocks.to_blocks(grid)).write.parquet(path)
    assert "Exchange" not in plan_of(blocks.block_overviews(spark.read.parquet(path)))


@pytest.mark.parametrize("levels", [(), (0,), (3,), (256,)])
def test_levels_divide_the_side(spark, levels):
    with pytest.raises(ValueError, match="divide"):
        blocks.block_overviews(spark.createDataFrame([], "bx long, by long, values array<double>"), levels)
    with pytest.raises(ValueError, match="side"):
        blocks.to_blocks(spark.createDataFrame([], SCHEMA), side=0)


def test_a_remade_zone_changes_its_blocks_alone(spark):
    """The patched mosaic equals the one from scratch; blocks elsewhere are taken over unread."""
    side = 4
    order = spark.createDataFrame([("y", 1), ("z", 2)], "zone string, zone_seq int")

    def zone_blocks(rows):
        return blocks.merge_blocks(blocks.to_blocks(spark.createDataFrame(rows, SCHEMA), side=side)).drop("seqs")

    first = scattered(400)
    # the new zone z has other values, no cells on the left and some further right
    second = [r for r in first if r[0] == "y"] + [("z", x + 6, y, v and v + 1, s) for z, x, y, v, s in first if z == "z" and 0 <= x < 8]
    before, after = zone_blocks(first).cache(), zone_blocks(second).cache()
    touched = blocks.touched_blocks(before.filter("zone = 'z'"), after.filter("zone = 'z'"))
    old = blocks.combine_blocks(before, order).withColumn("values", F.when(F.col("bx") < 5, F.col("values")))
    patched = blocks.patch_blocks(blocks.combine_blocks(before, order), after, order, touched)
    scratch = blocks.combine_blocks(after, order)

    def rows(df):
        return sorted((tuple(r) for r in blocks.from_blocks(df, (), side).collect()), key=str)

    assert rows(patched) == rows(scratch)
    # an untouched block comes from the old table, whatever it holds
    marked = blocks.patch_blocks(old.withColumn("seqs", F.transform("seqs", lambda s: s + 100)), after, order, touched)
    untouched = marked.join(touched, ["bx", "by"], "left_anti")
    assert all(s is None or s > 100 for r in untouched.collect() for s in r.seqs)
    before.unpersist(), after.unpersist()
