"""Registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic import fixtures
from fieldmosaic.functions import codes, naming
from fieldmosaic.operators import blocks, clean, labels, learn, metrics, raster, splits, tiles, weights
from fieldmosaic.operators import pools as quantised
from fieldmosaic.plans import scenarios, selection, stages
from fieldmosaic.session import new_path, tune
from fieldmosaic.sources import samples, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PIXEL_SIZE = 10_000.0
FOUR_BANDS = ["B06_p50", "B06_sd", "NDVI_p50", "VV_p50"]
TYPE_NAMES = sorted([*codes.TYPE_CLASSES, codes.OTHER_CLASS])
#: Borders of the four bands in ``pool_codes``.
POOL_BORDERS = ((500.0, 1250.5, 2500.0, 4000.0), (0.25, 0.5, 1.0, 2.5), (100.0, 350.25, 500.0), (10.0, 40.0))


def query(function):
    @wraps(function)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = tuned
    return function


# Samples: scan, clean, cast, filter, project.


@query
def read_csv(spark, sf):
    path = new_path(spark, "samples-csv")
    indexed = fixtures.derive(
        fixtures.table(spark, sf, "lineitem"), ("l_linenumber", "row"), *fixtures.CROP
    )
    indexed.write.option("header", True).csv(path)
    return samples.read_samples(spark, path, types={"groupID": "int", "zoneID": "int"})


@query
def read_csv_inferred(spark, sf):
    path = new_path(spark, "samples-csv")
    indexed = fixtures.derive(
        fixtures.table(spark, sf, "lineitem"), ("l_linenumber", "row"), *fixtures.CROP, fixtures.SERIAL
    )
    indexed.write.option("header", True).option("nullValue", "NA").csv(path)
    return samples.read_samples(spark, path, infer=True)


def _twice(df: DataFrame) -> DataFrame:
    return df.unionByName(df)


@query
def clean_samples(spark, sf):
    return clean.load_clean(_twice(fixtures.crop(spark, sf)))


@query
def drop_duplicates(spark, sf):
    return clean.drop_duplicate_samples(_twice(fixtures.crop(spark, sf)))


@query
def drop_nulls(spark, sf):
    return clean.drop_null_samples(fixtures.crop(spark, sf))


@query
def preview(spark, sf):
    return clean.preview(fixtures.crop(spark, sf, keyed=True), 5, order_by=["key"])


@query
def require_band(spark, sf):
    return clean.require_band(fixtures.crop(spark, sf))


@query
def cast_strata(spark, sf):
    floats = fixtures.crop(spark, sf).withColumns(
        {c: F.col(c).cast("double") for c in ("groupID", "zoneID")}
    )
    return clean.cast_strata(floats)


@query
def cast_all_int(spark, sf):
    return clean.cast_all_int(clean.drop_null_samples(fixtures.wide_crop(spark, sf)))


@query
def exclude_type(spark, sf):
    return clean.exclude_codes(fixtures.crop(spark, sf))


@query
def exclude_season(spark, sf):
    return clean.exclude_codes(fixtures.crop(spark, sf), codes.EXCLUDED_SEASON_CODES)


@query
def stratum_46000(spark, sf):
    return clean.filter_stratum(fixtures.crop(spark, sf), [46000])


@query
def stratum_22000(spark, sf):
    return clean.filter_stratum(fixtures.crop(spark, sf), [22000])


@query
def stratum_43000_6000(spark, sf):
    return clean.filter_stratum(fixtures.crop(spark, sf), [43000, 6000])


def _labelled(spark, sf, scheme=codes.TYPE_CLASSES, **kw) -> DataFrame:
    return labels.with_label(fixtures.crop(spark, sf, **kw), scheme)


@query
def select_small(spark, sf):
    wide = labels.with_label(fixtures.wide_crop(spark, sf), codes.TYPE_CLASSES)
    return clean.select_features(wide, codes.small_feature_names())


@query
def select_full(spark, sf):
    wide = fixtures.wide_crop(spark, sf)
    return clean.select_features(
        labels.with_label(wide, codes.SEASON_CLASSES), clean.band_names(wide)
    )


@query
def feature_names(spark, sf):
    """Every feature name with the number of samples that have it."""
    names = codes.feature_names()
    counts = fixtures.wide_crop(spark, sf).agg(*(F.count(n).alias(n) for n in names))
    present = counts.unpivot([], names, "feature", "samples")
    return codes.feature_name_table(spark).join(present, "feature", "left")


# Labels, counts and weights.


@query
def label_type(spark, sf):
    return _labelled(spark, sf).select("id", "B06_sd", "label")


@query
def label_season(spark, sf):
    return _labelled(spark, sf, codes.SEASON_CLASSES).select("id", "B06_sd", "label")


@query
def label_type_int(spark, sf):
    kept = clean.exclude_codes(clean.require_band(fixtures.crop(spark, sf)))
    return kept.withColumn("y1", codes.label_by_crop_type_int(F.col("id"))).select(
        "id", "B06_p50", "y1"
    )


@query
def label_from_table(spark, sf):
    mapping = codes.class_table(spark, codes.SEASON_CLASSES)
    return labels.label_from_table(fixtures.crop(spark, sf), mapping).select(
        "id", "NDVI_p50", "label"
    )


@query
def class_counts(spark, sf):
    return weights.class_counts(fixtures.crop(spark, sf))


def _prepared(spark, sf) -> DataFrame:
    rows = clean.load_clean(_twice(fixtures.crop(spark, sf)))
    return labels.with_label(clean.exclude_codes(rows), codes.TYPE_CLASSES)


@query
def balanced_weights(spark, sf):
    return weights.balanced_class_weights(_prepared(spark, sf))


@query
def balanced_weights_override(spark, sf):
    return weights.balanced_class_weights(_prepared(spark, sf), override={"0": 3.5})


@query
def auto_weights(spark, sf):
    return weights.auto_class_weights(_prepared(spark, sf))


@query
def weighted_samples(spark, sf):
    rows = _labelled(spark, sf, keyed=True)
    return weights.attach_weights(rows, weights.balanced_class_weights(rows)).select(
        "key", "label", "weight"
    )


# Vectors, splits, folds.


@query
def assembled(spark, sf):
    kept = clean.drop_null_samples(fixtures.crop(spark, sf, keyed=True))
    vectors = learn.assemble(kept, FOUR_BANDS).select(
        "key", vector_to_array("features").alias("features")
    )
    return vectors.select(
        "key",
        F.size("features").cast("bigint").alias("n_features"),
        *(F.col("features")[i].alias(f"f{i}") for i in range(len(FOUR_BANDS))),
    )


@query
def split_hash(spark, sf):
    rows = fixtures.crop(spark, sf, keyed=True)
    return splits.split_hash(rows, "key").select("key", "is_test")


@query
def split_random(spark, sf):
    train, test = splits.split_random(fixtures.crop(spark, sf, keyed=True))
    pools = splits.make_pools(train.select("key"), test.select("key"))
    return pools.groupBy("key").agg(F.count(F.lit(1)).alias("times"))


@query
def pools(spark, sf):
    rows = splits.split_hash(_labelled(spark, sf, keyed=True), "key")
    both = splits.make_pools(rows.filter(~F.col("is_test")), rows.filter("is_test"))
    return both.groupBy("label", "is_test", "is_validation").agg(F.count(F.lit(1)).alias("n"))


@query
def folds(spark, sf):
    rows = _labelled(spark, sf, keyed=True).select("key", "label")
    return splits.stratified_folds(rows, "key")


@query
def folds_hash(spark, sf):
    return splits.hash_folds(_labelled(spark, sf, keyed=True), "key").select("key", "label", "fold")


# Metrics on a derived prediction column.


def _predicted(spark, sf) -> DataFrame:
    """The true class, or the next one in order for a fifth of the rows, by key hash."""
    rows = _labelled(spark, sf, keyed=True)
    following = F.create_map(
        *(F.lit(v) for pair in zip(TYPE_NAMES, TYPE_NAMES[1:] + TYPE_NAMES[:1]) for v in pair)
    )
    wrong = naming.hash_share(F.col("key"), 0.2)
    return rows.withColumn(
        "prediction", F.when(wrong, following[F.col("label")]).otherwise(F.col("label"))
    )


@query
def accuracy(spark, sf):
    return metrics.accuracy(_predicted(spark, sf))


@query
def prf_support(spark, sf):
    return metrics.precision_recall_fscore_support(_predicted(spark, sf))


@query
def confusion(spark, sf):
    return metrics.confusion_counts(_predicted(spark, sf))


@query
def confusion_matrix(spark, sf):
    wide = metrics.confusion_matrix(_predicted(spark, sf), TYPE_NAMES)
    return wide.withColumnsRenamed({c: f"predicted_{c}" for c in TYPE_NAMES})


def _band_totals(spark, sf) -> DataFrame:
    """A stand-in importance table: share of samples whose band is above a bound."""
    rows = fixtures.crop(spark, sf)
    bounds = {"B06_p50": 2500, "B06_sd": 1, "NDVI_p50": 500, "VV_p50": 1000}
    shares = rows.agg(
        *((F.count_if(F.col(b) > v) / F.count(F.lit(1))).alias(b) for b, v in bounds.items())
    )
    return shares.unpivot([], list(bounds), "band", "importance")


@query
def ranked_importance(spark, sf):
    return metrics.nonzero_importance(metrics.rank_importance(_band_totals(spark, sf)))


@query
def results_json(spark, sf):
    document = metrics.results_document(_band_totals(spark, sf), _predicted(spark, sf))
    path = new_path(spark, "results")
    sinks.write_results(document, path)
    back = spark.read.schema(document.schema).json(path)
    return back.select(
        "accuracy",
        F.array_join(F.transform("feat_importance", lambda p: p["band"]), ",").alias("bands"),
        F.array_join(F.col("support").cast("array<string>"), ",").alias("support"),
        F.col("precision")[0].alias("first_precision"),
        F.col("recall")[1].alias("second_recall"),
        F.col("fscore")[2].alias("third_fscore"),
    )


@query
def ranked_candidates(spark, sf):
    """Mean score per rule of thumb over three hash folds, best first."""
    return metrics.rank_candidates(_candidate_scores(spark, sf))


@query
def best_candidate(spark, sf):
    return metrics.best_candidate(_candidate_scores(spark, sf))


def _candidate_scores(spark, sf) -> DataFrame:
    rows = splits.hash_folds(_labelled(spark, sf, keyed=True), "key")
    rules = F.explode(
        F.array(*(F.struct(F.lit(f"always={n}").alias("params"), F.lit(n).alias("guess")) for n in TYPE_NAMES))
    )
    scored = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).select(
        "fold", "label", "n", rules.alias("rule")
    )
    per_fold = scored.groupBy("rule.params", "fold").agg(
        (F.sum(F.when(F.col("label") == F.col("rule.guess"), F.col("n")).otherwise(F.lit(0).cast("bigint")))
         / F.sum("n")).alias("score")
    )
    return per_fold.groupBy("params").agg(
        F.round(F.avg("score"), 12).alias("mean_test_score")
    )


# Learning. The forest is the learner of most queries: native multiclass, one fit.


def _training_rows(spark, sf) -> DataFrame:
    kept = fixtures.crop(spark, sf, keyed=True)
    kept = clean.exclude_codes(clean.drop_null_samples(kept))
    return splits.split_hash(labels.with_label(kept, codes.TYPE_CLASSES), "key", out="is_validation")


def _forest(rows: DataFrame):
    return learn.train_classifier(
        rows, ["groupID", "zoneID", *FOUR_BANDS], algorithm="forest", numTrees=20, maxDepth=7, seed=1
    )


@query
def train_score(spark, sf):
    rows = _training_rows(spark, sf)
    scored = learn.predict(_forest(rows), rows.filter("is_validation"))
    return scored.select(
        "key", "label", "predicted_label",
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


@query
def train_tree(spark, sf):
    """The code follows from one band, so a single deep tree must give back every label."""
    rows = _training_rows(spark, sf)
    model = learn.train_classifier(
        rows, ["groupID", "zoneID", *FOUR_BANDS], algorithm="forest", numTrees=1, maxDepth=20, maxBins=128,
        bootstrap=False, featureSubsetStrategy="all", seed=1,
    )
    return learn.predict(model, rows.filter("is_validation")).select("key", "label", "predicted_label")


@query
def train_boosted(spark, sf):
    """Multiclass boosted trees with balanced weights, L2 and random strength. The code
    follows from one band, so they must give back every label."""
    rows = _training_rows(spark, sf)
    rows = weights.attach_weights(rows, weights.auto_class_weights(rows))
    model = learn.train_classifier(
        rows, FOUR_BANDS, algorithm="boosted", weight="weight", iterations=100, depth=6, learning_rate=0.5,
        l2_leaf_reg=1.0, random_strength=0.1, border_count=64, seed=1, patience=4, tolerance=0.02,
    )
    return learn.predict(model, rows.filter("is_validation")).select("key", "label", "predicted_label")


@query
def pool_codes(spark, sf):
    """Codes of the bands of all training rows for given borders, from the written pool."""
    pool = quantised.write_pool(_training_rows(spark, sf), FOUR_BANDS, keep=["key"], borders=POOL_BORDERS)
    codes_of = (quantised.code_of(i).alias(f"code_{i}") for i in range(len(FOUR_BANDS)))
    return pool.rows.select("key", "class_index", *codes_of)


def _majority(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and the share of the commonest label, in all or by ``keys``."""
    counts = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("majority"))


@query
def grid_search(spark, sf):
    """Candidates in order, and whether their mean score is a fifth above what naming the
    commonest class would reach."""
    rows = splits.stratified_folds(_training_rows(spark, sf), "key").filter(~F.col("is_validation"))
    table, _ = learn.grid_search(
        rows, FOUR_BANDS, {"depth": [1, 7]}, algorithm="forest", iterations=20, seed=1
    )
    known = _majority(rows).select("majority").scalar()
    ranked = metrics.rank_candidates(table).withColumn("majority", known)
    return ranked.select("position", "params", "majority", (F.col("mean_test_score") >= F.col("majority") + 0.2).alias("above"))


@query
def importance(spark, sf):
    """Per band its place by either measure of importance, held against the share of rows
    whose class is the commonest one among the rows of like values."""
    rows = _training_rows(spark, sf)
    model = _forest(rows)
    by_gain = metrics.rank_importance(learn.importance_table(model, rows))
    by_change = metrics.rank_importance(learn.change_table(model, rows)).withColumnsRenamed({"importance": "change", "position": "change_position"})
    both = by_gain.join(by_change, "band")
    return both.select(
        "band",
        (F.col("position") == 1).alias("strongest"),
        (F.col("change_position") == 1).alias("moves_most"),
        (F.col("importance").between(0, 1) & F.col("change").between(0, 100)).alias("in_scale"),
    )


@query
def scenario_summary(spark, sf):
    """Test rows of each scenario, the share of their commonest class, and whether the model's
    accuracy on them is a tenth above it."""
    path = new_path(spark, "sample-table")
    kept = clean.load_clean(fixtures.keyed_wide_crop(spark, sf), by_hash=True)
    buckets = sinks.bucket_count(kept.count())
    sinks.write_bucketed_samples(kept, path, buckets)
    scored = scenarios.train_scenarios(spark.read.parquet(path), key="key", buckets=buckets, iterations=20, depth=7, seed=1)
    known = None
    for name, (_, rows) in scored.items():
        part = _majority(rows.select("label", F.lit(name).alias("scenario")), "scenario")
        known = part if known is None else known.unionByName(part)
    both = scenarios.summarise(scored).join(known, "scenario")
    return both.select("scenario", "test_rows", "majority", (F.col("accuracy") >= F.col("majority") + 0.1).alias("above"))


@query
def model_round_trip(spark, sf):
    rows = _training_rows(spark, sf)
    path = new_path(spark, "model")
    model, test = _forest(rows), rows.filter("is_validation")
    sinks.save_model(model, path)
    before = learn.predict(model, test).select("key", F.col("predicted_label").alias("before"))
    after = learn.predict(sinks.load_model(path), test).select("key", "label", "features", "probability", "predicted_label")
    out = new_path(spark, "predictions")
    sinks.write_predictions(after.join(before, "key"), out, "csv")
    back = spark.read.csv(out, header=True)
    return back.select("key", "label", (F.col("predicted_label") == F.col("before")).alias("same"))


@query
def select_model(spark, sf):
    """The whole choice of a model: hold out, search, refit, report, save."""
    rows = _training_rows(spark, sf).drop("is_validation")
    chosen = selection.select_model(
        rows, FOUR_BANDS, {"depth": [1, 7]}, "key", new_path(spark, "selection"), algorithm="forest", iterations=20, seed=1
    )
    best = metrics.best_candidate(chosen.candidates.drop("position")).select("params").scalar()
    document = chosen.results.select(  # one row
        F.size("precision").alias("n_classes"), F.aggregate("support", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("test_rows"),
        F.col("feat_importance")[0]["band"].alias("first_band"),
    )
    return document.withColumn("best", best)


# Tiles and their index.


@query
def tile_links(spark, sf):
    pages = fixtures.table(spark, sf, "pages").select("page_id", "url", "html").withColumnRenamed("url", "page")
    found = samples.list_links(pages, suffix="tion", prefix=F.col("page"))
    return found.select("page_id", F.col("position").cast("bigint").alias("position"), "url")


@query
def tile_links_all(spark, sf):
    pages = fixtures.table(spark, sf, "pages").select("page_id", "html")
    found = samples.list_links(pages, suffix="", prefix="/data/")
    return found.select("page_id", F.col("position").cast("bigint").alias("position"), "url")


@query
def epsg_names(spark, sf):
    found = tiles.with_zone(fixtures.tiles(spark, sf))
    output = naming.zone_output_name(F.col("zone"))
    return found.select(
        "seq",
        naming.normalise_epsg(F.col("srs")).alias("epsg"),
        "zone",
        output.alias("output"),
        naming.reprojected_output_name(F.concat(F.lit("http://host/dir/"), output)).alias("reprojected"),
        naming.reprojected_output_name(F.col("url")).alias("tile_output"),
    )


@query
def zone_groups(spark, sf):
    grouped = tiles.group_tiles_by_zone(fixtures.tiles(spark, sf), per_list=1000)
    return grouped.select(
        "zone", "part", F.size("urls").cast("bigint").alias("n"), F.array_join("urls", " ").alias("urls")
    )


@query
def zone_sources(spark, sf):
    return tiles.zone_sources(fixtures.tiles(spark, sf)).select("zone", "seq", "url", "xmin", "ymax")


@query
def zone_mosaic(spark, sf):
    return tiles.zone_mosaic(fixtures.tiles(spark, sf))


@query
def combined_extent(spark, sf):
    moved = tiles.reproject_extents(tiles.zone_sources(fixtures.tiles(spark, sf)))
    whole = tiles.combine_extents(moved.withColumn("n_tiles", F.lit(1)))
    return whole.select(
        *(F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "n_tiles"
    )


@query
def skip_existing(spark, sf):
    wanted = tiles.zone_mosaic(fixtures.tiles(spark, sf)).withColumn(
        "output", naming.zone_output_name(F.col("zone"))
    )
    existing = wanted.filter(F.substring("zone", -1, 1).isin("0", "2", "4", "6", "8"))
    return tiles.skip_existing(wanted, existing).select("output", "zone", "n_tiles")


@query
def window_sources(spark, sf):
    """The tiles that each window overlaps."""
    return tiles.overlaps(tiles.zone_sources(fixtures.tiles(spark, sf)), fixtures.windows(spark, sf), 4 * PIXEL_SIZE, ("seq", "url"))


@query
def window_pixels(spark, sf):
    """The mosaic of each window alone."""
    return tiles.window_pixels(_zone_pixels(spark, sf), fixtures.windows(spark, sf), PIXEL_SIZE)


# Pixels.


def _zone_pixels(spark, sf) -> DataFrame:
    return tiles.zone_sources(fixtures.pixels(spark, sf)).drop("srs")


@query
def mosaic_pixels(spark, sf):
    return raster.mosaic_pixels(_zone_pixels(spark, sf))


def _reprojected(spark, sf) -> DataFrame:
    cells = raster.mosaic_pixels(_zone_pixels(spark, sf))
    centres = cells.withColumns(
        {c: (F.col(f"p{c}") + 0.5) * PIXEL_SIZE for c in ("x", "y")}
    )
    return raster.reproject(centres)


@query
def reproject(spark, sf):
    return _reprojected(spark, sf).select(
        "zone", "px", "py", F.round("tx", 3).alias("tx"), F.round("ty", 3).alias("ty")
    )


@query
def reproject_geographic(spark, sf):
    """Points in degrees, from the cells of the zone mosaics."""
    cells = raster.mosaic_pixels(_zone_pixels(spark, sf))
    degrees = cells.withColumns(
        {
            "x": F.pmod("px", F.lit(4000)) / F.lit(100.0) - 10,
            "y": F.pmod("py", F.lit(3500)) / F.lit(100.0) + 35,
            "epsg": F.lit("EPSG4326"),
        }
    )
    return raster.reproject(degrees, zone="epsg").select(
        "zone", "px", "py", F.round("tx", 3).alias("tx"), F.round("ty", 3).alias("ty")
    )


@query
def regrid(spark, sf):
    return raster.regrid_nearest(_reprojected(spark, sf), PIXEL_SIZE)


@query
def warp_zones(spark, sf):
    return raster.warp_zones(raster.mosaic_pixels(_zone_pixels(spark, sf)), PIXEL_SIZE, PIXEL_SIZE)


@query
def warp_systems(spark, sf):
    """Tiles in UTM on WGS 84, in UTM on ETRS 89, in the target system and in none."""
    mixed = tiles.zone_sources(fixtures.mixed_pixels(spark, sf)).drop("srs")
    return raster.warp_zones(raster.mosaic_pixels(mixed), PIXEL_SIZE, PIXEL_SIZE)


@query
def combine_zones(spark, sf):
    cells = raster.warp_zones(raster.mosaic_pixels(_zone_pixels(spark, sf)), PIXEL_SIZE, PIXEL_SIZE)
    # the order comes from the tile index, one row per tile, not from the pixels
    order = tiles.zone_mosaic(fixtures.tiles(spark, sf)).select("zone", F.col("first_seq").alias("zone_seq"))
    return raster.combine_zones(cells, order)


@query
def overview_pyramid(spark, sf):
    return raster.overview_pyramid(_single_grid(spark, sf))


@query
def overview_average(spark, sf):
    """Means of whole hundredths, which are exact up to one division."""
    hundredths = F.round(F.col("value") * 100).cast("bigint")
    grid = _single_grid(spark, sf).withColumn("value", hundredths)
    return raster.overview_pyramid(grid, (128, 32, 48, 32), "average")


def _single_grid(spark, sf) -> DataFrame:
    return raster.mosaic_pixels(fixtures.pixels(spark, sf), keys=("px", "py"))


# Block rasters.


def _strips(spark, sf) -> DataFrame:
    """Zone pixels of sources that hold 2,400 pixels each, some cells of them twice."""
    return _zone_pixels(spark, sf).withColumn("seq", F.floor(F.col("seq") / 2400))


@query
def mosaic_blocks(spark, sf):
    merged = blocks.merge_blocks(blocks.to_blocks(_strips(spark, sf), side=32))
    return blocks.from_blocks(merged, side=32)


@query
def block_sizes(spark, sf):
    """Cells with data in each block of each source."""
    table = blocks.to_blocks(_strips(spark, sf), side=32)
    cells = F.filter("values", lambda v: v.isNotNull())
    return table.select("zone", "bx", "by", "seq", F.size(cells).cast("bigint").alias("n_cells"), F.array_max(cells).alias("highest"))


def _grid_blocks(grid: DataFrame) -> DataFrame:
    return blocks.to_blocks(grid.withColumn("seq", F.lit(0)), ())


@query
def block_overviews(spark, sf):
    return blocks.block_overviews(_grid_blocks(_single_grid(spark, sf)))


@query
def block_averages(spark, sf):
    """Means of whole hundredths, which are exact up to one division."""
    hundredths = F.round(F.col("value") * 100).cast("bigint")
    grid = _single_grid(spark, sf).withColumn("value", hundredths)
    return blocks.block_overviews(_grid_blocks(grid), (16, 32, 128), "average")


@query
def patched_blocks(spark, sf):
    """A combined mosaic after one zone was made anew with other values and fewer cells."""
    place = blocks.merge_blocks(blocks.to_blocks(_strips(spark, sf), side=16)).drop("seqs")
    order = tiles.zone_mosaic(fixtures.tiles(spark, sf)).select("zone", F.col("first_seq").alias("zone_seq"))
    mosaic = blocks.combine_blocks(place, order)
    old, others = place.filter("zone = 'EPSG32631'"), place.filter("zone <> 'EPSG32631'")
    anew = old.filter("by % 2 = 0").withColumn("values", F.transform("values", lambda v: v + 1))
    patched = blocks.patch_blocks(mosaic, others.unionByName(anew), order, blocks.touched_blocks(old, anew))
    return blocks.from_blocks(patched, (), side=16)


# Publishing and stages.


@query
def publish(spark, sf):
    path = new_path(spark, "published")
    sinks.publish_partitions(raster.mosaic_pixels(_zone_pixels(spark, sf)), path)
    # A second delivery, from what is published, replaces only the zones it holds.
    newer = sinks.read_published(spark, path).filter(F.col("zone") == "EPSG32630").withColumn("value", F.col("value") + 1)
    sinks.publish_partitions(newer, path)
    return sinks.read_published(spark, path)


@query
def staged_resume(spark, sf):
    base = new_path(spark, "stages")
    source = fixtures.pixels(spark, sf)
    plan = stages.mosaic_stages(PIXEL_SIZE, PIXEL_SIZE, (4, 8))
    stages.run_stages(source, plan[:3], base)
    table, ran = stages.run_stages(source, plan, base)
    if list(ran) != ["reprojected", "combined"]:
        raise RuntimeError(f"a resumed job ran {list(ran)}")
    return table


@query
def listed_mosaic(spark, sf):
    """The staged mosaic of listed tiles alone: every third tile is in no listing, and its
    pixels overlap those of listed ones."""
    tiles_table = fixtures.tiles(spark, sf)
    given = {
        "source": fixtures.pixels(spark, sf),
        "tiles": tiles_table,
        "links": tiles_table.filter(F.col("seq") % 3 != 1).select("url"),
    }
    table, _ = stages.run_stages(given, stages.mosaic_stages(PIXEL_SIZE, PIXEL_SIZE, (4, 8)), new_path(spark, "stages"))
    return table
