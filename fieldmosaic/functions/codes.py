"""Crop codes, class schemes, strata and feature names, and the columns made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes left out of training, per scheme.
EXCLUDED_TYPE_CODES = (0, 1000, 991, 9998)
EXCLUDED_SEASON_CODES = (0, 1000, 991, 9998, 1100, 1500, 1900)

# Class -> crop codes, by crop type.
TYPE_CLASSES = {
    "1100": (1100, 1110, 1120),  # wheat
    "1500": (1500, 1510, 1520),  # barley
    "1900": (1900, 1910, 1920),  # cereal
    "1200": (1200,),  # maize
    "4350": (4350, 4351, 4352),  # rapeseed
    "5100": (5100,),  # potatoes
    "8100": (8100,),  # sugar beet
    "9100": (9100, 9110, 9120),  # grass
}

# Class -> crop codes, by season.
SEASON_CLASSES = {
    "1910": (1110, 1510, 1910),  # winter cereals
    "1920": (1120, 1520, 1920),  # spring cereals
    "1200": (1200,),
    "4350": (4350, 4351, 4352),
    "5100": (5100,),
    "8100": (8100,),
    "9100": (9100, 9110, 9120),
}

# Fixed value: class of every code that no scheme lists.
OTHER_CLASS = "0"

# Satellite layers and the statistics taken of each.
OPTICAL_LAYERS = ("B06", "B12", "NDVI", "NDMI", "NDGI", "NDRE1", "NDRE2", "NDRE5", "ANIR")
OPTICAL_STATS = ("p25", "p50", "p75", "sd", "t4", "t7", "t10", "t13", "t16", "t19")
RADAR_LAYERS = ("ratio", "VH", "VV")
RADAR_STATS = ("p25", "p50", "p75", "sd", "t2", "t5", "t8", "t11", "t14", "t17")

# Layers of the small feature set, with all or only summary statistics.
SMALL_OPTICAL_LAYERS = ("B06", "B12", "ANIR", "NDGI")
SMALL_RADAR_LAYERS = ("VV", "VH")
SMALL_SUMMARY_LAYERS = ("ratio", "NDVI", "NDRE1", "NDRE2", "NDRE5")
SUMMARY_STATS = ("sd", "p25", "p50", "p75")


def feature_names() -> list[str]:
    """The 120 band features, layer by layer, optical before radar."""
    return [
        f"{layer}_{stat}"
        for layers, stats in ((OPTICAL_LAYERS, OPTICAL_STATS), (RADAR_LAYERS, RADAR_STATS))
        for layer in layers
        for stat in stats
    ]


def small_feature_names() -> list[str]:
    """The 80 features of the reduced set."""

    def summary_first(stats: Sequence[str]) -> list[str]:
        return [*SUMMARY_STATS, *(s for s in stats if s not in SUMMARY_STATS)]

    plan = (
        (SMALL_OPTICAL_LAYERS, summary_first(OPTICAL_STATS)),
        (SMALL_RADAR_LAYERS, summary_first(RADAR_STATS)),
        (SMALL_SUMMARY_LAYERS, SUMMARY_STATS),
    )
    return [f"{layer}_{stat}" for layers, stats in plan for layer in layers for stat in stats]


def feature_name_table(spark: SparkSession) -> DataFrame:
    """``feature_names()`` as rows ``(position, layer, stat, feature)``."""
    groups = F.array(
        *(
            F.struct(F.lit(layer).alias("layer"), F.array(*map(F.lit, stats)).alias("stats"))
            for layers, stats in ((OPTICAL_LAYERS, OPTICAL_STATS), (RADAR_LAYERS, RADAR_STATS))
            for layer in layers
        )
    )
    return (
        spark.range(1)
        .select(F.posexplode(groups).alias("g", "group"))
        .select("g", "group.layer", F.posexplode("group.stats").alias("s", "stat"))
        .select(
            (F.col("g") * len(OPTICAL_STATS) + F.col("s")).alias("position"),
            "layer",
            "stat",
            F.concat_ws("_", "layer", "stat").alias("feature"),
        )
    )


def class_of(code: Column, classes: Mapping[str, Sequence[int]]) -> Column:
    """Class text of a crop code; unlisted and null codes give the other class."""
    branches = F
    for name, codes in classes.items():
        branches = branches.when(code.isin(*codes), F.lit(name))
    return branches.otherwise(F.lit(OTHER_CLASS))


def label_by_crop_type(code: Column) -> Column:
    return class_of(code, TYPE_CLASSES)


def label_by_season(code: Column) -> Column:
    return class_of(code, SEASON_CLASSES)


def label_by_crop_type_int(code: Column) -> Column:
    return label_by_crop_type(code).cast("int")


def class_table(spark: SparkSession, classes: Mapping[str, Sequence[int]]) -> DataFrame:
    """A scheme as rows ``(id, label)``, the form ``label_from_table`` joins."""
    rows = [(code, name) for name, codes in classes.items() for code in codes]
    return spark.createDataFrame(rows, "id int, label string")
