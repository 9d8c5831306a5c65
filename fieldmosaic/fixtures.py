"""Sample, tile and pixel tables derived from the given tables.

Each table is a list of ``(expression, name)`` pairs in SQL both Spark and the
checking engine read, so queries and their checks share one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmosaic.functions.codes import feature_names

# Codes dealt out to the sample rows, by quantity.
SAMPLE_CODES = (
    1100, 1110, 1120, 1200, 1500, 1510, 1520, 1900, 1910, 1920, 4350, 4351,
    4352, 5100, 8100, 9100, 9110, 9120, 0, 1000, 991, 9998,
)

_CODE_CASES = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SAMPLE_CODES))

# Unique over lineitem at all scales; money in cents, so both engines write it alike.
KEY = (
    "concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), "
    "CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), "
    "CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)), "
    "CAST(CAST(floor(l_extendedprice * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR(20)), "
    "CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)))"
)

CROP = (
    (f"CASE CAST(floor((l_quantity-1)*23/50) AS INT) {_CODE_CASES} ELSE 3000 END", "id"),
    (
        "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 46000 WHEN 1 THEN 22000 "
        "WHEN 2 THEN 43000 ELSE 6000 END",
        "groupID",
    ),
    ("CAST(l_suppkey % 7 AS INT)", "zoneID"),
    ("CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity * CAST(100 AS DOUBLE) END", "B06_p50"),
    ("l_quantity * l_discount", "B06_sd"),
    ("l_extendedprice / CAST(100 AS DOUBLE)", "NDVI_p50"),
    ("l_tax * CAST(1000 AS DOUBLE)", "VV_p50"),
)

_NAMED = {name: expression for expression, name in CROP}

# All 120 bands: the four above, the others by rule from quantity, price and tax.
WIDE = CROP[:3] + tuple(
    (
        _NAMED.get(
            name,
            f"l_quantity * CAST({i + 1} AS DOUBLE) + l_extendedprice / CAST({1000 + i} AS DOUBLE)"
            f" - l_tax * CAST({i % 10} AS DOUBLE)",
        ),
        name,
    )
    for i, name in enumerate(feature_names())
)

TILES = (
    ("event_id", "seq"),
    (
        "concat('tile_', CAST(event_id AS VARCHAR(20)), "
        "CASE WHEN event_id % 5 = 0 THEN '.vrt' ELSE '.tif' END)",
        "url",
    ),
    # Every 11th tile has no readable coordinate system.
    (
        "CASE WHEN event_id % 11 = 10 THEN '' "
        "ELSE concat('EPSG: 326', CAST(29 + CAST(floor(event_id / CAST(120 AS DOUBLE)) AS BIGINT) % 7 AS VARCHAR(20))) END",
        "srs",
    ),
    ("CAST(200000 + (event_id % 60) * 10000 AS DOUBLE)", "xmin"),
    ("CAST(4000000 + (CAST(floor(event_id / CAST(100 AS DOUBLE)) AS BIGINT) % 200) * 10000 AS DOUBLE)", "ymin"),
    ("CAST(210000 + (event_id % 60) * 10000 AS DOUBLE)", "xmax"),
    ("CAST(4010000 + (CAST(floor(event_id / CAST(100 AS DOUBLE)) AS BIGINT) % 200) * 10000 AS DOUBLE)", "ymax"),
)

# Pixels of 10 km in zone grids: sources of a zone overlap, zones overlap, some hold no data.
PIXELS = (
    ("event_id", "seq"),
    (TILES[2][0], "srs"),
    ("20 + event_id % 60", "px"),
    ("400 + CAST(floor(event_id / CAST(600 AS DOUBLE)) AS BIGINT) % 200", "py"),
    ("CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END", "value"),
)

# The same with every other tile in UTM on ETRS 89 or in the target system itself.
MIXED_PIXELS = (
    PIXELS[0],
    (
        "CASE WHEN event_id % 11 = 10 THEN '' WHEN event_id % 4 = 1 THEN concat('EPSG: 258', CAST(29 + event_id % 7 AS VARCHAR(20))) "
        "WHEN event_id % 4 = 3 THEN 'EPSG: 3035' ELSE concat('EPSG: 326', CAST(29 + event_id % 7 AS VARCHAR(20))) END",
        "srs",
    ),
    *PIXELS[2:],
)

# Windows on zones, one per supplier: from a cell to some hundred kilometres wide.
WINDOWS = (
    ("s_suppkey", "window"),
    ("concat('EPSG326', CAST(29 + s_suppkey % 7 AS VARCHAR(20)))", "zone"),
    ("CAST(195000 + (s_suppkey * 37 % 60) * 10000 AS DOUBLE)", "xmin"),
    ("CAST(3995000 + (s_suppkey * 53 % 40) * 10000 AS DOUBLE)", "ymin"),
    ("CAST(205000 + (s_suppkey * 37 % 60) * 10000 + (s_suppkey % 6) * (s_suppkey % 6) * 15000 AS DOUBLE)", "xmax"),
    ("CAST(4010000 + (s_suppkey * 53 % 40) * 10000 + (s_suppkey % 5) * 40000 AS DOUBLE)", "ymax"),
)

# Whole numbers of 16 digits, beyond what a double holds.
SERIAL = ("9007199254740993 + 2 * l_orderkey", "serial")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{expression} AS `{name}`" for expression, name in pairs))


def derive_sql(source: str, *pairs: tuple[str, str]) -> str:
    columns = ", ".join(f'{expression} AS "{name}"' for expression, name in pairs)
    return f"SELECT {columns} FROM {source}"


def crop(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    pairs = (*CROP, (KEY, "key")) if keyed else CROP
    return derive(table(spark, sf_dir, "lineitem"), *pairs)


def wide_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "lineitem"), *WIDE)


def keyed_wide_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "lineitem"), *WIDE, (KEY, "key"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), *TILES)


def mixed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), *MIXED_PIXELS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), *PIXELS)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "supplier"), *WINDOWS)
