"""Row filters, casts and projections of the sample table."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmosaic.functions.codes import EXCLUDED_TYPE_CODES


def drop_duplicate_samples(df: DataFrame, by_hash: bool = False) -> DataFrame:
    """Full-row distinct. Copies merge before the shuffle, so a hot row costs one row a task.

    ``by_hash`` is for wide rows that rarely come twice: a job that runs while the plan is
    built counts 64 bits of every row. Only where some come more than once are rows shuffled
    and compared whole. ``df`` is read again and must give the same rows.
    """
    if by_hash:
        bits = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
        counts = df.select(bits.alias("_bits")).groupBy("_bits").agg(F.count(F.lit(1)).alias("n"))
        if counts.where("n > 1").isEmpty():
            return df
    return df.dropDuplicates()


def drop_null_samples(df: DataFrame) -> DataFrame:
    """Drop rows with a null or NaN anywhere."""
    return df.dropna(how="any")


def require_band(df: DataFrame, band: str = "B06_p50") -> DataFrame:
    value = F.col(band)
    return df.filter(value.isNotNull() & ~F.isnan(value))


def cast_strata(df: DataFrame, columns: Sequence[str] = ("groupID", "zoneID")) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def cast_all_int(df: DataFrame) -> DataFrame:
    """Every number truncated toward zero to a long; text columns pass through."""
    return df.select(
        *(
            F.col(f"`{f.name}`").cast("bigint").alias(f.name)
            if isinstance(f.dataType, T.NumericType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


def exclude_codes(df: DataFrame, codes: Sequence[int] = EXCLUDED_TYPE_CODES) -> DataFrame:
    """Rows whose code is not listed. A null code is not listed, so it stays.

    Written as ``null or not in`` rather than with coalesce: this form is one the
    Parquet reader takes as a pushed filter.
    """
    code = F.col("id")
    return df.filter(code.isNull() | ~code.isin(*codes))


def filter_stratum(df: DataFrame, groups: Sequence[int]) -> DataFrame:
    return df.filter(F.col("groupID").isin(*groups))


def band_names(df: DataFrame) -> list[str]:
    """Model features of a sample table: every column but the crop code."""
    return [c for c in df.columns if c != "id"]


def select_features(df: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    return df.select(*(f"`{n}`" for n in names), label)


def load_clean(df: DataFrame, integers: bool = False, by_hash: bool = False) -> DataFrame:
    """Duplicates out, then nulls out, then casts, in this order.

    Both filters and the ones callers add are functions of the row, so Catalyst
    moves them below the distinct and the shuffle carries only kept rows. ``by_hash`` is
    the one of ``drop_duplicate_samples``.
    """
    kept = df.transform(drop_duplicate_samples, by_hash).transform(drop_null_samples)
    return kept.transform(cast_all_int if integers else cast_strata)


def missing_as_lowest(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Nulls and NaN of double and float features as the lowest of their type, for tree
    learners only.

    The variant that requires one band keeps rows with others missing; a tree then
    sees a missing value as below every real one.
    """
    lowest = {T.DoubleType: -sys.float_info.max, T.FloatType: -3.4028234663852886e38}
    missing = {
        f.name: F.when(F.col(f"`{f.name}`").isNull() | F.isnan(f"`{f.name}`"), F.lit(lowest[type(f.dataType)]).cast(f.dataType))
        .otherwise(F.col(f"`{f.name}`"))
        for f in df.schema
        if type(f.dataType) in lowest and f.name in set(bands)
    }
    return df.withColumns(missing) if missing else df


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows; with ``order_by`` a top-n that keeps n rows a task."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
