"""Repeatable splits, training pools and stratified folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.naming import hash_bucket, hash_share


def row_key(df: DataFrame) -> Column:
    """Key of a whole row as text: 64 bits of its values, whatever their number and type.

    Equal rows have equal keys, and different rows different ones but for one pair in
    2^64. A null differs from every value.
    """
    marks = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "n").otherwise("v") for c in df.columns))
    return F.hex(F.xxhash64(marks, *(F.col(f"`{c}`") for c in df.columns)))


def split_random(
    df: DataFrame, shares: Sequence[float] = (0.7, 0.3), seed: int = 24
) -> list[DataFrame]:
    """Spark's own random split. Which row goes where depends on the partitioning."""
    return df.randomSplit(list(shares), seed=seed)


def split_hash(
    df: DataFrame, key: str, test_share: float = 0.3, seed: int | str = 190, out: str = "is_test"
) -> DataFrame:
    """Flag a stable share of rows by the hash of their key. No shuffle, any partitioning."""
    return df.withColumn(out, hash_share(F.col(key), test_share, seed))


def make_pools(train: DataFrame, evaluation: DataFrame, out: str = "is_validation") -> DataFrame:
    """Both pools as one frame with a flag, the form the tree learners watch."""
    return train.withColumn(out, F.lit(False)).unionByName(evaluation.withColumn(out, F.lit(True)))


def hash_folds(df: DataFrame, key: str, k: int = 3, seed: int | str = "fold") -> DataFrame:
    """Fold by key hash: no shuffle, folds of a class equal in expectation."""
    return df.withColumn("fold", hash_bucket(F.col(key), k, seed))


def stratified_folds(
    df: DataFrame, key: str, label: str = "label", k: int = 3, bits: int = 16
) -> DataFrame:
    """Exact folds: per class, ``k`` runs in key-hash order whose sizes differ by at most 1.

    Gives what ``ntile(k) over (partition by label order by hash, key)`` gives, less
    one, for the first 60 bits of the key's md5 as the hash, without putting a class
    into one task. Rows are ranked inside slices of the hash; slice sizes, counted
    before the shuffle, give every slice its first rank. ``key`` must be unique, as
    ``row_key`` is after ``drop_duplicate_samples``.
    """
    word = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    # Never null, or the join would add a filter that computes the hash once more.
    word = F.coalesce(word, F.lit(0).cast("bigint"))
    hashed = df.withColumn("_hash", word)
    # The slice comes first wherever rows are sorted: it tells rows apart best.
    parts = ["_slice", label]
    hashed = hashed.withColumn("_slice", F.shiftright("_hash", 60 - bits))
    if df.schema[label].nullable:
        # A null label is a class of its own; a key that is never null lets the join
        # below use the partitioning of the window as it is.
        parts = ["_slice", "_class"]
        named = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
        hashed = hashed.withColumn("_class", named)
    sizes = hashed.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size"))
    up_to = Window.partitionBy(parts[1]).orderBy("_slice")
    starts = sizes.select(
        *parts,
        (F.sum("_size").over(up_to) - F.col("_size")).alias("_start"),
        F.sum("_size").over(Window.partitionBy(parts[1])).alias("_total"),
    )
    in_slice = Window.partitionBy(*parts).orderBy("_hash", key)
    joined = hashed.withColumn("_row", F.row_number().over(in_slice) - 1).join(starts, parts)
    rank, total = F.col("_start") + F.col("_row"), F.col("_total")
    # The first total % k folds hold one row more than the others.
    small, large = F.floor(total / k), total % k
    in_large = large * (small + 1)
    fold = F.when(rank < in_large, F.floor(rank / (small + 1))).otherwise(
        large + F.floor((rank - in_large) / F.greatest(small, F.lit(1)))
    )
    return joined.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")
