"""Text columns of the mosaic job: coordinate-system codes, output names, hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the common coordinate system of the combined mosaic.
TARGET_EPSG = "EPSG3035"

# Zone of tiles whose coordinate system could not be read.
UNKNOWN_ZONE = "unknown"


def normalise_epsg(srs: Column) -> Column:
    """``'EPSG: 32631\\n'`` -> ``'EPSG32631'``."""
    return F.translate(srs, " \n:", "")


def zone_of(srs: Column) -> Column:
    """Normalised code, or the explicit unknown zone for anything that is no code."""
    code = normalise_epsg(srs)
    return F.when(code.rlike("^EPSG[0-9]+$"), code).otherwise(F.lit(UNKNOWN_ZONE))


def zone_output_name(epsg: Column) -> Column:
    return F.concat(epsg, F.lit(".vrt"))


def reprojected_output_name(url: Column, target: str = TARGET_EPSG) -> Column:
    """Last URL segment, its ``.vrt`` marked with the target system."""
    return F.replace(F.substring_index(url, "/", -1), F.lit(".vrt"), F.lit(f"_{target}.vrt"))


def _hash_word(key: Column, seed: int | str) -> Column:
    """First 32 bits of the md5 of the (seeded) key as eight hex digits."""
    text = F.concat(F.lit(f"{seed}:"), key) if seed != "" else key
    return F.substring(F.md5(text), 1, 8)


def hash_share(key: Column, share: float, seed: int | str = "") -> Column:
    """True for the given share of keys: those whose hash lies in its upper end.

    Hex digits of one length sort like the numbers they stand for, so the hash is
    compared as text and never converted. It depends on the key alone and so
    survives repartitioning and recomputation.
    """
    first = round((1 - share) * 2**32)
    if first >= 2**32:
        return F.lit(False)
    return _hash_word(key, seed) >= F.lit(f"{first:08x}")


def hash_bucket(key: Column, buckets: int, seed: int | str = "") -> Column:
    """Bucket 0..buckets-1 by equal ranges of the key's hash; for few buckets."""
    word = _hash_word(key, seed)
    # A sum, not nested cases: every term is evaluated, so the hash is computed once.
    bucket = F.lit(0)
    for i in range(1, buckets):
        bound = -(-i * 2**32 // buckets)
        bucket = bucket + (word >= F.lit(f"{bound:08x}")).cast("int")
    return bucket
