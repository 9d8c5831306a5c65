"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1_000_000


def remainder(of: int) -> Column:
    """crc32 of the document id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` (0 or 1) of about ``rows`` labelled documents, all of
    them while there are fewer.

    ``train`` says which document ids may be learned from. The sample takes the ids whose
    hash is below a share of its range, so it doesn't depend on partitions. Rows without an
    id or label are left out; of several labels of an id the largest counts. The sampled
    labels are broadcast, their number being bounded by ``rows`` (within a few percent).
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    count = known.count()
    if count > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < F.lit(int(_SCALE * rows / count)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
