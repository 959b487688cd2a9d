"""What the two classifiers share: which labelled rows they may learn from, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents a fit takes at most: those with the least hash of doc_id. A bound on the fit only.
MAX_LABELLED = 12_000


def held_out(doc_id="doc_id") -> F.Column:
    """Rows no label of which is learnt: crc32 of doc_id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def training_labels(labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, y`` of at most ``limit`` documents; one that is labelled both ways is left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("high")).where("y = high")
    return one.select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
