"""Operator 9: sharding along a Hilbert curve over document metadata.

Each metadata dimension is quantised into ``2**BITS`` buckets at its quantiles (a string's bucket follows the share of
rows with lesser strings, whole strings compared), the buckets' place on a Hilbert curve is
the document's index, and the order of the indexes is cut into runs of equal row counts. A run covers a
compact region of the metadata space, so files pruned by their minimum and maximum are pruned in all
dimensions at once. Ties are ordered by the text's checksum, so that equal texts lie together, then by
doc_id. Law: ``rows`` (shard sizes differ by one at most).

Ranks are global without a global task: rows are dealt by range of (index, checksum, doc_id), a hot index
is cut by the other two, and each range gets the total of the ranges before it.

Cases: null metadata is a bucket below all others; a null text has size 1 and checksum 0; repeated rows each get
a slot; an empty table gives no rows; other columns are ignored (``write_shards`` keeps them, one named ``shard`` as
``shard_``, as the folders bear that name).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrovox.llm.common import free_name, small_side, table
from dendrovox.plans.iterate import materialize

SHARDS, BITS = 16, 5
DIMENSIONS = ("source", "lang", "n_chars")
#: Rows of a range of the last sort, about; at least MIN_RANGES ranges.
RANGE_ROWS, MIN_RANGES = 100_000, 64


def hilbert_index(axes: list[pd.Series], bits: int) -> pd.Series:
    """Place on the Hilbert curve of points with integer coordinates below ``2**bits``.

    Each level of the curve is a rotation (an exchange or a reflection of axes) that depends on the level
    above it; the transposed index is then interleaved, the first axis leading (Skilling 2004).
    """
    x = [a.to_numpy("int64").copy() for a in axes]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = ((x[0] ^ x[i]) & low) * ~flip
            x[0] = (x[0] ^ (low * flip)) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold = x[n - 1] * 0
    for level in range(bits - 1, 0, -1):
        fold ^= ((1 << level) - 1) * ((x[n - 1] >> level) & 1)
    out = x[0] * 0
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ fold) >> level) & 1)
    return pd.Series(out)


def _is_text(docs: DataFrame, name: str) -> bool:
    return dict(docs.dtypes)[name] in ("string", "binary")


def _ranked(df: DataFrame, order: list[str], rows: int, weight) -> DataFrame:
    """``df`` with ``before``: the weight of the rows before it in ``order``; by ranges, each of which gets the total before it."""
    ranged = materialize(df.repartitionByRange(max(MIN_RANGES, -(-rows // RANGE_ROWS)), *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum(weight).alias("weight"))  # a row for each range
    before = totals.select("part", (F.sum("weight").over(Window.orderBy("part")) - F.col("weight")).alias("_before"))
    within = F.sum(weight).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "part").withColumn("before", F.col("_before") + F.col("_within")).drop("part", "_before", "_within")


def _text_buckets(plain: DataFrame, name: str, bits: int) -> DataFrame:
    """``name, bucket`` of each different string."""
    values = materialize(plain.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")), "values")
    rows, total = values.agg(F.count(F.lit(1)), F.sum("n")).first()
    ranked = _ranked(values, [name], rows, F.col("n"))
    return materialize(ranked.select(name, F.floor(F.col("before") * (1 << bits) / F.lit(total or 1)).cast("int").alias("bucket")), "buckets")


def hilbert_keys(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, index`` of each row. Quantiles are over all rows (of numbers by Greenwald and Khanna)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    value = lambda d: F.col(d) if _is_text(docs, d) else F.col(d).cast("double")
    plain = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), *[value(d).alias(f"d{k}") for k, d in enumerate(dimensions)])
    plain = materialize(plain, "metadata")
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [k for k, d in enumerate(dimensions) if not _is_text(docs, d)]
    cuts = plain.agg(F.lit(0), *[F.percentile_approx(f"d{k}", share, 10_000) for k in numbers]).first()
    for k in range(len(dimensions)):
        if k in numbers:
            known = sorted(set(cuts[1 + numbers.index(k)] or []))
            below = sum(((F.col(f"d{k}") > c).cast("int") for c in known), F.lit(0))
            plain = plain.withColumn(f"b{k}", F.when(F.col(f"d{k}").isNull(), 0).otherwise(below).cast("int"))
        else:
            plain = plain.join(small_side(_text_buckets(plain, f"d{k}", bits).withColumnRenamed("bucket", f"b{k}")), f"d{k}", "left")
    place = F.pandas_udf(lambda *axes: hilbert_index(list(axes), bits), "long")
    cell = plain.select("doc_id", "size", "text_crc32", *[F.coalesce(f"b{k}", F.lit(0)).alias(f"b{k}") for k in range(len(dimensions))])
    return cell.select("doc_id", "size", "text_crc32", place(*[f"b{k}" for k in range(len(dimensions))]).alias("index"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, index, shard, slot`` of each row of ``docs``."""
    keys = materialize(hilbert_keys(docs, dimensions, bits), "keys")
    rows = keys.count()
    ranked, total, rank = _ranked(keys, ["index", "text_crc32", "doc_id"], rows, F.lit(1)), F.lit(rows), F.col("before")
    shard = F.floor(rank * shards / total)
    first = F.ceil(shard * total / shards)
    return ranked.select("doc_id", "size", "text_crc32", "index", shard.cast("int").alias("shard"), (rank - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Write whole rows of ``docs`` as ``path/shard=K``, in the order of their slots; returns the assignment.

    A shard's rows are cut into ranges of slots, so no task holds a whole shard. doc_id must be unique here.
    """
    found = materialize(assign_shards(docs, shards, dimensions), "shards")
    rows = docs.withColumnRenamed("shard", "shard_") if "shard" in docs.columns else docs
    slot = free_name(rows, "slot")
    placed = rows.join(small_side(found.select("doc_id", "shard", F.col("slot").alias(slot))), "doc_id")
    dealt = placed.repartitionByRange(4 * shards, "shard", slot).sortWithinPartitions("shard", slot).drop(slot)
    dealt.write.partitionBy("shard").parquet(path)
    return found


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("index").alias("curve_index"))
