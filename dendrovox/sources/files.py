"""Sources and sinks: manifests, voxel tables, tree and marker texts, catalogs, sidecars, predecessor and path stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.functions.grid import flip_y

VOXELS = "volume_id long, z int, y int, x int, intensity int"
CATALOG = "ID long, full_name string, nnunet_name string, spacing string, img_size string, v3draw_path string"


def scan_manifest(spark: SparkSession, root: str, suffix: str = ".v3draw") -> DataFrame:
    """``path, name, length`` of the files with a suffix below a folder, but those named with ``_i`` or ``_p``, sorted by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return manifest_rows(found.select("path", "length"))


def manifest_rows(files: DataFrame) -> DataFrame:
    named = files.withColumn("name", F.substring_index("path", "/", -1))
    return named.where(~F.col("name").contains("_i") & ~F.col("name").contains("_p")).orderBy("path")


def read_voxels(spark: SparkSession, path: str, schema: str = VOXELS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_voxels(vox: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet by bucket of volume, each file sorted, so that a volume's scan skips other files and row groups."""
    bucket = F.pmod(F.xxhash64("volume_id"), F.lit(buckets)).cast("int")
    vox.withColumn("bucket", bucket).repartition("bucket", "volume_id").sortWithinPartitions("volume_id", "z", "y", "x").write.partitionBy("bucket").parquet(path)


def parse_swc(lines: DataFrame) -> DataFrame:
    """Node rows from text rows ``tree_id, line, value``; comment and blank lines are dropped."""
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kept = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).withColumn("_t", t)
    num = lambda k, kind: F.get("_t", F.lit(k)).try_cast("double").cast(kind)
    return kept.select("tree_id", "line", num(0, "long").alias("n"), num(1, "int").alias("type"), *[num(k + 2, "double").alias(c) for k, c in enumerate("xyzr")], num(6, "long").alias("parent"))


def read_swc(spark: SparkSession, glob: str) -> DataFrame:
    """Node rows with ``tree_id`` (the file's path) and ``line``. A file is one tree, read whole to keep its line order."""
    text = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("tree_id"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_swc(text)


def swc_lines(nodes: DataFrame, number_offset: int = 0, reverse_y: DataFrame | None = None) -> DataFrame:
    """``tree_id, n, value``: nodes as text. Optional shift of the ids, and reversal of y by volume height (``tree_id, height``)."""
    at = nodes
    if reverse_y is not None:
        at = at.join(reverse_y.select("tree_id", "height"), "tree_id").withColumn("y", flip_y(F.col("y"), F.col("height"), "h"))
    n = F.col("n") + number_offset
    parent = F.when(F.col("parent") == -1, -1).otherwise(F.col("parent") + number_offset)
    value = F.format_string("%d %d %.3f %.3f %.3f %.3f %d", n, F.col("type"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"), F.col("r").cast("double"), parent)
    return at.select("tree_id", n.alias("n"), value.alias("value"))


def write_swc(nodes: DataFrame, path: str, mode: str = "overwrite", number_offset: int = 0, reverse_y: DataFrame | None = None) -> None:
    """Text files ``path/tree_id=K``, nodes in order; ``mode`` is overwrite or append."""
    dealt = swc_lines(nodes, number_offset, reverse_y).repartition("tree_id").sortWithinPartitions("tree_id", "n")
    dealt.select("tree_id", "value").write.mode(mode).partitionBy("tree_id").text(path)


def parse_markers(lines: DataFrame, scale: float = 1.0, truncate: bool = False) -> DataFrame:
    """Marker rows from ``image_id, line, value``; comment and blank lines dropped, coordinates scaled (and truncated)."""
    t = F.split("value", ",")
    kept = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).withColumn("_t", t)

    def number(k: int) -> Column:
        v = F.trim(F.get("_t", F.lit(k))).try_cast("double") * scale
        return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double") if truncate else v

    color = F.struct(*[F.trim(F.try_element_at("_t", F.lit(k + 8))).try_cast("int").alias(c) for k, c in enumerate("rgb")])
    return kept.select("image_id", F.col("line").alias("ord"), *[number(k).alias(c) for k, c in enumerate("xyz")], F.trim(F.get("_t", F.lit(3))).try_cast("double").alias("r"), color.alias("color"))


def read_markers(spark: SparkSession, glob: str, scale: float = 1.0, truncate: bool = False) -> DataFrame:
    text = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("image_id"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_markers(text, scale, truncate)


def marker_lines(markers: DataFrame) -> DataFrame:
    """``image_id, ord, value`` of markers with ``main``: the main one red, the others green."""
    color = F.when(F.col("main"), "255,0,0").otherwise("0,255,0")
    value = F.concat(F.format_string("%.3f, %.3f, %.3f, 1, 1, , , ", "x", "y", "z"), color)
    return markers.select("image_id", "ord", value.alias("value"))


def write_markers(markers: DataFrame, path: str) -> None:
    dealt = marker_lines(markers).repartition("image_id").sortWithinPartitions("image_id", "ord")
    dealt.select("image_id", "value").write.mode("overwrite").partitionBy("image_id").text(path)


def catalog_text(catalog: DataFrame) -> DataFrame:
    """The catalog with its structs as the texts that the CSV form holds."""
    triple = lambda c: F.concat(F.lit("("), F.concat_ws(", ", *[F.col(f"{c}.{a}").cast("string") for a in "zyx"]), F.lit(")"))
    return catalog.withColumns({"spacing": triple("spacing"), "img_size": triple("img_size")})


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog_text(catalog).orderBy("ID").write.mode("overwrite").option("header", "true").csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("header", "true").csv(path)


def read_key_list(spark: SparkSession, path: str, column: str = "ID", kind: str = "csv") -> DataFrame:
    """``id`` out of a CSV or Parquet sheet."""
    found = spark.read.option("header", "true").csv(path) if kind == "csv" else spark.read.parquet(path)
    return found.select(F.col(column).cast("long").alias("id"))


def spacing_sidecar(catalog: DataFrame) -> DataFrame:
    """``name, value``: the sidecar text ``{"spacing":[z,y,x]}`` of each image."""
    return catalog.select(F.col("nnunet_name").alias("name"), F.to_json(F.struct(F.array("spacing.z", "spacing.y", "spacing.x").alias("spacing"))).alias("value"))


#: Sidecars that a task writes, about. Each is a file of its own, so it is their number that takes time, not their bytes.
SIDECARS = 500


def write_spacing(catalog: DataFrame, path: str) -> None:
    sidecars = spacing_sidecar(catalog)
    tasks = 1 + sidecars.count() // SIDECARS
    sidecars.repartition(tasks, "name").write.mode("overwrite").partitionBy("name").text(path)


def save_predecessor(pred: DataFrame, path: str) -> None:
    """A folder for each volume, a file for each 64 planes of it."""
    found = pred.where("pred_code <> -1").select("volume_id", "z", "y", "x", "pred_code")
    found.repartition("volume_id", F.floor(F.col("z") / 64)).write.mode("overwrite").partitionBy("volume_id").parquet(path)


def load_predecessor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("volume_id long, z int, y int, x int, pred_code int").parquet(path)


#: Path points in a file, about.
POINTS = 1_000_000


def save_paths(paths: DataFrame, path: str) -> None:
    """A folder for each volume, of one file for each million of its points; a path lies in one file."""
    shares = paths.groupBy("volume_id").agg((1 + F.floor(F.count(F.lit(1)) / POINTS)).alias("_shares"))
    dealt = paths.join(shares, "volume_id").withColumn("_share", F.pmod(F.xxhash64("path_id"), F.col("_shares")))
    dealt.repartition("volume_id", "_share").drop("_shares", "_share").write.mode("overwrite").partitionBy("volume_id").parquet(path)


def load_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pending(manifest: DataFrame, *outputs: DataFrame) -> DataFrame:
    """Items of which any output (each a table of ``name``) is missing; a partial result counts as none."""
    out = manifest
    for k, o in enumerate(outputs):
        out = out.join(o.select("name", F.lit(True).alias(f"_o{k}")).distinct(), "name", "left")
    missing = [F.col(f"_o{k}").isNull() for k in range(len(outputs))]
    found = missing[0]
    for m in missing[1:]:
        found = found | m
    return out.where(found).select(manifest.columns)
