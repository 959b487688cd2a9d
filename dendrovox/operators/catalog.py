"""Relational operators on catalogs of images, markers and trees: tables of ``id, name``.

A name is a file name; its stem is the part before the last dot, its id the number before the first underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stem(name) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def name_id(name) -> Column:
    """The number before the first underscore; null if it is none."""
    return F.split(name, "_")[0].try_cast("bigint")


def _first(df: DataFrame, by: list, *order) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """``name, side`` of the names that one side only has (``a`` or ``b``)."""
    x = a.select("name", F.lit(1).alias("_a")).distinct().join(b.select("name", F.lit(1).alias("_b")).distinct(), "name", "full_outer")
    return x.where("_a is null or _b is null").select("name", F.when(F.col("_b").isNull(), "a").otherwise("b").alias("side"))


def spacing_from_name(names: DataFrame) -> DataFrame:
    """``names`` with ``spacing`` (z, y, x): from the first ``R``-number token if the name has ``_P``, ``_T`` and ``_R``, else null."""
    token = F.try_element_at(F.filter(F.split("name", "_"), lambda t: (F.length(t) > 2) & t.rlike("^R[0-9]+$")), F.lit(1))
    r = F.coalesce(F.substring(token, 2, 20).cast("double"), F.lit(1000.0))
    named = F.col("name").contains("_P") & F.col("name").contains("_T") & F.col("name").contains("_R")
    return names.withColumn("spacing", F.when(named, F.struct(F.lit(1.0).alias("z"), (r / 1000).alias("y"), (r / 1000).alias("x"))))


def spacing_lookup(names: DataFrame, raw_info: DataFrame, strict: bool = False) -> DataFrame:
    """``names`` with ``spacing``, by ``number`` = what stands before the name's first dot, as a number; (1, 1, 1) where it is
    unknown or no number, or no row if ``strict`` (which takes whole numbers only).
    """
    known = raw_info.select(F.col("number").cast("double").alias("_number"), "resolution")
    number = F.trim(F.split("name", r"\.")[0]).try_cast("long" if strict else "double").cast("double")
    at = names.withColumn("_number", number).join(known, "_number", "inner" if strict else "left")
    r = F.coalesce(F.col("resolution") / 1000, F.lit(1.0))
    return at.select(*names.columns, F.struct(F.lit(1.0).alias("z"), r.alias("y"), r.alias("x")).alias("spacing"))


def resolve_markers(images: DataFrame, markers: DataFrame, id_compare: str = "int") -> DataFrame:
    """``id, name, marker``: the marker file of the same stem, else the first of the same id (as number or text), else null."""
    key = (lambda c: name_id(c)) if id_compare == "int" else (lambda c: F.split(c, "_")[0])
    i = images.select("id", "name", stem(F.col("name")).alias("_stem"), key(F.col("name")).alias("_key"))
    m = markers.select(F.col("name").alias("marker"))
    exact = _first(m.withColumn("_stem", stem(F.col("marker"))), ["_stem"], "marker").withColumnRenamed("marker", "_exact")
    near = m.withColumn("_key", key(F.col("marker"))).groupBy("_key").agg(F.min("marker").alias("_near"))
    return i.join(exact, "_stem", "left").join(near, "_key", "left").select("id", "name", F.coalesce("_exact", "_near").alias("marker"))


def soma_policy(images: DataFrame, markers: DataFrame, mode: int = 0) -> DataFrame:
    """0: images without a marker; 1: with one (several cell bodies); 2: all."""
    if mode == 2:
        return images
    found = resolve_markers(images, markers).where("marker is not null").select("id", "name")
    return images.join(found, ["id", "name"], "left_anti" if mode == 0 else "left_semi")


def build_catalog(images: DataFrame, dims: DataFrame, spacing: DataFrame) -> DataFrame:
    """Catalog rows sorted by ID: ``ID, full_name, nnunet_name, spacing, img_size, v3draw_path``.

    ``images``: ``name, path``; ``dims``: ``id, depth, height, width``; ``spacing``: ``id, spacing``. Joined by id.
    """
    at = images.withColumn("id", name_id(F.col("name"))).join(dims, "id").join(spacing.select("id", "spacing"), "id")
    size = F.struct(F.col("depth").alias("z"), F.col("height").alias("y"), F.col("width").alias("x"))
    return at.select(F.col("id").alias("ID"), stem(F.col("name")).alias("full_name"), F.format_string("image_%03d", "id").alias("nnunet_name"), "spacing", size.alias("img_size"), F.col("path").alias("v3draw_path")).orderBy("ID")


def rename_by_mapping(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``name, new_name``: the full name of the catalog's first row with the file's stem as ``nnunet_name``; null if there is none."""
    first = _first(catalog.select(F.col("nnunet_name").alias("_stem"), "full_name", "ID"), ["_stem"], "ID")
    suffix = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    return files.withColumn("_stem", stem(F.col("name"))).join(first, "_stem", "left").select("name", F.concat("full_name", suffix).alias("new_name"))


def missing_mappings(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that ``rename_by_mapping`` cannot rename."""
    return files.select("name", stem(F.col("name")).alias("nnunet_name")).join(catalog, "nnunet_name", "left_anti").select("name")


def traced_list(files: DataFrame) -> DataFrame:
    """``name, id, duplicate``: true for all files of an id but the first by name."""
    at = files.select("name", name_id(F.col("name")).alias("id"))
    return at.withColumn("duplicate", F.row_number().over(Window.partitionBy("id").orderBy("name")) > 1)


def keep_listed(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id"), "id", "left_semi")


def keep_in_both(files: DataFrame, ids_a: DataFrame, ids_b: DataFrame) -> DataFrame:
    return keep_listed(keep_listed(files, ids_a), ids_b)


def find_tree(images: DataFrame, trees: DataFrame) -> DataFrame:
    """``id, name, tree``: the first path of a tree whose stem is the image's; null if there is none."""
    first = trees.groupBy(stem(F.col("name")).alias("_stem")).agg(F.min("path").alias("tree"))
    return images.withColumn("_stem", stem(F.col("name"))).join(first, "_stem", "left").select("id", "name", "tree")


def align_versions(*runs: DataFrame) -> DataFrame:
    """``name, v0, v1, ...``: paths of the names that every run has (the first path of each)."""
    tagged = reduce(DataFrame.unionByName, [r.select("name", "path", F.lit(k).alias("version")) for k, r in enumerate(runs)])
    firsts = [F.min(F.when(F.col("version") == k, F.col("path"))).alias(f"v{k}") for k in range(len(runs))]
    return tagged.groupBy("name").agg(F.count_distinct("version").alias("_n"), *firsts).where(F.col("_n") == len(runs)).drop("_n")


def pair_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name", F.col("id").alias("id_a")).join(b.select("name", F.col("id").alias("id_b")), "name")


def stale_outputs(outputs: DataFrame, images: DataFrame, markers: DataFrame) -> DataFrame:
    """Outputs of images that have a marker."""
    found = resolve_markers(images, markers).where("marker is not null").select(stem(F.col("name")).alias("_stem"))
    return outputs.withColumn("_stem", stem(F.col("name"))).join(found, "_stem", "left_semi").select(*outputs.columns)


def normalise_marker_names(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.replace(F.col("name"), F.lit("v3draw.marker"), F.lit("marker")))


def parse_size(catalog: DataFrame, column: str = "img_size") -> DataFrame:
    """``depth, height, width`` out of a text like ``(z, y, x)``."""
    part = lambda k: F.regexp_replace(F.split(column, ",")[k], "[^0-9]", "").cast("int")
    return catalog.select("*", *[part(k).alias(d) for k, d in enumerate(("depth", "height", "width"))])


def first_n(files: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` files by name."""
    return files.orderBy("name").limit(n)


def lookup_spacing(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """``files`` with ``xy_spacing``, the second component of the spacing of the catalog's row of that ID."""
    return files.join(catalog.select(F.col("ID").alias("id"), F.col("spacing.y").alias("xy_spacing")), "id", "left")


def drop_scratch(files: DataFrame, words: tuple[str, ...] = ("gsdt", "ini"), suffix: str = ".tif") -> DataFrame:
    """Files with the suffix and none of the scratch words in their name."""
    kept = F.col("name").endswith(suffix)
    for w in words:
        kept = kept & ~F.col("name").contains(w)
    return files.where(kept)
