"""What a delivery folder holds: formats, missing files, digests and stale stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_of(files: DataFrame, folder: str, name: str) -> DataFrame:
    """``exif`` if there is any JPEG, else ``ortho`` if any TIFF, else null."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.([^.]*)$", 1))
    return files.groupBy(folder).agg(F.when(F.bool_or(ext.isin("jpg", "jpeg")), "exif").when(F.bool_or(ext.isin("tif", "tiff")), "ortho").alias("format"))


def missing(expected: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(listed, on, "left_anti")


def frame_number(name: Column) -> Column:
    """The four digits of the camera's names (any case), as a number; else null."""
    n = F.regexp_extract(name, r"(?i)_(\d{4})_D\.JPG", 1)
    return F.when(n != "", n.cast("int"))


def shot_number(name: Column) -> Column:
    """The first digits of a file name without its extension; an error if it has none."""
    n = F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), r"\d+", 0)
    return F.when(n != "", n.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no shot number in the name "), name)).cast("long"))


def fileset_digest(files: DataFrame, folder: str) -> DataFrame:
    """Count, newest time and 16 digits of a digest over sorted name, size and time."""
    files_ = F.array_sort(F.collect_list(F.struct("name", "size", "mtime")))
    line = lambda s: F.concat(s["name"], F.lit("|"), s["size"].cast("string"), F.lit("|"), s["mtime"].cast("string"), F.lit("\n"))
    text = F.array_join(F.transform(files_, line), "")
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.max("mtime").alias("newest"), F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def stamp_tags(files: DataFrame, folder: str, source: Column, composed: Column, prefix: str = "STITCHING_") -> DataFrame:
    """(folder, tags): the six tags that name what a mosaic was made of."""
    d = fileset_digest(files, folder)
    tags = (("SOURCE_DIR", source), ("FRAMES_DIR", F.col(folder)), ("FRAMES_COUNT", F.col("files")), ("FRAMES_MTIME", F.col("newest")), ("FRAMES_DIGEST", F.col("digest")), ("COMPOSED", composed))
    return d.select(folder, F.create_map(*(x for k, v in tags for x in (F.lit(prefix + k), v.cast("string")))).alias("tags"))


def read_stamp(tags: Column, prefix: str = "STITCHING_") -> Column:
    """The stamp among all tags of a file: an empty map if it has none."""
    return F.map_filter(tags, lambda k, _: F.startswith(k, F.lit(prefix)))


def point_tables(files: DataFrame) -> DataFrame:
    """CSV files that are not remapped ones (folder, name), in order."""
    return files.where(F.lower("name").endswith(".csv") & ~F.regexp_replace("name", r"\.[^.]*$", "").endswith("_mosaic")).orderBy("folder", "name")


def with_images_of_flight(tables: DataFrame, shots: DataFrame) -> DataFrame:
    """``tables`` of folders that hold at least one image (folder) of the flight."""
    return tables.join(shots.select("folder").distinct(), "folder", "left_semi")


def twin_folder(folder: Column) -> Column:
    """The folder of delivered images for that of rectified ones, and the other way."""
    return F.when(folder.endswith("_rettificate"), F.regexp_replace(folder, "_rettificate$", "")).otherwise(F.concat(folder, F.lit("_rettificate")))


def stale_reasons(stamp: DataFrame, current: DataFrame, ignored: tuple[str, ...] = ("COMPOSED", "MTIME")) -> DataFrame:
    """Keys on which a stamp and the current state differ; absent values are named."""
    j = stamp.withColumnRenamed("value", "was").join(current.withColumnRenamed("value", "now"), "key", "full")
    absent = F.lit("(absent)")
    return j.where(~F.col("was").eqNullSafe(F.col("now")) & ~F.col("key").isin(*ignored)).select("key", F.coalesce("was", absent).alias("was"), F.coalesce("now", absent).alias("now"))
