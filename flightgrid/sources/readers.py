"""Readers of a survey's documents: calibration, shot metadata, odometry, image lists.

Each reader parses a column of JSON texts (``spark.read.text(path, wholetext=True)``
gives one a file), so that files are spread over tasks; ``load_exif`` joins what the
parts hold.  Broken inputs raise an error when the rows concerned are computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightgrid.functions import geo
from flightgrid.sources.checks import frame_number

CALIBRATION = "cameraMatrix array<array<double>>, imageSize array<int>"
#: Tags of a shot: fixed names.  Numbers may be strings with a plus, so all are read as text.
TAGS = ("SourceFile", "EXIF:GPSLatitude", "EXIF:GPSLongitude", "XMP:GPSLatitude", "XMP:GPSLongitude", "XMP:RelativeAltitude", "XMP:GimbalPitchDegree", "XMP:FlightYawDegree", "XMP:FlightXSpeed", "XMP:FlightYSpeed", "EXIF:DateTimeOriginal")


def fail(where: Column, message: Column | str, value: Column) -> Column:
    """``value``, or an error in rows where ``where`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(where, F.raise_error(text)).otherwise(value)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def calibration(docs: DataFrame, json: str = "json") -> DataFrame:
    """``docs`` with focal, width and height; an error without an image size."""
    c = F.from_json(json, CALIBRATION)
    size = fail(F.coalesce(F.size(c.imageSize), F.lit(0)) < 2, "the calibration has no image size: make it again", c.imageSize)
    return docs.select(*[x for x in docs.columns if x != json], c.cameraMatrix[0][0].alias("focal"), size[0].alias("width"), size[1].alias("height"))


def metadata(docs: DataFrame, key: str = "flight_id", json: str = "json") -> DataFrame:
    """A row a shot whose file name is a camera's, with its index, parsed tags, and
    ``vo_idx``, its place by index, before any filter."""
    tags = "array<struct<" + ", ".join(f"`{t}`: string" for t in TAGS) + ">>"
    rows = docs.select(key, F.explode(F.from_json(json, tags)).alias("t")).select(key, *(F.col(f"t.`{t}`").alias(t.replace(":", "_")) for t in TAGS))
    rows = rows.withColumn("index", frame_number(F.col("SourceFile"))).where("index is not null")
    order = Window.partitionBy(key).orderBy("index", "SourceFile")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        key,
        "index",
        (F.row_number().over(order) - 1).alias("vo_idx"),
        F.col("SourceFile").alias("path"),
        geo.dms(F.col("EXIF_GPSLatitude"), blank("XMP_GPSLatitude"), "S").alias("lat"),
        geo.dms(F.col("EXIF_GPSLongitude"), blank("XMP_GPSLongitude"), "W").alias("lon"),
        F.abs(geo.signed_number(F.col("XMP_RelativeAltitude"))).alias("altitude_m"),
        geo.signed_number(F.col("XMP_GimbalPitchDegree")).alias("gimbal_pitch_deg"),
        geo.signed_number(F.col("XMP_FlightYawDegree")).alias("flight_yaw_deg"),
    )


def odometry_steps(docs: DataFrame, key: str = "flight_id", json: str = "json") -> DataFrame:
    """(key, vo_idx, d_east, d_north) of a list of pairs, joined later by position."""
    rows = docs.select(key, F.posexplode(F.from_json(json, "array<array<double>>")).alias("vo_idx", "d"))
    d = fail(F.coalesce(F.size("d"), F.lit(0)) != 2, "a step of the odometry is no pair", F.col("d"))
    return rows.select(key, "vo_idx", d.alias("d")).select(key, "vo_idx", F.col("d")[0].alias("d_east"), F.col("d")[1].alias("d_north"))


def image_list(files: DataFrame, key: str = "flight_id", path: str = "path") -> DataFrame:
    """(key, index, path) of camera files; of those with one index the last by path."""
    found = files.withColumn("index", frame_number(F.col(path))).where("index is not null")
    return found.groupBy(key, "index").agg(F.max(path).alias("path"))


def select_range(records: DataFrame, images: DataFrame, start: int | None = None, end: int | None = None, key: str = "flight_id") -> DataFrame:
    """Records that have an image, in an inclusive range of indices (open ends: those of
    the images); an error for a flight of which nothing is left."""
    ends = images.groupBy(key).agg(F.min("index").alias("__low"), F.max("index").alias("__high"))
    low, high = (F.col(c) if x is None else F.lit(x) for c, x in (("__low", start), ("__high", end)))
    joined = records.drop("path").join(images, [key, "index"]).join(ends, key).where(F.col("index").between(low, high)).drop("__low", "__high")
    lost = ends.select(key).join(joined.select(key), key, "left_anti").orderBy(key).limit(5).collect()
    if lost:  # checked at once: a plan could drop an error raised beside no rows
        raise ValueError(f"no image in the range: {[r[key] for r in lost]}")
    return joined


def with_positions(records: DataFrame, positions: DataFrame, key: str = "flight_id") -> DataFrame:
    """``records`` with the position at their ``vo_idx``; an error where there is none."""
    p = positions.withColumn("__there", F.lit(True))
    joined = records.join(p, [key, "vo_idx"], "left")
    there = fail(F.col("__there").isNull(), F.concat(F.lit("the odometry has no position for shot "), F.col("vo_idx").cast("string")), F.col("__there"))
    return joined.withColumn("__there", there).where("__there").drop("__there")


def verified_size(rows: DataFrame, declared: tuple[str, str], real: tuple[str, str]) -> DataFrame:
    """``rows`` whose declared image size is the real one; else an error."""
    same = (F.col(declared[0]) == F.col(real[0])) & (F.col(declared[1]) == F.col(real[1]))
    return rows.withColumn("__same", fail(~F.coalesce(same, F.lit(False)), "the images are not of the declared size: make the calibration again", same)).where("__same").drop("__same")


def intrinsics(dewarp: Column) -> Column:
    """k1, k2, p1, p2, k3 of ``date;fx,fy,cx,cy,k1,k2,p1,p2,k3``."""
    return F.transform(F.slice(F.split(F.split(dewarp, ";")[1], ","), 5, 5), lambda x: x.cast("double"))


def packet(content: Column, start: str = "<x:xmpmeta", end: str = "</x:xmpmeta>") -> Column:
    """The XMP packet in a file's text; an error where there is none."""
    a, b = F.instr(content, F.lit(start)), F.instr(content, F.lit(end))
    return fail((a == 0) | (b < a), "no packet: the original shots are wanted", F.substring(content, a, b - a + len(end)))


def load_exif(spark: SparkSession, folder: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of one flight (calibration.json, metadata.json, translations.json and
    images in ``folder``) with positions, and the calibration's size and ground pixel."""
    one = lambda name: documents(spark, f"{folder}/{name}").select(F.lit(0).alias("flight_id"), "json")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG}").load(folder).select(F.lit(0).alias("flight_id"), "path")
    records = select_range(metadata(one("metadata.json")), image_list(files), start, end)
    w = Window.partitionBy("flight_id").orderBy("vo_idx")
    zeroed = lambda c: F.sum(F.when(F.col("vo_idx") == 0, 0.0).otherwise(F.col(c))).over(w)
    positions = odometry_steps(one("translations.json")).select("flight_id", "vo_idx", zeroed("d_east").alias("east"), zeroed("d_north").alias("north"))
    placed = with_positions(records, positions)
    placed = placed.withColumns({c: F.col(c) - F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("east", "north")})
    sized = calibration(one("calibration.json"))
    return placed.join(F.broadcast(sized), "flight_id").withColumn("gsd", F.when(F.col("focal") > 0, F.col("altitude_m") / F.col("focal"))).drop("flight_id")  # one row


READERS: dict[str, Callable[..., DataFrame]] = {"exif": load_exif}


def load(spark: SparkSession, kind: str, folder: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of a folder by the reader of its format."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    return READERS[kind](spark, folder, start, end)
