"""Canvas geometry and per-pixel operators on long pixel tables (x, y, shot, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canvas(corners: DataFrame, key: str) -> DataFrame:
    """Integer bounds of all corners."""
    return corners.groupBy(key).agg(F.floor(F.min("x")).alias("x0"), F.floor(F.min("y")).alias("y0"), F.ceil(F.max("x")).alias("x1"), F.ceil(F.max("y")).alias("y1"))


def frame_boxes(corners: DataFrame, key: str, frame: str) -> DataFrame:
    """Bounds of each frame, cut to the canvas."""
    own = corners.groupBy(key, frame).agg(F.floor(F.min("x")).alias("fx0"), F.floor(F.min("y")).alias("fy0"), F.ceil(F.max("x")).alias("fx1"), F.ceil(F.max("y")).alias("fy1"))
    j = own.join(canvas(corners, key), key)
    return j.select(key, frame, F.greatest("fx0", "x0").alias("x0"), F.greatest("fy0", "y0").alias("y0"), F.least("fx1", "x1").alias("x1"), F.least("fy1", "y1").alias("y1"))


def frames_in_bands(boxes: DataFrame, rows: int, halo: int) -> DataFrame:
    """Band numbers whose rows, with a halo, each box meets: no range join is needed,
    as a box names its bands."""
    first = F.greatest(F.lit(0), F.floor((F.col("y0") - halo) / rows))
    last = F.floor((F.col("y1") + halo - 1) / rows)
    return boxes.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("band"))


def disagreement(pixels: DataFrame) -> DataFrame:
    """Spread of the shots that cover a pixel, and how many they are."""
    return pixels.groupBy("x", "y").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("value")).alias("spread"), F.count("*").alias("shots"))


def loud(spread: DataFrame, factor: float = 3.0) -> DataFrame:
    """Pixels above the median plus ``factor`` robust deviations."""
    m = spread.agg(F.median("spread").alias("m"))
    d = spread.crossJoin(F.broadcast(m)).withColumn("d", F.abs(F.col("spread") - F.col("m")))  # one row
    mad = d.agg(F.median("d").alias("mad"))
    return d.crossJoin(F.broadcast(mad)).where(F.col("spread") > F.col("m") + factor * 1.4826 * F.col("mad")).select("x", "y", "spread", "shots")


def owner(pixels: DataFrame) -> DataFrame:
    """The shot whose centre is nearest; of equals the lowest."""
    return pixels.groupBy("x", "y").agg(F.min(F.struct("distance", "shot")).alias("o")).select("x", "y", F.col("o.shot").alias("shot"))


def majority(pixels: DataFrame, blob: str) -> DataFrame:
    """The commonest shot of each blob; of equals the lowest."""
    n = pixels.groupBy(blob, "shot").agg(F.count("*").alias("n"))
    return n.groupBy(blob).agg(F.max(F.struct("n", (-F.col("shot")).alias("s"))).alias("m")).select(blob, (-F.col("m.s")).alias("shot"), F.col("m.n").alias("n"))


def overview(pixels: DataFrame, factor: int) -> DataFrame:
    """Averages of blocks of ``factor`` by ``factor`` pixels."""
    return pixels.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def large(pixels: DataFrame, blob: str, margin: float) -> DataFrame:
    """(blob, area) of the blobs that could hide a disc of radius ``margin``."""
    return pixels.groupBy(blob).agg(F.count("*").alias("area")).where(F.col("area") >= math.pi * max(margin, 1.0) ** 2)


def scale_drift(poses: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """(key, least, most, outside): the range of ``drift`` and how many leave it."""
    return poses.groupBy(key).agg(F.min("drift").alias("least"), F.max("drift").alias("most"), F.count_if(F.abs(F.col("drift") - 1) > tolerance).alias("outside"))
