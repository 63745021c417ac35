"""Descriptor matching, similarity fits and outlier rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _two_least(queries: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and Hamming distances of the two targets nearest to each query, ties to
    the first; a distance of 255 says that there is none."""
    place, d = np.zeros((len(queries), 2), np.int64), np.full((len(queries), 2), 255, np.uint8)
    step = max(1, 262_144 // max(1, len(targets)))
    for at in range(0, len(queries) if len(targets) else 0, step):
        x = np.bitwise_count(queries[at : at + step, None] ^ targets[None])
        rows = np.arange(len(x))
        for n in range(min(2, len(targets))):
            k = x.argmin(1)
            place[at : at + step, n], d[at : at + step, n] = k, x[rows, k]
            x[rows, k] = 255
    return place, d


def _match_block(a: pa.Table, b: pa.Table) -> pa.Table:
    """The two nearest of ``b`` for each row of ``a``; equal bits are compared once."""
    b = b.sort_by("t")
    bits, back = np.unique(a["bits"].to_numpy().view(np.uint64), return_inverse=True)
    place, d = _two_least(bits, b["bits"].to_numpy().view(np.uint64))
    place, d = place[back], d[back]
    q, n = np.nonzero(d < 255)
    return pa.table({"i": a["i"].take(q), "j": a["j"].take(q), "q": a["q"].take(q), "t": b["t"].take(place[q, n]), "d": d[q, n].astype(np.int32)})


def two_nearest(pairs: DataFrame, features: DataFrame, least: int = 8, block_rows: int = 4_096, shard_rows: int = 32_768) -> DataFrame:
    """For image pairs (i, j): the two features of j nearest to each of i by Hamming
    distance of bit descriptors, ties by the feature number; images with fewer than
    ``least`` features take no part, features without bits match nothing.  All of a
    pair's features are compared, as brute-force matching does, in blocks of about
    ``block_rows`` of i and ``shard_rows`` of j, each a group of its own, so that
    distances are never rows.  Of equal descriptors in j the two first are enough."""
    n = features.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    parts = lambda rows: F.ceil(F.col("n") / rows).cast("int")
    p = pairs.join(n.select(F.col("image").alias("i"), parts(block_rows).alias("blocks")), "i")
    p = p.join(n.select(F.col("image").alias("j"), parts(shard_rows).alias("shards")), "j")
    f = features.where("bits is not null").select("image", "feature", F.col("bits").cast("long").alias("bits"))
    first = Window.partitionBy("image", "bits").orderBy("feature")
    once = f.withColumn("__n", F.row_number().over(first)).where("__n <= 2")
    deal = lambda m: F.pmod(F.xxhash64("feature"), F.col(m)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    keys = ("i", "j", "block", "shard")
    left = p.join(f.withColumnRenamed("image", "i"), "i").select("i", "j", deal("blocks").alias("block"), numbers("shards").alias("shard"), F.col("feature").alias("q"), "bits")
    right = p.join(once.withColumnRenamed("image", "j"), "j").select("i", "j", numbers("blocks").alias("block"), deal("shards").alias("shard"), F.col("feature").alias("t"), "bits")
    left, right = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, right))  # columns of their own
    kinds = {c: x.schema[c].dataType.simpleString() for x in (left, right) for c in x.columns}
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_match_block, f"i {kinds['i']}, j {kinds['j']}, q {kinds['q']}, t {kinds['t']}, d int")
    order = Window.partitionBy("i", "j", "q").orderBy("d", "t")
    return got.withColumn("n", F.row_number().over(order)).where("n <= 2")


def ratio_test(nearest: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches whose best distance is below ``ratio`` times the second."""
    per = nearest.groupBy("i", "j", "q").agg(F.min_by("t", "n").alias("t"), F.min("d").alias("d1"), F.max(F.when(F.col("n") == 2, F.col("d"))).alias("d2"))
    return per.where(F.col("d2").isNotNull() & (F.col("d1") < ratio * F.col("d2"))).select("i", "j", "q", "t", "d1", "d2")


def similarity(points: DataFrame, key: str) -> DataFrame:
    """Least-squares similarity x' = a x - b y + tx, y' = b x + a y + ty of (x, y) to
    (u, v) for each key: closed form from one pass of sums.  It needs two points (else
    null); points in one place have the scale 1, and of reflected ones the rotation is
    the nearest and the scale that of the reflection."""
    m = points.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyuv"), *(F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "yy", "xu", "yv", "xv", "yu")))
    s = F.col("xx") + F.col("yy") - F.col("mx") ** 2 - F.col("my") ** 2
    xu, yv, xv, yu = (F.col(p + q) - F.col(f"m{p}") * F.col(f"m{q}") for p, q in ("xu", "yv", "xv", "yu"))
    turn = F.hypot(xu + yv, xv - yu)
    # The sum of the singular values of the covariance, as it is, for reflected points too.
    scale = F.when(s > 1e-12, F.when(xu * yv - yu * xv < 0, F.hypot(xu - yv, yu + xv)).otherwise(turn) / s).otherwise(1.0)
    two = F.col("n") > 1
    a = F.when(two, scale * F.when(turn > 0, (xu + yv) / turn).otherwise(1.0))
    b = F.when(two, scale * F.when(turn > 0, (xv - yu) / turn).otherwise(0.0))
    m = m.withColumns({"a": a, "b": b})
    return m.select(key, "n", "a", "b", (F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("tx"), (F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("ty"))


def residuals(points: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    p = points.join(fit.drop("n"), key)
    dx = F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx") - F.col("u")
    dy = F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty") - F.col("v")
    return p.select(*points.columns, F.hypot(dx, dy).alias("residual"))


def inliers(found: DataFrame, key: str, column: str = "residual", factor: float = 4.0, least: int = 8) -> DataFrame:
    """Rows below the median plus ``factor`` robust deviations, where a group has more
    than ``least`` rows, a spread, and enough left; else all of them."""
    w = Window.partitionBy(key)
    df = found.withColumns({"__m": F.median(column).over(w), "__n": F.count("*").over(w)})
    df = df.withColumn("__d", F.abs(F.col(column) - F.col("__m")))
    df = df.withColumn("__mad", F.median("__d").over(w))
    df = df.withColumn("__in", F.col(column) < F.col("__m") + factor * 1.4826 * F.col("__mad"))
    df = df.withColumn("__k", F.count_if("__in").over(w))
    used = (F.col("__n") > least) & (F.col("__mad") > 0) & (F.col("__k") >= F.greatest(F.lit(float(least)), F.col("__n") / 2))
    return df.where(~used | F.col("__in")).select(*found.columns)


def robust_similarity(points: DataFrame, key: str, gsd: float = 1.0, expected_deg: float = 0.0) -> DataFrame:
    """Fit, drop outliers once, fit again; with residuals, in metres by ``gsd``, of the
    points that were kept, and what the rotation differs from the expected one."""
    kept = inliers(residuals(points, similarity(points, key), key), key).drop("residual")
    fit = similarity(kept, key)
    n = points.groupBy(key).agg(F.count("*").alias("points"))
    r = residuals(kept, fit, key).withColumn("residual", F.col("residual") * gsd).join(n, key)
    report = r.groupBy(key).agg(F.first("points").alias("points"), F.median("residual").alias("median_m"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms_m"), F.max("residual").alias("max_m"))
    out = fit.join(report, key)
    return out.select(key, "points", (F.col("points") - F.col("n")).alias("outliers"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"), F.hypot("a", "b").alias("scale"), "median_m", "rms_m", "max_m", (F.degrees(F.atan2("b", "a")) - expected_deg).alias("rotation_residual_deg"))


def enough_matches(matches: DataFrame, least: int = 10) -> DataFrame:
    """Matches of the image pairs that have ``least`` of them."""
    n = matches.groupBy("i", "j").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("i", "j")
    return matches.join(n, ["i", "j"], "left_semi")


def constraints(inlying: DataFrame, least: int = 12) -> DataFrame:
    """(i, j, n_inlier) of the pairs with ``least`` inliers."""
    return inlying.groupBy("i", "j").agg(F.count("*").alias("n_inlier")).where(F.col("n_inlier") >= least)
