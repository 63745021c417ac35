"""Overlap joins, the best neighbours of each shot, and the constraint graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid_join(frames: DataFrame, cell: float, key: str = "flight_id", number: str = "k") -> DataFrame:
    """Pairs i < j of frames (x, y, r) of a flight whose circles meet.  Each frame goes
    to its own cell, and, as the left side, to the nine around it; ``cell`` must be at
    least twice the largest radius, so neighbours are in adjacent cells."""
    at = frames.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    near = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = at.select(key, F.explode(near).alias("c"), F.struct(*frames.columns).alias("a")).select(key, "c.cx", "c.cy", "a")
    right = at.select(key, "cx", "cy", F.struct(*frames.columns).alias("b"))
    met = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) < F.col("a.r") + F.col("b.r")
    return left.join(right, [key, "cx", "cy"]).where((F.col(f"a.{number}") < F.col(f"b.{number}")) & met).select(key, "a", "b")


def box_overlap(pairs: DataFrame) -> DataFrame:
    """Share of the smaller of two axis-parallel boxes (w, h around x, y)."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(f"a.{p}") + F.col(f"a.{s}") / 2, F.col(f"b.{p}") + F.col(f"b.{s}") / 2) - F.greatest(F.col(f"a.{p}") - F.col(f"a.{s}") / 2, F.col(f"b.{p}") - F.col(f"b.{s}") / 2))
    least = F.least(F.col("a.w") * F.col("a.h"), F.col("b.w") * F.col("b.h"))
    return pairs.withColumn("overlap", F.when(least > 0, side("x", "w") * side("y", "h") / least).otherwise(0.0))


def top_neighbours(pairs: DataFrame, k: int = 6, key: str = "flight_id") -> DataFrame:
    """Pairs that are among the ``k`` best of either end."""
    ends = pairs.select(key, "i", "j", "overlap", F.explode(F.array("i", "j")).alias("end"))
    order = Window.partitionBy(key, "end").orderBy(F.desc("overlap"), "i", "j")
    return ends.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(key, "i", "j", "overlap").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree), isolated ones included."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def _written(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else _temporary(spark, df)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _temporary(spark: SparkSession, df: DataFrame) -> DataFrame:
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="flightgrid-"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, component): the least node reachable, by star contraction, each round
    written to the shared folder."""
    e = _written(edges.where("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v")).distinct())
    state = None
    for _ in range(most):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = _written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components have not settled")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pairs, components, the largest one, isolated nodes and the range of the
    degrees."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    c = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest_component"))
    e = edges.agg(F.count("*").alias("pairs"))
    d = degrees(nodes, edges).agg(F.count_if(F.col("degree") == 0).alias("isolated"), F.min("degree").alias("degree_min"), F.median("degree").alias("degree_median"), F.max("degree").alias("degree_max"))
    return e.crossJoin(c).crossJoin(d)  # one row each


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, independent cycles, and whether they are at
    least a quarter of the nodes."""
    c = components(nodes, edges).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    e = edges.select("i", "j").distinct().agg(F.count("*").alias("edges"))
    out = c.crossJoin(e)  # one row each
    n = F.col("edges") - F.col("nodes") + F.col("components")
    return out.select("nodes", "edges", "components", n.alias("cycles"), (n >= F.floor(F.col("nodes") / 4)).alias("healthy"))


def threshold_holding_together(nodes: DataFrame, pairs: DataFrame, start: float = 0.25, end: float = 0.05, step: float = 0.05) -> tuple[float, DataFrame]:
    """Lower the overlap threshold until the pairs make one component; the last one
    tried is returned in any case.  Overlaps are computed once by the caller."""
    threshold = start
    while True:
        kept = top_neighbours(pairs.where(F.col("overlap") >= threshold))
        whole = components(nodes, kept).agg(F.countDistinct("component")).first()[0] <= 1
        if whole or threshold - step < end - 1e-9:
            return threshold, kept
        threshold = round(threshold - step, 10)
