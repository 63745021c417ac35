"""Point tables: dialects, references to shots, and the frame a point is measured on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")


def delimiter(line: Column) -> Column:
    """The commonest of the known delimiters in a line; of equals the first known."""
    counts = F.array(*(F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    return F.array_max(counts).d


def alias_match(header: Column, names: tuple[str, ...], prefix: bool = False) -> Column:
    """Place of the first header that is one of ``names``, or begins with one."""
    clean = F.transform(header, lambda h: F.lower(F.trim(h)))
    hit = (lambda h: F.exists(F.array(*map(F.lit, names)), lambda p: F.startswith(h, p))) if prefix else (lambda h: h.isin(*names))
    return F.array_position(F.transform(clean, hit), True) - 1


def stem(path: Column) -> Column:
    """Lower-case file name without folders and extension."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def shortened(name: Column) -> Column:
    """A stem, and what is left of it after each dropping of trailing numbers, in order."""
    tail = F.regexp_extract(name, r"((?:_\d+)*)$", 1)
    n = F.length(tail) - F.length(F.replace(tail, F.lit("_"), F.lit("")))
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.regexp_replace(name, F.concat(F.lit(r"(_\d+){"), i.cast("string"), F.lit("}$")), F.lit("")))
    return F.filter(cut, lambda c: c != "")


def resolve(points: DataFrame, shots: DataFrame, image: str = "image") -> DataFrame:
    """``points`` with the ``shot`` that their image names: the stem, or what is left
    of it after dropping trailing numbers, first hit first.  Of shots with one stem the
    last wins; unknown images have a null shot."""
    known = shots.groupBy(stem(F.col("path")).alias("stem")).agg(F.max("ord").alias("shot"))
    # Images are few next to points: each name is resolved once and joined back.
    images = points.select(image).distinct()
    long = images.select(image, F.posexplode(shortened(stem(F.col(image)))).alias("level", "stem")).join(known, "stem")
    return points.join(long.groupBy(image).agg(F.min_by("shot", "level").alias("shot")), image, "left")


def margin(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Distance to the nearest edge, negative outside; on an edge is inside."""
    return F.least(x, w - x, y, h - y)


def rerouted(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``points`` (point_id, shot, u, v in UTM) with the shot to measure on, the pixel
    there and whether it is another one: the cited shot unless the point is outside of
    it and inside another, of which the one with the widest margin wins (ties: the
    lowest).  Rows of one ``point_id`` are routed together, to the widest margin of all
    of them (ties: the lowest shot, then the greatest pixel).  ``frames`` (shot, a, b, tx, ty, w, h) are the inverse poses of one flight;
    they meet only points that lie outside, by cells of the greatest frame size."""
    own = points.join(frames, "shot")
    px, py = _at("a", "b", "tx", "ty")
    own = own.withColumns({"px": px, "py": py}).withColumn("m", margin(F.col("px"), F.col("py"), F.col("w"), F.col("h")))
    inverse = F.col("a") ** 2 + F.col("b") ** 2
    # Centre and radius of each frame in UTM.
    cx, cy = F.col("w") / 2 - F.col("tx"), F.col("h") / 2 - F.col("ty")
    placed = frames.select("*", ((F.col("a") * cx + F.col("b") * cy) / inverse).alias("x"), ((F.col("a") * cy - F.col("b") * cx) / inverse).alias("y"), (F.hypot("w", "h") / 2 / F.sqrt(inverse)).alias("r"))
    cell = F.lit(2.0) * placed.agg(F.max("r")).first()[0] if not placed.isEmpty() else F.lit(1.0)
    near = F.array(*(F.struct((F.floor(F.col("x") / cell) + i).alias("cx"), (F.floor(F.col("y") / cell) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    others = placed.select(F.col("shot").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("a", "b", "tx", "ty", "w", "h")), F.explode(near).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    out = own.where("m < 0").select("point_id", "u", "v", F.floor(F.col("u") / cell).alias("cx"), F.floor(F.col("v") / cell).alias("cy"))
    ox, oy = _at("o_a", "o_b", "o_tx", "o_ty")
    met = out.join(others, ["cx", "cy"]).withColumns({"ox": ox, "oy": oy}).withColumn("om", margin(F.col("ox"), F.col("oy"), F.col("o_w"), F.col("o_h"))).where("om >= 0")
    best = met.groupBy("point_id").agg(F.max(F.struct("om", (-F.col("other")).alias("o"), "ox", "oy")).alias("best"))
    got = own.join(best, "point_id", "left")
    moved = F.col("best").isNotNull()
    return got.select("point_id", F.when(moved, -F.col("best.o")).otherwise(F.col("shot")).alias("shot"), F.when(moved, F.col("best.ox")).otherwise(F.col("px")).alias("px"), F.when(moved, F.col("best.oy")).otherwise(F.col("py")).alias("py"), moved.alias("rerouted"))


def _at(a: str, b: str, tx: str, ty: str) -> tuple[Column, Column]:
    return F.col(a) * F.col("u") - F.col(b) * F.col("v") + F.col(tx), F.col(b) * F.col("u") + F.col(a) * F.col("v") + F.col(ty)


def remapped_line(cells: Column, delimiter: Column, places: list[tuple[Column, Column]]) -> Column:
    """A CSV line with new values at 0-based places (null: not there), the rest kept."""

    def put(place: Column, value: Column):
        return lambda c, i: F.when(i == place, value).otherwise(c)

    row = cells
    for place, value in places:
        row = F.when(place.isNull(), row).otherwise(F.transform(row, put(place, value)))
    return F.call_function("array_join", row, delimiter)


def shift_report(points: DataFrame) -> DataFrame:
    """One row: points kept, rejected (no shot) and rerouted, and the median and the
    greatest ``shift`` of those kept."""
    kept = F.col("shot").isNotNull()
    return points.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.count_if(F.col("rerouted")).alias("rerouted"), F.median(F.when(kept, F.col("shift"))).alias("median_shift"), F.max(F.when(kept, F.col("shift"))).alias("max_shift"))
