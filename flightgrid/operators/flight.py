"""Telemetry: odometry, curves, legs and thinning of the shots of a flight.

All operators are per ``flight_id``; a flight is a partition of its windows, so
flights are independent tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightgrid.functions.geo import yaw_difference


def by_order() -> WindowSpec:
    return Window.partitionBy("flight_id").orderBy("ord")


def dense_index(shots: DataFrame, order: str = "event_id", out: str = "vo_idx") -> DataFrame:
    """0-based place in the flight, before any filter."""
    return shots.withColumn(out, F.row_number().over(Window.partitionBy("flight_id").orderBy(order)) - 1)


def odometry(shots: DataFrame, north_speed: str, east_speed: str) -> DataFrame:
    """Position steps: speed times the time since the shot before (1 s for the first)."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(by_order())) / 1e6
    dt = F.coalesce(seconds, F.lit(1.0))
    return shots.withColumns({"d_east": F.col(east_speed) * dt, "d_north": F.col(north_speed) * dt})


def integrate(steps: DataFrame, first: int | None = None) -> DataFrame:
    """Running positions, the first step at zero; the origin moves to shot ``first``."""
    running = by_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zeroed = lambda c: F.when(F.col("ord") == 0, 0.0).otherwise(F.col(c))
    out = steps.withColumns({"east": F.sum(zeroed("d_east")).over(running), "north": F.sum(zeroed("d_north")).over(running)})
    if first is not None:
        whole = by_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.where(F.col("ord") >= first).withColumns({c: F.col(c) - F.first(c).over(whole) for c in ("east", "north")})
    return out


def frame_range(shots: DataFrame, start: int | None, end: int | None, index: str = "ord") -> DataFrame:
    """Inclusive; open ends are the flight's own."""
    keep = F.lit(True)
    if start is not None:
        keep &= F.col(index) >= start
    if end is not None:
        keep &= F.col(index) <= end
    return shots.where(keep)


def dominant_axis(shots: DataFrame) -> DataFrame:
    """Axial circular mean of the yaw, by doubled angles."""
    t = F.radians(2 * F.col("flight_yaw_deg"))
    return shots.groupBy("flight_id").agg((F.degrees(F.atan2(F.avg(F.sin(t)), F.avg(F.cos(t)))) / 2).alias("axis_deg"))


def mark_curves(shots: DataFrame, yaw_tolerance: float = 15.0, nadir_tolerance: float = 3.0) -> DataFrame:
    """usable, is_curve and heading (1, -1, null in curves) of each shot."""
    whole = Window.partitionBy("flight_id")
    t = F.radians(2 * F.col("flight_yaw_deg"))
    axis = F.degrees(F.atan2(F.avg(F.sin(t)).over(whole), F.avg(F.cos(t)).over(whole))) / 2
    df = shots.withColumn("axis_deg", axis)
    d = F.abs(yaw_difference(F.col("flight_yaw_deg"), F.col("axis_deg")))
    usable = F.abs(F.coalesce("gimbal_pitch_deg", F.lit(-90.0)) + 90) <= nadir_tolerance
    curve = (F.least(d, 180 - d) > yaw_tolerance) | ~usable
    return df.withColumns({"usable": usable, "is_curve": curve, "heading": F.when(~curve, F.when(d < 90, 1).otherwise(-1))})


def legs(marked: DataFrame, footprint: float, least: int = 3) -> DataFrame:
    """Runs of one heading with at least ``least`` shots, and as long as the footprint
    or half the flight's typical leg."""
    island = F.sum(F.when(F.col("heading").eqNullSafe(F.lag("heading").over(by_order())), 0).otherwise(1)).over(by_order())
    runs = marked.withColumn("island", island).where("heading is not null")
    one = runs.groupBy("flight_id", "island").agg(
        F.first("heading").alias("heading"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.count("*").alias("n"),
        F.min_by(F.struct("east_m", "north_m"), "ord").alias("a"),
        F.max_by(F.struct("east_m", "north_m"), "ord").alias("b"),
    )
    one = one.where(F.col("n") >= least).withColumn("extent_m", F.hypot(F.col("b.east_m") - F.col("a.east_m"), F.col("b.north_m") - F.col("a.north_m")))
    typical = F.percentile("extent_m", 0.5).over(Window.partitionBy("flight_id"))
    one = one.withColumn("least_m", F.least(F.lit(float(footprint)), 0.5 * typical)).where("extent_m >= least_m")
    number = F.row_number().over(Window.partitionBy("flight_id").orderBy("first_ord"))
    return one.select("flight_id", number.alias("leg_id"), "heading", "first_ord", "last_ord", F.col("n").cast("long").alias("n"), "extent_m")


def demote(marked: DataFrame, found: DataFrame) -> DataFrame:
    """Shots of dropped legs become curves without a heading."""
    inside = found.select("flight_id", F.explode(F.sequence("first_ord", "last_ord")).alias("ord"), F.lit(True).alias("in_leg"))
    out = marked.join(inside, ["flight_id", "ord"], "left")
    return out.withColumns({"is_curve": F.col("in_leg").isNull(), "heading": F.when(F.col("in_leg"), F.col("heading"))}).drop("in_leg")


def thin(shots: DataFrame, step: Column | float) -> DataFrame:
    """Greedy thinning along the flight: the first usable shot, and each usable one at
    least ``step`` from the last kept or, where there is such a column, marked as an
    ``endpoint`` of a leg.  The fold needs a flight's shots in one array."""
    step = F.lit(step) if isinstance(step, (int, float)) else step
    end = F.col("endpoint") if "endpoint" in shots.columns else F.lit(False)
    usable = shots.where("usable").withColumns({"step": step.cast("double"), "end": end})
    per = usable.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("ord", "east_m", "north_m", "step", "end"))).alias("s"))
    empty = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array().cast("array<int>").alias("kept"))

    def fold(acc: Column, s: Column) -> Column:
        take = acc.x.isNull() | s.end | (F.hypot(s.east_m - acc.x, s.north_m - acc.y) >= s.step)
        return F.struct(
            F.when(take, s.east_m).otherwise(acc.x).alias("x"),
            F.when(take, s.north_m).otherwise(acc.y).alias("y"),
            F.when(take, F.concat(acc.kept, F.array(s.ord.cast("int")))).otherwise(acc.kept).alias("kept"),
        )

    return per.select("flight_id", F.explode(F.aggregate("s", empty, fold, lambda acc: acc.kept)).alias("ord"))


def thinning_step(footprint: Column | float, overlap: float) -> Column:
    """Metres between kept shots that leave the wanted overlap, at least a twentieth."""
    return (F.lit(footprint) if isinstance(footprint, (int, float)) else footprint) * max(1.0 - overlap, 0.05)


def with_endpoints(shots: DataFrame, found: DataFrame) -> DataFrame:
    """``shots`` with ``endpoint``: the first and last shot of each leg."""
    ends = found.select("flight_id", F.explode(F.array("first_ord", "last_ord")).alias("ord")).distinct().withColumn("endpoint", F.lit(True))
    return shots.join(ends, ["flight_id", "ord"], "left").withColumn("endpoint", F.coalesce("endpoint", F.lit(False)))


def default_overlap(lateral: float | None = None) -> float:
    """The overlap along the flight when none is asked for."""
    return 0.5 * (1 + (0.25 if lateral is None else lateral))


def consecutive(kept: DataFrame) -> DataFrame:
    """Steps between neighbours among the kept shots."""
    nxt = lambda c: F.lead(c).over(by_order())
    out = kept.select("flight_id", F.col("ord").alias("i"), nxt("ord").alias("j"), (nxt("east_m") - F.col("east_m")).alias("dx"), (-(nxt("north_m") - F.col("north_m"))).alias("dy"))
    return out.where("j is not null")


def forward(shots: DataFrame, least: float = 0.30) -> DataFrame:
    """Unit steps to the shots before and after; the longer-aligned one with the axis
    decides the direction's sign."""
    prev = lambda c: F.col(c) - F.lag(c).over(by_order())
    nxt = lambda c: F.lead(c).over(by_order()) - F.col(c)
    df = shots.withColumns({"px": prev("east_m"), "py": prev("north_m"), "nx": nxt("east_m"), "ny": nxt("north_m")})
    ax, ay = F.sin(F.radians("axis_deg")), F.cos(F.radians("axis_deg"))

    def along(x: str, y: str) -> Column:
        n = F.hypot(x, y)
        return F.when(n >= least, (F.col(x) * ax + F.col(y) * ay) / n)

    p, q = along("px", "py"), along("nx", "ny")
    best = F.when(F.coalesce(F.abs(p), F.lit(-1.0)) >= F.coalesce(F.abs(q), F.lit(-1.0)), p).otherwise(q)
    sign = F.when(F.coalesce(best, F.lit(1.0)) >= 0, 1).otherwise(-1)
    return df.select("flight_id", "ord", sign.alias("sign"))


def neighbour_steps(shots: DataFrame, least: float = 0.3) -> DataFrame:
    """Unit vectors (px, py) from the shot before and (nx, ny) to the next; null where
    there is none or the step is shorter than ``least`` metres."""
    w = Window.partitionBy("flight_id").orderBy("ord")
    out = {}
    for names, sign, other in ((("px", "py"), 1, F.lag), (("nx", "ny"), -1, F.lead)):
        x = sign * (F.col("east_m") - other("east_m").over(w))
        y = sign * (F.col("north_m") - other("north_m").over(w))
        size = F.sqrt(x * x + y * y)
        out |= {n: F.when(size >= least, c / size) for n, c in zip(names, (x, y), strict=True)}
    return shots.withColumns(out)


def axis_vote(steps: DataFrame) -> DataFrame:
    """Per flight: whether the steps run along the yaw axis rather than across it."""
    s, c = F.sin(F.radians("flight_yaw_deg")), F.cos(F.radians("flight_yaw_deg"))
    part = lambda k, x, y: F.coalesce(F.abs(F.col(f"{k}x") * x + F.col(f"{k}y") * y), F.lit(0.0))
    along, across = (part("p", x, y) + part("n", x, y) for x, y in ((s, c), (c, -s)))
    return steps.groupBy("flight_id").agg(F.sum(along).alias("along"), F.sum(across).alias("across")).withColumn("is_along", F.col("along") >= F.col("across"))


def feature_ladder(frames: Column, rungs: tuple[int, ...] = (3_000, 12_000, 48_000), budget: float = 6e8, size: int = 40) -> Column:
    """Features a frame to try: the first rung, and the later ones within the budget."""
    return F.concat(F.array(F.lit(rungs[0])), F.filter(F.array(*map(F.lit, rungs[1:])), lambda r: frames * r * size <= budget))


def pixel_sizes(shots: DataFrame, key: str = "flight_id") -> DataFrame:
    """(key, gsd, least, most): the least pixel size over both axes (gx, gy) of all
    shots, and the range of the ratio of the axes."""
    ratio = F.greatest("gx", "gy") / F.least("gx", "gy")
    return shots.groupBy(key).agg(F.min(F.least("gx", "gy")).alias("gsd"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))
