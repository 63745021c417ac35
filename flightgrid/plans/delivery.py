"""More survey queries: documents and listings, rotated overlaps, constraints, points,
stamps and summaries.  Registered with those of plans.survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightgrid import fixtures as fx
from flightgrid.functions import geo
from flightgrid.operators import flight, graph, match, points
from flightgrid.plans import survey
from flightgrid.plans.survey import FILES, SHOTS, _shots, _t, query, r4, r6
from flightgrid.sources import checks, readers

# ---- documents

_DEWARP = "select p_partkey, '2024-01-01;3000.0,3000.0,12.5,-7.5,' || cast(p_size as varchar(9)) || '.5,-0.25,' || cast(p_partkey % 7 as varchar(9)) || ',0,1.5' as dewarp from part"


@query("select p_partkey, p_size + 0.5e0 as k1, -0.25e0 as k2, cast(p_partkey % 7 as double) as p1, 0e0 as p2, 1.5e0 as k3 from part")
def s8_intrinsics(spark, d):
    k = readers.intrinsics(F.concat(F.lit("2024-01-01;3000.0,3000.0,12.5,-7.5,"), F.col("p_size").cast("string"), F.lit(".5,-0.25,"), (F.col("p_partkey") % 7).cast("string"), F.lit(",0,1.5")))
    return _t(spark, d, "part").select("p_partkey", *(F.get(k, F.lit(i)).alias(n) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))))


@query("select p_partkey, p_size * 100 + 0.5e0 as focal, p_size + 10 as width, p_size + 7 as height from part")
def s9_calibration(spark, d):
    text = F.concat(F.lit('{"cameraMatrix": [['), (F.col("p_size") * 100).cast("string"), F.lit('.5, 0, 1], [0, 1, 1], [0, 0, 1]], "imageSize": ['), (F.col("p_size") + 10).cast("string"), F.lit(", "), (F.col("p_size") + 7).cast("string"), F.lit("]}"))
    return readers.calibration(_t(spark, d, "part").select("p_partkey", text.alias("json")))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document a flight, of shots in no order."""
    e = _t(spark, d, "events").withColumn("flight_id", F.col("user_id"))
    n = F.col("event_id") % 5000
    name = F.when(F.col("event_id") % 11 == 0, F.format_string("x/other_%d.JPG", "event_id")).otherwise(F.format_string("x/DJI_%04d_d.jpg", n))
    deg = lambda c, m: F.concat((F.col("event_id") % m).cast("string"), F.lit(f" deg {c}' 30.00\""))
    shot = F.struct(
        name.alias("SourceFile"),
        deg(12, 80).alias("EXIF:GPSLatitude"),
        deg(30, 170).alias("EXIF:GPSLongitude"),
        F.when(F.col("event_id") % 2 == 0, "1 S").otherwise("1 N").alias("XMP:GPSLatitude"),
        F.when(F.col("event_id") % 3 == 0, "1 W").alias("XMP:GPSLongitude"),
        F.concat(F.lit("-"), (F.col("event_id") % 50).cast("string"), F.lit(".5")).alias("XMP:RelativeAltitude"),
        F.lit("-90.0").alias("XMP:GimbalPitchDegree"),
        F.concat(F.lit("+"), (F.col("event_id") % 180).cast("string")).alias("XMP:FlightYawDegree"),
    )
    return e.groupBy("flight_id").agg(F.to_json(F.collect_list(shot)).alias("json"))


_META = """m as (select user_id as flight_id, event_id, cast(event_id % 5000 as int) as "index", 'x/DJI_' || lpad(cast(event_id % 5000 as varchar), 4, '0') || '_d.jpg' as path from events where event_id % 11 <> 0),
v as (select *, cast(row_number() over (partition by flight_id order by "index", path, event_id) - 1 as int) as vo_idx from m)"""


@query(f"""with {_META} select flight_id, "index", vo_idx, path, round((event_id % 80 + 12 / 60e0 + 30 / 3600e0) * case when event_id % 2 = 0 then -1 else 1 end, 6) as lat, round((event_id % 170 + 30 / 60e0 + 30 / 3600e0) * case when event_id % 3 = 0 then -1 else 1 end, 6) as lon, event_id % 50 + 0.5e0 as altitude_m, -90e0 as gimbal_pitch_deg, cast(event_id % 180 as double) as flight_yaw_deg from v where flight_id in (select flight_id from m group by flight_id having count(*) = count(distinct "index"))""")
def s10_metadata(spark, d):
    rows = readers.metadata(_metadata(spark, d))
    # Repeated indices have no defined order of their tags: flights without them.
    fine = rows.groupBy("flight_id").agg(F.count("*").alias("n"), F.countDistinct("index").alias("k")).where("n = k").select("flight_id")
    return rows.join(fine, "flight_id", "left_semi").withColumns({"lat": r6("lat"), "lon": r6("lon")})


@query(f"{SHOTS} select flight_id, ord as vo_idx, round(east_m, 6) as d_east, round(north_m, 6) as d_north from fx_shots")
def s11_odometry(spark, d):
    pair = F.array(r6("east_m"), r6("north_m"))
    docs = _shots(spark, d).groupBy("flight_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", pair.alias("p")))), lambda x: x.p)).alias("json"))
    return readers.odometry_steps(docs)


_LIST = "select source as flight_id, 'a/' || source || '_' || lpad(cast(doc_id % 700 as varchar(9)), 4, '0') || case when doc_id % 3 = 0 then '_D.JPG' else '_d.jpg' end as path from documents where doc_id % 3 < 2"


def _images(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("a/"), "source", F.lit("_"), F.lpad((F.col("doc_id") % 700).cast("string"), 4, "0"), F.when(F.col("doc_id") % 3 == 0, "_D.JPG").when(F.col("doc_id") % 3 == 1, "_d.jpg").otherwise(".tif"))
    return readers.image_list(_t(spark, d, "documents").select(F.col("source").alias("flight_id"), name.alias("path")))


_INDEXED = f"""select flight_id, cast(regexp_extract(path, '_([0-9]{{4}})_', 1) as int) as "index", max(path) as path from ({_LIST}) z group by 1, 2"""


@query(_INDEXED)
def s12_image_list(spark, d):
    return _images(spark, d)


@query(f"""with i as ({_INDEXED}), r as (select distinct source as flight_id, cast(doc_id % 900 as int) as "index" from documents), e as (select flight_id, max("index") as hi from i group by flight_id)
select r.flight_id, r."index", i.path from r join i on r.flight_id = i.flight_id and r."index" = i."index" join e on e.flight_id = r.flight_id where r."index" >= 20 and r."index" <= e.hi""")
def j1_records_with_images(spark, d):
    records = _t(spark, d, "documents").select(F.col("source").alias("flight_id"), (F.col("doc_id") % 900).cast("int").alias("index"), F.lit("old").alias("path")).distinct()
    images = _images(spark, d)
    fine = images.where("index >= 20").select("flight_id").distinct()  # others raise an error
    return readers.select_range(records.join(fine, "flight_id", "left_semi"), images.join(fine, "flight_id", "left_semi"), 20).select("flight_id", "index", "path")


@query(f"{SHOTS} select flight_id, ord as vo_idx, round(east_m, 6) as east_m, round(north_m, 6) as north_m from fx_shots where ord % 2 = 0")
def j2_records_with_positions(spark, d):
    s = _shots(spark, d).withColumnRenamed("ord", "vo_idx")
    return readers.with_positions(s.where("vo_idx % 2 = 0").select("flight_id", "vo_idx"), s.select("flight_id", "vo_idx", r6("east_m").alias("east_m"), r6("north_m").alias("north_m")))


@query("select p_partkey, p_size * 4 as width from part")
def f18_verified_size(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 4).alias("width"), F.lit(3).alias("height"), (F.col("p_size") * 4).alias("w"), F.lit(3).alias("h"))
    return readers.verified_size(p, ("width", "height"), ("w", "h")).select("p_partkey", "width")


@query("select p_partkey, (1000e0 / p_size + 1000.2e0 / p_size) / 2 as scale from part")
def e22_measured_scale(spark, d):
    return _t(spark, d, "part").select("p_partkey", geo.measured_scale(F.lit(1000.0), F.lit(1000.2), F.col("p_size"), F.col("p_size")).alias("scale"))


# ---- tables of points in folders (S18, J9, U3), stamps

_TABLES = "select source as folder, 't' || cast(doc_id as varchar(9)) || case when doc_id % 4 = 0 then '_mosaic' else '' end || case when doc_id % 5 = 0 then '.txt' else '.csv' end as name, doc_id from documents"


@query(f"select folder, name, case when folder = 'src1' then 'src1_rettificate' else folder || '_rettificate' end as twin from ({_TABLES}) z where doc_id % 5 <> 0 and doc_id % 4 <> 0 and folder in (select source from documents where doc_id % 9 = 0)")
def s18_point_tables(spark, d):
    _t(spark, d, "documents").createOrReplaceTempView("documents")
    tables = checks.point_tables(spark.sql(_TABLES).select("folder", "name"))
    shots = _t(spark, d, "documents").where("doc_id % 9 = 0").select(F.col("source").alias("folder"))
    return checks.with_images_of_flight(tables, shots).select("folder", "name", checks.twin_folder(F.col("folder")).alias("twin"))


@query(f"with f as ({FILES}), g as (select folder, count(*) as n, max(mtime) as t, substr(sha256(string_agg(name || '|' || size || '|' || mtime || chr(10), '' order by name, size, mtime)), 1, 16) as x from f group by folder) select folder, n.key, n.value from g, lateral (values ('STITCHING_SOURCE_DIR', '/in'), ('STITCHING_FRAMES_DIR', folder), ('STITCHING_FRAMES_COUNT', cast(g.n as varchar)), ('STITCHING_FRAMES_MTIME', cast(t as varchar)), ('STITCHING_FRAMES_DIGEST', x), ('STITCHING_COMPOSED', '1-9')) n(key, value)")
def k10_stamp(spark, d):
    tags = checks.stamp_tags(survey._files(spark, d), "folder", F.lit("/in"), F.lit("1-9"))
    other = F.map_concat("tags", F.create_map(F.lit("AREA"), F.lit("x")))
    return tags.select("folder", F.explode(checks.read_stamp(other)).alias("key", "value"))


# ---- rotated overlaps (E17, E18, J3), summaries

@query(None)
def j3_rotated_pairs(spark, d):
    """Shared areas of rotated frames; no SQL, the tests hold it against another clip."""
    w, h = F.lit(14.0), F.lit(10.0)
    pose = ("pa", "pb", "px", "py")
    p = geo.initial_pose(F.col("east_m"), -F.col("north_m"), F.col("flight_yaw_deg"), F.col("relative_alt_m") / 30, w, h)
    s = _shots(spark, d).select("flight_id", F.col("ord").alias("k"), F.col("east_m").alias("x"), (-F.col("north_m")).alias("y"), (F.col("relative_alt_m") / 30 * 74**0.5).alias("r"), *(c.alias(n) for c, n in zip(p, pose, strict=True)))
    largest = s.agg(F.max("r")).first()[0] or 1.0
    found = graph.grid_join(s, 2 * largest + 1e-9)
    a, b = (tuple(F.col(f"{f}.{c}") for c in pose) for f in "ab")
    found = found.where(geo.may_overlap(a, b, w, h, 0.2499))  # what rounds to less is not clipped
    pairs = found.select("flight_id", F.col("a.k").alias("i"), F.col("b.k").alias("j"), r4(geo.overlap_fraction(geo.corners(a, w, h), geo.corners(b, w, h))).alias("overlap"))
    return pairs.where("overlap >= 0.25")


@query(f"{survey._REACH}, dg as (select c_custkey as node, count(v) as degree from customer left join (select i as v from e union all select j from e) z on v = c_custkey group by c_custkey), sz as (select component, count(*) as n from comp group by component) select (select count(*) from e) as pairs, (select count(*) from sz) as components, (select max(n) from sz) as largest_component, count(*) filter (degree = 0) as isolated, min(degree) as degree_min, median(degree) as degree_median, max(degree) as degree_max from dg")
def a8_graph_summary(spark, d):
    return graph.summary(*survey._edges(spark, d))


# ---- constraints

_LINK = "select flight_id, ord as i, lead(ord) over w as j, cos(0.01e0 * ord) as ha, sin(0.01e0 * ord) as hb, east_m - (lead(east_m) over w) + value % 3 as hx, (lead(north_m) over w) - north_m as hy, east_m as xi, -north_m as yi, lead(east_m) over w as xj, -(lead(north_m) over w) as yj from fx_shots window w as (partition by flight_id order by ord)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d, _LINK).where("j is not null")


def _poses() -> tuple:
    one, none = F.lit(1.0), F.lit(0.0)
    h = tuple(map(F.col, ("ha", "hb", "hx", "hy")))
    return h, (one, none, F.col("xi"), F.col("yi")), (one, none, F.col("xj"), F.col("yj"))


def _gap(x: int, y: int) -> str:
    return f"sqrt(((ha - 1) * {x} - hb * {y} + hx - xi + xj) ** 2 + (hb * {x} + (ha - 1) * {y} + hy - yi + yj) ** 2)"


_GAPS = [_gap(*c) for c in ((0, 0), (41, 0), (41, 31), (0, 31))]


@query(f"{SHOTS}, l as ({_LINK}) select flight_id, i, j, greatest({', '.join(_GAPS)}) <= 0.25e0 * sqrt(41e0 * 41 + 31 * 31) as agrees from l where j is not null")
def f10_agrees_with_seed(spark, d):
    return _links(spark, d).select("flight_id", "i", "j", geo.agrees(*_poses(), F.lit(41.0), F.lit(31.0)).alias("agrees"))


@query(f"{SHOTS}, l as ({_LINK}) select flight_id, round(median(({' + '.join(_GAPS)}) / 4), 4) as residual, count(*) as pairs from l where j is not null group by flight_id")
def a13_residual(spark, d):
    r = geo.corner_residual(*_poses(), F.lit(41.0), F.lit(31.0))
    return _links(spark, d).withColumn("r", r).groupBy("flight_id").agg(F.round(F.median("r"), 4).alias("residual"), F.count("*").alias("pairs"))


@query("with m as (select l_suppkey % 40 as i, 40 + l_partkey % 30 as j, l_quantity > 20 as ok from lineitem), n as (select i, j, count(*) as n, count(*) filter (ok) as n_inlier from m group by i, j) select i, j, n_inlier from n where n >= 10 and n_inlier >= 12")
def f9_constraints(spark, d):
    m = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("i"), (40 + F.col("l_partkey") % 30).alias("j"), (F.col("l_quantity") > 20).alias("ok"))
    return match.constraints(match.enough_matches(m).where("ok"))


# ---- points (J6, K8, A24, E31, T5), frames of an ortho

_FRAMES = "select cast(i as bigint) as shot, 1e0 as a, 0e0 as b, -20e0 * i as tx, 5e0 * (i % 3) as ty, 30e0 as w, 40e0 as h from (select distinct l_partkey % 60 as i from lineitem) z"
_PLACED = "select l_orderkey * 10 + l_linenumber as point_id, cast(l_partkey % 60 as bigint) as shot, 20e0 * (l_partkey % 60) + l_quantity * 1.5e0 - 20 as u, l_discount * 300 + 2 as v from lineitem"
_M = "least({f}.a * u - {f}.b * v + {f}.tx, {f}.w - ({f}.a * u - {f}.b * v + {f}.tx), {f}.b * u + {f}.a * v + {f}.ty, {f}.h - ({f}.b * u + {f}.a * v + {f}.ty))"
_ROUTED = f"""f as ({_FRAMES}), p as ({_PLACED}), o as (select p.*, {_M.format(f='f')} as m, f.a * u - f.b * v + f.tx as px from p join f on p.shot = f.shot),
b as (select point_id, shot as other, px as opx from (select o.point_id, g.shot, g.a * u - g.b * v + g.tx as px, row_number() over (partition by o.point_id order by {_M.format(f='g')} desc, g.shot) as n from o join f g on abs(g.shot - o.shot) <= 4 where o.m < 0 and {_M.format(f='g')} >= 0) z where n = 1)
select o.point_id, coalesce(b.other, o.shot) as shot, round(coalesce(b.opx, o.px), 4) + 0e0 as px, b.other is not null as rerouted from o left join b on o.point_id = b.point_id"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return points.rerouted(spark.sql(_PLACED), spark.sql(_FRAMES))


@query(f"with {_ROUTED}")
def j6_rerouted_points(spark, d):
    return _routed(spark, d).select("point_id", "shot", r4("px").alias("px"), "rerouted")


@query(f"with r0 as (with {_ROUTED}) select count(*) as kept, 0 as rejected, count(*) filter (rerouted) as rerouted, round(median(abs(px)), 4) as median_shift, round(max(abs(px)), 4) as max_shift from r0")
def a24_shift_report(spark, d):
    got = points.shift_report(_routed(spark, d).withColumn("shift", F.abs(r4("px"))))
    return got.withColumns({"median_shift": F.round("median_shift", 4), "max_shift": F.round("max_shift", 4)})


@query("select l_orderkey * 10 + l_linenumber as point_id, cast(l_linenumber as varchar) || ';mosaic.tif;' || printf('%.1f', l_quantity) || ';note' as line from lineitem")
def k8_remapped_lines(spark, d):
    cells = F.array(F.col("l_linenumber").cast("string"), F.lit("img.jpg"), F.lit("0"), F.lit("note"))
    line = points.remapped_line(cells, F.lit(";"), [(F.lit(1), F.lit("mosaic.tif")), (F.lit(2), F.format_string("%.1f", "l_quantity")), (F.lit(None).cast("int"), F.lit("x"))])
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), line.alias("line"))


@query(f"{SHOTS} select flight_id, ord, round(0.5e0 * cos(radians(flight_yaw_deg)), 4) + 0e0 as xx, round(-0.5e0 * sin(radians(flight_yaw_deg)), 4) + 0e0 as xy, round(east_m - 0.5e0 * 20.5e0 * cos(radians(flight_yaw_deg)) + 0.5e0 * 15.5e0 * sin(radians(flight_yaw_deg)), 4) + 0e0 as tx, round(north_m + 0.5e0 * 20.5e0 * sin(radians(flight_yaw_deg)) + 0.5e0 * 15.5e0 * cos(radians(flight_yaw_deg)), 4) + 0e0 as ty from fx_shots")
def e27_tile_to_utm(spark, d):
    yaw = F.radians("flight_yaw_deg")
    t = geo.tile_to_utm(F.col("east_m"), F.col("north_m"), F.sin(yaw), F.cos(yaw), F.lit(0.5), F.lit(41.0), F.lit(31.0))
    return _shots(spark, d).withColumn("t", t).select("flight_id", "ord", *(r4(f"t.{c}").alias(c) for c in ("xx", "xy", "tx", "ty")))


@query(f"{SHOTS}, s as (select flight_id, relative_alt_m / 3000 as gx, relative_alt_m / 3000 * (1 + value / 1e5) as gy from fx_shots) select flight_id, round(min(least(gx, gy)), 9) as gsd, round(min(greatest(gx, gy) / least(gx, gy)), 6) as least, round(max(greatest(gx, gy) / least(gx, gy)), 6) as most from s group by flight_id")
def a19_pixel_sizes(spark, d):
    gx = F.col("relative_alt_m") / 3000
    gy = gx * (1 + F.col("value") / 1e5)
    return flight.pixel_sizes(_shots(spark, d).withColumns({"gx": gx, "gy": gy})).select("flight_id", F.round("gsd", 9).alias("gsd"), r6("least").alias("least"), r6("most").alias("most"))


@query(f"{SHOTS} select flight_id, median(relative_alt_m / 3000) as gsd, round(avg(north_m), 6) as lat, round(avg(east_m), 6) as lon, round(max(east_m) - min(east_m), 6) as east_extent, round(max(north_m) - min(north_m), 6) as north_extent from fx_shots group by flight_id")
def a3_flight_report(spark, d):
    s = _shots(spark, d)
    return s.groupBy("flight_id").agg(F.median(F.col("relative_alt_m") / 3000).alias("gsd"), r6(F.avg("north_m")).alias("lat"), r6(F.avg("east_m")).alias("lon"), r6(F.max("east_m") - F.min("east_m")).alias("east_extent"), r6(F.max("north_m") - F.min("north_m")).alias("north_extent"))


@query("select l_orderkey, l_linenumber, l_quantity > 25 or l_discount > 0.05 or l_tax > 0.07 as valid from lineitem")
def e34_valid_pixels(spark, d):
    bands = [F.when(F.col(c) > F.lit(x), 1).otherwise(0) for c, x in (("l_quantity", 25), ("l_discount", 0.05), ("l_tax", 0.07))]
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.valid_pixel(*bands).alias("valid"))


QUERIES, ORACLE = survey.QUERIES, survey.ORACLE
