"""Survey queries on the fixtures, each with SQL for the same rows.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightgrid import fixtures as fx
from flightgrid.functions import geo
from flightgrid.operators import flight, graph, match, points, raster
from flightgrid.sources import checks
from flightgrid.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHOTS = fx.shots_sql()


def query(sql: str | None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _shots(spark: SparkSession, d: str, select: str = "select * from fx_shots") -> DataFrame:
    _t(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql(f"{SHOTS} {select}")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r4(c: Column | str) -> Column:
    """Without a negative zero."""
    return F.round(c, 4) + 0.0


# ---- sources and checks

FILES = "select source as folder, source || '_' || lpad(cast(doc_id % 10000 as varchar(9)), 4, '0') || case when doc_id % 3 = 0 then '_D.JPG' when doc_id % 3 = 1 then '_d.jpg' else '.tif' end as name, n_chars as size, doc_id as mtime from documents"


def _files(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "documents").createOrReplaceTempView("documents")
    return spark.sql(FILES)


@query(f"with f as ({FILES}) select folder, case when bool_or(lower(name) like '%.jpg') then 'exif' when bool_or(lower(name) like '%.tif') then 'ortho' end as format from f group by folder")
def s1_format_detection(spark, d):
    return checks.format_of(_files(spark, d), "folder", "name")


@query(f"with f as ({FILES}) select folder, name from f where mtime % 7 = 0 and name not in (select name from f where mtime % 14 = 0)")
def s3_missing_files(spark, d):
    f = _files(spark, d)
    return checks.missing(f.where("mtime % 7 = 0").select("folder", "name"), f.where("mtime % 14 = 0").select("folder", "name"), ["folder", "name"])


@query(f"with f as ({FILES}) select name, cast(nullif(regexp_extract(name, '_([0-9]{{4}})_D\\.JPG', 1, 'i'), '') as int) as frame from f")
def f2_frame_name(spark, d):
    return _files(spark, d).select("name", checks.frame_number(F.col("name")).alias("frame"))


@query(f"with f as ({FILES}) select name, cast(regexp_extract(split_part(name, '.', 1), '[0-9]+') as bigint) as shot from f")
def s16_shot_number(spark, d):
    return _files(spark, d).select("name", checks.shot_number(F.col("name")).alias("shot"))


@query(f"with f as ({FILES}) select folder, count(*) as files, max(mtime) as newest, substr(sha256(string_agg(name || '|' || size || '|' || mtime || chr(10), '' order by name, size, mtime)), 1, 16) as digest from f group by folder")
def e33_fileset_digest(spark, d):
    return checks.fileset_digest(_files(spark, d), "folder")


STAMPS = "select case r_regionkey when 0 then 'DIGEST' when 1 then 'MTIME' when 2 then 'COUNT' when 3 then 'SOURCE' else 'FRAMES' end as key, r_name as value from region"


@query(f"with a as ({STAMPS}), s as (select * from a where value <> 'ASIA'), c as (select key, case when key = 'COUNT' then value else value || 'x' end as value from a where key <> 'FRAMES') select coalesce(s.key, c.key) as key, coalesce(s.value, '(absent)') as was, coalesce(c.value, '(absent)') as now from s full join c on s.key = c.key where s.value is distinct from c.value and coalesce(s.key, c.key) not in ('COMPOSED', 'MTIME')")
def j12_stale_reasons(spark, d):
    _t(spark, d, "region").createOrReplaceTempView("region")
    a = spark.sql(STAMPS)
    now = a.where("key <> 'FRAMES'").withColumn("value", F.when(F.col("key") == "COUNT", F.col("value")).otherwise(F.concat("value", F.lit("x"))))
    return checks.stale_reasons(a.where("value <> 'ASIA'"), now)


# ---- scalar expressions

DMS = "select event_id, cast(event_id % 90 as varchar(9)) || ' deg ' || cast(event_id % 60 as varchar(9)) || chr(39) || ' ' || cast(event_id % 50 as varchar(9)) || '.50\"' as lat, case when event_id % 2 = 0 then 'S' else 'N' end as letter, '+' || cast(event_id % 200 as varchar(9)) || '.25' as alt from events"


@query(f"with f as ({DMS}) select event_id, round((event_id % 90 + (event_id % 60) / 60e0 + (event_id % 50 + 0.5e0) / 3600) * case letter when 'S' then -1 else 1 end, 6) as lat, event_id % 200 + 0.25e0 as alt from f")
def e1_parse_tags(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    f = spark.sql(DMS)
    return f.select("event_id", r6(geo.dms(F.col("lat"), F.col("letter"), "S")).alias("lat"), F.abs(geo.signed_number(F.col("alt"))).alias("alt"))


@query(f"{SHOTS} select flight_id, ord, round(flight_yaw_deg * 3 - value - 360 * floor((flight_yaw_deg * 3 - value + 180) / 360), 6) as yaw_diff, round(relative_alt_m / 3000, 6) as gsd from fx_shots")
def e5_yaw_and_gsd(spark, d):
    return _shots(spark, d).select("flight_id", "ord", r6(geo.yaw_difference(F.col("flight_yaw_deg") * 3, F.col("value"))).alias("yaw_diff"), r6(F.col("relative_alt_m") / 3000).alias("gsd"))


PLACES = "select event_id, (event_id % 150) - 75e0 + value / 1e4 as lat, (event_id % 360) - 180e0 + value / 1e4 as lon from events"
_E, _N = geo.to_utm_sql("lat", "lon")


@query(f"with p as ({PLACES}) select event_id, cast(case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1 as int) as epsg, cast(floor((lon + 180) / 6) * 6 - 177 as int) as central, round(degrees(atan(tan(radians(lon - (floor((lon + 180) / 6) * 6 - 177))) * sin(radians(lat)))), 6) as convergence, round({_E}, 3) as east, round({_N}, 3) as north from p")
def e9_utm(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    lat, lon = F.col("lat"), F.col("lon")
    east, north = geo.to_utm(lat, lon)
    return spark.sql(PLACES).select("event_id", geo.utm_epsg(lat, lon).cast("int").alias("epsg"), geo.central_meridian(lon).cast("int").alias("central"), r6(geo.convergence(lat, lon)).alias("convergence"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


_POSE = "cos(radians(flight_yaw_deg)) * s as a, sin(radians(flight_yaw_deg)) * s as b, east_m as cx, -north_m as cy from (select *, relative_alt_m / 30 as s from fx_shots) z"


@query(f"{SHOTS}, p as (select flight_id, ord, {_POSE}), q as (select *, cx - (a * 20.5e0 - b * 15.5e0) as tx, cy - (b * 20.5e0 + a * 15.5e0) as ty from p) select flight_id, ord, round(a, 4) + 0e0 as a, round(b, 4) + 0e0 as b, round(tx, 4) + 0e0 as tx, round(ty, 4) + 0e0 as ty, round(41 * 31 * (a * a + b * b), 4) + 0e0 as area, round((a * 41 - b * 31 + tx), 4) + 0e0 as x2, round(sqrt(660.5e0) * sqrt(a * a + b * b), 4) + 0e0 as radius, round(ln(sqrt(a * a + b * b)), 4) + 0e0 as log_scale from q")
def e10_poses_and_footprints(spark, d):
    w, h = F.lit(41.0), F.lit(31.0)
    p = geo.initial_pose(F.col("east_m"), -F.col("north_m"), F.col("flight_yaw_deg"), F.col("relative_alt_m") / 30, w, h)
    df = _shots(spark, d).select("flight_id", "ord", *(c.alias(n) for c, n in zip(p, ("a", "b", "tx", "ty"), strict=True)))
    q = tuple(map(F.col, ("a", "b", "tx", "ty")))
    df = df.withColumn("quad", geo.corners(q, w, h))
    mid = geo.apply_pose(q, w / 2, h / 2)
    first = F.get("quad", F.lit(0))
    return df.select("flight_id", "ord", *(r4(c).alias(c) for c in ("a", "b", "tx", "ty")), r4(geo.polygon_area(F.col("quad"))).alias("area"), r4(F.get("quad", F.lit(2)).x).alias("x2"), r4(F.hypot(first.x - mid[0], first.y - mid[1])).alias("radius"), r4(geo.decompose(q)[3]).alias("log_scale"))


@query(f"{SHOTS}, p as (select flight_id, ord, {_POSE}) select flight_id, ord, cast(1 as double) as ia, cast(0 as double) as ib, cast(0 as double) as ix, cast(0 as double) as iy, round(3 * cx, 6) as sx from p")
def e13_compose_invert_rescale(spark, d):
    s = F.col("relative_alt_m") / 30
    p = (s * F.cos(F.radians("flight_yaw_deg")), s * F.sin(F.radians("flight_yaw_deg")), F.col("east_m"), -F.col("north_m"))
    one = geo.compose(geo.invert(p), p)
    clean = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zero
    return _shots(spark, d).select("flight_id", "ord", *(clean(c).alias(n) for c, n in zip(one, ("ia", "ib", "ix", "iy"), strict=True)), r6(geo.rescale(p, F.lit(3.0))[2]).alias("sx"))


@query(f"{SHOTS} select flight_id, ord, case when value * 10 / 8 >= 700 then 8 when value * 10 / 4 >= 700 then 4 when value * 10 / 2 >= 700 then 2 else 1 end as reduction, cast(floor(179e0 * ord / greatest(count(*) over (partition by flight_id) - 1, 1)) as int) as hue from fx_shots")
def e21_reduction_and_hue(spark, d):
    from pyspark.sql import Window

    long = F.col("value") * 10
    red = F.coalesce(F.get(F.filter(F.array(*map(F.lit, (8, 4, 2, 1))), lambda r: long / r >= 700), F.lit(0)), F.lit(1))
    n = F.count("*").over(Window.partitionBy("flight_id"))
    return _shots(spark, d).select("flight_id", "ord", red.alias("reduction"), F.floor(179.0 * F.col("ord") / F.greatest(n - 1, F.lit(1))).cast("int").alias("hue"))


# ---- telemetry

STEPS = f"{SHOTS}, s as (select *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by flight_id order by ord)) / 1e6, 1e0) as dt from fx_shots), i as (select flight_id, ord, sum(case when ord = 0 then 0 else value / 1000 * dt end) over w as east, sum(case when ord = 0 then 0 else relative_alt_m * dt end) over w as north from s window w as (partition by flight_id order by ord rows unbounded preceding))"


@query(f"{STEPS}, k as (select * from i where ord >= 3) select flight_id, ord, round(east - first_value(east) over (partition by flight_id order by ord), 3) as east, round(north - first_value(north) over (partition by flight_id order by ord), 3) as north from k")
def w2_odometry_positions(spark, d):
    shots = _shots(spark, d).withColumn("v_e", F.col("value") / 1000)
    got = flight.integrate(flight.odometry(shots, "relative_alt_m", "v_e"), first=3)
    return got.select("flight_id", "ord", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query("select event_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as vo_idx from events where true")
def w4_dense_index(spark, d):
    return flight.dense_index(_t(spark, d, "events").withColumnRenamed("user_id", "flight_id")).select("event_id", "vo_idx")


@query(f"{SHOTS} select flight_id, ord from fx_shots where ord >= 5 and ord <= 20")
def f1_frame_range(spark, d):
    return flight.frame_range(_shots(spark, d), 5, 20).select("flight_id", "ord")


MARKED = f"""{SHOTS}, ax as (select flight_id, degrees(atan2(avg(sin(radians(2 * flight_yaw_deg))), avg(cos(radians(2 * flight_yaw_deg))))) / 2 as axis_deg from fx_shots group by flight_id),
m as (select s.*, a.axis_deg, abs(flight_yaw_deg - axis_deg - 360 * floor((flight_yaw_deg - axis_deg + 180) / 360)) as dd, abs(coalesce(gimbal_pitch_deg, -90) + 90) <= 3 as usable from fx_shots s join ax a on s.flight_id = a.flight_id),
mk as (select *, least(dd, 180 - dd) > 15 or not usable as is_curve, case when least(dd, 180 - dd) > 15 or not usable then null when dd < 90 then 1 else -1 end as heading from m)"""


@query(f"{MARKED} select flight_id, ord, usable, is_curve, heading, round(axis_deg, 6) as axis_deg from mk")
def f0_mark_curves(spark, d):
    return flight.mark_curves(_shots(spark, d)).select("flight_id", "ord", "usable", "is_curve", "heading", r6("axis_deg").alias("axis_deg"))


@query(f"{MARKED} select flight_id, count(*) as shots, count(*) filter (is_curve) as curves, count(*) filter (usable) as usable, round(min(axis_deg), 6) as axis_deg, round(median(relative_alt_m), 6) as median_alt, round(max(east_m) - min(east_m), 6) as extent from mk group by flight_id")
def a2_flight_summary(spark, d):
    m = flight.mark_curves(_shots(spark, d))
    return m.groupBy("flight_id").agg(F.count("*").alias("shots"), F.count_if("is_curve").alias("curves"), F.count_if("usable").alias("usable"), r6(F.min("axis_deg")).alias("axis_deg"), r6(F.median("relative_alt_m")).alias("median_alt"), r6(F.max("east_m") - F.min("east_m")).alias("extent"))


LEGS = f"""{MARKED}, isl as (select *, sum(case when heading is not distinct from ph and ord > 0 then 0 else 1 end) over (partition by flight_id order by ord rows unbounded preceding) as island from (select *, lag(heading) over (partition by flight_id order by ord) as ph from mk) z),
one as (select flight_id, island, min(heading) as heading, min(ord) as first_ord, max(ord) as last_ord, count(*) as n, sqrt((arg_max(east_m, ord) - arg_min(east_m, ord)) ** 2 + (arg_max(north_m, ord) - arg_min(north_m, ord)) ** 2) as extent_m from isl where heading is not null group by flight_id, island having count(*) >= 3),
leg as (select *, least(12e0, 0.5e0 * (select median(o.extent_m) from one o where o.flight_id = one.flight_id)) as least_m from one)
, legs as (select flight_id, cast(row_number() over (partition by flight_id order by first_ord) as int) as leg_id, heading, first_ord, last_ord, n, extent_m from leg where extent_m >= least_m)"""


@query(f"{LEGS} select flight_id, leg_id, heading, first_ord, last_ord, n, round(extent_m, 6) as extent_m from legs")
def w5_legs(spark, d):
    got = flight.legs(flight.mark_curves(_shots(spark, d)), 12.0)
    return got.withColumn("extent_m", r6("extent_m"))


@query(f"{LEGS} select m.flight_id, m.ord, l.leg_id is null as is_curve, case when l.leg_id is not null then m.heading end as heading from mk m left join legs l on m.flight_id = l.flight_id and m.ord between l.first_ord and l.last_ord")
def w6_demotion(spark, d):
    m = flight.mark_curves(_shots(spark, d))
    return flight.demote(m, flight.legs(m, 12.0)).select("flight_id", "ord", "is_curve", "heading")


_ENDS = "ends as (select flight_id, first_ord as ord from legs union select flight_id, last_ord from legs)"


@query(f"""{LEGS.replace('with shots_raw', 'with recursive shots_raw', 1)}, {_ENDS}, u as (select m.flight_id, m.ord, m.east_m, m.north_m, e.ord is not null as fixed, row_number() over (partition by m.flight_id order by m.ord) as n from mk m left join ends e on m.flight_id = e.flight_id and m.ord = e.ord where m.usable),
t(flight_id, n, ord, kx, ky, keep) as (select flight_id, n, ord, east_m, north_m, true from u where n = 1 union all
select flight_id, n, ord, case when take then x else kx end, case when take then y else ky end, take from (select u.flight_id, u.n, u.ord, t.kx, t.ky, u.east_m as x, u.north_m as y, u.fixed or sqrt((u.east_m - kx) ** 2 + (u.north_m - ky) ** 2) >= 6 as take from t join u on u.flight_id = t.flight_id and u.n = t.n + 1) z)
select flight_id, ord from t where keep""")
def w7_thinning(spark, d):
    m = flight.mark_curves(_shots(spark, d))
    return flight.thin(flight.with_endpoints(m, flight.legs(m, 12.0)), flight.thinning_step(15.0, 0.6))


@query(f"{SHOTS}, k as (select * from fx_shots where ord % 3 = 0) select * from (select flight_id, ord as i, lead(ord) over w as j, round(lead(east_m) over w - east_m, 6) as dx, round(-(lead(north_m) over w - north_m), 6) + 0e0 as dy from k window w as (partition by flight_id order by ord)) z where j is not null")
def w10_consecutive_constraints(spark, d):
    got = flight.consecutive(_shots(spark, d).where("ord % 3 = 0"))
    return got.select("flight_id", "i", "j", r6("dx").alias("dx"), (r6("dy") + 0.0).alias("dy"))


_AL = "(({x}) * sin(radians(axis_deg)) + ({y}) * cos(radians(axis_deg))) / nullif(sqrt(({x}) ** 2 + ({y}) ** 2), 0)"


@query(f"""{MARKED}, st as (select *, east_m - lag(east_m) over w as px, north_m - lag(north_m) over w as py, lead(east_m) over w - east_m as nx, lead(north_m) over w - north_m as ny from mk window w as (partition by flight_id order by ord)),
al as (select flight_id, ord, case when sqrt(px ** 2 + py ** 2) >= 0.3 then {_AL.format(x="px", y="py")} end as p, case when sqrt(nx ** 2 + ny ** 2) >= 0.3 then {_AL.format(x="nx", y="ny")} end as q from st)
select flight_id, ord, case when coalesce(case when coalesce(abs(p), -1) >= coalesce(abs(q), -1) then p else q end, 1) >= 0 then 1 else -1 end as sign from al""")
def w9_forward_direction(spark, d):
    return flight.forward(flight.mark_curves(_shots(spark, d)))


# ---- overlaps and the graph

PAIRS = f"""{SHOTS}, bx as ({fx.BOXES}), pr as (select a.flight_id, a.k as i, b.k as j, greatest(0, 14 - abs(a.x - b.x)) * greatest(0, 10 - abs(a.y - b.y)) / 140 as overlap from bx a join bx b on a.flight_id = b.flight_id and a.k < b.k
where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 2 * sqrt(74))"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    boxes = _shots(spark, d, fx.BOXES).withColumns({"w": F.lit(14.0), "h": F.lit(10.0), "r": F.sqrt(F.lit(74.0))})
    found = graph.box_overlap(graph.grid_join(boxes, 2 * 74**0.5 + 1e-9))
    return found.select("flight_id", F.col("a.k").alias("i"), F.col("b.k").alias("j"), "overlap")


@query(f"{PAIRS} select flight_id, i, j, round(overlap, 6) as overlap from pr where overlap >= 0.25")
def j3_overlap_pairs(spark, d):
    return _pairs(spark, d).where("overlap >= 0.25").withColumn("overlap", r6("overlap"))


@query(f"{PAIRS}, e as (select *, round(overlap, 9) as o from pr where overlap >= 0.25), n as (select flight_id, i, j, o, row_number() over (partition by flight_id, i_ order by o desc, i, j) as n from (select *, i as i_ from e union all select *, j from e) z) select distinct flight_id, i, j from n where n <= 6")
def t2_top_neighbours(spark, d):
    p = _pairs(spark, d).where("overlap >= 0.25").withColumn("overlap", F.round("overlap", 9))
    return graph.top_neighbours(p).select("flight_id", "i", "j")


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    nodes = _t(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return nodes, spark.sql(fx.EDGES)


@query(f"with e as ({fx.EDGES}) select c_custkey as node, count(v) as degree from customer left join (select i as v from e union all select j from e) z on v = c_custkey group by c_custkey")
def a8_degrees(spark, d):
    return graph.degrees(*_edges(spark, d))


_REACH = f"with recursive e as ({fx.EDGES}), both_ as (select i as a, j as b from e union all select j, i from e), r(node, root) using key (node) as (select c_custkey, c_custkey from customer union select b.b as node, min(r.root) as root from r join both_ b on b.a = r.node join recurring.r x on x.node = b.b where r.root < x.root group by b.b), comp as (select node, root as component from r)"


@query(f"{_REACH} select node, component from comp")
def a9_components(spark, d):
    return graph.components(*_edges(spark, d))


@query(f"{_REACH}, s as (select (select count(*) from comp) as nodes, (select count(distinct component) from comp) as components, (select count(*) from e) as edges) select nodes, edges, components, edges - nodes + components as cycles, edges - nodes + components >= floor(nodes / 4) as healthy from s")
def a10_cycles(spark, d):
    return graph.cycles(*_edges(spark, d))


@query(f"{_REACH} select component, count(*) as n, cast(row_number() over (order by count(*) desc, component) as int) as place from comp group by component having count(*) > 1")
def t4_components_by_size(spark, d):
    from pyspark.sql import Window

    sizes = graph.components(*_edges(spark, d)).groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "component")))


# ---- matching and fits

_BITS = "select vec_id as feature, label as image, embedding from embeddings where vec_id < 400"


@query(f"""with f as (select vec_id as feature, label as image, cast(list_aggregate(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), 'string_agg', '') as bit) as b from embeddings where label in (select label from embeddings group by label having count(*) >= 8)),
p as (select a.image as i, b.image as j from (select distinct image from f) a join (select distinct image from f) b on a.image < b.image),
dd as (select p.i, p.j, q.feature as q, t.feature as t, bit_count(xor(q.b, t.b)) as d from p join f q on q.image = p.i join f t on t.image = p.j),
n as (select *, row_number() over (partition by i, j, q order by d, t) as n from dd)
select a.i, a.j, a.q, a.t, cast(a.d as int) as d1, cast(b.d as int) as d2 from n a join n b on a.i = b.i and a.j = b.j and a.q = b.q and a.n = 1 and b.n = 2 where a.d < 0.75 * b.d""")
def j4_descriptor_matches(spark, d):
    sign = lambda i: F.shiftleft(F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i)
    bits = sign(0)
    for i in range(1, 64):
        bits = bits.bitwiseOR(sign(i))
    f = _t(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.col("label").alias("image"), F.when(F.col("embedding").isNotNull(), bits).alias("bits"))
    images = f.select("image").distinct()  # a few labels
    pairs = images.withColumnRenamed("image", "i").join(images.withColumnRenamed("image", "j"), F.col("i") < F.col("j"))
    return match.ratio_test(match.two_nearest(pairs, f))


_PTS = "select flight_id, ord, east_m as x, -north_m as y, east_m * 0.9 - (-north_m) * 0.1 + 5 + (value % 1) + case when ord = 7 then 500 else 0 end as u, east_m * 0.1 + (-north_m) * 0.9 - 3 + (value * 7 % 1) as v from fx_shots"
_FIT = """(select flight_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv, avg(x*x)+avg(y*y)-avg(x)*avg(x)-avg(y)*avg(y) as s, avg(x*u)+avg(y*v)-avg(x)*avg(u)-avg(y)*avg(v) as sa, avg(x*v)-avg(y*u)-avg(x)*avg(v)+avg(y)*avg(u) as sb, (avg(x*u)-avg(x)*avg(u))*(avg(y*v)-avg(y)*avg(v))-(avg(y*u)-avg(y)*avg(u))*(avg(x*v)-avg(x)*avg(v)) as det, sqrt((avg(x*u)-avg(x)*avg(u)-avg(y*v)+avg(y)*avg(v))**2 + (avg(y*u)-avg(y)*avg(u)+avg(x*v)-avg(x)*avg(v))**2) as mirrored from {t} group by flight_id)"""
_AB = "(select *, mu - a * mx + b * my as tx, mv - b * mx - a * my as ty from (select *, sc * coalesce(sa / nullif(sqrt(sa*sa+sb*sb), 0), 1) as a, sc * coalesce(sb / nullif(sqrt(sa*sa+sb*sb), 0), 0) as b from (select *, case when s > 1e-12 then case when det < 0 then mirrored else sqrt(sa*sa+sb*sb) end / s else 1 end as sc from {f} z where n > 1) z2) z3)"
_RES = "(select p.*, sqrt((a * x - b * y + tx - u) ** 2 + (b * x + a * y + ty - v) ** 2) as residual from {p} p join {f} f on p.flight_id = f.flight_id)"


@query(f"{SHOTS}, p as ({_PTS}), f as (select * from {_AB.format(f=_FIT.format(t='p'))} y) select flight_id, n, round(a, 6) as a, round(b, 6) as b, round(tx, 4) as tx, round(ty, 4) as ty from f")
def a11_similarity(spark, d):
    fit = match.similarity(_shots(spark, d, _PTS), "flight_id").where("n > 1")
    return fit.select("flight_id", "n", r6("a").alias("a"), r6("b").alias("b"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@query(f"""{SHOTS}, p as ({_PTS}), f as (select * from {_AB.format(f=_FIT.format(t='p'))} y), r as (select * from {_RES.format(p='p', f='f')} y),
m as (select *, median(residual) over (partition by flight_id) as med, count(*) over (partition by flight_id) as cnt from r), m2 as (select *, median(abs(residual - med)) over (partition by flight_id) as mad from m),
m3 as (select *, residual < med + 4 * 1.4826e0 * mad as ok from m2), m4 as (select *, count(*) filter (ok) over (partition by flight_id) as k from m3),
q as (select flight_id, ord, x, y, u, v from m4 where not (cnt > 8 and mad > 0 and k >= greatest(8, cnt / 2)) or ok),
g as (select * from {_AB.format(f=_FIT.format(t='q'))} y), rr as (select q.flight_id, 0.5e0 * sqrt((a * x - b * y + tx - u) ** 2 + (b * x + a * y + ty - v) ** 2) as residual, n, a, b, c.all_ from q join g on q.flight_id = g.flight_id join (select flight_id, count(*) as all_ from p group by flight_id) c on c.flight_id = q.flight_id)
select flight_id, max(all_) as points, max(all_) - max(n) as outliers, round(degrees(atan2(max(b), max(a))) - 1.5e0, 4) as rotation_residual_deg, round(max(residual), 4) as max_m, round(degrees(atan2(max(b), max(a))), 4) as rotation_deg, round(sqrt(max(a) ** 2 + max(b) ** 2), 5) as scale, round(median(residual), 4) as median_m, round(sqrt(avg(residual ** 2)), 4) as rms_m from rr group by flight_id""")
def a12_robust_fit(spark, d):
    got = match.robust_similarity(_shots(spark, d, _PTS), "flight_id", 0.5, 1.5)
    return got.select("flight_id", "points", "outliers", F.round("rotation_deg", 4).alias("rotation_deg"), F.round("scale", 5).alias("scale"), F.round("median_m", 4).alias("median_m"), F.round("rms_m", 4).alias("rms_m"), F.round("max_m", 4).alias("max_m"), F.round("rotation_residual_deg", 4).alias("rotation_residual_deg"))


# ---- canvas and pixels

_CORNERS = f"{SHOTS}, c as (select flight_id, ord as k, east_m + dx as x, -north_m + dy as y from fx_shots, (select 0.5e0 as dx, 0.25e0 as dy union all select 14.5e0, 10.25e0) z)"


def _corners(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d, "select flight_id, ord as k, east_m + dx as x, -north_m + dy as y from fx_shots, (select 0.5e0 as dx, 0.25e0 as dy union all select 14.5e0, 10.25e0) z")


@query(f"{_CORNERS} select flight_id, cast(floor(min(x)) as bigint) as x0, cast(floor(min(y)) as bigint) as y0, cast(ceil(max(x)) as bigint) as x1, cast(ceil(max(y)) as bigint) as y1 from c group by flight_id")
def a6_canvas(spark, d):
    return raster.canvas(_corners(spark, d), "flight_id")


@query(f"{_CORNERS}, b as (select flight_id, k, cast(floor(min(y)) + 1000 as bigint) as y0, cast(ceil(max(y)) + 1000 as bigint) as y1 from c group by flight_id, k) select flight_id, k, g.band from b, range(0, 100) g(band) where y1 + 8 > g.band * 64 and y0 - 8 < (g.band + 1) * 64")
def j7_frames_in_bands(spark, d):
    b = raster.frame_boxes(_corners(spark, d), "flight_id", "k").withColumns({"y0": F.col("y0") + 1000, "y1": F.col("y1") + 1000})
    return raster.frames_in_bands(b, 64, 8).select("flight_id", "k", "band")


PIXELS = "select l_partkey % 40 as x, l_suppkey % 30 as y, l_linenumber as shot, cast(l_quantity * 4 as bigint) as value, (l_orderkey % 17) as distance, l_partkey % 23 as blob from lineitem"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(PIXELS)


@query(f"with p as ({PIXELS}) select x, y, round(case when count(*) < 2 then 0 else stddev_pop(value) end, 6) as spread, count(*) as shots from p group by x, y")
def a15_disagreement(spark, d):
    return raster.disagreement(_pixels(spark, d)).withColumn("spread", r6("spread"))


@query(f"with p as ({PIXELS}), s as (select x, y, round(case when count(*) < 2 then 0 else stddev_pop(value) end, 6) as spread, count(*) as shots from p group by x, y), m as (select median(spread) as m from s), k as (select median(abs(spread - m)) as mad from s, m) select x, y, spread, shots from s, m, k where spread > m + 1 * 1.4826e0 * mad")
def f12_loud_pixels(spark, d):
    return raster.loud(raster.disagreement(_pixels(spark, d)).withColumn("spread", r6("spread")), 1.0)


@query(f"with p as ({PIXELS}) select x, y, cast(min(distance * 100 + shot) % 100 as int) as shot from p group by x, y")
def a16_nadir_owner(spark, d):
    return raster.owner(_pixels(spark, d)).withColumn("shot", F.col("shot").cast("int"))


@query(f"with p as ({PIXELS}), n as (select blob, shot, count(*) as n from p group by blob, shot), r as (select *, row_number() over (partition by blob order by n desc, shot) as k from n) select blob, shot, n from r where k = 1")
def a17_blob_majority(spark, d):
    return raster.majority(_pixels(spark, d), "blob")


@query(f"with p as ({PIXELS}) select cast(floor(x / 4e0) as bigint) as x, cast(floor(y / 4e0) as bigint) as y, round(avg(value), 6) as value, count(*) as n from p group by 1, 2")
def k6_overview(spark, d):
    return raster.overview(_pixels(spark, d), 4).withColumn("value", r6("value"))


# ---- points

LINES = "select doc_id, case doc_id % 4 when 0 then 'Path;x;y' when 1 then 'file,row , col' when 2 then 'source|LONgitude|lat' else 'a\tpx\tpy' end as line from documents"


@query(f"""with l as ({LINES}), x as (select *, case doc_id % 4 when 0 then ';' when 1 then ',' when 2 then '|' else chr(9) end as delimiter from l)
select doc_id, delimiter, case doc_id % 4 when 3 then null else 0 end as image, case doc_id % 4 when 0 then 1 when 1 then 2 when 3 then 1 end as x, case doc_id % 4 when 2 then 1 end as lon from x""")
def s17_csv_dialect(spark, d):
    _t(spark, d, "documents").createOrReplaceTempView("documents")
    df = spark.sql(LINES).withColumn("delimiter", points.delimiter(F.col("line")))
    header = F.split("line", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    at = lambda names, prefix=False: F.when((p := points.alias_match(header, names, prefix)) >= 0, p).cast("int")
    return df.select("doc_id", "delimiter", at(("path", "img_path", "image", "image_path", "file", "filename", "source")).alias("image"), at(("x", "col", "column", "px")).alias("x"), at(("lon",), True).alias("lon"))


POINTS = "select l_orderkey * 10 + l_linenumber as point_id, 'D:\\img\\IMG_' || lpad(cast(l_partkey % 90 as varchar(9)), 4, '0') || case l_linenumber % 3 when 0 then '' when 1 then '_2' else '_0_11' end || '.TIF' as image, l_quantity * 30 as x, l_extendedprice / 100 as y from lineitem"
POINTS_SPARK = POINTS.replace("\\", "\\\\")


@query(f"with p as ({POINTS}), q as (select *, cast(regexp_extract(image, 'IMG_([0-9]{{4}})', 1) as int) as n from p) select point_id, case when n < 70 then n end as shot, round(least(x, 1500 - x, y, 900 - y), 6) as margin, least(x, 1500 - x, y, 900 - y) >= 0 as inside from q")
def j5_point_shots(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    shots = spark.range(70).select(F.format_string("frames/img_%04d.jpg", "id").alias("path"), F.col("id").cast("int").alias("ord"))
    got = points.resolve(spark.sql(POINTS_SPARK), shots)
    m = points.margin(F.col("x"), F.col("y"), F.lit(1500.0), F.lit(900.0))
    return got.select("point_id", "shot", r6(m).alias("margin"), (m >= 0).alias("inside"))


# ---- windows of the telemetry stream, here as a batch

@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def telemetry_windows(spark, d):
    return telemetry.shots_per_window(_t(spark, d, "events")).withColumn("mean", r6("mean"))


# ---- sizes, targets and drift

@query(f"{SHOTS} select flight_id, ord, round(41 * (relative_alt_m / 3000), 4) as along, round(31 * (relative_alt_m / 3000), 4) as across from fx_shots")
def e20_footprint_metres(spark, d):
    gsd = F.col("relative_alt_m") / 3000
    return _shots(spark, d).select("flight_id", "ord", r4(41 * gsd).alias("along"), r4(31 * gsd).alias("across"))


@query(f"with p as ({PLACES}) select event_id, case when event_id % 2 = 0 then 0 else round(-degrees(atan(tan(radians(lon - (floor((lon + 180) / 6) * 6 - 177))) * sin(radians(lat)))), 4) + 0e0 end as rotation from p")
def e23_expected_rotation(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    turn = r4(-geo.convergence(F.col("lat"), F.col("lon")))
    return spark.sql(PLACES).select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(turn).alias("rotation"))


@query(f"{SHOTS}, c as (select flight_id, min(floor(east_m)) as x, min(floor(-north_m)) as y, min(relative_alt_m) / 3000 as gsd from fx_shots where ord = 0 group by flight_id) select flight_id, round(500000 + x * gsd, 4) + 0e0 as east, round(4800000 - y * gsd, 4) + 0e0 as north from c")
def e24_canvas_origin(spark, d):
    c = _shots(spark, d).where("ord = 0").groupBy("flight_id").agg(F.min(F.floor("east_m")).alias("x"), F.min(F.floor(-F.col("north_m"))).alias("y"), (F.min("relative_alt_m") / 3000).alias("gsd"))
    return c.select("flight_id", r4(500000 + F.col("x") * F.col("gsd")).alias("east"), r4(4800000 - F.col("y") * F.col("gsd")).alias("north"))


@query(f"{SHOTS}, k as (select * from fx_shots where ord >= 2) select flight_id, ord, round((east_m - first_value(east_m) over w) / 0.5e0, 4) + 0e0 as x, round(-(north_m - first_value(north_m) over w) / 0.5e0, 4) + 0e0 as y from k window w as (partition by flight_id order by ord)")
def e25_gps_targets(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("flight_id").orderBy("ord")
    shift = lambda c: (F.col(c) - F.first(c).over(w)) / 0.5
    return _shots(spark, d).where("ord >= 2").select("flight_id", "ord", r4(shift("east_m")).alias("x"), r4(-shift("north_m")).alias("y"))


@query(f"{SHOTS} select flight_id, ord, round(east_m, 4) + 0e0 as x, round(-north_m, 4) + 0e0 as y from fx_shots")
def e26_pose_centres(spark, d):
    w, h = F.lit(41.0), F.lit(31.0)
    pose = geo.initial_pose(F.col("east_m"), -F.col("north_m"), F.col("flight_yaw_deg"), F.col("relative_alt_m") / 30, w, h)
    x, y = geo.apply_pose(pose, w / 2, h / 2)
    return _shots(spark, d).select("flight_id", "ord", r4(x).alias("x"), r4(y).alias("y"))


_STEP = f"""{SHOTS}, st as (select *, east_m - lag(east_m) over w as ax, north_m - lag(north_m) over w as ay, lead(east_m) over w - east_m as bx, lead(north_m) over w - north_m as by_ from fx_shots window w as (partition by flight_id order by ord)),
un as (select flight_id, ord, flight_yaw_deg, case when sqrt(ax * ax + ay * ay) >= 0.3 then ax / sqrt(ax * ax + ay * ay) end as px, case when sqrt(ax * ax + ay * ay) >= 0.3 then ay / sqrt(ax * ax + ay * ay) end as py,
case when sqrt(bx * bx + by_ * by_) >= 0.3 then bx / sqrt(bx * bx + by_ * by_) end as nx, case when sqrt(bx * bx + by_ * by_) >= 0.3 then by_ / sqrt(bx * bx + by_ * by_) end as ny from st)"""


@query(f"{_STEP} select flight_id, ord, " + ", ".join(f"round({c}, 4) + 0e0 as {c}" for c in ("px", "py", "nx", "ny")) + " from un")
def w8_neighbour_steps(spark, d):
    return flight.neighbour_steps(_shots(spark, d)).select("flight_id", "ord", *(r4(c).alias(c) for c in ("px", "py", "nx", "ny")))


_DOT = "coalesce(abs({k}x * {x} + {k}y * {y}), 0)"
_SIN, _COS = "sin(radians(flight_yaw_deg))", "cos(radians(flight_yaw_deg))"


@query(f"{_STEP}, v as (select flight_id, sum({_DOT.format(k='p', x=_SIN, y=_COS)} + {_DOT.format(k='n', x=_SIN, y=_COS)}) as along, sum({_DOT.format(k='p', x=_COS, y='-' + _SIN)} + {_DOT.format(k='n', x=_COS, y='-' + _SIN)}) as across from un group by flight_id) select flight_id, round(along, 4) + 0e0 as along, round(across, 4) + 0e0 as across, along >= across as is_along from v")
def a20_axis_vote(spark, d):
    got = flight.axis_vote(flight.neighbour_steps(_shots(spark, d)))
    return got.select("flight_id", r4("along").alias("along"), r4("across").alias("across"), "is_along")


@query("select label as image, count(*) as features, count(*) * 40 as bytes from embeddings group by label")
def a23_descriptor_counts(spark, d):
    n = F.count("*")
    return _t(spark, d, "embeddings").groupBy(F.col("label").alias("image")).agg(n.alias("features"), (n * 40).alias("bytes"))


@query(f"{SHOTS}, n as (select flight_id, count(*) * 10 as n from fx_shots group by flight_id) select flight_id, cast(r.rung as int) as rung from n, (values (3000), (12000), (48000)) r(rung) where r.rung = 3000 or n * r.rung * 40 <= 600000000")
def c2_feature_ladder(spark, d):
    n = _shots(spark, d).groupBy("flight_id").agg((F.count("*") * 10).alias("n"))
    return n.select("flight_id", F.explode(flight.feature_ladder(F.col("n"))).alias("rung"))


@query(f"with p as ({PIXELS}) select blob, count(*) as area from p group by blob having count(*) >= pi() * greatest(9, 1) ** 2")
def f13_large_blobs(spark, d):
    return raster.large(_pixels(spark, d), "blob", 9.0)


@query(f"{SHOTS}, s as (select flight_id, relative_alt_m / median(relative_alt_m) over (partition by flight_id) as s from fx_shots) select flight_id, round(min(s), 4) as least, round(max(s), 4) as most, count(*) filter (abs(s - 1) > 0.0002e0) as outside from s group by flight_id")
def f15_scale_drift(spark, d):
    shots = _shots(spark, d)
    usual = shots.groupBy("flight_id").agg(F.median("relative_alt_m").alias("usual"))
    return raster.scale_drift(shots.join(usual, "flight_id").withColumn("drift", F.col("relative_alt_m") / F.col("usual")), "flight_id", 0.0002).select("flight_id", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), "outside")
