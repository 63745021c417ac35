"""Survey operators on hand-made cases, and all queries against their SQL."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from flightgrid.functions import geo
from flightgrid.operators import flight, graph, match, points, raster
from flightgrid.plans import delivery, survey  # noqa: F401
from flightgrid.sources import checks, readers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def near(v):
    return float(f"{v:.6g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(survey.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = survey.QUERIES[name](spark, SF)
    got = con.execute(survey.ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(near(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(near(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def shots(spark, rows):
    return spark.createDataFrame(rows, "flight_id long, ord int, flight_yaw_deg double, gimbal_pitch_deg double, east_m double, north_m double")


def test_curves_and_legs_of_odd_flights(spark):
    rows = [(1, 0, 10.0, None, 0.0, 0.0)]  # one shot
    rows += [(2, i, 0.0 if i < 2 else 90.0, -90.0, float(i), 0.0) for i in range(3)]  # no leg of three
    rows += [(3, i, 0.0, -70.0, float(i), 0.0) for i in range(5)]  # off nadir: all curves
    rows += [(4, i, 0.0 if i < 5 else 180.0, -90.0, 0.0, float(i if i < 5 else 9 - i)) for i in range(10)]
    marked = flight.mark_curves(shots(spark, rows))
    got = flight.legs(marked, 100.0).collect()
    assert {(r.flight_id, r.heading, r.first_ord, r.last_ord) for r in got} == {(4, 1, 0, 4), (4, -1, 5, 9)}
    assert marked.where("flight_id = 3 and not is_curve").count() == 0
    assert flight.thin(marked, 2.0).where("flight_id = 3").count() == 0
    kept = {r.ord for r in flight.thin(marked, 2.0).where("flight_id = 4").collect()}
    assert kept == {0, 2, 4, 7, 9}
    ends = marked.withColumn('endpoint', F.col('ord').isin(5, 8))
    assert {r.ord for r in flight.thin(ends, 2.0).where('flight_id = 4').collect()} == {0, 2, 4, 5, 7, 8}


def test_yaw_difference_range(spark):
    rows = [(a, b) for a in (-540.0, -180.0, 0.0, 180.0, 359.9) for b in (-90.0, 0.0, 180.0)]
    for r in spark.createDataFrame(rows, "a double, b double").select("a", "b", geo.yaw_difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert -180 <= r.d < 180 and math.isclose((r.a - r.b - r.d) % 360 % 360, 0, abs_tol=1e-9)


def test_pose_algebra(spark):
    one = spark.range(1)
    lit = lambda *v: tuple(map(F.lit, v))
    p = lit(2.0, 1.0, 5.0, -3.0)
    x = one.select(*geo.compose(geo.invert(p), p)).first()
    assert tuple(x) == pytest.approx((1, 0, 0, 0))
    q = geo.initial_pose(*lit(10.0, 20.0, 30.0, 2.0, 4.0, 6.0))
    assert tuple(one.select(*geo.apply_pose(q, F.lit(2.0), F.lit(3.0))).first()) == pytest.approx((10, 20))
    assert one.select(geo.polygon_area(geo.corners(q, F.lit(4.0), F.lit(6.0)))).first()[0] == pytest.approx(96)


def test_grid_join_finds_all_pairs(spark):
    r = random.Random(1)
    rows = [(f, k, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(1, 4)) for f in (1, 2) for k in range(60)]
    got = {(x.flight_id, x.a.k, x.b.k) for x in graph.grid_join(spark.createDataFrame(rows, "flight_id long, k int, x double, y double, r double"), 8.0).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) < a[4] + b[4]}
    assert got == want


def test_threshold_is_lowered_until_whole(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    pairs = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 2, 0.17), (1, 2, 3, 0.3)], "flight_id long, i long, j long, overlap double")
    threshold, kept = graph.threshold_holding_together(nodes, pairs)
    assert threshold == pytest.approx(0.15) and kept.count() == 3
    threshold, _ = graph.threshold_holding_together(nodes, pairs.where("j < 3"))
    assert threshold == pytest.approx(0.05)


def test_known_similarity_is_recovered(spark):
    r = random.Random(2)
    rows = []
    for _ in range(40):
        x, y = r.uniform(0, 100), r.uniform(0, 100)
        rows.append((1, x, y, 0.8 * x - 0.3 * y + 7, 0.3 * x + 0.8 * y - 2))
    rows.append((1, 1.0, 1.0, 900.0, 900.0))
    df = spark.createDataFrame([(k, x, y, u + r.gauss(0, 1e-3), v + r.gauss(0, 1e-3)) for k, x, y, u, v in rows], "k int, x double, y double, u double, v double")
    fit = match.robust_similarity(df, "k").first()
    assert fit.outliers >= 1 and fit.scale == pytest.approx(math.hypot(0.8, 0.3), rel=1e-3)
    few = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0)], "k int, x double, y double, u double, v double")
    assert match.similarity(few, "k").first().a is None  # one point fixes no scale


def test_ratio_test_needs_two(spark):
    f = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (3, 3, 0), (3, 4, -1)], "image long, feature long, bits long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "i long, j long")
    assert [(x.i, x.j, x.t) for x in match.ratio_test(match.two_nearest(pairs, f, least=1)).collect()] == [(1, 3, 3)]
    assert match.two_nearest(pairs, f).count() == 0  # eight descriptors on either side


def test_two_nearest_in_blocks_equal_brute_force(spark):
    """Equal and missing descriptors, several blocks and shards, ties by the number."""
    r = random.Random(3)
    f = [(image, 1000 * image + k, r.choice([None, -1, 0, 7, r.getrandbits(5), r.getrandbits(63)])) for image, n in ((1, 60), (2, 90), (3, 8), (4, 7)) for k in range(n)]
    f += [(5, 5000 + k, 3 if k < 1 else None) for k in range(9)]
    want = set()
    for i, j in ((1, 2), (1, 3), (2, 3), (3, 5)):
        for q in (x for x in f if x[0] == i and x[2] is not None):
            near = sorted(((q[2] ^ t[2]) % 2**64).bit_count() * 10**6 + t[1] for t in f if t[0] == j and t[2] is not None)[:2]
            want |= {(i, j, q[1], d % 10**6, d // 10**6, n + 1) for n, d in enumerate(near)}
    features = spark.createDataFrame(f, "image int, feature long, bits long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (3, 5), (1, 9)], "i int, j int")
    for sizes in ((4096, 32768), (7, 11)):
        got = match.two_nearest(pairs, features, 8, *sizes)
        assert dict(got.dtypes) == {"i": "int", "j": "int", "q": "bigint", "t": "bigint", "d": "int", "n": "int"}
        assert sorted(map(tuple, got.select("i", "j", "q", "t", "d", "n").collect())) == sorted(want)


def test_points_fall_back_on_shorter_stems(spark):
    s = spark.createDataFrame([("d/IMG_1.JPG", 1), ("e/img_1.tif", 4), ("d/IMG_1_2.JPG", 2)], "path string, ord int")
    p = spark.createDataFrame([("x\\img_1_2_0.png",), ("IMG_1_7.jpg",), ("other.jpg",), (None,)], "image string")
    assert {(r.image, r.shot) for r in points.resolve(p, s).collect()} == {("x\\img_1_2_0.png", 2), ("IMG_1_7.jpg", 4), ("other.jpg", None), (None, None)}


def test_rows_of_one_point_tie_at_the_greatest_pixel(spark):
    """SQL of j6 leaves open which of these rows gives the pixel; it is always the same here."""
    frames = spark.createDataFrame([(s, 1.0, 0.0, -20.0 * s, 0.0, 30.0, 40.0) for s in (0, 1, 2)], "shot long, a double, b double, tx double, ty double, w double, h double")
    rows = [(7, 0, 31.0, 5.0), (7, 0, 33.0, 5.0), (7, 0, 32.0, 5.0), (8, 0, 31.0, 5.0), (9, 0, 1.0, 5.0)]
    for r in (rows, rows[::-1], rows[1:3] + rows[:1] + rows[3:]):
        p = spark.createDataFrame(r, "point_id long, shot long, u double, v double").repartition(3)
        got = sorted((x.point_id, x.shot, x.px, x.rerouted) for x in points.rerouted(p, frames).collect())
        assert got == [(7, 1, 13.0, True)] * 3 + [(8, 1, 11.0, True), (9, 0, 1.0, False)]


def test_format_and_bands(spark):
    f = spark.createDataFrame([("a", "x.TIF"), ("a", "y.Jpeg"), ("b", "z.tiff"), ("c", "w.txt")], "folder string, name string")
    assert {tuple(r) for r in checks.format_of(f, "folder", "name").collect()} == {("a", "exif"), ("b", "ortho"), ("c", None)}
    b = spark.createDataFrame([(1, 0, 10), (2, 60, 70), (3, 200, 201)], "k int, y0 long, y1 long")
    assert {(r.k, r.band) for r in raster.frames_in_bands(b, 64, 4).collect()} == {(1, 0), (2, 0), (2, 1), (3, 3)}


def test_streaming_windows_equal_batch(spark, tmp_path):
    from flightgrid.streaming.telemetry import shots_per_window

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = shots_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("per_window").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("per_window")) == key(shots_per_window(events))


def test_published_utm_points(spark):
    """The CN Tower, and 0 N 0 E, in zones 17 and 31, and back."""
    rows = [(43.642566667, -79.387138889, 32617, 630084.0, 4833438.0), (0.0, 0.0, 32631, 166021.44, 0.0), (-33.0, 3.0, 32731, 500000.0, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "lat double, lon double")
    east, north = geo.to_utm(F.col("lat"), F.col("lon"))
    got = df.select("lat", "lon", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"), east.alias("e"), north.alias("n"))
    got = got.select("*", *(c.alias(x) for c, x in zip(geo.from_utm(F.col("e"), F.col("n"), F.col("epsg")), ("lat2", "lon2"), strict=True)))
    for x, r in zip(got.collect(), rows, strict=True):
        assert x.epsg == r[2] and x.e == pytest.approx(r[3], abs=1.0)
        assert r[4] is None or x.n == pytest.approx(r[4], abs=1.0)
        assert (x.lat2, x.lon2) == pytest.approx(r[:2], abs=1e-8)


def clipped_area(p, q):
    """Shared area of convex polygons, by half planes."""
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2
    p, q = (r if area(r) > 0 else r[::-1] for r in (p, q))
    for a, b in zip(q, q[1:] + q[:1], strict=True):
        side = lambda v, a=a, b=b: (b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0])
        out = []
        for u, v in zip(p, p[1:] + p[:1], strict=True):
            if side(u) >= 0:
                out.append(u)
            if side(u) * side(v) < 0:
                t = side(u) / (side(u) - side(v))
                out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        p = out
    return abs(area(p)) if len(p) > 2 else 0.0


def test_overlap_of_rotated_frames(spark):
    r = random.Random(5)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    turn = lambda q, w, x, y: [(math.cos(w) * a - math.sin(w) * b + x, math.sin(w) * a + math.cos(w) * b + y) for a, b in q]
    pairs = [(square, square), (square, turn(square, 0, 2, 0)), (square, turn(square, 0, 9, 0)), (square, square[::-1]), (square, [(0.0, 0.0)] * 4)]
    pairs += [(turn(square, r.uniform(0, 6), r.uniform(0, 2), r.uniform(0, 2)), turn(square, r.uniform(0, 6), r.uniform(0, 2), r.uniform(0, 2))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    for x in df.select("i", geo.overlap_fraction(F.col("a"), F.col("b")).alias("o")).collect():
        a, b = pairs[x.i]
        assert x.o == pytest.approx(0 if b[0] == b[1] else clipped_area(a, b) / 4, abs=1e-9)
    assert delivery.QUERIES["j3_rotated_pairs"](spark, SF).where("overlap < 0.25 or overlap > 1.0001 or i >= j").count() == 0


def test_rotated_overlaps_run_once_and_in_batches(spark, capsys):
    """No interpreted lambdas, and one evaluation although the result is filtered."""
    delivery.QUERIES["j3_rotated_pairs"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "lambda" not in plan and plan.count("ArrowEvalPython [") == 1
    quad = "array<struct<x: double, y: double>>"
    square, bent = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (3.0, 0.0), (4.0, 4.0), (1.0, 2.0)]
    df = spark.createDataFrame([(0, square, None), (1, square, bent), (2, bent, square), (3, [(0.0, None)] * 4, square)], f"i int, a {quad}, b {quad}")
    got = {x.i: x.o for x in df.select("i", geo.overlap_fraction(F.col("a"), F.col("b")).alias("o")).collect()}
    assert got == {0: 0, 1: pytest.approx(clipped_area(square, bent) / 4), 2: pytest.approx(clipped_area(square, bent) / 4), 3: 0}


def test_bound_loses_no_overlap(spark):
    """Frames of all scales, degenerate ones too; the bound leaves out most that share less."""
    r = random.Random(8)

    def pose():
        scale, turn = r.choice([0.0, 1.0, 1.0, 1.3, 4.0, -1.0]), r.choice([0.7, 0.7 + math.pi / 2, r.uniform(0, 7)])
        return scale * math.cos(turn), scale * math.sin(turn), r.uniform(-15, 15), r.uniform(-15, 15)

    rows = [(i, *pose(), *pose()) for i in range(3000)] + [(-1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    a, b = (tuple(F.col(f"{f}{k}") for k in range(4)) for f in "ab")
    w, h = F.lit(14.0), F.lit(10.0)
    shared = geo.overlap_fraction(geo.corners(a, w, h), geo.corners(b, w, h))
    got = df.select("i", shared.alias("o"), geo.may_overlap(a, b, w, h, 0.2499).alias("may")).collect()
    assert all(x.may for x in got if x.o >= 0.24995) and sum(x.o >= 0.25 for x in got) > 300
    assert sum(not x.may for x in got) > 500


def test_similarity_of_reflected_and_single_places(spark):
    mirrored = [(1, x, y, -x, y) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 2.0), (3.0, 7.0))]
    one_place = [(2, 1.0, 1.0, float(i), 0.0) for i in range(3)]
    df = spark.createDataFrame(mirrored + one_place, "k int, x double, y double, u double, v double")
    import numpy as np

    for fit in match.similarity(df, "k").collect():
        p = np.array([r[1:] for r in mirrored + one_place if r[0] == fit.k])
        s, d = p[:, :2] - p[:, :2].mean(0), p[:, 2:] - p[:, 2:].mean(0)
        u, values, vt = np.linalg.svd(d.T @ s / len(p))
        turn = u @ np.diag([1, np.sign(np.linalg.det(u @ vt))]) @ vt
        spread = (s**2).sum() / len(p)
        scale = values.sum() / spread if spread > 0 else 1.0
        assert (fit.a, fit.b) == pytest.approx((scale * turn[0, 0], scale * turn[1, 0]))


def test_readers_of_a_folder(spark, tmp_path):
    import json

    (tmp_path / "calibration.json").write_text(json.dumps({"cameraMatrix": [[2000.5, 0, 1], [0, 1, 1], [0, 0, 1]], "imageSize": [40, 30]}))
    shot = lambda i: {"SourceFile": f"f/DJI_{i:04d}_D.JPG", "EXIF:GPSLatitude": "43 deg 12' 36.00\"", "EXIF:GPSLongitude": "10 deg 0' 0.00\"", "XMP:GPSLongitude": "10 W", "XMP:RelativeAltitude": "+30.5", "XMP:FlightYawDegree": 12}
    (tmp_path / "metadata.json").write_text(json.dumps([shot(3), {"SourceFile": "other.jpg"}, shot(1), shot(2)]))
    (tmp_path / "translations.json").write_text("[[9, 9], [1, 2], [3, 4]]")
    for i in (1, 2, 3, 7):
        (tmp_path / f"DJI_{i:04d}_D.JPG").write_bytes(b"x")
    got = readers.load(spark, "exif", f"file://{tmp_path}", 2).orderBy("index").collect()
    assert [(r["index"], r.vo_idx, r.east, r.north) for r in got] == [(2, 1, 0.0, 0.0), (3, 2, 3.0, 4.0)]
    assert got[0].lat == pytest.approx(43.21) and got[0].lon == -10 and got[0].gsd == pytest.approx(30.5 / 2000.5) and got[0].width == 40
    with pytest.raises(Exception, match="no image in the range"):
        readers.load(spark, "exif", f"file://{tmp_path}", 900).collect()
    (tmp_path / "translations.json").write_text("[[9, 9]]")
    with pytest.raises(Exception, match="no position"):
        readers.load(spark, "exif", f"file://{tmp_path}").collect()
    with pytest.raises(ValueError):
        readers.load(spark, "other", str(tmp_path))
    no = spark.createDataFrame([('{"cameraMatrix": [[1]]}',)], "json string")
    with pytest.raises(Exception, match="no image size"):
        readers.calibration(no).collect()
    assert spark.createDataFrame([("ab<x:xmpmeta q></x:xmpmeta>c",)], "c string").select(readers.packet(F.col("c"))).first()[0] == "<x:xmpmeta q></x:xmpmeta>"


def test_names_without_numbers_and_long_suffixes(spark):
    assert spark.createDataFrame([("ortho_12_3.tif",)], "n string").select(checks.shot_number(F.col("n"))).first()[0] == 12
    with pytest.raises(Exception, match="no shot number"):
        spark.createDataFrame([("none.tif",)], "n string").select(checks.shot_number(F.col("n"))).collect()
    s = spark.createDataFrame([("d/a.JPG", 1)], "path string, ord int")
    p = spark.createDataFrame([("a_1_2_3_4_5_6_7.png",), ("_4.png",)], "image string")
    assert {(r.image, r.shot) for r in points.resolve(p, s).collect()} == {("a_1_2_3_4_5_6_7.png", 1), ("_4.png", None)}
