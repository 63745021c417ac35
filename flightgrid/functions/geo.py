"""Angles, geodesy, plane similarities and polygons as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the UTM scale: fixed values.
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def signed_number(s: Column) -> Column:
    """A number that may have a leading plus."""
    return F.replace(s, F.lit("+"), F.lit("")).cast("double")


def dms(s: Column, sign_from: Column, negative: str) -> Column:
    """Degrees from ``d deg m' s"``; the sign comes from the letter in another tag."""
    parts = F.split(F.trim(F.regexp_replace(s, "deg|['\"]", " ")), r"\s+")
    value = parts[0].cast("double") + parts[1].cast("double") / 60 + parts[2].cast("double") / 3600
    return F.when(F.contains(sign_from, F.lit(negative)), -value).otherwise(value)


def yaw_difference(a: Column, b: Column) -> Column:
    """In [-180, 180)."""
    d = a - b
    return d - 360 * F.floor((d + 180) / 360)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def central_meridian(lon: Column) -> Column:
    return (utm_zone(lon) - 1) * 6 - 177


def convergence(lat: Column, lon: Column) -> Column:
    """Degrees from true to grid north."""
    return F.degrees(F.atan(F.tan(F.radians(lon - central_meridian(lon))) * F.sin(F.radians(lat))))


def _krueger() -> tuple[float, list[float]]:
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, alpha


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series."""
    radius, alpha = _krueger()
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(lon))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * radius * east, K0 * radius * north + F.when(lat >= 0, 0.0).otherwise(1e7)


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude of UTM coordinates: the inverse of the series."""
    n = FLAT / (2 - FLAT)
    radius, _ = _krueger()
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    south = epsg >= 32700
    xi0, eta0 = (north - F.when(south, 1e7).otherwise(0.0)) / (K0 * radius), (east - 500000) / (K0 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    central = (epsg % 100 - 1) * 6 - 177
    return F.degrees(phi), central + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def to_utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """The same series as SQL text."""
    radius, alpha = _krueger()
    e = math.sqrt(FLAT * (2 - FLAT))
    lam = f"radians({lon} - ((floor(({lon} + 180) / 6)) * 6 - 177))"
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r}::double * atanh({e!r}::double * {s}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *(f"{a!r}::double * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))])
    north = " + ".join([xi, *(f"{a!r}::double * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))])
    return f"(500000 + {K0 * radius!r}::double * ({east}))", f"({K0 * radius!r}::double * ({north}) + case when {lat} >= 0 then 0 else 1e7 end)"


# A similarity is (a, b, tx, ty): x' = a x - b y + tx, y' = b x + a y + ty.
Pose = tuple[Column, Column, Column, Column]


def initial_pose(x: Column, y: Column, yaw: Column, scale: Column, w: Column, h: Column) -> Pose:
    """Rotate a frame about its centre by ``yaw``, scale it, put the centre at (x, y)."""
    a, b = scale * F.cos(F.radians(yaw)), scale * F.sin(F.radians(yaw))
    return a, b, x - (a * w / 2 - b * h / 2), y - (b * w / 2 + a * h / 2)


def apply_pose(p: Pose, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, tx, ty = p
    return a * x - b * y + tx, b * x + a * y + ty


def compose(p: Pose, q: Pose) -> Pose:
    """First q, then p."""
    a, b = p[0] * q[0] - p[1] * q[1], p[1] * q[0] + p[0] * q[1]
    return (a, b, *apply_pose(p, q[2], q[3]))


def invert(p: Pose) -> Pose:
    a, b, tx, ty = p
    n = a * a + b * b
    c, d = a / n, -b / n
    return c, d, -(c * tx - d * ty), -(d * tx + c * ty)


def rescale(p: Pose, factor: Column) -> Pose:
    return p[0], p[1], p[2] * factor, p[3] * factor


def decompose(p: Pose) -> Pose:
    """Translation, angle and logarithm of the scale."""
    return p[2], p[3], F.atan2(p[1], p[0]), F.log(F.greatest(F.sqrt(p[0] * p[0] + p[1] * p[1]), F.lit(1e-12)))


def corners(p: Pose, w: Column, h: Column) -> Column:
    """array<struct<x, y>> of a frame's corners, around it."""
    zero = F.lit(0.0)
    return F.array(*(F.struct(X.alias("x"), Y.alias("y")) for X, Y in (apply_pose(p, *c) for c in ((zero, zero), (w, zero), (w, h), (zero, h)))))


def polygon_area(ring: Column) -> Column:
    """Shoelace, absolute."""
    n = F.size(ring)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(ring, i).x * F.get(ring, (i + 1) % n).y - F.get(ring, (i + 1) % n).x * F.get(ring, i).y)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2)


def _twice(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the signed areas of rings, one a column; slots from ``n`` on repeat the
    first vertex."""
    total = np.zeros(x.shape[1])
    for i in range(len(x)):
        j = (i + 1) % len(x)
        total = np.where(i < n, total + x[i] * y[j] - x[j] * y[i], total)
    return total


def _clipped(x: np.ndarray, y: np.ndarray, n: np.ndarray, p: tuple, q: tuple) -> tuple:
    """The parts of rings to the left of the lines p -> q."""
    side = (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    after = np.roll(side, -1, 0)
    used = np.arange(len(x))[:, None] < n
    here = used & (side >= 0)
    cross = used & (((side > 0) & (after < 0)) | ((side < 0) & (after > 0)))
    t = side / np.where(side == after, 1.0, side - after)
    ends = np.cumsum(here.astype(np.int8) + cross, 0)
    n, size = ends[-1], max(1, int(ends[-1].max()))
    out = []
    for v in (x, y):
        w = np.zeros((size, v.shape[1]))
        w[(ends - here - cross)[here], np.nonzero(here)[1]] = v[here]
        w[(ends - 1)[cross], np.nonzero(cross)[1]] = (v + t * (np.roll(v, -1, 0) - v))[cross]
        out.append(np.where(np.arange(size)[:, None] < n, w, w[0]))
    return *out, n


def shared_fraction(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Shared area of convex quads over the smaller, one pair a column: each side of b,
    counter-clockwise, cuts a.  0 where a quad is degenerate or a coordinate missing."""
    if not ax.shape[1]:
        return np.zeros(0)
    four = np.full(ax.shape[1], 4)
    with np.errstate(all="ignore"):
        ta, tb = _twice(ax, ay, four), _twice(bx, by, four)
        x, y, n = np.where(ta < 0, ax[::-1], ax), np.where(ta < 0, ay[::-1], ay), four
        bx, by = np.where(tb < 0, bx[::-1], bx), np.where(tb < 0, by[::-1], by)
        for k in range(4):
            x, y, n = _clipped(x, y, n, (bx[k], by[k]), (bx[(k + 1) % 4], by[(k + 1) % 4]))
        least = np.minimum(np.abs(ta), np.abs(tb)) / 2
        area = np.where(n < 3, 0.0, np.abs(_twice(x, y, n)) / 2)
        return np.where(least > 0, area / np.where(least > 0, least, 1.0), 0.0)


def _fraction(*columns: pa.Array) -> pa.Array:
    v = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
    return pa.array(shared_fraction(v[0:4], v[4:8], v[8:12], v[12:16]))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Shared area over the smaller of two quads; 0 where either is degenerate.  Python
    over Arrow batches: as nested higher-order functions, which are not compiled, the
    clip takes milliseconds a pair."""
    # Not to be run again for a filter on its result.
    shared = F.arrow_udf(_fraction, "double").asNondeterministic()
    return shared(*(F.get(q, F.lit(i))[c].cast("double") for q in (a, b) for c in "xy" for i in range(4)))


def may_overlap(p: Pose, q: Pose, w: Column, h: Column, least: float) -> Column:
    """False only where two frames of w by h share less than ``least`` of the smaller:
    the second's extent along the sides of the first bounds the shared area."""
    n, m = p[0] * p[0] + p[1] * p[1], q[0] * q[0] + q[1] * q[1]
    area = F.lit(1.0)
    # Along (a, b) and (-b, a), lengths are in units of a pixel times n.
    for (x, y), side in (((p[0], p[1]), w), ((-p[1], p[0]), h)):
        at = x * (q[2] - p[2]) + y * (q[3] - p[3])
        right, down = (x * q[0] + y * q[1]) * w, (y * q[0] - x * q[1]) * h
        none = F.lit(0.0)
        low, high = at + F.least(none, right) + F.least(none, down), at + F.greatest(none, right) + F.greatest(none, down)
        area = area * F.greatest(none, F.least(n * side, high) - F.greatest(none, low))
    return area >= least * n * F.least(n, m) * w * h


def tile_to_utm(x: Column, y: Column, ahead_x: Column, ahead_y: Column, gsd: Column, w: Column, h: Column) -> Column:
    """Affine (xx, xy, yx, yy, tx, ty) from pixels to UTM: up is ``ahead``, right is it
    turned clockwise."""
    rx, ry = ahead_y, -ahead_x
    return F.struct((gsd * rx).alias("xx"), (-gsd * ahead_x).alias("xy"), (gsd * ry).alias("yx"), (-gsd * ahead_y).alias("yy"), (x - gsd * w / 2 * rx + gsd * h / 2 * ahead_x).alias("tx"), (y - gsd * w / 2 * ry + gsd * h / 2 * ahead_y).alias("ty"))


def measured_scale(full_w: Column, full_h: Column, w: Column, h: Column, tolerance: float = 1e-3) -> Column:
    """Full over reduced size; an error where the axes are reduced unlike."""
    sx, sy = full_w / w, full_h / h
    unlike = F.abs(sx - sy) / F.greatest(sx, sy) > tolerance
    return F.when(unlike, F.raise_error(F.lit("the reduction differs between the axes")).cast("double")).otherwise((sx + sy) / 2)


def agrees(h: Pose, i: Pose, j: Pose, w: Column, height: Column, tolerance: float = 0.25) -> Column:
    """Whether a measured similarity puts the corners where the poses predict them, to
    ``tolerance`` diagonals."""
    predicted = compose(invert(j), i)
    zero = F.lit(0.0)
    gaps = []
    for corner in ((zero, zero), (w, zero), (w, height), (zero, height)):
        (x, y), (u, v) = apply_pose(h, *corner), apply_pose(predicted, *corner)
        gaps.append(F.hypot(x - u, y - v))
    return F.greatest(*gaps) <= tolerance * F.hypot(w, height)


def corner_residual(h: Pose, i: Pose, j: Pose, w: Column, height: Column) -> Column:
    """Mean distance of an image's corners under its own pose and by way of the other."""
    zero, total = F.lit(0.0), F.lit(0.0)
    for corner in ((zero, zero), (w, zero), (w, height), (zero, height)):
        (x, y), (u, v) = apply_pose(i, *corner), apply_pose(j, *apply_pose(h, *corner))
        total = total + F.hypot(x - u, y - v)
    return total / 4


def valid_pixel(*bands: Column) -> Column:
    """Any band is not zero: nodata is zero in all."""
    return F.greatest(*bands) > 0 if len(bands) > 1 else bands[0] > 0
