"""Plane geometry as column expressions.

A ring is ARRAY<STRUCT<x DOUBLE, z DOUBLE>> without a closing point; z grows to the south in tile
coordinates. Everything here stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6_371_000.0


def point(x: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))


def rectangle(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """A ring of four corners."""
    return F.array(point(x0, z0), point(x1, z0), point(x1, z1), point(x0, z1))


def to_local(lat: Column, lon: Column, lat0: float, lon0: float, metres: float = 111_320.0, south: bool = False) -> Column:
    """Metres from an origin (equirectangular), to centimetres; z to the north, or to the south."""
    x = (lon - lon0) * math.cos(math.radians(lat0)) * metres
    z = (lat - lat0) * metres * (-1 if south else 1)
    cm = lambda v: F.floor(v * 100 + 0.5) / 100 + 0.0  # noqa: E731  adding 0.0 makes -0.0 plain
    return F.struct(cm(x).alias("x"), cm(z).alias("z"))


def to_geo(x: Column, z: Column, lat0: float, lon0: float, metres: float = 111_320.0, south: bool = False) -> Column:
    return F.struct((z * (-1 if south else 1) / metres + lat0).alias("lat"), (x / (math.cos(math.radians(lat0)) * metres) + lon0).alias("lon"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    half = lambda d: F.sin(F.radians(d) / 2)
    h = half(lat2 - lat1) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1) ** 2
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distance(x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    return F.hypot(x1 - x2, z1 - z2)


def successors(ring: Column) -> Column:
    """Every point's next one; the first follows the last."""
    n = F.size(ring)
    return F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), F.least(n, F.lit(1))))


def edges(ring: Column) -> Column:
    """ARRAY<STRUCT<p, q>> of a ring's edges."""
    return F.zip_with(ring, successors(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))


def cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["z"] - e["q"]["x"] * e["p"]["z"]


def signed_area(ring: Column) -> Column:
    return total(edges(ring), cross) / 2


def area(ring: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    return F.abs(signed_area(ring))


def area_with_holes(outer: Column, holes: Column) -> Column:
    return F.greatest(F.lit(0.0), area(outer) - F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda acc, h: acc + area(h)))


def perimeter(ring: Column) -> Column:
    return total(edges(ring), lambda e: F.hypot(e["p"]["x"] - e["q"]["x"], e["p"]["z"] - e["q"]["z"]))


def path_length(points: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.size(points)), lambda p, q: F.hypot(p["x"] - q["x"], p["z"] - q["z"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def centroid(ring: Column) -> Column:
    """Area centroid; the mean of the points where the area is 0."""
    a = signed_area(ring)
    part = lambda k: total(edges(ring), lambda e: (e["p"][k] + e["q"][k]) * cross(e))
    mean = lambda k: total(ring, lambda p: p[k]) / F.size(ring)
    flat = F.abs(a) < 5e-10
    return F.struct(*(F.when(flat, mean(k)).otherwise(part(k) / (6 * a)).alias(k) for k in ("x", "z")))


def bbox(ring: Column) -> Column:
    xs, zs = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["z"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(zs).alias("z0"), F.array_max(xs).alias("x1"), F.array_max(zs).alias("z1"))


def overlap_area(a: Column, b: Column) -> Column:
    """Area two boxes share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("z0", "z1")


def box_area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["z1"] - a["z0"])


def box_iou(a: Column, b: Column) -> Column:
    shared = overlap_area(a, b)
    return F.coalesce(F.try_divide(shared, box_area(a) + box_area(b) - shared), F.lit(0.0))


def in_box(x: Column, z: Column, box: Column, pad: float = 0.0) -> Column:
    return (x >= box["x0"] - pad) & (x <= box["x1"] + pad) & (z >= box["z0"] - pad) & (z <= box["z1"] + pad)


def boxes_touch(a: Column, b: Column, pad: float = 0.0) -> Column:
    return (a["x0"] - pad <= b["x1"]) & (b["x0"] - pad <= a["x1"]) & (a["z0"] - pad <= b["z1"]) & (b["z0"] - pad <= a["z1"])


def in_ring(x: Column, z: Column, ring: Column) -> Column:
    """Even-odd test: an odd number of edges crosses the ray to the right."""

    def crosses(e: Column) -> Column:
        spans = (e["q"]["z"] > z) != (e["p"]["z"] > z)
        meets = x < (e["p"]["x"] - e["q"]["x"]) * (z - e["q"]["z"]) / F.nullif(e["p"]["z"] - e["q"]["z"], F.lit(0.0)) + e["q"]["x"]
        return F.when(spans & meets, 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def in_polygon(x: Column, z: Column, outer: Column, holes: Column) -> Column:
    return in_ring(x, z, outer) & ~F.exists(F.coalesce(holes, F.array()), lambda h: in_ring(x, z, h))


def to_segment(x: Column, z: Column, e: Column) -> Column:
    """Distance from a point to the segment from e.p to e.q."""
    dx, dz = e["q"]["x"] - e["p"]["x"], e["q"]["z"] - e["p"]["z"]
    px, pz, n = x - e["p"]["x"], z - e["p"]["z"], dx * dx + dz * dz
    along = px * dx + pz * dz
    # Beside the segment by the cross product: no place on it is computed, so whole numbers that tie are told as ties.
    beside = F.abs(px * dz - pz * dx) / F.sqrt(n)
    return F.when((along <= 0) | (n == 0), F.hypot(px, pz)).when(along >= n, F.hypot(x - e["q"]["x"], z - e["q"]["z"])).otherwise(beside)


def to_ring(x: Column, z: Column, ring: Column) -> Column:
    """Distance from a point to a ring's edge, from within and from without."""
    return F.array_min(F.transform(edges(ring), lambda e: to_segment(x, z, e)))


def to_polygon_edge(x: Column, z: Column, outer: Column, holes: Column) -> Column:
    """Distance from a point to the nearest edge of an outline or of its holes."""
    return F.array_min(F.transform(F.concat(F.array(outer), F.coalesce(holes, F.array())), lambda r: to_ring(x, z, r)))


def to_polygon(x: Column, z: Column, outer: Column, holes: Column) -> Column:
    """Distance from a point to a polygon; 0 inside, and within a hole the distance to its edge."""
    return F.when(in_polygon(x, z, outer, holes), 0.0).otherwise(to_polygon_edge(x, z, outer, holes))


def rings_apart(a: Column, b: Column) -> Column:
    """Least distance of two rings; 0 where they overlap. Corners against edges, both ways, which is exact for rings
    whose edges do not cross; crossing edges give 0."""
    one = lambda p, q: F.array_min(F.transform(p, lambda c: to_ring(c["x"], c["z"], q)))
    side = lambda o, p, q: (p["x"] - o["x"]) * (q["z"] - o["z"]) - (p["z"] - o["z"]) * (q["x"] - o["x"])
    meet = lambda e, f: (side(e["p"], e["q"], f["p"]) * side(e["p"], e["q"], f["q"]) < 0) & (side(f["p"], f["q"], e["p"]) * side(f["p"], f["q"], e["q"]) < 0)
    inside = in_ring(a[0]["x"], a[0]["z"], b) | in_ring(b[0]["x"], b[0]["z"], a)
    crossing = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: meet(e, f)))
    return F.when(inside | crossing, 0.0).otherwise(F.least(one(a, b), one(b, a)))


def hausdorff(a: Column, b: Column) -> Column:
    """The farthest that a corner of one ring is from the other ring's edge, both ways."""
    one = lambda p, q: F.array_max(F.transform(p, lambda c: to_ring(c["x"], c["z"], q)))
    return F.greatest(one(a, b), one(b, a))


def orientation(ring: Column) -> Column:
    """Direction of the principal axis of the points, in degrees from 0 to 180."""
    c, n = centroid(ring), F.size(ring)
    moment = lambda i, j: total(ring, lambda p: (p[i] - c[i]) * (p[j] - c[j])) / n
    degrees = F.degrees(F.atan2(2 * moment("x", "z"), moment("x", "x") - moment("z", "z")) / 2)
    return F.when(degrees < 0, degrees + 180).otherwise(degrees)


def turn_between(a: Column, b: Column) -> Column:
    """Difference of two directions of rectangles: 0 to 45 degrees."""
    d = F.abs(a - b) % 90
    return F.least(d, 90 - d)


def cell(v: Column, size: float, origin: float = 0.0) -> Column:
    """Cell number; floor, so cells below 0 are right too."""
    return F.floor((v - origin) / size)


def cells_of_box(box: Column, size: float, pad: float = 0.0) -> Column:
    """ARRAY<STRUCT<cx, cz>> of all cells that a box touches."""
    span = lambda lo, hi: F.sequence(cell(box[lo] - pad, size), cell(box[hi] + pad, size))
    return F.flatten(F.transform(span("x0", "x1"), lambda cx: F.transform(span("z0", "z1"), lambda cz: F.struct(cx.alias("cx"), cz.alias("cz")))))


def tiles_of_box(box: Column, size: float, shrink: float = 1e-9) -> Column:
    """Tiles a box lies in; a box that ends on a tile's edge is not in the next one."""
    span = lambda lo, hi: F.sequence(cell(box[lo], size), F.greatest(cell(box[lo], size), cell(box[hi] - shrink, size)))
    return F.flatten(F.transform(span("x0", "x1"), lambda tx: F.transform(span("z0", "z1"), lambda tz: F.struct(tx.alias("tx"), tz.alias("tz")))))


def at_share(points: Column, share: float) -> Column:
    """The point at a share of a polyline's length."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points)), lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.hypot(p["x"] - q["x"], p["z"] - q["z"]).alias("d")))
    start = F.struct((path_length(points) * share).alias("left"), F.element_at(points, 1)["x"].alias("x"), F.element_at(points, 1)["z"].alias("z"))

    def walk(acc: Column, s: Column) -> Column:
        part = F.when(s["d"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["left"]) / s["d"])).otherwise(0.0)
        moved = lambda k: F.when(acc["left"] > 0, s["p"][k] + (s["q"][k] - s["p"][k]) * part).otherwise(acc[k])
        return F.struct((acc["left"] - s["d"]).alias("left"), moved("x").alias("x"), moved("z").alias("z"))

    done = F.aggregate(steps, start, walk)
    return F.struct(done["x"].alias("x"), done["z"].alias("z"))


def shape_problem(ring: Column, least: float = 8, most: float = 60_000) -> Column:
    """Why a footprint is unusable; null if it is usable (self-crossings are the kernels' matter)."""
    finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["z"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["z"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["z"]) < 1e300))
    a = area(ring)
    return F.when(F.coalesce(F.size(ring), F.lit(0)) < 3, "too-few-points").when(~finite, "non-finite").when(a < least, "too-small").when(a > most, "too-big")
