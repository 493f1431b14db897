"""Rivers and water: widths between banks, ribbons, conflicts with buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions import geo
from quadrille.operators.spatial import hits, in_any
from quadrille.storage import stored


def _steps(points: Column) -> Column:
    return F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points)), lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.hypot(p["x"] - q["x"], p["z"] - q["z"]).alias("d")))


def frame_at(points: Column, share: Column) -> Column:
    """struct<x, z, tx, tz>: the point at a share of a line's length, and the line's direction there."""
    start = F.struct((geo.path_length(points) * share).alias("left"), *(F.lit(0.0).alias(k) for k in ("x", "z", "tx", "tz")), F.lit(False).alias("done"))

    def walk(acc: Column, s: Column) -> Column:
        here = ~acc["done"] & (s["d"] > 0)
        part = F.least(F.lit(1.0), acc["left"] / s["d"])
        place = lambda k: F.when(here, s["p"][k] + (s["q"][k] - s["p"][k]) * part).otherwise(acc[k])
        way = lambda k, t: F.when(here, (s["q"][k] - s["p"][k]) / s["d"]).otherwise(acc[t])
        return F.struct(F.when(acc["done"], acc["left"]).otherwise(acc["left"] - s["d"]).alias("left"), place("x").alias("x"), place("z").alias("z"), way("x", "tx").alias("tx"), way("z", "tz").alias("tz"), (acc["done"] | (acc["left"] - s["d"] <= 0)).alias("done"))

    return F.aggregate(_steps(points), start, walk, lambda acc: F.struct(*(acc[k].alias(k) for k in ("x", "z", "tx", "tz"))))


def ray_to_ring(x: Column, z: Column, dx: Column, dz: Column, ring: Column) -> Column:
    """Least distance from a point along a direction to a ring; null if it never meets it."""

    def hit(e: Column) -> Column:
        ex, ez = e["q"]["x"] - e["p"]["x"], e["q"]["z"] - e["p"]["z"]
        det = dx * ez - dz * ex
        safe = F.when(F.abs(det) >= 1e-9, det)
        t = ((e["p"]["x"] - x) * ez - (e["p"]["z"] - z) * ex) / safe
        u = ((e["p"]["x"] - x) * dz - (e["p"]["z"] - z) * dx) / safe
        return F.when((t >= 0) & u.between(0, 1), t)

    return F.array_min(F.transform(geo.edges(ring), hit))


def river_widths(lines: DataFrame, banks: DataFrame, line_id: str, samples: int = 9, margin: float = 0.1, size: float = 300.0) -> DataFrame:
    """(line_id, width, n): the median width between the banks at samples along a line. A sample counts in the
    smallest bank polygon that holds it; widths far off the median are left out once; fewer than three samples
    give no width. ``banks``: bank_id, ring."""
    shares = F.array(*(F.lit(margin + (1 - 2 * margin) * i / max(1, samples - 1)) for i in range(samples)))
    at = lines.where(geo.path_length(F.col("points")) > 0).select(line_id, "points", F.explode(shares).alias("share"))
    at = at.select(line_id, "share", frame_at(F.col("points"), F.col("share")).alias("f"))
    at = stored(at, "frames").select(line_id, "share", "f.*")  # the walk along the line is done once a sample
    none = F.array().cast("array<array<struct<x:double,z:double>>>")
    parts = banks.select("bank_id", F.col("ring").alias("outer"), none.alias("holes"), geo.bbox(F.col("ring")).alias("box"), geo.area(F.col("ring")).alias("area"))
    held = hits(at, parts, size, "bank_id").groupBy(line_id, "share").agg(F.min_by(F.struct("x", "z", "tx", "tz", "outer"), F.struct("area", "bank_id")).alias("b"))
    x, z, tx, tz, ring = (F.col(f"b.{k}") for k in ("x", "z", "tx", "tz", "outer"))
    wide = held.select(line_id, (ray_to_ring(x, z, -tz, tx, ring) + ray_to_ring(x, z, tz, -tx, ring)).alias("w"))
    wide = stored(wide, "samples").where("w is not null")  # used twice
    rough = wide.groupBy(line_id).agg(F.median("w").alias("m"), F.count("*").alias("c"))
    kept = wide.join(rough, line_id).withColumn("near", F.col("w").between(F.col("m") * 0.35, F.col("m") * 2.5))
    out = kept.groupBy(line_id, "c", "m").agg(F.median(F.when(F.col("near"), F.col("w"))).alias("trimmed"), F.count_if("near").alias("n")).where("c >= 3")
    return out.select(line_id, F.when(F.col("n") >= 3, F.col("trimmed")).otherwise(F.col("m")).alias("width"), F.when(F.col("n") >= 3, F.col("n")).otherwise(F.col("c")).alias("n"))


#: The scales tried, the one tried more for a river that should stay, and the shares of the points.
SCALES, THIN_SCALE = (1.0, 0.85, 0.70, 0.55), 0.40
EDGE_FITS, EDGE_FITS_THIN, CENTRE_FITS, CENTRE_HIDES = 0.15, 0.35, 0.30, 0.55


def building_conflicts(rivers: DataFrame, buildings: DataFrame, river_id: str, size: float = 150.0) -> DataFrame:
    """(river_id, action, scale, edge_share, centre_share, tried, thin): keep, shrink or suppress a river by the share of
    its points, and of its edges' points, that lie in buildings.

    The first scale fits at which few enough of both do; a river that lies mostly in buildings is suppressed at once. One
    that should stay (``prefer``) may get thinner, and then stays with more of its edge in buildings. ``rivers``: points,
    ``halves`` (half a width for each point, the last one for all that follow) or one ``half``, and ``prefer`` if there is
    any; ``buildings``: building_id, ring. The edge at a point is half a width off, square to the way from the point
    before to the one behind. A line of one point is kept."""
    halves = F.col("halves") if "halves" in rivers.columns else F.array(F.col("half").cast("double"))
    prefer = F.coalesce(F.col("prefer"), F.lit(False)) if "prefer" in rivers.columns else F.lit(False)
    own = rivers.select(river_id, "points", halves.alias("halves"), prefer.alias("prefer"), F.size("points").alias("n"), F.array(*map(F.lit, SCALES)).alias("scales"))
    own = own.withColumn("scales", F.when(F.col("prefer"), F.concat("scales", F.array(F.lit(THIN_SCALE)))).otherwise(F.col("scales")))
    at = lambda i: F.element_at("points", F.least(F.greatest(i, F.lit(1)), F.col("n")))
    v = own.where("n >= 2").select(river_id, "points", "halves", "n", "scales", F.posexplode("points").alias("i", "p"))
    v = v.select(river_id, "scales", "i", F.col("p.x").alias("x"), F.col("p.z").alias("z"), at(F.col("i")).alias("a"), at(F.col("i") + 2).alias("b"), F.element_at("halves", F.least(F.col("i") + 1, F.size("halves"))).alias("h"))
    tx, tz = F.col("b.x") - F.col("a.x"), F.col("b.z") - F.col("a.z")
    long = F.when(F.hypot(tx, tz) > 0, F.hypot(tx, tz)).otherwise(1.0)
    v = v.select(river_id, "scales", "i", "x", "z", "h", (-tz / long).alias("nx"), (tx / long).alias("nz"))
    side = lambda sign, s: F.struct((F.col("x") + sign * F.col("nx") * (F.col("h") * s)).alias("x"), (F.col("z") + sign * F.col("nz") * (F.col("h") * s)).alias("z"))
    edges = v.select(river_id, "i", "x", "z", "h", "nx", "nz", F.posexplode("scales").alias("step", "s")).select(river_id, "i", "step", F.explode(F.array(side(1, F.col("s")), side(-1, F.col("s")))).alias("p")).select(river_id, "i", "step", "p.x", "p.z")
    spots = edges.unionByName(v.select(river_id, "i", F.lit(-1).alias("step"), "x", "z"))  # the centre is the same at all scales
    none = F.array().cast("array<array<struct<x:double,z:double>>>")
    parts = buildings.where("size(ring) > 0").select(F.col("ring").alias("outer"), none.alias("holes"))
    held = in_any(spots, parts, size / 6).select(river_id, "i", "step").distinct().groupBy(river_id, "step").agg(F.count("*").alias("n"))
    held = held.groupBy(river_id).agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("held"))  # six steps at most
    share = lambda step: F.coalesce(F.try_element_at("held", step), F.lit(0)) / F.col("n")
    out = own.select(river_id, "scales", "prefer", F.greatest("n", F.lit(1)).alias("n")).join(held, river_id, "left").withColumn("centre", share(F.lit(-1)))
    out = out.withColumn("edges", F.transform("scales", lambda _, i: share(i)))
    first = F.when(F.col("centre") <= CENTRE_FITS, F.array_position(F.transform("edges", lambda e: e <= EDGE_FITS), True)).otherwise(F.lit(0)).cast("int")
    last, count = F.element_at("edges", -1), F.size("scales")
    out = out.withColumns({"first": first, "hidden": F.col("centre") >= CENTRE_HIDES})
    thin = ~F.col("hidden") & (F.col("first") == 0) & F.col("prefer") & (F.col("centre") <= CENTRE_FITS) & (last <= EDGE_FITS_THIN)
    fits = ~F.col("hidden") & (F.col("first") > 0)
    scale = F.when(fits, F.element_at("scales", F.greatest("first", F.lit(1)))).when(thin, F.lit(THIN_SCALE)).otherwise(0.0)
    tried = F.when(F.col("hidden"), 1).when(fits, F.col("first")).otherwise(count)
    action = F.when(scale == 1.0, "keep").when(scale > 0, "shrink").otherwise("suppress")
    return out.select(river_id, action.alias("action"), scale.alias("scale"), F.element_at("edges", tried).alias("edge_share"), F.col("centre").alias("centre_share"), tried.alias("tried"), thin.alias("thin"))
