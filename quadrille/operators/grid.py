"""Aggregates over a square grid: lengths, coverage, density, clusters of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadrille.functions import geo
from quadrille.operators.graph import labelled
from quadrille.operators.spatial import first_hit
from quadrille.storage import stored


def line_cells(lines: DataFrame, size: float, points: str = "points") -> DataFrame:
    """(cx, cz, length): a polyline's length dealt to cells. A segment is sampled every half cell, both ends
    included, and every sample carries length / steps, so a segment counts (steps + 1) / steps times."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    segments = lines.where(F.size(points) >= 2).select(F.explode(pairs).alias("s"))
    length = F.hypot(F.col("s.q.x") - F.col("s.p.x"), F.col("s.q.z") - F.col("s.p.z"))
    segments = segments.withColumn("d", length).withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("d") / (size / 2))))
    samples = segments.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    at = lambda k: F.col(f"s.p.{k}") + (F.col(f"s.q.{k}") - F.col(f"s.p.{k}")) * (F.col("i") / F.col("steps"))
    return samples.groupBy(geo.cell(at("x"), size).alias("cx"), geo.cell(at("z"), size).alias("cz")).agg(F.sum(F.col("d") / F.col("steps")).alias("length"))


def ring_cells(shapes: DataFrame, size: float, ring: str = "ring", keep: list[str] | None = None) -> DataFrame:
    """(cx, cz, kept columns) of the cells whose centre lies in a ring."""
    keep = keep or []
    cells = shapes.select(*keep, F.col(ring).alias("_r"), F.explode(geo.cells_of_box(geo.bbox(F.col(ring)), size)).alias("_c"))
    centre = lambda k: (F.col(f"_c.{k}") + 0.5) * size
    return cells.where(geo.in_ring(centre("cx"), centre("cz"), F.col("_r"))).select("_c.cx", "_c.cz", *keep).distinct()


def cell_masks(shapes: DataFrame, size: float, bit: str = "bit", ring: str = "ring") -> DataFrame:
    """(cx, cz, mask): for every cell whose centre a shape holds, the bits of all such shapes together."""
    return ring_cells(shapes, size, ring, keep=[bit]).groupBy("cx", "cz").agg(F.bit_or(bit).alias("mask"))


def box_cells(boxes: DataFrame, size: float, box: str = "box") -> DataFrame:
    """(cx, cz) of all cells that a box touches."""
    return boxes.select(F.explode(geo.cells_of_box(F.col(box), size)).alias("_c")).select("_c.cx", "_c.cz").distinct()


def point_cells(points: DataFrame, size: float, **sums: str) -> DataFrame:
    """(cx, cz, n, sums): points counted, and columns summed, by cell."""
    return points.groupBy(geo.cell(F.col("x"), size).alias("cx"), geo.cell(F.col("z"), size).alias("cz")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def around(cells: DataFrame, keep: list[str], centre: bool = True) -> DataFrame:
    """Every cell's neighbours: (cx, cz) of the neighbour, (from_cx, from_cz), and kept columns."""
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a in (-1, 0, 1) for b in (-1, 0, 1) if centre or a or b))
    moved = cells.withColumn("_d", F.explode(steps))
    return moved.select((F.col("cx") + F.col("_d.dx")).alias("cx"), (F.col("cz") + F.col("_d.dz")).alias("cz"), F.col("cx").alias("from_cx"), F.col("cz").alias("from_cz"), *keep)


def land_cells(parts: DataFrame, size: float, key: str = "ward_id") -> DataFrame:
    """(cx, cz, x, z, ward_id): every cell whose centre lies in an area, with the first such area."""
    cells = box_cells(parts, size).select("cx", "cz", ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cz") + 0.5) * size).alias("z"), F.struct("cx", "cz").alias("_id"))
    return first_hit(cells, parts, size * 8, "_id", key).where(F.col(key).isNotNull()).drop("_id")


def coverage(parts: DataFrame, buildings: DataFrame, roads: DataFrame, rails: DataFrame, rivers: DataFrame, parks: DataFrame, water: DataFrame | None = None, size: float = 100.0) -> DataFrame:
    """One row a land cell: ward_id, n (buildings), area, covered (a footprint touches it), road, rail, river,
    in_park, in_water, gap (a road of over 30 m, no building, and no park, water, or over 40 m of rail or river)."""
    land = land_cells(parts, size)
    built = point_cells(buildings, size, area="area")
    touched = box_cells(buildings, size).withColumn("touched", F.lit(True))
    length = lambda df, name: line_cells(df, size).withColumnRenamed("length", name)
    out = land.join(built, ["cx", "cz"], "left").join(touched, ["cx", "cz"], "left")
    for df, name in ((roads, "road"), (rails, "rail"), (rivers, "river")):
        out = out.join(length(df, name), ["cx", "cz"], "left")
    out = out.join(ring_cells(parks, size).withColumn("in_park", F.lit(True)), ["cx", "cz"], "left")
    if water is not None:
        out = out.join(water.select("cx", "cz").distinct().withColumn("in_water", F.lit(True)), ["cx", "cz"], "left")
    else:
        out = out.withColumn("in_water", F.lit(False))
    none = F.lit(0.0)
    out = out.select(
        "cx", "cz", "x", "z", "ward_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("area", none).alias("area"),
        (F.col("n").isNotNull() | F.coalesce("touched", F.lit(False))).alias("covered"),
        *(F.coalesce(c, none).alias(c) for c in ("road", "rail", "river")), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_park", "in_water")),
    )
    open_ = F.col("in_park") | F.col("in_water") | (F.col("rail") > 40) | (F.col("river") > 40)
    return out.withColumn("gap", ~F.col("covered") & (F.col("road") > 30) & ~open_)


def coverage_by_ward(cells: DataFrame) -> DataFrame:
    count = lambda cond: F.count_if(cond)
    out = cells.groupBy("ward_id").agg(F.count("*").alias("land_cells"), count(F.col("covered")).alias("building_cells"), F.sum("n").alias("buildings"), F.sum("area").alias("footprint"), count(F.col("gap")).alias("gap_cells"))
    return out.withColumn("coverage", F.floor(F.col("building_cells") / F.col("land_cells") * 1000 + 0.5) / 1000)


def clusters(cells: DataFrame, size: float, least: int = 3, weight: str | None = None) -> DataFrame:
    """Clusters of cells that touch by side or corner, of at least ``least`` cells: cluster, n, ward_id (the
    commonest, smaller on a tie), box of the cell centres, km2, total of ``weight``."""
    named = stored(cells.withColumn("node", F.format_string("%+09d%+09d", F.col("cx").cast("long"), F.col("cz").cast("long"))), "cells")  # used three times
    near = around(named.select("cx", "cz", F.col("node").alias("a")), ["a"], centre=False)
    edges = near.join(named.select("cx", "cz", F.col("node").alias("b")), ["cx", "cz"]).select("a", "b")
    parts = labelled(named, edges)
    wards = parts.groupBy("comp", "ward_id").agg(F.count("*").alias("c")).groupBy("comp").agg(F.max_by("ward_id", F.struct("c", (-F.col("ward_id")).alias("w"))).alias("ward_id"))
    total = F.sum(weight) if weight else F.lit(0.0)
    grouped = parts.groupBy("comp").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"), total.alias("total"))
    out = grouped.where(F.col("n") >= least).join(wards, "comp")
    return out.select(F.col("comp").alias("cluster"), "n", "ward_id", "x0", "x1", "z0", "z1", (F.floor(F.col("n") * size * size / 1e6 * 1000 + 0.5) / 1000).alias("km2"), "total")


def density(parts: DataFrame, buildings: DataFrame, roads: DataFrame, raw_points: DataFrame, boxes: list[tuple[float, float, float, float]] = (), size: float = 100.0, least: int = 3, source_radius: float = 400.0) -> DataFrame:
    """Cells with at least ``least`` buildings and no road in the nine cells around, each with its cause.

    source-missing: no raw road point near (nine coarse cells, by rounding); sparse-ward: 8 % of the ward's
    cells or more are source-missing; facility-block: inside a stated box; else unexplained."""
    land = land_cells(parts, size)
    road = line_cells(roads, size).select("cx", "cz").withColumn("road", F.lit(True))
    near = around(road.select("cx", "cz"), []).select("cx", "cz").distinct().withColumn("near", F.lit(True))
    coarse = lambda v: F.floor(v / source_radius + 0.5)
    raw = raw_points.select(coarse(F.col("x")).alias("cx"), coarse(F.col("z")).alias("cz")).distinct()
    raw = around(raw, []).select(F.col("cx").alias("gx"), F.col("cz").alias("gz")).distinct().withColumn("raw", F.lit(True))
    built = point_cells(buildings, size)
    cells = land.join(near, ["cx", "cz"], "left").join(built, ["cx", "cz"], "left").withColumn("gx", coarse(F.col("x"))).withColumn("gz", coarse(F.col("z"))).join(raw, ["gx", "gz"], "left")
    cells = cells.withColumn("missing", F.col("near").isNull() & F.col("raw").isNull())
    wards = cells.groupBy("ward_id").agg((F.count_if("missing") / F.count("*") >= 0.08).alias("sparse"))
    inside = F.lit(False)
    for x0, z0, x1, z1 in boxes:
        inside = inside | (F.col("x").between(x0, x1) & F.col("z").between(z0, z1))
    cause = F.when(F.col("missing"), "source-missing").when(F.col("sparse"), "sparse-ward").when(inside, "facility-block").otherwise("unexplained")
    bad = cells.where(F.col("near").isNull() & (F.col("n") >= least)).join(wards, "ward_id")
    return bad.select("cx", "cz", "ward_id", "n", cause.alias("cause"))


def severity(kind: Column, km2: Column, n: Column, explained: Column, major: Column) -> Column:
    """Severity of an anomaly by its kind."""
    # Bounds by kind.
    steps = lambda v, *bounds: F.when(v >= bounds[0][0], bounds[0][1]).otherwise(steps(v, *bounds[1:]) if len(bounds) > 1 else F.lit("LOW"))
    return (
        F.when(explained, F.when(km2 >= 0.3, "LOW").otherwise("INFO"))
        .when(kind == "A", steps(km2, (1.0, "CRITICAL"), (0.3, "HIGH"), (0.08, "MEDIUM")))
        .when(kind == "F", steps(n, (20, "CRITICAL"), (5, "HIGH"), (2, "MEDIUM")))
        .when(kind == "C", steps(n, (30, "HIGH"), (8, "MEDIUM")))
        .when(kind == "B", steps(km2, (0.3, "HIGH"), (0.08, "MEDIUM")))
        .when(kind.isin("D", "E"), F.when(major, "CRITICAL").when(km2 >= 0.3, "HIGH").otherwise("MEDIUM"))
        .when(kind == "G", "MEDIUM")
        .when(kind == "H", F.when(major, "CRITICAL").otherwise("HIGH"))
        .otherwise("LOW")
    )


def lone_blanks(blank: DataFrame, built: DataFrame, least: int = 8) -> DataFrame:
    """Blank cells among dense ones: the upper median of the eight neighbours' counts is ``least`` or more."""
    near = around(blank, [], centre=False).join(built.select("cx", "cz", "n"), ["cx", "cz"], "left")
    counts = near.groupBy("from_cx", "from_cz").agg(F.sort_array(F.collect_list(F.coalesce("n", F.lit(0)))).alias("c"))
    return counts.select(F.col("from_cx").alias("cx"), F.col("from_cz").alias("cz"), F.element_at("c", 5).alias("median")).where(F.col("median") >= least)


def row_runs(cells: DataFrame, most: int) -> DataFrame:
    """Runs of neighbouring cells in a row, of at most ``most`` cells: cz, cx0, n."""
    w = Window.partitionBy("cz").orderBy("cx")
    runs = cells.withColumn("_g", F.col("cx") - F.row_number().over(w))
    numbered = runs.withColumn("_i", F.row_number().over(Window.partitionBy("cz", "_g").orderBy("cx")) - 1)
    return numbered.groupBy("cz", "_g", F.floor(F.col("_i") / most).alias("_k")).agg(F.min("cx").alias("cx0"), F.count("*").alias("n")).select("cz", "cx0", "n")


def eroded(cells: DataFrame) -> DataFrame:
    """Cells whose eight neighbours are all there too."""
    near = around(cells.select("cx", "cz"), [], centre=False)
    found = near.join(cells.select("cx", "cz"), ["cx", "cz"]).groupBy("from_cx", "from_cz").agg(F.count("*").alias("n")).where("n = 8")
    return found.select(F.col("from_cx").alias("cx"), F.col("from_cz").alias("cz"))
