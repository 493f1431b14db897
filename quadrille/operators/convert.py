"""Mapped elements as rows of the job's layers: parks, water, railways, facilities; census tables as records.

Elements have type, id, lat, lon, tags, and geometry (an array of lat, lon). Rows that a layer does not take
are left out by a condition, or carry the reason where the layer reports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions import geo, names
from quadrille.functions.classify import first_rule, land_use, water_class
from quadrille.functions.num import cell_value, leading_number

Origin = tuple[float, float]

# Which tags make which facility, and its priority.
FACILITIES = [
    ("railway", "station", "station", 1), ("amenity", "townhall", "government", 2), ("office", "government", "government", 2), ("amenity", "hospital", "hospital", 3),
    ("amenity", "college", "university", 4), ("amenity", "university", "university", 4), ("amenity", "school", "school", 5), ("amenity", "library", "library", 5),
]


def local_points(geometry: Column, origin: Origin) -> Column:
    return F.transform(geometry, lambda p: geo.to_local(p["lat"], p["lon"], *origin))


def opened(points: Column) -> Column:
    """A ring without the last point where it repeats the first."""
    n = F.size(points)
    closed = (n > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(closed, F.slice(points, 1, n - 1)).otherwise(points)


def middle(origin: Origin) -> Column:
    """A node's place, or the mean of an element's points; null without either."""
    g = F.col("geometry")
    mean = lambda k: F.aggregate(g, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(g)
    at = lambda k: F.when(F.col("type") == "node", F.col(k)).when(F.size(g) > 0, mean(k))
    return F.when(at("lat").isNotNull() & at("lon").isNotNull(), geo.to_local(at("lat"), at("lon"), *origin))


def shown_name(tags: Column) -> Column:
    return F.coalesce(F.nullif(tags["name:ja"], F.lit("")), tags["name"])


def parks(elements: DataFrame, origin: Origin) -> DataFrame:
    """(id, tag, name, p): closed ways that are parks or have a land use, as rings of three points or more."""
    t = F.col("tags")
    tag = F.when(t["leisure"] == "park", "leisure_park").when(t["landuse"] != "", F.concat(F.lit("landuse_"), t["landuse"]))
    out = elements.where(F.col("type") == "way").select("id", tag.alias("tag"), F.coalesce(t["name"], F.lit("")).alias("name"), opened(local_points(F.col("geometry"), origin)).alias("p"))
    return out.where(F.col("tag").isNotNull() & (F.size("p") >= 3))


def waterways(elements: DataFrame, origin: Origin) -> DataFrame:
    """(id, type, name, kind, p, water_class, surface, width, intermittent): flowing ways as lines, other water as areas.
    surface is false for what runs in a tunnel, under a cover, or below the ground."""
    t = F.col("tags")
    flows = t["waterway"].isin("river", "canal", "stream", "drain", "ditch")
    still = (t["natural"] == "water") | (t["water"] != "") | (t["waterway"] == "riverbank")
    below = t["tunnel"].isin("culvert", "yes", "building_passage") | (t["covered"] == "yes") | (t["layer"].try_cast("double") < 0)
    width, p = leading_number(t["width"]), local_points(F.col("geometry"), origin)
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = elements.where(F.col("type") == "way").select(
        "id", F.when(flows, t["waterway"]).when(still, "water").alias("type"), F.coalesce(t["name"], F.lit("")).alias("name"), F.when(flows, "line").otherwise("area").alias("kind"),
        F.when(flows, p).otherwise(opened(p)).alias("p"), water_class(t).alias("water_class"), (~yes(below)).alias("surface"), F.when((width > 0) & (width < 400), width).alias("width"),
        yes(t["intermittent"] == "yes").alias("intermittent"),
    )
    return out.where(F.col("type").isNotNull() & (F.size("p") >= F.when(F.col("kind") == "line", 2).otherwise(3)))


def railways(elements: DataFrame, origin: Origin) -> tuple[DataFrame, DataFrame]:
    """(lines, stations): ways with a railway tag (id, railway, name, p), and stations that are no way (id, name, at)."""
    t = F.col("tags")
    is_line = (F.col("type") == "way") & F.col("geometry").isNotNull() & (t["railway"] != "")
    name = F.coalesce(shown_name(t), F.lit("")).alias("name")
    lines = elements.where(is_line).select("id", t["railway"].alias("railway"), name, local_points(F.col("geometry"), origin).alias("p")).where(F.size("p") >= 2)
    stations = elements.where(~F.coalesce(is_line, F.lit(False)) & (t["railway"] == "station")).select("id", name, middle(origin).alias("at"))
    return lines, stations.where("at is not null")


def facilities(elements: DataFrame, origin: Origin) -> DataFrame:
    """(id, name, category, priority, at): named facilities of the eight kinds, nodes or ways at their middle.
    Names of one place are put together by ``sequential.greedy_dedupe``."""
    t = F.col("tags")
    kind = first_rule([(t[k] == v, {"category": c, "priority": n}) for k, v, c, n in FACILITIES])
    out = elements.select("id", shown_name(t).alias("name"), kind.alias("k"), middle(origin).alias("at"))
    return out.where("k is not null and name <> '' and at is not null").select("id", "name", "k.category", "k.priority", "at")


def facility_report(elements: DataFrame, frame: tuple[float, float, float, float]) -> DataFrame:
    """(id, name, lat, lon, reason): reason is null for a usable facility, else why it is left out: no place, a place
    outside the (south, west, north, east) frame, or no name."""
    g, t = F.col("geometry"), F.col("tags")
    mean = lambda k: F.when(F.col("type") == "node", F.col(k)).when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(g))
    south, west, north, east = frame
    out = elements.select("id", shown_name(t).alias("name"), mean("lat").alias("lat"), mean("lon").alias("lon"))
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    reason = first_rule([(F.col("lat").isNull() | F.col("lon").isNull(), "no-coordinates"), (~inside, "outside-bbox"), (F.coalesce("name", F.lit("")) == "", "no-name")])
    return out.withColumn("reason", reason)


def land_uses(elements: DataFrame) -> DataFrame:
    return elements.select("id", land_use(F.col("tags")).alias("u")).where("u is not null").select("id", "u.*")


#: Layers by name: what a job calls with (elements, origin).
CONVERTERS = {"parks": parks, "waterways": waterways, "facilities": facilities, "rail_lines": lambda e, o: railways(e, o)[0], "stations": lambda e, o: railways(e, o)[1]}


def derived(features: DataFrame, levels: list[str], visible: Callable[[Column, DataFrame], Column], pick: Callable[[DataFrame], list[Column]]) -> DataFrame:
    """A layer's features at each level they show at: (level, picked columns). ``visible(level, features)`` says where a
    feature shows, ``pick(features)`` what of it a level's tiles keep; both give columns."""
    rows = features.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return rows.where(visible(F.col("level"), rows)).select("level", *pick(rows))


# ---- census tables ---------------------------------------------------------------------------------


def _blank(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(c), F.lit("")) == "")
    return out


def _level_reason(level: Column, block: int) -> Column:
    number = F.trim(level).try_cast("double")
    return F.when(number == 1, "municipality-total-row").when(number < block, "subtotal-row").otherwise("unknown-region-level")


def age_rows(cells: DataFrame, wards: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of an age table with ``ward``, ``block_name`` and ``reason`` (null: a record). Only rows of both sexes
    together, of the block level 4, in a ward of the city and of the target, and with a block name are records.
    ``cells``: sex, level, municipality, town, chome, code, and any number of value columns; ``keep``: columns that are no cells."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ward, block = names.ward_of(text("municipality")), F.concat(text("town"), text("chome"))
    number = text("level").try_cast("double")
    reason = first_rule(
        [
            (_blank([c for c in cells.columns if c not in (keep or [])]), "empty-row"),
            (text("sex") != "総数", "sex-breakdown-row"),
            (~number.eqNullSafe(F.lit(4.0)), _level_reason(text("level"), 4)),
            (ward.isNull(), "non-city-row"),
            (~ward.isin(wards) if wards else F.lit(False), "ward-not-in-target"),
            (block == "", "empty-block-name"),
        ]
    )
    return cells.withColumns({"ward": ward, "block_name": block, "reason": reason})


def population_rows(cells: DataFrame, municipalities: list[str] | None = None, block_level: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Rows of the older population table with ``reason`` (null: a record), composite code, population and whether
    it is withheld. The block level is 3 there. ``cells``: municipality_code, level, municipality, town, chome, code, population."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    block = F.concat(text("town"), text("chome"))
    number = text("level").try_cast("double")
    reason = first_rule(
        [
            (_blank([c for c in cells.columns if c not in (keep or [])]), "empty-row"),
            (~text("municipality_code").isin(municipalities) if municipalities else F.lit(False), "municipality-not-in-target"),
            (~number.eqNullSafe(F.lit(float(block_level))), _level_reason(text("level"), block_level)),
            (block == "", "empty-block-name"),
        ]
    )
    people = cell_value(F.col("population"))
    code = names.composite_code(text("municipality_code"), F.coalesce(names.padded_code(F.col("code")), F.lit("")))
    return cells.withColumns({"reason": reason, "composite_code": code, "population_2015": people["value"], "withheld": people["suppressed"]})
