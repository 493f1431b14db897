"""Order-dependent operators. Greedy decisions over near items are taken in parallel rounds (``prefixes``, ``rounds``); the others
run a short loop inside a group, which is one river, one track, one label or one view, never a whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadrille.functions import kernels
from quadrille.operators import prefixes
from quadrille.operators.folds import chain_edges
from quadrille.operators.graph import labelled
from quadrille.operators.rounds import drop_contained, first_apart, greedy_dedupe  # noqa: F401
from quadrille.operators.spatial import near_pairs
from quadrille.storage import stored, tasks


def contained_names(items: DataFrame, radius: float = 100.0) -> DataFrame:
    """Facilities (id, ord, name, category, x, z) without those whose name is part of a nearby one's of their category:
    see ``rounds.drop_contained``, whose rule this is, decided by ``prefixes``, as dense places have too many pairs for
    rows. Nearby is below ``radius``. A null name or category has no partner."""
    known = F.col("name").isNotNull() & F.col("category").isNotNull()
    rows = prefixes.placed(items.select("id", "ord", "x", "z", "name", F.length("name").alias("size"), F.when(known, F.struct("category")).alias("kind")), "ord", radius)
    part_of = lambda a, b: F.contains(f"{b}_name", f"{a}_name")
    starters, lost = prefixes.starters(rows, radius, beats=(F.col("i_size") >= F.col("j_size")) & part_of("j", "i"))
    # A starter goes if a longer later partner is still there when it is met.
    still = F.col("j_by").isNull() | (F.col("j_by") > F.col("i_pos"))
    longer = (F.col("j_pos") > F.col("i_pos")) & (F.col("j_size") > F.col("i_size")) & part_of("i", "j")
    goes = prefixes.near(rows.join(starters, "pos", "left_semi"), rows.join(lost, "pos", "left"), radius, False, longer & still, "left_semi")
    gone = stored(lost.select("pos").unionByName(goes.select(F.col("i_pos").alias("pos"))).distinct(), "gone")
    return items.join(rows.join(gone, "pos", "left_semi").select("id").distinct(), "id", "left_anti")


def station_clusters(stations: DataFrame, radius: float = 130, group_radius: float = 900, name_radius: float = 420) -> DataFrame:
    """(station_id, cluster): stations chained within ``radius``; then clusters of a group within
    ``group_radius`` of the group's first one; then clusters of one label within ``name_radius``, in order,
    with the running mean position. ``stations``: station_id, name, grp (null: none), x, z.

    A mean lies between the cluster it took last and where it was before, so what it takes next is within twice the
    radius of that cluster: clusters that such steps do not chain together are decided apart from each other."""
    edges = chain_edges(stations.select(F.col("station_id").alias("id"), "x", "z"), radius)
    chained = labelled(stations.withColumn("node", F.col("station_id")), edges)
    names = chained.groupBy("comp", "name").agg(F.count("*").alias("n"), F.min("station_id").alias("first"))
    common = names.groupBy("comp").agg(F.min_by("name", F.struct(-F.col("n"), F.col("first"))).alias("common"))
    clusters = chained.groupBy("comp").agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.count("*").alias("n"), F.min_by("grp", F.when(F.col("grp").isNotNull(), F.col("station_id"))).alias("grp")).join(common, "comp")
    first = clusters.where("grp is not null").groupBy("grp").agg(F.min("comp").alias("base"), F.min_by(F.struct("x", "z"), "comp").alias("at"))
    joined = clusters.join(first, "grp", "left")
    near = F.hypot(F.col("x") - F.col("at.x"), F.col("z") - F.col("at.z")) <= group_radius
    joined = joined.select(F.coalesce(F.when(near, F.col("base")), F.col("comp")).alias("base"), "comp", "x", "z", "n", F.coalesce("grp", "common").alias("label"))
    merged = joined.groupBy("base").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("z"), F.sum("n").alias("n"), F.min_by("label", "comp").alias("label"))

    def same_label(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("base").to_dict("records")
        to = {}
        for i, r in enumerate(rows):
            if r["base"] in to:
                continue
            to[r["base"]] = r["base"]
            for s in rows[i + 1 :]:
                if s["base"] not in to and np.hypot(r["x"] - s["x"], r["z"] - s["z"]) <= name_radius:
                    to[s["base"]] = r["base"]
                    n = r["n"] + s["n"]
                    r["x"], r["z"], r["n"] = (r["x"] * r["n"] + s["x"] * s["n"]) / n, (r["z"] * r["n"] + s["z"] * s["n"]) / n, n
        return pd.DataFrame({"base": list(to), "cluster": list(to.values())})

    kind = dict(stations.dtypes)["station_id"]
    merged = stored(merged, "clusters")
    other = merged.select(F.col("base").alias("b"), F.col("label").alias("b_label"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    steps = near_pairs(merged, other, "x", "z", "bx", "bz", 2 * name_radius).where((F.col("base") < F.col("b")) & F.col("label").eqNullSafe(F.col("b_label")))
    final = labelled(merged.withColumn("node", F.col("base")), steps.select(F.col("base").alias("a"), "b")).groupBy("comp").applyInPandas(same_label, f"base {kind}, cluster {kind}")
    return chained.join(joined.select("comp", "base"), "comp").join(final, "base").select("station_id", "cluster")


def smoothed(widths: list[float], spike: float = 1.8, pull: float = 2.1, wide: float = 2.6) -> list[float]:
    """Widths in order without single spikes; a value already corrected is the next one's neighbour."""
    w = list(widths)
    if len(w) < 3:
        return w
    middle = float(np.median(w))
    for i, v in enumerate(w):
        if 0 < i < len(w) - 1:
            low, high = w[i - 1], w[i + 1]
            mean = (low + high) / 2
            if max(low, high) / min(low, high) < spike and not 1 / spike <= v / mean <= spike:
                w[i] = mean
        else:
            other = w[1] if i == 0 else w[i - 1]
            if not 1 / pull <= w[i] / other <= pull:
                w[i] = (w[i] + other) / 2
            if not 1 / wide <= w[i] / middle <= wide:
                w[i] = (w[i] + middle) / 2
    return w


def smooth_widths(series: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """(key, order, width) with the widths of each key smoothed in order."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(width).cast("double").alias("w"))))
    whole = series.repartition(tasks(series), key).groupBy(key).agg(steps.alias("s"))
    one = F.pandas_udf(lambda widths: pd.Series([smoothed(w.tolist()) for w in widths]), "array<double>")
    out = whole.select(key, "s", one(F.transform("s", lambda v: v["w"])).alias("w"))
    return out.select(key, F.explode(F.arrays_zip("s", "w")).alias("v")).select(key, F.col("v.s.at").alias(order), F.col("v.w").alias(width))


def anchors(items: DataFrame, key: str, radius: float) -> DataFrame:
    """Of same-key items, taken by ``ord``, the ids of those that are farther than ``radius`` from all kept before."""
    rows = prefixes.placed(items.select("id", "ord", "x", "z", F.struct(key).alias("kind")), "ord", radius)
    return rows.join(prefixes.starters(rows, radius, closed=True)[0], "pos", "left_semi").select("id")


def place_labels(candidates: DataFrame, view: str = "view", columns: int = 8, rows: int = 6, per_cell: int = 4, cap: int = 120) -> DataFrame:
    """(view, id, placed, reason) of labels taken by priority: capped in number and by grid cell, never one over
    another; pinned labels always stand. ``candidates``: view, id, priority, near, sx, sy (-1 to 1), hw, hh, pinned."""
    kind = dict(candidates.dtypes)[view]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed, cells, out = [], {}, []
        for r in pdf.sort_values(["priority", "near", "id"], ascending=[False, True, True]).itertuples(index=False):
            cell = (min(columns - 1, max(0, int((r.sx + 1) / 2 * columns))), min(rows - 1, max(0, int((r.sy + 1) / 2 * rows))))
            hidden = None
            if not r.pinned:
                if len(placed) >= cap:
                    hidden = "cap"
                elif cells.get(cell, 0) >= per_cell:
                    hidden = "grid"
                elif any(abs(r.sx - p.sx) < r.hw + p.hw and abs(r.sy - p.sy) < r.hh + p.hh for p in placed):
                    hidden = "collision"
            if hidden is None:
                placed.append(r)
                cells[cell] = cells.get(cell, 0) + 1
            out.append((getattr(r, view), r.id, hidden is None, hidden))
        return pd.DataFrame(out, columns=[view, "id", "placed", "reason"])

    inside = candidates.where(F.col("sx").between(-1.1, 1.1) & F.col("sy").between(-1.1, 1.1))
    return inside.groupBy(view).applyInPandas(run, f"{view} {kind}, id long, placed boolean, reason string")


def stitched(ways: list[list[tuple]]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Ways joined where their ends meet: (closed rings, chains left open)."""
    open_, rings = [], []
    for way in ways:
        chain = list(way)
        while len(chain) > 1 and chain[0] != chain[-1]:
            for i, other in enumerate(open_):
                if other[0] == chain[-1]:
                    chain = chain + other[1:]
                elif other[-1] == chain[-1]:
                    chain = chain + other[-2::-1]
                elif other[-1] == chain[0]:
                    chain = other[:-1] + chain
                elif other[0] == chain[0]:
                    chain = other[:0:-1] + chain
                else:
                    continue
                del open_[i]
                break
            else:
                break
        (rings if len(chain) > 3 and chain[0] == chain[-1] else open_).append(chain)
    return rings, open_


def assemble_rings(ways: DataFrame, relation: str = "relation") -> DataFrame:
    """(relation, role, ring, n, closed): a relation's ways stitched by role; open chains are reported.
    ``ways``: relation, role, ord, points ARRAY<STRUCT<x,z>>."""
    own = ways.where(F.col("role").isNotNull()).repartition(tasks(ways), relation).groupBy(relation, "role")
    whole = own.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", kernels.flat(F.col("points")).alias("p")))), lambda w: w["p"]).alias("ways"))

    def run(rows: pd.Series) -> pd.Series:
        out = []
        for many in rows:
            rings, left = stitched([list(zip(way[::2], way[1::2])) for way in (w.tolist() for w in many)])
            out.append([{"ring": i, "n": len(r) - closed, "closed": closed} for closed, part in ((True, rings), (False, left)) for i, r in enumerate(part)])
        return pd.Series(out)

    told = whole.select(relation, "role", F.pandas_udf(run, "array<struct<ring:long,n:long,closed:boolean>>")("ways").alias("r"))
    return told.select(relation, "role", F.explode("r").alias("r")).select(relation, "role", "r.*")
