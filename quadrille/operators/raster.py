"""Rasters in blocks: shapes filled by scanlines, eight bit planes a cell, and depths from the shore.

A raster is a table of blocks (bx, bz, cells): SIDE x SIDE cells, row by row along x. A cell (cx, cz) has its centre at
((cx + 0.5) size, (cz + 0.5) size). Filling is pre-aggregated: every task ORs what it has of a block before the block is
put together from the tasks' parts as they stream by. Depths travel from block to block over one-cell borders until no
block changes; a round asks only blocks with a border that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.functions import geo
from quadrille.storage import stored

#: Cells along a block, and the depth of what no land is known for.
SIDE, FAR = 128, np.inf
BLOCK = pa.schema([("bx", pa.int64()), ("bz", pa.int64()), ("cells", pa.binary())])
BLOCK_DDL = "bx long, bz long, cells binary"


def scan_fill(rings: list[np.ndarray], x0: float, z0: float, size: float, side: int) -> np.ndarray:
    """Which of side x side cells have their centre inside the rings by even and odd: an edge counts for the rows from its
    lower end up to its upper one, and turns over all cells from its crossing on."""
    turns = np.zeros((side, side + 1), np.int64)
    for ring in rings:
        a, b = ring, np.roll(ring, -1, axis=0)
        low, high = np.where((a[:, 1] < b[:, 1])[:, None], a, b), np.where((a[:, 1] < b[:, 1])[:, None], b, a)
        first = np.maximum(0, np.ceil((low[:, 1] - z0) / size - 0.5)).astype(np.int64)
        last = np.minimum(side, np.ceil((high[:, 1] - z0) / size - 0.5)).astype(np.int64)
        count = np.maximum(0, last - first)
        edge = np.repeat(np.arange(len(a)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[edge]
        z = z0 + (row + 0.5) * size
        x = low[edge, 0] + (z - low[edge, 1]) * (high[edge, 0] - low[edge, 0]) / (high[edge, 1] - low[edge, 1])
        at = np.clip(np.ceil((x - x0) / size - 0.5), 0, side).astype(np.int64)
        np.add.at(turns, (row, at), 1)
    return turns.cumsum(axis=1)[:, :side] % 2 == 1


def fill(shapes: DataFrame, size: float, side: int = SIDE) -> DataFrame:
    """Blocks of bytes: each cell's bits of all shapes that hold its centre. ``shapes``: rings (outline and holes, arrays of
    struct<x, z>), bit (0 to 7). Shapes without rings fill nothing."""
    parts = shapes.where(F.size("rings") > 0).select("rings", F.col("bit").cast("int").alias("bit"), geo.bbox(F.flatten("rings")).alias("box"))
    parts = parts.withColumn("c", F.explode(geo.cells_of_box(F.col("box"), size * side))).select(F.col("c.cx").cast("long").alias("bx"), F.col("c.cz").cast("long").alias("bz"), "bit", "rings")
    salted = parts.repartition("bx", "bz", F.pmod(F.xxhash64("rings"), F.lit(64))).sortWithinPartitions("bx", "bz")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, None
        for batch in batches:
            out = []
            for bx, bz, bit, rings in zip(*(batch.column(c).to_pylist() for c in ("bx", "bz", "bit", "rings"))):
                if (bx, bz) != at:
                    if at:
                        out.append((*at, cells.tobytes()))
                    at, cells = (bx, bz), np.zeros((side, side), np.uint8)
                rings = [np.array([(p["x"], p["z"]) for p in ring], float) for ring in rings if ring]
                cells[scan_fill(rings, bx * side * size, bz * side * size, size, side)] |= 1 << bit
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOCK.types)], schema=BLOCK)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, cells.tobytes()), BLOCK.types)], schema=BLOCK)

    return merged(salted.mapInArrow(draw, BLOCK_DDL))


def merged(parts: DataFrame) -> DataFrame:
    """Blocks of bytes, those of one place ORed."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, None
        for batch in batches:
            out = []
            for bx, bz, more in zip(*(batch.column(c).to_pylist() for c in ("bx", "bz", "cells"))):
                more = np.frombuffer(more, np.uint8)
                if (bx, bz) == at:
                    cells = cells | more
                    continue
                if at:
                    out.append((*at, cells.tobytes()))
                at, cells = (bx, bz), more
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOCK.types)], schema=BLOCK)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, cells.tobytes()), BLOCK.types)], schema=BLOCK)

    return parts.repartition("bx", "bz").sortWithinPartitions("bx", "bz").mapInArrow(join, BLOCK_DDL)


def of_cells(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """Blocks of bytes from (cx, cz, mask)."""
    place = lambda c: F.floor(F.col(c) / side)
    rows = cells.groupBy("cx", "cz").agg(F.bit_or(F.col("mask").cast("long")).alias("mask")).select(place("cx").alias("bx"), place("cz").alias("bz"), F.pmod("cx", F.lit(side)).alias("i"), F.pmod("cz", F.lit(side)).alias("j"), "mask")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((side, side), np.uint8)
        out[pdf["j"], pdf["i"]] = pdf["mask"]
        return pd.DataFrame({"bx": [pdf["bx"].iloc[0]], "bz": [pdf["bz"].iloc[0]], "cells": [out.tobytes()]})

    return rows.groupBy("bx", "bz").applyInPandas(draw, BLOCK_DDL)  # a block has side * side rows at most


def cells_of(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """(cx, cz, mask) of the cells that have a bit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, bz, cells in zip(*(batch.column(c).to_pylist() for c in ("bx", "bz", "cells"))):
                cells = np.frombuffer(cells, np.uint8).reshape(side, side)
                j, i = np.nonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(bx * side + i), pa.array(bz * side + j), pa.array(cells[j, i].astype(np.int64))], names=["cx", "cz", "mask"])

    return blocks.mapInArrow(read, "cx long, cz long, mask long")


def plane_counts(blocks: DataFrame) -> DataFrame:
    """(bit, cells, alone): the cells that have each bit, and those that have no other; bits without a cell are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.bincount(np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8), minlength=256)
            has = [(bit, int(values[(np.arange(256) >> bit & 1) == 1].sum()), int(values[1 << bit])) for bit in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*has)], names=["bit", "cells", "alone"])

    return blocks.mapInArrow(count, "bit long, cells long, alone long").groupBy("bit").agg(F.sum("cells").alias("cells"), F.sum("alone").alias("alone")).where("cells > 0")


def chamfer(depth: np.ndarray) -> np.ndarray:
    """Two passes over a raster: a step along an axis costs 1, a diagonal one the root of two."""
    out, steps = depth.copy(), np.arange(depth.shape[1])
    for _ in range(2):  # down and to the right, then turned round
        for j in range(len(out)):
            row = out[j]
            if j:
                up = out[j - 1]
                row = np.minimum(row, up + 1)
                row[1:] = np.minimum(row[1:], up[:-1] + 2**0.5)
                row[:-1] = np.minimum(row[:-1], up[1:] + 2**0.5)
            out[j] = np.minimum.accumulate(row - steps) + steps
        out = out[::-1, ::-1]
    return out


#: Where a block's border goes: the neighbour, and the cells of the own block that are its frame.
AROUND = [(dx, dz) for dx in (-1, 0, 1) for dz in (-1, 0, 1) if dx or dz]


def _edge(depth: np.ndarray, dx: int, dz: int) -> np.ndarray:
    """The own cells next to the neighbour at (dx, dz)."""
    pick = lambda d: slice(None) if d == 0 else slice(0, 1) if d < 0 else slice(-1, None)
    return depth[pick(dz), pick(dx)].ravel()


def shore_depths(blocks: DataFrame, water: int, land: int, side: int = SIDE) -> DataFrame:
    """(cx, cz, depth) of the cells that have the bit ``water``: steps to the nearest cell with the bit ``land``, of any
    length; null if there is no land at all. Steps go over all cells of the raster's box; what lies outside is no land."""
    given = stored(blocks, "raster")
    box = given.agg(F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("bz").alias("z0"), F.max("bz").alias("z1"))
    places = box.where("x0 is not null").select(F.explode(F.sequence("x0", "x1")).alias("bx"), "z0", "z1").select("bx", F.explode(F.sequence("z0", "z1")).alias("bz"))
    edge = ", ".join(f"e{k} binary" for k in range(len(AROUND)))
    ddl = f"bx long, bz long, depth binary, changed array<int>, {edge}"

    def row(bx: int, bz: int, old: np.ndarray | None, new: np.ndarray) -> tuple:
        edges = [_edge(new, *d) for d in AROUND]
        changed = [k for k, e in enumerate(edges) if np.isfinite(e).any() and (old is None or (_edge(old, *AROUND[k]) - e > 1e-9).any())]
        return (bx, bz, new.astype("<f8").tobytes(), changed, *(e.astype("<f8").tobytes() for e in edges))

    names = ["bx", "bz", "depth", "changed", *(f"e{k}" for k in range(len(AROUND)))]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for bx, bz, cells in zip(pdf["bx"], pdf["bz"], pdf["cells"]):
                cells = np.zeros((side, side), np.uint8) if cells is None else np.frombuffer(cells, np.uint8).reshape(side, side)
                out.append(row(bx, bz, None, chamfer(np.where(cells & land, 0.0, FAR))))
            yield pd.DataFrame(out, columns=names)

    now = stored(places.join(given, ["bx", "bz"], "left").mapInPandas(start, ddl), "depths")
    while True:
        told = now.select("bx", "bz", F.explode("changed").alias("k"), *(f"e{k}" for k in range(len(AROUND))))
        value = F.coalesce(*(F.when(F.col("k") == k, F.col(f"e{k}")) for k in range(len(AROUND))))
        step = lambda i: F.element_at(F.array(*(F.lit(d[i]) for d in AROUND)), F.col("k") + 1)
        borders = told.select((F.col("bx") + step(0)).alias("bx"), (F.col("bz") + step(1)).alias("bz"), F.struct("k", value.alias("edge")).alias("border")).groupBy("bx", "bz").agg(F.collect_list("border").alias("borders"))  # eight at most
        met = now.select("bx", "bz", "depth").join(borders, ["bx", "bz"])
        if met.limit(1).count() == 0:
            break

        def relax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for bx, bz, depth, borders_ in zip(pdf["bx"], pdf["bz"], pdf["depth"], pdf["borders"]):
                    old = np.frombuffer(depth, "<f8").reshape(side, side)
                    framed = np.full((side + 2, side + 2), FAR)
                    framed[1:-1, 1:-1] = old
                    for border in borders_:
                        dx, dz = AROUND[border["k"]]  # it comes from the other side
                        pick = lambda d: slice(1, -1) if d == 0 else slice(-1, None) if d < 0 else slice(0, 1)
                        place = framed[pick(dz), pick(dx)]
                        place[...] = np.frombuffer(border["edge"], "<f8").reshape(place.shape)
                    out.append(row(bx, bz, old, chamfer(framed)[1:-1, 1:-1]))
                yield pd.DataFrame(out, columns=names)

        new = stored(met.mapInPandas(relax, ddl), "depths")
        rest = now.join(new.select("bx", "bz"), ["bx", "bz"], "left_anti").withColumn("changed", F.array().cast("array<int>"))
        now = stored(rest.unionByName(new), "depths")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bx, bz, cells, depth in zip(pdf["bx"], pdf["bz"], pdf["cells"], pdf["depth"]):
                j, i = np.nonzero(np.frombuffer(cells, np.uint8).reshape(side, side) & water)
                steps = np.frombuffer(depth, "<f8").reshape(side, side)[j, i]
                yield pd.DataFrame({"cx": bx * side + i, "cz": bz * side + j, "depth": np.where(np.isfinite(steps), steps, np.nan)})

    found = given.join(now.select("bx", "bz", "depth"), ["bx", "bz"]).mapInPandas(read, "cx long, cz long, depth double")
    return found.withColumn("depth", F.when(~F.isnan("depth"), F.col("depth")))
