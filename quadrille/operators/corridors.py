"""Corridor tracking: the best sequence of partner tracks along a track, by blocked (max, +) products.

A track's segments are dealt into blocks. A block gives the matrix of the best worth of each way through it, from every
state it may be entered in to every state it may be left in; matrices of up to BLOCK blocks are multiplied into that of
a larger one, level by level, until a track is one. On the way down every block learns the worths it is entered with.
Of equal ways the plain program takes the one it meets first when it walks back segment by segment, which a block's
matrix does not tell; so each block then says, for every state it may be left in, in which one that walk enters it, and
these maps are put together level by level as the matrices were. So no track is one task's work, and worths are whole numbers, so the
path is the plain program's, ties included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quadrille.storage import stored

#: Segments of a block, and blocks of a larger one.
BLOCK = 256
#: What a change between two partners and a segment without one cost, and how many candidates of a segment
#: and partners of a track count.
SWITCH, NONE, CANDIDATES, STATES = 0.55, 0.15, 3, 10
#: Worths are counted in millionths; NEVER is below any sum.
UNIT, NEVER = 1_000_000, -(1 << 60)


def costs(states: int) -> np.ndarray:
    """cost[a, b] of going from state a to b; state 0 is none."""
    out = np.full((states, states), round(SWITCH * UNIT), np.int64)
    out[0, :] = out[:, 0] = 0
    np.fill_diagonal(out, 0)
    return out


def after(worth: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(max, +): worth[..., a] and step[a, b] give [..., b]."""
    return np.maximum((worth[..., :, None] + step).max(axis=-2), NEVER)


def product(steps: list[np.ndarray]) -> np.ndarray:
    out = np.where(np.eye(len(steps[0]), dtype=bool), 0, NEVER)
    for step in steps:
        out = after(out, step)
    return out


def entered(enter: np.ndarray, steps: list[np.ndarray]) -> list[np.ndarray]:
    """The worths with which each step is entered."""
    worths = [enter]
    for step in steps[:-1]:
        worths.append(after(worths[-1], step))
    return worths


def way_back(enter: np.ndarray, steps: list[np.ndarray]) -> list[np.ndarray]:
    """For each step the state before it by the state after it, the first of equals."""
    return [(worth[:, None] + step).argmax(axis=0) for worth, step in zip(entered(enter, steps), steps)]


def left_in(leave: int, maps: list[np.ndarray]) -> list[int]:
    """The state in which each step, or block, is left."""
    out = []
    for before in maps[::-1]:
        out.append(leave)
        leave = int(before[leave])
    return out[::-1]


def through(maps: list[np.ndarray]) -> np.ndarray:
    """The state before all steps by the state after them."""
    out = np.arange(len(maps[0]))
    for before in maps[::-1]:
        out = before[out]
    return out


def walk_back(enter: np.ndarray, steps: list[np.ndarray], leave: int | None) -> tuple[list[np.ndarray], list[int]]:
    """The worths with which each step is entered, and the state in which it is left; ``leave``: the last one's, else
    the best, the first of equals."""
    worths = entered(enter, steps)
    return worths, left_in(int(after(worths[-1], steps[-1]).argmax()) if leave is None else leave, way_back(enter, steps))


def _segment_steps(scores: list) -> list[np.ndarray]:
    """A step for each segment: the cost of the change and the worth of the state, NEVER where it has no candidate."""
    local = np.array([list(row) for row in scores], np.int64)
    cost = costs(local.shape[1])
    return [np.maximum(row[None, :] - cost, NEVER) for row in local]


def _square(flat) -> np.ndarray:
    flat = np.asarray(flat, np.int64)
    return flat.reshape(round(len(flat) ** 0.5), -1)


def best_candidates(candidates: DataFrame, track: str = "track") -> DataFrame:
    """The CANDIDATES best of each segment: (track, pos, rank, partner, seg, worth); equals by seg."""
    order = Window.partitionBy(track, "pos").orderBy(F.desc("score"), F.asc_nulls_last("seg"), "partner")
    real = candidates.where("partner is not null and score is not null").select(track, "pos", "partner", "seg", F.col("score").cast("double").alias("score"))
    return real.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES).select(track, "pos", "rank", "partner", "seg", F.round(F.col("score") * UNIT).cast("long").alias("worth"))


def track_corridors(candidates: DataFrame, track: str = "track", block: int = BLOCK) -> DataFrame:
    """(track, pos, partner, seg, score, switched): the partner of every segment of a track, the partner's segment, and
    whether the partner is another than that of the segment before, both being there.

    ``candidates``: track, pos (from 0), partner (null where a segment has none), seg, score. A segment's best three
    count, and the ten partners that a track meets most often, the first met of equals, are its states."""
    kind = dict(candidates.dtypes)
    best = stored(best_candidates(candidates, track), "candidates")
    met = best.groupBy(track, "partner").agg(F.count("*").alias("n"), F.min(F.struct("pos", "rank")).alias("first"))
    state = F.row_number().over(Window.partitionBy(track).orderBy(F.desc("n"), "first"))
    states = met.withColumn("state", state).where(F.col("state") <= STATES).select(track, "partner", "state")
    many = states.groupBy(track).agg(F.max("state").alias("many"))
    own = best.join(states, [track, "partner"]).groupBy(track, "pos").agg(F.collect_list(F.struct("state", "rank", "partner", "seg", "worth")).alias("found"))
    places = candidates.select(track, "pos").distinct().join(own, [track, "pos"], "left").join(many, track, "left").withColumn("many", F.coalesce("many", F.lit(0)))
    none = F.lit(-round(NONE * UNIT)).cast("long")
    worth = lambda s: F.array_max(F.transform(F.filter(F.coalesce("found", F.array()), lambda c: c["state"] == s), lambda c: c["worth"]))
    scores = F.transform(F.sequence(F.lit(0), F.col("many")), lambda s: F.when(s == 0, none).otherwise(F.coalesce(worth(s), F.lit(NEVER))))
    segments = stored(places.select(track, "pos", F.floor(F.col("pos") / block).alias("block"), "found", scores.alias("scores")), "segments")

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({track: [pdf[track].iloc[0]], "block": [pdf["block"].iloc[0]], "step": [product(_segment_steps(list(pdf["scores"]))).ravel()]})

    def larger(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({track: [pdf[track].iloc[0]], "block": [pdf["block"].iloc[0] // block], "step": [product([_square(x) for x in pdf["step"]]).ravel()]})

    ddl = f"{track} {kind[track]}, block long, step array<long>"
    levels = [stored(segments.select(track, "pos", "block", "scores").groupBy(track, "block").applyInPandas(leaf, ddl), "steps")]
    while levels[-1].groupBy(track).count().where("count > 1").limit(1).count():
        levels.append(stored(levels[-1].groupBy(track, F.floor(F.col("block") / block)).applyInPandas(larger, ddl), "steps"))

    keys, up = f"{track} {kind[track]}, block long", F.floor(F.col("block") / block)

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({track: pdf[track], "block": pdf["block"], "enter": entered(np.asarray(pdf["enter"].iloc[0], np.int64), [_square(x) for x in pdf["step"]])})

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        step = _square(pdf["step"].iloc[0])
        enter = np.where(np.arange(len(step)) == 0, 0, NEVER)  # a track begins as if behind a segment without a partner
        return pd.DataFrame({track: pdf[track], "block": pdf["block"], "enter": [enter], "leave": [walk_back(enter, [step], None)[1][0]]})

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        maps = way_back(np.asarray(pdf["enter"].iloc[0], np.int64), _segment_steps(list(pdf["scores"])))
        return pd.DataFrame({track: [pdf[track].iloc[0]], "block": [pdf["block"].iloc[0]], "before": [through(maps)]})

    def larger_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({track: [pdf[track].iloc[0]], "block": [pdf["block"].iloc[0] // block], "before": [through([np.asarray(x, np.int64) for x in pdf["before"]])]})

    def down_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({track: pdf[track], "block": pdf["block"], "leave": left_in(int(pdf["leave"].iloc[0]), [np.asarray(x, np.int64) for x in pdf["before"]])})

    ends = stored(levels[-1].groupBy(track).applyInPandas(top, f"{keys}, enter array<long>, leave long"), "ends")
    enters = ends.drop("leave")
    for steps in levels[-2::-1]:
        inner = steps.withColumn("up", up).join(enters.withColumnRenamed("block", "up"), [track, "up"])
        enters = inner.groupBy(track, "up").applyInPandas(down, f"{keys}, enter array<long>")
    enters = stored(enters, "enters")
    maps = [stored(segments.select(track, "pos", "block", "scores").join(enters, [track, "block"]).groupBy(track, "block").applyInPandas(back, f"{keys}, before array<long>"), "maps")]
    for _ in levels[2:]:
        maps.append(stored(maps[-1].groupBy(track, up).applyInPandas(larger_back, f"{keys}, before array<long>"), "maps"))
    leaves = ends.drop("enter")
    for before in maps[::-1] if len(levels) > 1 else []:
        inner = before.withColumn("up", up).join(leaves.withColumnRenamed("block", "up"), [track, "up"])
        leaves = inner.groupBy(track, "up").applyInPandas(down_back, f"{keys}, leave long")
    told = enters.join(leaves, [track, "block"])

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        maps = way_back(np.asarray(pdf["enter"].iloc[0], np.int64), _segment_steps(list(pdf["scores"])))
        left = left_in(int(pdf["leave"].iloc[0]), maps)
        before = [int(m[state]) for m, state in zip(maps, left)]
        return pd.DataFrame({track: pdf[track], "pos": pdf["pos"], "state": left, "switched": [a != b and a > 0 and b > 0 for a, b in zip(before, left)]})

    walked = segments.select(track, "pos", "block", "scores").join(told, [track, "block"]).groupBy(track, "block").applyInPandas(path, f"{track} {kind[track]}, pos long, state long, switched boolean")
    chosen = F.array_min(F.transform(F.filter("found", lambda c: c["state"] == F.col("state")), lambda c: F.struct((-c["worth"]).alias("worth"), c["rank"].alias("rank"), c["partner"].alias("partner"), c["seg"].alias("seg"))))
    out = segments.select(track, "pos", "found").join(walked, [track, "pos"]).withColumn("chosen", F.when(F.col("state") > 0, chosen))
    return out.select(track, "pos", "chosen.partner", "chosen.seg", (-F.col("chosen.worth") / UNIT).alias("score"), "switched")


def corridor_switches(paths: DataFrame, track: str = "track") -> DataFrame:
    """(track, segments, paired, switches) of tracked corridors."""
    return paths.groupBy(track).agg(F.count("*").alias("segments"), F.count("partner").alias("paired"), F.count_if("switched").alias("switches"))
