"""What a flight saw: rays through voxels, first sight of each point, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.scalar import CELL, XYZ
from voxelspark.operators.accumulate import running
from voxelspark.operators.components import stored
from voxelspark.operators.neighbours import LISTED, VIEW, Places, listed, meet, numbers, of_poses, views

#: Crossings that are closer in distance than this count as one: z is crossed first then, and x last.
TIE = 1e-9
#: Pairs of views and points of one grid block that one task may look at, and rays that are walked at a time.
PAIRS, RAYS = 1 << 23, 1 << 14
#: Length, width and height of the frustum.
FRUSTUM = (20.0, 20.0, 15.0)
VIEWED = "scene_id long, ax double, ay double, az double, yaw double"
#: Cells a side of a brick, the unit of the occupied space that a task holds.
BRICK = 8


def _crossings(start: np.ndarray, end: np.ndarray, res: float) -> tuple[np.ndarray, ...]:
    """Of rays: first and last cell, whether they leave the first, and by axis the step, the distance of the first crossing, that between two, and their number."""
    cell, goal = np.floor(start / res).astype(np.int64), np.floor(end / res).astype(np.int64)
    way = end - start
    dist = np.sqrt((way**2).sum(1))
    live = (dist >= 1e-9) & (cell != goal).any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = way / dist[:, None]
        still = ~(np.abs(unit) >= 1e-12)
        step = np.where(unit > 0, 1, -1)
        first = np.where(still, np.inf, ((cell + (step > 0)) * res - start) / unit)
        each = np.where(still, np.inf, res / np.abs(unit))
    return cell, goal, live, step, first, each, np.where(live[:, None] & ~still, np.abs(goal - cell), 0)


def _walk(start: np.ndarray, end: np.ndarray, res: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of many rays, without each ray's last one: ray numbers and cells.

    A ray enters a new cell where it crosses a grid plane.  The k-th crossing of an axis is at a known distance, and the
    cell that it enters follows from the number of crossings of the other two axes up to there, so all
    crossings of all rays are worked out at once, in no order.
    """
    cell, goal, live, step, first, each, number = _crossings(start, end, res)
    rays, cells = [np.flatnonzero(live)], [cell[live]]
    for axis in range(3):
        ray = np.repeat(np.arange(len(start)), number[:, axis])
        k = np.arange(len(ray)) - np.repeat(np.cumsum(number[:, axis]) - number[:, axis], number[:, axis])
        at = first[ray, axis] + k * each[ray, axis]
        entered = cell[ray].copy()
        entered[:, axis] += step[ray, axis] * (k + 1)
        for other in range(3):
            if other != axis:
                with np.errstate(invalid="ignore"):
                    gone = (at - first[ray, other] + (TIE if other > axis else -TIE)) / each[ray, other]
                    passed = np.floor(gone) + 1 if other > axis else np.ceil(gone)
                passed = np.where(number[ray, other] > 0, np.clip(passed, 0, number[ray, other]), 0).astype(np.int64)
                entered[:, other] += step[ray, other] * passed
        before = (entered != goal[ray]).any(1)
        rays.append(ray[before])
        cells.append(entered[before])
    return np.concatenate(rays), np.concatenate(cells)


def ray_voxels(pairs: DataFrame, res: float = 1.0) -> DataFrame:
    """Cells on the way from a pose (``ax, ay, az``) to a point (``bx, by, bz``): its own included, the target's not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), RAYS):
                part = batch.iloc[at : at + RAYS]
                ray, cell = _walk(part[[f"a{n}" for n in XYZ]].to_numpy(float), part[[f"b{n}" for n in XYZ]].to_numpy(float), res)
                yield pd.DataFrame({n: part[n].to_numpy()[ray] for n in ("scene_id", "seq", "point_id")} | {c: cell[:, k].astype(np.int32) for k, c in enumerate(CELL)})

    kept = pairs.select("scene_id", "seq", "point_id", *[f"{s}{n}" for s in "ab" for n in XYZ])
    return kept.mapInPandas(run, "scene_id long, seq long, point_id long, ix int, iy int, iz int")


def ray_lengths(poses: DataFrame, points: DataFrame, res: float = 1.0, reach: float = 25.0) -> DataFrame:
    """Rays to a pose's visible candidates, their cells and the sum of the cells' coordinates: ``scene_id, seq, rays, cells, ix, iy, iz``.  Neither a ray nor a cell is a row."""
    names = ("rays", "cells", *CELL)

    def run(key: tuple, left: pa.Table, places: Places, seen: pa.Table, _: pa.Table) -> pa.Table:
        own = numbers(left, VIEW[:3])
        sums = np.zeros((len(names), len(left)), np.int64)
        for pose, point in places.candidates(own, numbers(left, "cs"), reach, *FRUSTUM):
            for at in range(0, len(pose), RAYS):
                i = pose[at : at + RAYS]
                ray, cell = _walk(own[i], places.place[point[at : at + RAYS]], res)
                sums[0] += np.bincount(i, minlength=len(left))
                sums[1] += np.bincount(i[ray], minlength=len(left))
                for k in range(3):
                    sums[2 + k] += np.bincount(i[ray], cell[:, k], len(left)).astype(np.int64)
        met = sums[0] > 0
        return pa.table([left.column(n).filter(pa.array(met)) for n in ("scene_id", *VIEW)] + [pa.array(v[met]) for v in sums], names=["scene_id", *VIEW, *names])

    found = meet(stored(views(poses)), points, run, f"{VIEWED}, {', '.join(f'{n} long' for n in names)}", PAIRS, reach=reach)
    return of_poses(poses, found).groupBy("scene_id", "seq").agg(*[F.sum(n).alias(n) for n in names])


def with_places(pairs: DataFrame, poses: DataFrame, points: DataFrame) -> DataFrame:
    a = poses.select("scene_id", "seq", *[F.col(n).alias(f"a{n}") for n in XYZ])
    b = points.select("scene_id", "point_id", *[F.col(n).alias(f"b{n}") for n in XYZ])
    return pairs.join(a, ["scene_id", "seq"]).join(b, ["scene_id", "point_id"])


class Bricks:
    """Occupied cells in two levels: a grid of bricks, most of them empty, and the cells of the others.

    A brick costs four bytes and an occupied one 512 more, so 0.1 m voxels around a block of 25 m, which are 752 cells a side, take 4 MB and half a
    kilobyte for each brick with a cell; a plain bitmap would take 425 MB.
    """

    def __init__(self, cells: np.ndarray, low: np.ndarray, side: int) -> None:
        self.low, number = low, -(-side // BRICK)
        cells = cells - low
        shape = (number,) * 3
        brick = np.ravel_multi_index(tuple((cells // BRICK).T), shape)
        used, place = np.unique(brick, return_inverse=True)
        self.index = np.full(number**3, -1, np.int32)
        self.index[used] = np.arange(len(used))
        self.shape, self.cells = shape, np.zeros((len(used), BRICK**3), bool)
        self.cells[place, self._inner(cells)] = True

    @staticmethod
    def _inner(cells: np.ndarray) -> np.ndarray:
        return np.ravel_multi_index(tuple((cells % BRICK).T), (BRICK,) * 3)

    def occupied(self, cells: np.ndarray) -> np.ndarray:
        cells = cells - self.low
        brick = self.index[np.ravel_multi_index(tuple((cells // BRICK).T), self.shape)]
        out = brick >= 0
        out[out] = self.cells[brick[out], self._inner(cells[out])]
        return out


def _walls(key: tuple, wall: pa.Table, res: float, reach: float) -> Bricks:
    """The occupied cells in the blocks around a block; its rays stay inside them."""
    low = np.floor((np.array([k.as_py() for k in key[1:4]]) - 1) * reach / res).astype(np.int64) - 1
    return Bricks(numbers(wall, CELL).astype(np.int64), low, int(np.ceil(3 * reach / res)) + 3)


def _free(start: np.ndarray, end: np.ndarray, wall: Bricks, res: float) -> np.ndarray:
    """Rays without an occupied cell before their last one."""
    # most are blocked by the cell before it, which is known where one crossing is clearly the last
    _, before, live, step, first, each, number = _crossings(start, end, res)
    with np.errstate(invalid="ignore"):
        last = np.where(number > 0, first + (number - 1) * each, -1.0)
    rank = np.sort(last, 1)
    clear = np.flatnonzero(live & (rank[:, 2] > rank[:, 1] + 1e-6))
    axis = last[clear].argmax(1)
    before[clear, axis] -= step[clear, axis]
    free = np.ones(len(start), bool)
    free[clear[wall.occupied(before[clear])]] = False
    rest = np.flatnonzero(free)
    for at in range(0, len(rest), RAYS):
        part = rest[at : at + RAYS]
        ray, cell = _walk(start[part], end[part], res)
        free[part[ray[wall.occupied(cell)]]] = False
    return free


def unoccluded(poses: DataFrame, points: DataFrame, occupied: DataFrame, res: float = 1.0, reach: float = 25.0) -> DataFrame:
    """Visible candidates with no occupied cell between the pose and the point's own cell: ``scene_id, seq, point_id``.

    Space is cut into grid blocks of side ``reach``.  The rays of a block's poses stay inside the blocks around it, so they
    meet the occupied cells there, held in :class:`Bricks`; neither a candidate nor a cell of a ray is ever a row.  Poses of the same place and yaw are looked at once, and
    what they see is a list of points, until the poses have got it.
    """

    def run(key: tuple, left: pa.Table, places: Places, seen: pa.Table, wall: pa.Table) -> pa.Table:
        own, held = numbers(left, VIEW[:3]), _walls(key, wall, res, reach)
        out = [(np.zeros(0, np.int64),) * 2]
        for pose, point in places.candidates(own, numbers(left, "cs"), reach, *FRUSTUM):
            free = _free(own[pose], places.place[point], held, res)
            out.append((pose[free], point[free]))
        return listed(key, left, seen.column("point_id").combine_chunks(), *map(np.concatenate, zip(*out)))

    found = meet(stored(views(poses)), points, run, LISTED, PAIRS, occupied, res, reach)
    return of_poses(poses, found).select("scene_id", "seq", F.explode("points").alias("point_id"))


def first_sights(seen_from: DataFrame, points: DataFrame, occupied: DataFrame, res: float = 1.0, reach: float = 25.0) -> DataFrame:
    """The first of these :func:`views` that sees each point: ``scene_id, point_id, first_seq``.  No pair is a row.

    A task takes its views in order, and a point that one has seen takes no part in what follows.  ``points`` may have ``first_seq``, by which a point is known to be
    seen already (or null): only earlier views count then.
    """

    def run(key: tuple, left: pa.Table, places: Places, seen: pa.Table, wall: pa.Table) -> pa.Table:
        own, held, seq = numbers(left, VIEW[:3]), _walls(key, wall, res, reach), left.column("seq").to_numpy()
        last = np.iinfo(np.int64).max
        known = pc.fill_null(seen.column("first_seq"), last).to_numpy() if "first_seq" in seen.column_names else np.full(len(seen), last)
        best = known.copy()
        for pose, point in places.candidates(own, numbers(left, "cs"), reach, *FRUSTUM):
            early = seq[pose] < best[point]
            pose, point = pose[early], point[early]
            free = _free(own[pose], places.place[point], held, res)
            np.minimum.at(best, point[free], seq[pose[free]])
        new = np.flatnonzero(best < known)
        return pa.table([pa.repeat(key[0], len(new)), seen.column("point_id").take(pa.array(new)), pa.array(best[new])], names=["scene_id", "point_id", "first_seq"])

    return first_seen(meet(seen_from, points, run, "scene_id long, point_id long, first_seq long", PAIRS, occupied, res, reach), "first_seq")


def still_open(points: DataFrame, poses: DataFrame, seen: DataFrame) -> DataFrame:
    """Points that some of these poses could be the first to see: not seen yet, or by a later pose than the first of these."""
    first = poses.groupBy("scene_id").agg(F.min("seq").alias("_from"))
    known = points.join(seen.select("scene_id", "point_id", "first_seq"), ["scene_id", "point_id"], "left").join(first, "scene_id")
    return known.filter(F.col("first_seq").isNull() | (F.col("first_seq") > F.col("_from"))).select(points.columns)


def first_seen_of(poses: DataFrame, points: DataFrame, occupied: DataFrame, first: int = 4096) -> DataFrame:
    """The first pose that sees each point: ``scene_id, point_id, first_seq``, without making all pairs.

    The first poses of each place and yaw are tried in order, in chunks of each scene that double: the first 4096, the next 8192, and so on.  A point that a chunk sees takes no part in the next ones, so
    there are some log2(poses) rounds, and the large ones have few points left.
    """
    seen_from = stored(views(poses))
    low = seen_from.groupBy("scene_id").agg(F.min("seq").alias("_low"))
    numbered = stored(seen_from.join(low, "scene_id").withColumn("_round", F.floor(F.log2((F.col("seq") - F.col("_low")) / first + 1)).cast("int")).drop("_low"))
    found, left = None, points
    for k in [r[0] for r in numbered.select("_round").distinct().sort("_round").collect()]:
        new = stored(first_sights(numbered.filter(F.col("_round") == k).drop("_round"), left, occupied))
        found = new if found is None else found.unionByName(new)
        left = points.hint("merge").join(found.hint("merge"), ["scene_id", "point_id"], "left_anti")
    return first_sights(seen_from, points, occupied) if found is None else found


def first_seen(pairs: DataFrame, seq: str = "seq") -> DataFrame:
    return pairs.groupBy("scene_id", "point_id").agg(F.min(seq).alias("first_seq"))


def coverage(points: DataFrame, seen: DataFrame) -> DataFrame:
    both = points.select("scene_id", "point_id").join(seen, ["scene_id", "point_id"], "left").groupBy("scene_id")
    counted = both.agg(F.count("first_seq").alias("seen"), F.count("*").alias("total"))
    return counted.withColumn("percent", F.round(100.0 * F.col("seen") / F.col("total"), 6))


def coverage_timeline(poses: DataFrame, seen: DataFrame, points: DataFrame) -> DataFrame:
    """Newly seen, seen so far and share of all points at each pose."""
    new = seen.groupBy("scene_id", F.col("first_seq").alias("seq")).agg(F.count("*").alias("new"))
    total = points.groupBy("scene_id").agg(F.count("*").alias("total"))
    out = poses.select("scene_id", "seq").join(new, ["scene_id", "seq"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    out = running(out, "seq", F.sum("new"), "seen", lambda before, inside: F.coalesce(before, F.lit(0)) + inside)
    return out.join(total, "scene_id").select("scene_id", "seq", "new", "seen", F.round(100.0 * F.col("seen") / F.col("total"), 6).alias("percent"))
