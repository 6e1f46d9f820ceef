"""Joins by distance: a grid cell as the key, then the exact condition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.functions.scalar import CELL, XYZ, quantize, yaw_from_quaternion
from voxelspark.operators.components import checkpoint, components, stored

#: Points of a cell that one row of a comparison holds.
PART = 256
#: Cells a side of the tiles in which components are joined first.
TILE_CELLS = 16
#: Least side of the grid cells in which a frustum looks for points.
GLANCE = 4.0
#: Pairs of views and points that a task may look at, candidates that are judged at a time, and points in a row of a view.
PAIRS, GLANCES, LIST = 1 << 23, 1 << 17, 1 << 16
#: Partitions to which the tasks of views are dealt at most.
TASKS = 2000
#: What decides what a pose sees, and the rows of what views see.
VIEW = ("ax", "ay", "az", "yaw")
LISTED = "scene_id long, ax double, ay double, az double, yaw double, points array<long>"
CUBE = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def around(offsets: Sequence[tuple[int, int, int]] = tuple(CUBE)) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, "abc")]) for o in offsets]))


def _spread(df: DataFrame, keep: Sequence[str], size: float) -> DataFrame:
    """Each row at the 27 grid cells around it."""
    cells = df.select(*keep, *quantize(size), around().alias("o"))
    return cells.select(*keep, *[(F.col(c) + F.col(f"o.{k}")).alias(c) for c, k in zip(CELL, "abc")])


def _square(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}{n}") - F.col(f"{b}{n}")) * (F.col(f"{a}{n}") - F.col(f"{b}{n}")) for n in XYZ), F.lit(0.0))


def radius_neighbors(points: DataFrame, r: float, within: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Ordered pairs of points of one group no farther than r: ``src, dst, w``.  ``points`` has ``point_id``."""
    left = points.select(*within, F.col("point_id").alias("src"), *[F.col(n).alias(f"a{n}") for n in XYZ], *XYZ)
    right = points.select(*within, F.col("point_id").alias("dst"), *[F.col(n).alias(f"b{n}") for n in XYZ], *quantize(r))
    near = _spread(left, [*within, "src", *[f"a{n}" for n in XYZ]], r).join(right, [*within, *CELL])
    return near.filter(F.col("src") != F.col("dst")).withColumn("d2", _square("a", "b")).filter(F.col("d2") <= r * r).select(*within, "src", "dst", F.sqrt("d2").alias("w"))


def _bounds(front: DataFrame, side: float) -> DataFrame:
    """``near`` and ``far``: squares of the least and greatest distance from a query to its cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for n, c in zip(XYZ, CELL):
        low, high = F.col(f"a{n}") - F.col(c) * side, (F.col(c) + 1) * side - F.col(f"a{n}")
        out, most = F.greatest(-low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))
        near, far = near + out * out, far + most * most
    return front.withColumns({"near": near, "far": far})


def nearest_point(queries: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """The nearest point of its scene to each query, ties to the least point_id: ``query_id, point_id, d``.

    Occupied cells of side ``reach`` are put together by eights, level by level, like an octree.  A query climbs until a cell beside its own is occupied; what lies two levels
    above that must hold its nearest point.  Queries then descend through occupied cells alone, and those farther than the far end of another one are left out, so a far query sees a
    few cells of each level and no cell that holds the scene.  All queries that have a point in their scene get an answer; only flags reach the driver.
    """
    places = [f"a{n}" for n in XYZ]
    names = ["scene_id", "query_id", *places]
    left = queries.select("scene_id", "query_id", *[F.col(n).alias(f"a{n}") for n in XYZ])
    left = stored(left.join(points.select("scene_id").distinct(), "scene_id", "left_semi"))
    if left.isEmpty():
        return left.select("scene_id", "query_id", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast("double").alias("d"))
    levels = [stored(points.select("scene_id", *quantize(reach)).distinct())]
    level_of = lambda k: levels[k] if k < len(levels) else levels.append(stored(level_of(k - 1).select("scene_id", *[F.floor(F.col(c) / 2).cast("int").alias(c) for c in CELL]).distinct())) or levels[k]

    def beside(rows: DataFrame, k: int) -> DataFrame:
        """Rows at the occupied cells of a level around their own."""
        side = reach * 2**k
        cells = rows.select(*names, *[F.floor(F.col(f"a{n}") / side).cast("int").alias(c) for n, c in zip(XYZ, CELL)], around().alias("o"))
        return cells.select(*names, *[(F.col(c) + F.col(f"o.{x}")).alias(c) for c, x in zip(CELL, "abc")]).join(level_of(k), ["scene_id", *CELL], "left_semi")

    start, k = {}, 0
    while not left.isEmpty():
        hit = stored(beside(left, k).select("scene_id", "query_id").distinct())
        start[k + 2] = left.join(hit, ["scene_id", "query_id"], "left_semi")
        left = stored(left.join(hit, ["scene_id", "query_id"], "left_anti"))
        k += 1
    front = None
    for k in range(max(start), -1, -1):
        if front is not None:
            child = F.explode(F.array(*[F.struct(*[F.lit(v).alias(x) for v, x in zip(o, "abc")]) for o in product((0, 1), repeat=3)])).alias("o")
            below = front.select(*names, *CELL, child).select(*names, *[(2 * F.col(c) + F.col(f"o.{x}")).alias(c) for c, x in zip(CELL, "abc")])
            front = below.join(level_of(k), ["scene_id", *CELL], "left_semi")
        if k in start:
            front = beside(start[k], k) if front is None else front.unionByName(beside(start[k], k))
        bounded = _bounds(front, reach * 2**k).withColumn("least", F.min("far").over(Window.partitionBy("scene_id", "query_id")))
        front = stored(bounded.filter(F.col("near") <= F.col("least") * (1 + 1e-9)).select(*names, *CELL))
    right = points.select("scene_id", "point_id", *[F.col(n).alias(f"b{n}") for n in XYZ], *quantize(reach))
    met = front.join(right, ["scene_id", *CELL]).withColumn("d2", _square("a", "b"))
    best = met.groupBy("scene_id", "query_id").agg(F.min(F.struct("d2", "point_id")).alias("m"))
    return best.select("scene_id", "query_id", F.col("m.point_id").alias("point_id"), F.sqrt("m.d2").alias("d"))


def flag_edge_points(skeleton: DataFrame, edges: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Skeleton points with an edge point of their label closer than tol."""
    left = skeleton.select("scene_id", "label", "ord", *XYZ, *[F.col(n).alias(f"a{n}") for n in XYZ])
    right = edges.select("scene_id", "label", *[F.col(n).alias(f"b{n}") for n in XYZ], *quantize(tol))
    near = _spread(left, ["scene_id", "label", "ord", *[f"a{n}" for n in XYZ]], tol).join(right, ["scene_id", "label", *CELL]).filter(_square("a", "b") < tol * tol)
    hit = near.select("scene_id", "label", "ord").distinct().withColumn("is_edge", F.lit(True))
    return skeleton.join(hit, ["scene_id", "label", "ord"], "left").withColumn("is_edge", F.coalesce("is_edge", F.lit(False)))


class Places:
    """Points of a task by the grid cells in which a frustum looks for them."""

    def __init__(self, place: np.ndarray, side: float) -> None:
        self.place, self.side = place, side
        cell = np.floor(place / side).astype(np.int64)
        self.low = cell.min(0) if len(cell) else np.zeros(3, np.int64)
        self.shape = cell.max(0, initial=-1 << 62) - self.low + 1 if len(cell) else np.ones(3, np.int64)
        at = np.ravel_multi_index(tuple((cell - self.low).T), tuple(self.shape))
        self.order = np.argsort(at, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=int(self.shape.prod())))])

    def candidates(self, own: np.ndarray, turn: np.ndarray, reach: float, length: float, width: float, height: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a pose and a point in its range and its frustum, as two arrays of numbers, a bounded part at a time and in the order of the poses.

        ``own``: places of the poses; ``turn``: cosine and sine of the yaw's opposite.  The test is that of :func:`in_range` and :func:`in_frustum`, operation by operation.
        """
        side, half = self.side, self.side * 0.75**0.5 + 1e-9
        flat, up = int(min(reach, (length * length + width * width / 4) ** 0.5) // side) + 1, int(height / 2 // side) + 1
        offset = np.stack(np.meshgrid(*[np.arange(-n, n + 1) for n in (flat, flat, up)], indexing="ij"), -1).reshape(-1, 3)
        step = max(1, GLANCES // len(offset))
        for at in range(0, len(own), step):
            a, (c, s) = own[at : at + step], turn[at : at + step].T[:, :, None]
            cell = np.floor(a / side).astype(np.int64)[:, None] + offset
            dx, dy, dz = np.moveaxis((cell + 0.5) * side - a[:, None], 2, 0)
            ahead, aside = c * dx - s * dy, s * dx + c * dy
            reached = np.minimum(ahead + half, length) / length
            # cells that a frustum meets: their middle is no farther from it than half a diagonal, turned by the yaw or not
            near = (ahead >= -half) & (ahead <= length + half) & (np.abs(aside) <= width / 2 * reached + half) & (dx * dx + dy * dy <= (reach + half) ** 2)
            near &= (np.abs(dz) <= height / 2 * reached + half) & ((cell >= self.low) & (cell < self.low + self.shape)).all(2)
            pose, o = np.nonzero(near)
            key = np.ravel_multi_index(tuple((cell[pose, o] - self.low).T), tuple(self.shape))
            first, count = self.start[key], self.start[key + 1] - self.start[key]
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // GLANCES)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(key)]):
                n = count[low:high]
                i = at + np.repeat(pose[low:high], n)
                j = self.order[np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                dx, dy, dz = (self.place[j] - own[i]).T
                c, s = turn[i].T
                ok = dx * dx + dy * dy + dz * dz <= reach * reach
                ahead, aside = c * dx - s * dy, s * dx + c * dy
                ok &= (ahead >= 0) & (ahead <= length) & (np.abs(aside) <= width / 2 * (ahead / length)) & (np.abs(dz) <= height / 2 * (ahead / length))
                yield i[ok], j[ok]


def placed_poses(poses: DataFrame) -> DataFrame:
    """``scene_id, seq`` and what decides what a pose sees: its place and its yaw.  Poses without them see nothing and go."""
    left = poses.select("scene_id", "seq", *[F.col(n).alias(f"a{n}") for n in XYZ], yaw_from_quaternion().alias("yaw"))
    return left.filter(reduce(Column.__and__, [F.abs(v) < float("inf") for v in VIEW]))


def views(poses: DataFrame) -> DataFrame:
    """The different places and yaws of the poses of a scene, each with its first pose."""
    return placed_poses(poses).groupBy("scene_id", *VIEW).agg(F.min("seq").alias("seq"))


def meet(seen_from: DataFrame, points: DataFrame, run: Callable[[tuple, pa.Table, Places, pa.Table, pa.Table], pa.Table], schema: str, most: int, walls: DataFrame | None = None, res: float = 1.0, reach: float = 25.0, length: float = 20.0, width: float = 20.0) -> DataFrame:
    """What ``run`` makes of the views of a grid block of side ``reach`` and of the points and occupied cells around it.

    Pairs of a view and a point are no rows and are not shuffled: only views and points are.  Both are counted first, and a block's views are dealt to so many tasks
    that none has more than some ``most`` pairs to look at, however dense they are.  ``run`` gets the block, its views in order of ``seq``, the points by cells, their table, and that of the walls.
    """
    grid = ["scene_id", *[f"b{c}" for c in CELL]]
    block = seen_from.select("*", F.cos(-F.col("yaw")).alias("c"), F.sin(-F.col("yaw")).alias("s"), *[q.alias(f"b{c}") for q, c in zip(quantize(reach, [f"a{n}" for n in XYZ]), CELL)])
    more = [c for c in points.columns if c == "first_seq"]
    none = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    held = points.select("scene_id", *[q.alias(f"o{c}") for q, c in zip(quantize(reach), CELL)], F.col("point_id").cast("long").alias("point_id"), *more, *XYZ, *none(CELL, "int"))
    own = ["scene_id", *[f"o{c}" for c in CELL]]
    beside = lambda df, old, new, sign: df.select("*", around().alias("o")).select("scene_id", *[(F.col(f"{old}{c}") + sign * F.col(f"o.{k}")).alias(f"{new}{c}") for c, k in zip(CELL, "abc")], *[c for c in df.columns if c != "scene_id"])
    there = beside(held.groupBy(*own).agg(F.count("*").alias("points")), "o", "b", 1).groupBy(*grid).agg(F.sum("points").alias("points"))
    here = block.groupBy(*grid).agg(F.count("*").alias("views"))
    parts = stored(here.join(there, grid).select(*grid, F.least("views", F.ceil(F.col("views") * F.col("points") / most)).cast("int").alias("parts")))
    left = block.hint("merge").join(parts.hint("merge"), grid).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int")).drop("parts")
    if walls is not None:
        cells = walls.select("scene_id", *[F.floor((F.col(c) + 0.5) * res / reach).cast("int").alias(f"o{c}") for c in CELL], *none(["point_id", *more], "long"), *none(XYZ, "double"), *CELL)
        held = held.unionByName(cells)
    # what lies in a block goes to the tasks of the blocks around it; the hints keep it from the driver, whatever the optimizer takes for its size
    ways = beside(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "b", "o", -1)
    right = held.hint("merge").join(ways.hint("merge"), own).drop(*own[1:])
    side = max(GLANCE, min(reach, (length * length + width * width / 4) ** 0.5) / 6)

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shown = pc.is_valid(right.column("point_id"))
        seen, wall = right.filter(shown), right.filter(pc.invert(shown))
        places = Places(np.stack([seen.column(n).to_numpy() for n in XYZ], 1), side)
        return run(key, left.sort_by("seq"), places, seen, wall)

    keys = [*grid, "part"]
    # a partition a task: by their bytes Spark would put many together
    number = min(max(parts.agg(F.sum("parts")).first()[0] or 1, 1), TASKS)
    dealt = [df.repartition(number, *keys).groupBy(*keys) for df in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(task, schema)


def numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], 1)


def listed(key: tuple, left: pa.Table, ids: pa.Array, pose: np.ndarray, point: np.ndarray) -> pa.Table:
    """Pairs in order of their poses as lists of at most ``LIST`` points a view, see ``LISTED``."""
    new = np.flatnonzero(np.diff(pose, prepend=-1))
    size = np.diff(new, append=len(pose))
    inner = np.arange(len(pose)) - np.repeat(new, size)
    start = np.flatnonzero(inner % LIST == 0)
    rows = left.take(pa.array(pose[start]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(pose)).astype(np.int32)), ids.take(pa.array(point)))
    return pa.table([rows.column(n) for n in ("scene_id", *VIEW)] + [lists], names=["scene_id", *VIEW, "points"])


def of_poses(poses: DataFrame, found: DataFrame) -> DataFrame:
    """Each pose with the rows of its view.  Neither side goes to the driver: a few bytes of a file may stand for many rows."""
    return placed_poses(poses).hint("merge").join(found.hint("merge"), ["scene_id", *VIEW])


def visible_candidates(poses: DataFrame, points: DataFrame, reach: float = 25.0, length: float = 20.0, width: float = 20.0, height: float = 15.0) -> DataFrame:
    """Pairs of a pose and a point in its range and its frustum: ``scene_id, seq, point_id``.

    Poses of the same place and yaw are looked at once.  A pose meets only the grid cells that its frustum touches.
    """

    def run(key: tuple, left: pa.Table, places: Places, seen: pa.Table, _: pa.Table) -> pa.Table:
        pairs = [*places.candidates(numbers(left, VIEW[:3]), numbers(left, "cs"), reach, length, width, height)]
        pose, point = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (zip(*pairs) if pairs else ((), ())))
        return listed(key, left, seen.column("point_id").combine_chunks(), pose, point)

    found = meet(stored(views(poses)), points, run, LISTED, PAIRS, reach=reach, length=length, width=width)
    return of_poses(poses, found).select("scene_id", "seq", F.explode("points").alias("point_id"))


def _components_by_tile(edges: DataFrame, within: Sequence[str]) -> DataFrame:
    """``node, component`` of ``src, dst, tile``: first inside each tile (null: the edge leaves it), then between the tiles' parts.

    A tile has a bounded number of cells, and so of edges.  Only edges between parts of different tiles go through rounds, so a long thin structure takes as many as its length in tiles asks for.
    """
    keys = [f"k{i}" for i in range(len(within))]
    inside = edges.filter("tile IS NOT NULL").select(*[F.col(f"src.{k}").alias(a) for k, a in zip(within, keys)], "tile.*", F.col("src.head").alias("a"), F.col("dst.head").alias("b"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        a, b = ends[: len(table)], ends[len(table) :]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            now = label.copy()
            np.minimum.at(now, label[a], least)
            np.minimum.at(now, label[b], least)
            now = now[now]
            if (now == label).all():
                break
            label = now
        return pa.table([*[pa.repeat(k, len(ids)) for k in key[: len(keys)]], pa.array(ids), pa.array(ids[label])], names=[*keys, "head", "root"])

    schema = ", ".join([*[f"{k} {inside.schema[k].dataType.simpleString()}" for k in keys], "head long", "root long"])
    node = lambda head: F.struct(*[F.col(k).alias(w) for k, w in zip(keys, within)], F.col(head).alias("head"))
    parts = stored(inside.groupBy(*keys, *CELL).applyInArrow(run, schema).select(node("head").alias("node"), node("root").alias("root")))
    at = lambda end: parts.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    leaving = edges.filter("tile IS NULL").join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    leaving = leaving.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")).distinct()
    between = components(leaving).withColumnRenamed("node", "root")
    joined = parts.join(between, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    alone = between.withColumnRenamed("root", "node").join(parts.select("node"), "node", "left_anti")
    return joined.unionByName(alone.select("node", "component"))


def radius_components(points: DataFrame, eps: float, within: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Points with ``component``: the least point_id that is linked to them by steps no longer than eps.

    Points of one cell of side eps / 2 are surely linked, so cells are the nodes: a dense cell costs one node.  Links
    are sought between the first points of cells, and joined inside tiles of cells before they go through rounds; only cells near each other that these leave in different components are compared
    point by point, each pair of cells as one row of two lists cut into parts of ``PART`` points.
    """
    side = eps / 2  # a cell's diagonal is under eps
    cell = points.select(*within, "point_id", *XYZ, *quantize(side))
    heads = cell.groupBy(*within, *CELL).agg(F.min("point_id").alias("head")).withColumn("node", F.struct(*within, "head"))  # ids repeat in other groups
    placed = checkpoint(cell.join(heads, [*within, *CELL]))
    first = placed.filter("point_id = head").select(*within, "node", *XYZ, *CELL, F.struct(*[F.floor(F.col(c) / TILE_CELLS).alias(c) for c in CELL]).alias("tile"))
    reach = [(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) > (0, 0, 0)]
    left = first.select(*within, F.col("node").alias("src"), *[F.col(n).alias(f"a{n}") for n in XYZ], *CELL, F.col("tile").alias("own"), around(reach).alias("o"))
    left = left.select(*within, "src", "own", *[f"a{n}" for n in XYZ], *[(F.col(c) + F.col(f"o.{k}")).alias(c) for c, k in zip(CELL, "abc")])
    right = first.select(*within, F.col("node").alias("dst"), *[F.col(n).alias(f"b{n}") for n in XYZ], *CELL, F.col("tile").alias("other"))
    near = checkpoint(left.join(right, [*within, *CELL]).select("src", "dst", F.when(F.col("own") == F.col("other"), F.col("own")).alias("tile"), (_square("a", "b") <= eps * eps).alias("linked")))
    label = _components_by_tile(near.filter("linked"), within)
    named = placed.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    apart = near.filter("NOT linked").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    apart = apart.select("src", "dst", F.coalesce("src_of", "src").alias("one"), F.coalesce("dst_of", "dst").alias("two")).filter("one <> two")
    number = F.floor(F.row_number().over(Window.partitionBy("node").orderBy("point_id")) / PART)
    lists = placed.select("node", number.alias("part"), F.struct(*XYZ).alias("p")).groupBy("node", "part").agg(F.collect_list("p").alias("list"))
    a, b = (lists.select(F.col("node").alias(n), F.col("list").alias(s)) for n, s in (("src", "a"), ("dst", "b")))
    close = lambda x, y: sum(((x[n] - y[n]) * (x[n] - y[n]) for n in XYZ), F.lit(0.0)) <= eps * eps
    met = apart.join(a, "src").join(b, "dst").filter(F.exists("a", lambda x: F.exists("b", lambda y: close(x, y))))
    met = stored(met.select("one", "two").distinct())
    if met.isEmpty():
        return named.select(*within, "point_id", *XYZ, F.col("component.head").alias("component"))
    joined = components(met, "one", "two").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return named.join(joined, "component", "left").select(*within, "point_id", *XYZ, F.coalesce("whole", "component")["head"].alias("component"))


def filter_lonely_points(points: DataFrame, min_size: int = 50, eps: float = 5.0) -> DataFrame:
    """Points of components of at least ``min_size``; ``eps`` is five voxels at a voxel size of one."""
    found = radius_components(points, eps)
    large = found.groupBy("scene_id", "component").count().filter(F.col("count") >= min_size).select("scene_id", "component")
    return found.join(large, ["scene_id", "component"], "left_semi")


def cluster_sizes(points: DataFrame, min_size: int = 50) -> DataFrame:
    return points.groupBy("scene_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)


def relabel_components(found: DataFrame, min_size: int = 50) -> DataFrame:
    """Parts of labels (``label, component``) with enough points, numbered by label and first point: ``new_label``."""
    parts = found.groupBy("scene_id", "label", "component").agg(F.count("*").alias("n"), F.min("point_id").alias("first")).filter(F.col("n") >= min_size)
    return parts.withColumn("new_label", F.dense_rank().over(Window.partitionBy("scene_id").orderBy("label", "first", "component")) - 1)


def split_clusters(points: DataFrame, eps: float = 3.0, min_size: int = 50) -> DataFrame:
    found = radius_components(points, eps, ("scene_id", "label"))
    return relabel_components(found, min_size)


def supervoxel_centroid(points: DataFrame, side: float = 4.0) -> DataFrame:
    """Mean of the means of a label's super-voxels, so that dense places do not weigh more."""
    inner = points.select("scene_id", "label", *XYZ, *quantize(side)).groupBy("scene_id", "label", *CELL).agg(*[F.avg(n).alias(n) for n in XYZ])
    return inner.groupBy("scene_id", "label").agg(*[F.avg(n).alias(n) for n in XYZ])


def merge_groups(edge_points: DataFrame) -> DataFrame:
    """Mean place and union of the cluster lists of each ``component``."""
    return edge_points.groupBy("scene_id", "component").agg(*[F.avg(n).alias(n) for n in XYZ], F.array_sort(F.array_distinct(F.flatten(F.collect_list("clusters")))).alias("clusters"))


def labels_to_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Per-frame labels to stable ids; points without one go."""
    return points.join(ids, ["scene_id", "frame_id", "label"])


def clusters_of_point(edge_points: DataFrame) -> DataFrame:
    return edge_points.select("scene_id", "point_id", *XYZ, F.explode("clusters").alias("label"))


def latest_at_tick(ticks: DataFrame, rows: DataFrame, values: Sequence[str] = XYZ, bucket: str = "day") -> DataFrame:
    """As-of join: each tick with the newest row at or before it, by one window over the union.

    Windows run inside buckets of time; a bucket starts with the newest row of the buckets before it, of which there is one each.
    """
    a = ticks.select("scene_id", "ts", F.lit(1).alias("tick"), F.lit(None).cast(rows.select(F.struct(*values)).schema[0].dataType).alias("v"))
    b = rows.groupBy("scene_id", "ts").agg(F.max(F.struct(*values)).alias("v")).select("scene_id", "ts", F.lit(0).alias("tick"), "v")
    both = a.unionByName(b).withColumn("bucket", F.date_trunc(bucket, "ts"))
    inside = Window.partitionBy("scene_id", "bucket").orderBy("ts", "tick").rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy("scene_id", "bucket").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("ts", "tick"))).alias("v"))
    before = Window.partitionBy("scene_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("scene_id", "bucket", F.last("v", ignorenulls=True).over(before).alias("carried"))
    out = both.withColumn("v", F.last("v", ignorenulls=True).over(inside)).filter("tick = 1").join(carried, ["scene_id", "bucket"])
    out = out.withColumn("v", F.coalesce("v", "carried")).filter("v IS NOT NULL")
    return out.select("scene_id", "ts", *[F.col(f"v.{n}").alias(n) for n in values])
