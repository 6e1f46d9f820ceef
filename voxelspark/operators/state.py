"""Ordered folds by scene: hysteresis, stable ids, arrival at waypoints, the elbow of a BIC curve.

A scene's rows are folded in order by a task that streams over them (see :mod:`folds`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.functions.scalar import XYZ
from voxelspark.operators.accumulate import BUCKET, running
from voxelspark.operators.folds import fold


def elbows(bics: DataFrame, gain: float = 0.01) -> DataFrame:
    """``flat``: the first k whose successor gains under one per cent, null if none does; ``least``: the k of the least BIC, the first of equals."""
    last = F.lag("bic").over(Window.partitionBy("scene_id").orderBy("k"))
    steps = bics.withColumn("last", last)
    flat = F.min(F.when((F.col("last") - F.col("bic")) / F.abs("last") < gain, F.col("k") - 1))
    return steps.groupBy("scene_id").agg(flat.alias("flat"), F.min_by("k", F.struct("bic", "k")).alias("least"))


def bic_elbow(bics: DataFrame, gain: float = 0.01) -> DataFrame:
    """First k whose successor gains under one per cent; else the k of the least BIC (first of equals)."""
    return elbows(bics, gain).select("scene_id", F.coalesce("flat", "least").alias("k"))


def mixture_bic(log_likelihood: Column, n: Column, k: Column) -> Column:
    """Of a k-component full-covariance mixture in three dimensions: 6k + 3k + (k - 1) numbers are fitted."""
    return (10 * k - 1) * F.log(n.cast("double")) - 2 * log_likelihood


#: Fixed values of the hysteresis: share of epochs needed to go up and down, least and most frames.
UP, DOWN, LEAST, MOST = 0.10, 0.5, 2, 5


@dataclass
class Hysteresis:
    """The state of one scene's number of clusters: the present one, the one last seen, for how long, and how often in a row another was."""

    k: int
    seen: int
    epochs: int = 0
    count: int = 0

    @classmethod
    def of(cls, first: int) -> Hysteresis:
        return cls(first, first)

    def detect(self, d: int) -> None:
        self.count = self.count + 1 if self.seen == d else 1
        self.seen = d
        need = min(MOST, max(LEAST, int((UP if d > self.k else DOWN) * self.epochs)))
        if self.k == d:
            self.epochs, self.count = self.epochs + 1, 0
        elif self.count >= need:
            self.k, self.epochs, self.count = d, 1, 0


def stable_k(detections: DataFrame) -> DataFrame:
    """The stable number of clusters at each frame: ``scene_id, frame_id, detected_k, stable_k, skipped``.

    A new number must be seen in several frames in a row: more of them the longer the present one has held, and more
    to go down than up.
    """

    def step(s: Hysteresis, row) -> list[tuple]:
        s.detect(row.detected_k)
        return [(row.scene_id, row.frame_id, row.detected_k, s.k, s.k != row.detected_k)]

    rows = detections.select("scene_id", "frame_id", "detected_k")
    return fold(rows, ["scene_id"], ["frame_id", "detected_k"], "scene_id long, frame_id long, detected_k long, stable_k long, skipped boolean", lambda row: Hysteresis.of(row.detected_k), step)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the cheapest matching of rows and columns (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            free = ~used[1:]
            reduced = c[row - 1] - u[row] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j
            after = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            gap = low[after]
            u[match[used]] += gap
            v[used] -= gap
            low[1:][free] -= gap
            j = after
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


class Tracks:
    """Centroids with lasting ids; the state of one scene."""

    def __init__(self, gate: float, most_missed: int = 15, rows: dict | None = None, next_id: int = 0) -> None:
        self.gate, self.most_missed, self.rows, self.next_id = gate, most_missed, rows or {}, next_id

    def step(self, places: np.ndarray) -> list[int]:
        """Ids of a frame's centroids, in their order."""
        known = list(self.rows)
        ids = [-1] * len(places)
        if len(places) and known:
            old = np.array([self.rows[t][0] for t in known])
            cost = np.sqrt(((places[:, None] - old[None]) ** 2).sum(2))
            for i, j in assign(cost):
                if cost[i, j] <= self.gate:  # a pair out of the gate is not matched again
                    ids[i] = known[j]
        hit = set(ids)
        for t in known:
            place, age, missed = self.rows[t]
            self.rows[t] = (place, age, missed + 1) if t not in hit else (place, age + 1, 0)
        for i, place in enumerate(places):
            if ids[i] < 0:
                ids[i] = self.next_id
                self.next_id += 1
                self.rows[ids[i]] = (place.tolist(), 1, 0)
            else:
                self.rows[ids[i]] = (place.tolist(), *self.rows[ids[i]][1:])
        if len(places):
            self.rows = {t: r for t, r in self.rows.items() if r[2] <= self.most_missed}
        return ids


def track_ids(centroids: DataFrame, res: float = 1.0, frames: DataFrame | None = None) -> DataFrame:
    """Lasting ids of the centroids of each frame: ``scene_id, frame_id, label, track_id``.

    ``frames`` may list frames without centroids, which only age the tracks.
    """
    kept = centroids.select("scene_id", "frame_id", F.col("label").cast("long").alias("label"), *XYZ)
    if frames is not None:
        empty = frames.select("scene_id", "frame_id").join(kept, ["scene_id", "frame_id"], "left_anti").distinct()
        kept = kept.unionByName(empty.select("scene_id", "frame_id", F.lit(None).cast("long").alias("label"), *[F.lit(None).cast("double").alias(n) for n in XYZ]))

    def work(s: dict) -> list[tuple]:
        """Ids of the frame that is complete."""
        ids = s["tracks"].step(np.array([p for _, p in s["rows"]], float).reshape(len(s["rows"]), 3))
        out = [(s["scene"], s["frame"], label, i) for (label, _), i in zip(s["rows"], ids)]
        s["rows"] = []
        return out

    def step(s: dict, row) -> list[tuple]:
        out = work(s) if row.frame_id != s["frame"] else []
        s["frame"] = row.frame_id
        if row.label == row.label and row.label is not None:
            s["rows"].append((int(row.label), (row.x, row.y, row.z)))
        return out

    start = lambda row: {"scene": row.scene_id, "frame": row.frame_id, "rows": [], "tracks": Tracks(5 * res)}
    return fold(kept, ["scene_id"], ["frame_id", "label", *XYZ], "scene_id long, frame_id long, label long, track_id long", start, step, work)


@dataclass
class Arrival:
    """The state of one scene's way: arrivals so far, and the last distance within reach of the present target."""

    targets: Sequence[tuple[float, float, float]]
    reach: float
    arrivals: int = 0
    last: float = float("inf")

    def move(self, x: float, y: float, z: float) -> bool:
        """Whether this step is an arrival."""
        a, b, c = self.targets[self.arrivals % len(self.targets)]
        d = ((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)) ** 0.5
        if d > self.last:
            self.arrivals, self.last = self.arrivals + 1, float("inf")
            return True
        if d < self.reach:
            self.last = d
        return False


def waypoint_arrival(rows: DataFrame, targets: Sequence[tuple[float, float, float]], reach: float = 2.0) -> DataFrame:
    """Arrivals at targets in turn, round and round: ``scene_id, arrivals``.

    Once within reach, the first step away counts, and the next target is the one to reach; so does any step away from
    a place within reach.
    """

    def step(s: dict, row) -> list[tuple]:
        s["way"].move(row.x, row.y, row.z)
        return []

    start = lambda row: {"scene_id": row.scene_id, "way": Arrival(targets, reach)}
    return fold(rows.select("scene_id", "ts", *XYZ), ["scene_id"], ["ts", *XYZ], "scene_id long, arrivals long", start, step, lambda s: [(s["scene_id"], s["way"].arrivals)])


def stride_sample(poses: DataFrame, n: int) -> DataFrame:
    return poses.filter(F.pmod("seq", F.lit(n)) == 0) if n > 1 else poses


def elapsed(poses: DataFrame, speed: float = 1.0) -> DataFrame:
    first = poses.groupBy("scene_id").agg(F.min_by("time", "seq").alias("_start"))
    return poses.join(first, "scene_id").withColumn("elapsed", (F.col("time") - F.col("_start")) / speed).drop("_start")


def path_so_far(poses: DataFrame) -> DataFrame:
    """Length of the path up to each pose: a prefix is its number of poses, not a copy of them."""
    return running(poses.select("scene_id", "seq"), "seq", F.count("*"), "n_poses", lambda before, inside: F.coalesce(before, F.lit(0)) + inside)


def path_prefix(poses: DataFrame, asked: DataFrame) -> DataFrame:
    """The path up to some poses, as its poses: a row of ``poses`` with ``upto`` for each asked ``scene_id, seq`` at or after it.

    Asked poses are few and known by number, so each pose is repeated only for those: a path of n poses asked for at every pose has n * n / 2 rows, which is what it
    holds, and :func:`path_so_far` gives its lengths instead.  A seq that no pose has gets the poses before it.  Joined by buckets of the order, whole buckets before the asked one first.
    """
    ends = asked.select("scene_id", F.col("seq").alias("upto")).distinct()
    stop = F.explode(F.sequence(F.lit(0), F.floor(F.col("upto") / BUCKET))).alias("_bucket")
    spread = ends.filter("upto >= 0").select("scene_id", "upto", stop)
    cut = poses.withColumn("_bucket", F.floor(F.col("seq") / BUCKET))
    return cut.join(spread, ["scene_id", "_bucket"]).filter(F.col("seq") <= F.col("upto")).select("scene_id", "upto", *[c for c in poses.columns if c != "scene_id"])


#: The place that a ring starts nearest to, and the place between it and the ring.
LEAD_IN = ((0.0, 0.0, 100.0), (120.0, 0.0, 130.0))


def ring_waypoints(structures: DataFrame, n: int = 12, lead_in: Sequence[tuple[float, float, float]] = ()) -> DataFrame:
    """n points on a circle (``cx, cy, radius, height``), the nearest to (0, 0, 100) first; ``lead_in`` places come before them."""
    angle = 2 * np.pi * F.col("i") / n
    raw = structures.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("scene_id", "i", (F.col("cx") + F.col("radius") * F.cos(angle)).alias("x"), (F.col("cy") + F.col("radius") * F.sin(angle)).alias("y"), F.col("height").alias("z"))
    d2 = F.round(F.col("x") * F.col("x") + F.col("y") * F.col("y") + (F.col("z") - LEAD_IN[0][2]) * (F.col("z") - LEAD_IN[0][2]), 6)
    first = raw.groupBy("scene_id").agg(F.min(F.struct(d2.alias("d2"), "i"))["i"].alias("first"))
    ring = raw.join(first, "scene_id").select("scene_id", (F.pmod(F.col("i") - F.col("first"), F.lit(n)) + len(lead_in)).cast("long").alias("ord"), *XYZ)
    if not lead_in:
        return ring
    ways = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), *[F.lit(float(v)).alias(c) for v, c in zip(p, XYZ)]) for k, p in enumerate(lead_in)])).alias("p")
    return structures.select("scene_id", ways).select("scene_id", "p.*").unionByName(ring)


def next_waypoints(ring: DataFrame, at: int, m: int = 6, center: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The m waypoints from ``at`` on, in a circle, with the yaw to the centre."""
    size = ring.groupBy("scene_id").agg(F.count("*").alias("n"))
    steps = size.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("step"), "n").select("scene_id", "step", F.pmod(F.col("step") + at, F.col("n")).alias("ord"))
    yaw = F.atan2(F.lit(center[1]) - F.col("y"), F.lit(center[0]) - F.col("x"))
    return steps.join(ring, ["scene_id", "ord"]).select("scene_id", F.col("step").cast("long").alias("step"), "ord", *XYZ, yaw.alias("yaw"))

