"""What poses see, by views: against plain loops, with repeated and odd poses, and without broadcasts."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.functions.scalar import voxel_center
from voxelspark.operators import neighbours, visibility

POSE = "scene_id long, seq long, x double, y double, z double, qx double, qy double, qz double, qw double"


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """Voxels, points and poses as files, which the optimizer takes for a few bytes; places and yaws come again and again."""
    rng = random.Random(11)
    cells = sorted({(rng.randrange(-20, 30), rng.randrange(-20, 20), rng.randrange(8)) for _ in range(900)})
    turns = [(0.0, 1.0), (1.0, 0.0), (1.0, -0.0), (math.sin(0.4), math.cos(0.4))]
    spots = [(rng.uniform(-15, 15), rng.uniform(-15, 15), rng.uniform(0, 8), *rng.choice(turns)) for _ in range(25)]
    poses = [(0, k, *spots[k % 25][:3], 0.0, 0.0, *spots[k % 25][3:]) for k in rng.sample(range(200), 120)]
    poses += [(0, 300, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 301, math.nan, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 302, math.inf, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    folder = str(tmp_path_factory.mktemp("scene"))
    spark.createDataFrame([(0, *c) for c in cells], "scene_id long, ix int, iy int, iz int").coalesce(1).write.parquet(f"{folder}/vox")
    spark.createDataFrame(poses, POSE).coalesce(1).write.parquet(f"{folder}/poses")
    vox = spark.read.parquet(f"{folder}/vox")
    number = F.col("ix") * 10000 + F.col("iy") * 100 + F.col("iz")
    points = vox.select("scene_id", number.cast("long").alias("point_id"), *voxel_center(1.0))
    expected = set()
    for _, seq, x, y, z, _, _, qz, qw in poses[:120]:
        yaw = math.atan2(2 * qw * qz, 1 - 2 * qz * qz)
        c, s = math.cos(-yaw), math.sin(-yaw)
        for i, j, k in cells:
            dx, dy, dz = i + 0.5 - x, j + 0.5 - y, k + 0.5 - z
            ahead, side = c * dx - s * dy, s * dx + c * dy
            if dx * dx + dy * dy + dz * dz <= 625 and 0 <= ahead <= 20 and abs(side) <= 10 * (ahead / 20) and abs(dz) <= 7.5 * (ahead / 20):
                expected.add((seq, i * 10000 + j * 100 + k))
    return vox, points, spark.read.parquet(f"{folder}/poses"), expected


def test_candidates_of_repeated_and_odd_poses(spark, scene, monkeypatch):
    _, points, poses, expected = scene
    assert neighbours.views(poses).filter("scene_id = 0").count() == 25
    for most in (neighbours.PAIRS, 500):
        monkeypatch.setattr(neighbours, "PAIRS", most)
        found = [(r.seq, r.point_id) for r in neighbours.visible_candidates(poses, points).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    rays = {r.seq: r.rays for r in visibility.ray_lengths(poses, points).collect()}
    assert rays == {s: sum(q == s for q, _ in expected) for s in {q for q, _ in expected}}


def test_nothing_that_poses_meet_is_broadcast(spark, scene):
    """The files of poses are small, and what they meet is not: joins by size sent it to the driver."""
    vox, points, poses, _ = scene
    small = visibility.first_sights(neighbours.views(poses), points, vox)
    for df in (neighbours.visible_candidates(poses, points), visibility.ray_lengths(poses, points), visibility.unoccluded(poses, points, vox), small):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_poses_and_points_are_not_shuffled(spark, scene):
    """An exchange has views, points, or lists of a view, and none has a row a pair."""
    vox, points, poses, _ = scene
    for df in (neighbours.visible_candidates(poses, points), visibility.unoccluded(poses, points, vox)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        places = [k for k, line in enumerate(plan) if "Generate explode(points" in line]
        assert places and all(k < 3 for k in places)  # above all joins


def test_known_sights_leave_earlier_views(spark, scene):
    vox, points, poses, _ = scene
    first = {r.point_id: r.first_seq for r in visibility.first_seen(visibility.unoccluded(poses, points, vox)).collect()}
    assert first and {r.point_id: r.first_seq for r in visibility.first_seen_of(poses, points, vox).collect()} == first
    middle = sorted(first.values())[len(first) // 2]
    known = points.withColumn("first_seq", F.when(F.col("point_id") % 2 == 0, F.lit(middle).cast("long")))
    found = {r.point_id: r.first_seq for r in visibility.first_sights(neighbours.views(poses), known, vox).collect()}
    assert found == {p: s for p, s in first.items() if p % 2 or s < middle}


def test_lists_are_cut(monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 3)
    left = pa.table({"scene_id": [0, 0, 0], "ax": [0.0, 1.0, 2.0], "ay": [0.0] * 3, "az": [0.0] * 3, "yaw": [0.0] * 3})
    out = neighbours.listed((), left, pa.array(range(100, 110)), np.array([0, 0, 0, 0, 2]), np.array([1, 2, 3, 4, 5])).to_pylist()
    assert [(r["ax"], r["points"]) for r in out] == [(0.0, [101, 102, 103]), (0.0, [104]), (2.0, [105])]
    assert neighbours.listed((), left, pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)).num_rows == 0
