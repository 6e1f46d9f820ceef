"""Tiles with halos against plain sets, and the streams and rays that rest on them."""

import itertools

import numpy as np
import pytest

from voxelspark.operators import morphology as V
from voxelspark.operators import tiles, visibility
from voxelspark.streaming import maps

BOX = list(itertools.product((-1, 0, 1), repeat=3))


def cells(df):
    return {(r.scene_id, r.ix, r.iy, r.iz) for r in df.collect()}


def frame(spark, found):
    return spark.createDataFrame([tuple(map(int, v)) for v in sorted(found)], "scene_id long, ix int, iy int, iz int").repartition(3)


def move(v, o):
    return (v[0], v[1] + o[0], v[2] + o[1], v[3] + o[2])


def grow(s):
    return {move(v, o) for v in s for o in BOX}


def shrink(s):
    return {v for v in s if all(move(v, o) in s for o in BOX)}


def faces(s):
    empty = {move(v, o) for v in s for o in V.FACES} - s
    return s | {v for v in empty if sum(move(v, o) in s for o in V.FACES) >= 2}


def double(s):
    return {(v[0], *(2 * c + d for c, d in zip(v[1:], o))) for v in s for o in itertools.product((0, 1), repeat=3)}


@pytest.fixture(scope="module")
def clumps():
    """Two scenes of solid and loose clumps on both sides of tile borders and of zero."""
    rng = np.random.default_rng(4)
    out = set()
    for scene, middle in ((0, (-1, 31, 0)), (0, (64, -33, 95)), (5, (0, 0, 0)), (5, (-32, 32, -64))):
        spread = rng.normal(0, 1.6, (400, 3)).round().astype(int)
        out |= {(scene, *(int(a + b) for a, b in zip(middle, p))) for p in spread}
    return out


def test_operators_equal_plain_sets(spark, clumps):
    vox = frame(spark, clumps)
    twice = grow(grow(clumps))
    assert cells(V.dilate(vox, 2)) == twice and cells(V.erode(vox, 1)) == shrink(clumps) != set()
    assert cells(V.close(vox, 2)) == shrink(shrink(twice)) - clumps
    around = [o for o in BOX if o != (0, 0, 0)]
    for threshold in (0, 9, 26):
        assert cells(V.erode_26(vox, threshold)) == {v for v in clumps if sum(move(v, o) in clumps for o in around) >= threshold}
    assert cells(V.dilate_6_selective(vox)) == faces(clumps) and cells(V.shell_26(vox)) == clumps - shrink(clumps)
    none = vox.filter("ix > 1000")
    assert all(f(none).count() == 0 for f in (V.dilate, V.erode, V.shell_26, lambda v: V.close(v, 3)))


@pytest.mark.parametrize("cycles", [0, 1, 2, 3])
def test_refinement_equals_its_steps_on_sets(spark, clumps, cycles):
    some = {v for v in clumps if v[0] == 5}
    points = frame(spark, some).selectExpr("scene_id", "ix + 0.5D AS x", "iy + 0.5D AS y", "iz + 0.5D AS z")
    for n in range(1, cycles + 1):
        some = double(some)
        some = faces(some) if n <= 1 else grow(shrink(some))
        if n == cycles:
            some = faces(shrink(some))
    res = 1 / 2**cycles
    out = {(r.scene_id, *(int(np.floor(c / res)) for c in (r.x, r.y, r.z))) for r in V.refine_shell(points, 1.0, cycles).collect()}
    assert out == some - shrink(some)


def test_any_side_gives_the_same(spark, clumps):
    vox = frame(spark, clumps)
    kernel = lambda b: tiles.eroded(tiles.dilated(b, 2), 2)
    assert len({frozenset(cells(tiles.on_tiles(vox, kernel, 4, side))) for side in (3, 16, 50)}) == 1


def feed(spark, batches, schema, folder):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_closing_changes_only_tiles_nearby(spark, clumps, tmp_path):
    rng = np.random.default_rng(9)
    many = clumps | {(5, *(int(c) for c in p)) for p in rng.integers(-150, 150, (600, 3))}
    points = [(v[0], v[1] + 0.5, v[2] + 0.25, v[3] + 0.75) for v in sorted(many)]
    rng.shuffle(points)
    rows = [(int(s), float(x), float(y), float(z)) for s, x, y, z in points]
    near = [(5, 60.5, -90.5, 20.5), (5, 62.5, -90.5, 20.5), (5, 64.5, -90.5, 20.5)]
    batches = [rows[:500], rows[500:] + rows[:50], near]
    stream = feed(spark, batches, "scene_id long, x double, y double, z double", str(tmp_path / "in"))
    query = maps.stream_closing(stream, str(tmp_path / "tiles"), str(tmp_path / "progress"))
    query.awaitTermination()
    whole = {(s, *(int(np.floor(c)) for c in p)) for s, *p in rows + near}
    assert cells(maps.current_closing(spark, str(tmp_path / "tiles"))) == shrink(shrink(grow(grow(whole)))) - whole
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert state[-1]["numRowsTotal"] > 300 and 0 < state[-1]["numRowsUpdated"] <= 8


def scene(rng):
    """A wall with a window before a back wall, and poses that look at it."""
    vox = {(0, 10, y, z) for y in range(-12, 13) for z in range(-8, 9) if not (abs(y) < 4 and abs(z) < 3)} | {(0, 16, y, z) for y in range(-12, 13) for z in range(-8, 9)}
    poses = [(0, k, float(k), float(rng.uniform(-6, 4)), float(rng.uniform(-5, 5)), float(rng.uniform(-3, 3)), 0.0, 0.0, float(np.sin(a / 2)), float(np.cos(a / 2))) for k, a in enumerate(rng.uniform(-0.6, 0.6, 40))]
    return vox, poses


POSE = "scene_id long, seq long, time double, x double, y double, z double, qx double, qy double, qz double, qw double"


@pytest.fixture
def flight(spark):
    vox, poses = scene(np.random.default_rng(3))
    points = [(s, i, x + 0.5, y + 0.5, z + 0.5) for i, (s, x, y, z) in enumerate(sorted(vox))]
    return frame(spark, vox), spark.createDataFrame(points, "scene_id long, point_id long, x double, y double, z double"), poses


def test_chunks_of_poses_give_the_first_sight(spark, flight, monkeypatch):
    vox, points, poses = flight
    df = spark.createDataFrame(poses, POSE)
    pairs = {(r.seq, r.point_id) for r in visibility.unoccluded(df, points, vox).collect()}
    first = {p: min(s for s, q in pairs if q == p) for _, p in pairs}
    assert 0 < len(first) < points.count()
    for step in (1, 7, 100):
        assert {r.point_id: r.first_seq for r in visibility.first_seen_of(df, points, vox, step).collect()} == first
    assert visibility.first_seen_of(df.filter("seq < 0"), points, vox).count() == 0
    monkeypatch.setattr(visibility, "PAIRS", 1 << 10)  # so that a block's pairs are dealt to many tasks
    assert {(r.seq, r.point_id) for r in visibility.unoccluded(df, points, vox).collect()} == pairs


def test_stream_coverage_looks_at_what_is_left(spark, flight, tmp_path):
    vox, points, poses = flight
    df = spark.createDataFrame(poses, POSE)
    expected = {r.point_id: r.first_seq for r in visibility.first_seen(visibility.unoccluded(df, points, vox)).collect()}
    order = poses[20:30] + poses[5:20] + poses[30:] + poses[:5]  # some come late
    batches = [order[:10], order[10:25], order[25:35], order[35:]]
    stream = feed(spark, batches, POSE, str(tmp_path / "in"))
    maps.stream_coverage(stream, points, vox, str(tmp_path / "seen"), str(tmp_path / "progress")).awaitTermination()
    assert {r.point_id: r.first_seq for r in maps.current_first_seen(spark, str(tmp_path / "seen")).collect()} == expected
    seen = maps.current_first_seen(spark, str(tmp_path / "seen"))
    later = spark.createDataFrame([(0, 100 + k, *p[2:]) for k, p in enumerate(poses)], POSE)
    left = visibility.still_open(points, later, seen)
    assert left.count() == points.count() - len(expected) and left.columns == points.columns
    assert visibility.still_open(points, df.filter("seq = 0"), seen).count() > left.count()


def test_bricks_equal_a_set_and_stay_small():
    rng = np.random.default_rng(5)
    low = np.array([-400, 100, -30])
    found = np.unique(rng.integers(0, 753, (5000, 3)), axis=0) + low
    bricks = visibility.Bricks(found, low, 753)
    asked = np.concatenate([found[::7], rng.integers(0, 753, (5000, 3)) + low])
    known = set(map(tuple, found))
    assert bricks.occupied(asked).tolist() == [tuple(c) in known for c in asked]
    assert bricks.index.nbytes + bricks.cells.nbytes < 4_000_000 + 600 * len(found)
    assert not visibility.Bricks(np.zeros((0, 3), np.int64), low, 753).occupied(asked).any()
