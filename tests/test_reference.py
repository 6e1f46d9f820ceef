"""The voxel operators against brute force on small scenes, and hand-worked traces."""

import itertools
import struct

import numpy as np
import pytest

from voxelspark.operators import mesh, morphology, neighbours, skeleton, state, visibility
from voxelspark.sources import clouds, poses
from voxelspark.streaming import maps


def cells(spark, rows):
    return spark.createDataFrame([(0, *map(int, r)) for r in rows], "scene_id long, ix int, iy int, iz int")


def got(df):
    return {(r.ix, r.iy, r.iz) for r in df.collect()}


def random_set(n, size, seed):
    rng = np.random.default_rng(seed)
    return {tuple(r) for r in rng.integers(-size, size, (n, 3)).tolist()}


def brute_dilate(s, r):
    span = range(-r, r + 1)
    return {(x + a, y + b, z + c) for x, y, z in s for a in span for b in span for c in span}


def brute_erode(s, r):
    span = range(-r, r + 1)
    return {p for p in s if all((p[0] + a, p[1] + b, p[2] + c) in s for a in span for b in span for c in span)}


def test_closing_is_extensive_and_equals_brute_force(spark):
    s = random_set(120, 5, 1)
    added = got(morphology.close(cells(spark, s), 1))
    assert added == brute_erode(brute_dilate(s, 1), 1) - s


def test_empty_set_stays_empty(spark):
    assert got(morphology.close(cells(spark, []), 2)) == set()


def test_outer_shell_leaves_out_cavities(spark):
    box = {p for p in itertools.product(range(5), repeat=3)} - {(2, 2, 2)}
    shell = got(morphology.outer_shell(cells(spark, box)))
    assert shell == {p for p in box if set(p) & {0, 4}}
    assert len(morphology.exterior_air(cells(spark, box)).collect()) == 7**3 - 5**3


def test_components_and_edges_of_a_chain(spark):
    rows = [(0, i, float(3 * i), 0.0, 0.0) for i in range(6)] + [(0, 9, 100.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    found = {r.point_id: r.component for r in neighbours.radius_components(points, 3.0).collect()}
    assert found == {**dict.fromkeys(range(6), 0), 9: 9}
    assert len(neighbours.radius_neighbors(points, 3.0).collect()) == 10


def test_rays_follow_a_slow_walk():
    rng = np.random.default_rng(3)
    start, end = rng.uniform(-5, 5, (40, 3)), rng.uniform(-5, 5, (40, 3))
    ray, cell = visibility._walk(start, end, 1.0)
    for i in range(40):
        first = np.floor(start[i]).astype(int)
        mine = sorted((tuple(c) for c in cell[ray == i]), key=lambda c: np.abs(np.array(c) - first).sum())  # cells come in no order
        goal = tuple(np.floor(end[i]).astype(int))
        assert goal not in mine
        if mine:
            assert mine[0] == tuple(np.floor(start[i]).astype(int))
            assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(mine, [*mine[1:], goal]))


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        cost = rng.uniform(0, 10, (n, m))
        pairs = state.assign(cost)
        assert len(pairs) == min(n, m)
        big, small = (range(m), range(n)) if n <= m else (range(n), range(m))
        best = min(sum(cost[(i, j) if n <= m else (j, i)] for i, j in zip(small, p)) for p in itertools.permutations(big, len(small)))
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_tracks_gate_and_age_out():
    t = state.Tracks(gate=5.0, most_missed=1)
    assert t.step(np.array([[0.0, 0, 0], [20.0, 0, 0]])) == [0, 1]
    assert t.step(np.array([[1.0, 0, 0]])) == [0]
    assert t.step(np.zeros((0, 3))) == [] and set(t.rows) == {0, 1}  # an empty frame only ages
    assert t.step(np.array([[1.0, 0, 0]])) == [0] and set(t.rows) == {0}
    assert t.step(np.array([[50.0, 0, 0]])) == [2]


def test_stable_k_needs_several_frames(spark):
    seen = [3, 4, 4, 4, 3, 4, 3, 3]
    df = spark.createDataFrame([(0, i, k) for i, k in enumerate(seen)], "scene_id long, frame_id long, detected_k long")
    out = [r.stable_k for r in state.stable_k(df).orderBy("frame_id").collect()]
    assert out == [3, 3, 4, 4, 4, 4, 4, 3]


def test_thinning_keeps_ends():
    line = np.array([[float(i), 0, 0] for i in range(20)])
    out = skeleton.thin(line, 1.0)
    assert out[0].tolist() == [0, 0, 0] and out[-1].tolist() == [19, 0, 0] and len(out) < 20


def test_picks_are_spread(spark):
    star = [[10.0, 0.0, 0.0], [-10.0, 0.0, 0.0], [9.5, 0.5, 0.0], [0.0, 8.0, 0.0], [0.0, 0.0, 0.0], [8.9, 4.4, 0.0], [0.0, 1.0, 0.0]]
    points = spark.createDataFrame([(0, 2, i, *p) for i, p in enumerate(star)] + [(0, 3, 9, 1.0, 1.0, 1.0)], "scene_id long, label int, point_id long, x double, y double, z double")
    middle = spark.createDataFrame([(0, 2, 0.0, 0.0, 0.0), (0, 3, 1.0, 1.0, 1.0)], "scene_id long, label int, x double, y double, z double")
    picked = lambda **more: [r.point_id for r in skeleton.edge_points(points, middle, **more).orderBy("ord").collect()]
    assert picked() == [0, 1, 5, 3]  # 2 is near 0; 5 is as far as 0 and apart from it
    assert picked(most=1) == [0] and picked(most=2) == [0, 1] and picked(most=3) == [0, 1, 5, 3]  # one like a picked one does not end it
    assert skeleton.edge_points(points.filter("label = 3"), middle).count() == 0


def test_paths_by_task_and_by_rounds_agree(spark):
    rows = [(0, 1, i, float(i), 0.0, 0.0) for i in range(12)]
    points = spark.createDataFrame(rows, "scene_id long, label int, point_id long, x double, y double, z double")
    ends = points.filter("point_id IN (0, 11)")
    small, large = (sorted(r.x for r in skeleton.densify(points, ends, task_edges=n).collect()) for n in (10**6, 0))
    assert small == large and small[0] == 0.0 and small[-1] == 11.0


def test_paths_on_a_grid_break_ties_alike_and_make_the_least_tree(spark):
    rows = [(0, 1, 10 * i + j, float(i), float(j), 0.0) for i in range(6) for j in range(6)]
    points = spark.createDataFrame(rows, "scene_id long, label int, point_id long, x double, y double, z double")
    ends = points.filter("point_id IN (0, 5, 50, 55, 23)")
    small, large = (skeleton.geodesic_paths(points, ends, task_edges=n) for n in (10**6, 0))
    key = lambda df: sorted((r.src, r.dst, r.hop, r.node) for r in df.collect())
    assert key(small) == key(large)
    place = {r[2]: np.array(r[3:]) for r in rows}
    targets, near = [0, 5, 50, 55, 23], 3.5
    dist = {a: {b: (0.0 if a == b else float(np.linalg.norm(place[a] - place[b])) if np.linalg.norm(place[a] - place[b]) <= near else np.inf) for b in place} for a in place}
    for k in place:
        for a in place:
            for b in place:
                dist[a][b] = min(dist[a][b], dist[a][k] + dist[k][b])
    best = min(sum(dist[a][b] for a, b in tree) for tree in itertools.combinations(itertools.combinations(targets, 2), 4) if connected(targets, tree))
    assert sum(r.dist for r in skeleton.geodesic_tree(small, points).collect()) == pytest.approx(best)


def connected(nodes, edges):
    seen, todo = set(), [nodes[0]]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n] + [a for a, b in edges if b == n]
    return seen == set(nodes)


def test_nearest_point_has_no_reach(spark):
    rng = np.random.default_rng(7)
    spots = [(0, i, *map(float, p)) for i, p in enumerate(np.vstack([rng.integers(-5, 5, (30, 3)), [[900, 0, 0]]]))]
    asked = [(0, i, *map(float, p)) for i, p in enumerate(np.vstack([rng.integers(-9, 9, (20, 3)), [[500, 500, 1]]]))] + [(3, 0, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "scene_id long, point_id long, x double, y double, z double")
    queries = spark.createDataFrame(asked, "scene_id long, query_id long, x double, y double, z double")
    found = {r.query_id: r.point_id for r in neighbours.nearest_point(queries, points, 1.0).collect()}
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[2:], b[2:]))
    assert found == {q[1]: min(spots, key=lambda p: (d2(q, p), p[1]))[1] for q in asked if q[0] == 0}


def test_components_of_dense_cells_and_of_scenes_with_the_same_ids(spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, *map(float, p)) for s in range(2) for i, p in enumerate(rng.uniform(0, 6, (70, 3)))]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    for eps in (0.7, 1.1):
        want = {}
        for s in range(2):
            own = [r for r in rows if r[0] == s]
            near = [(a[1], b[1]) for a in own for b in own if sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) <= eps * eps]
            name = {r[1]: r[1] for r in own}
            for _ in own:
                for a, b in near:
                    name[a] = name[b] = min(name[a], name[b])
            want |= {(s, i): c for i, c in name.items()}
        assert {(r.scene_id, r.point_id): r.component for r in neighbours.radius_components(points, eps).collect()} == want


def test_unoccluded_equals_a_slow_walk(spark):
    rng = np.random.default_rng(13)
    walls = {tuple(r) for r in rng.integers(-8, 8, (60, 3)).tolist()}
    spots = [(0, i, x + 0.5, y + 0.5, z + 0.5) for i, (x, y, z) in enumerate(sorted(walls))]
    flight = [(0, i, *map(float, rng.uniform(-12, 12, 3)), 0.0, 0.0, 0.0, 1.0) for i in range(40)]
    poses = spark.createDataFrame(flight, "scene_id long, seq long, x double, y double, z double, qx double, qy double, qz double, qw double")
    points = spark.createDataFrame(spots, "scene_id long, point_id long, x double, y double, z double")
    pairs = neighbours.visible_candidates(poses, points).collect()
    free = {(r.seq, r.point_id) for r in visibility.unoccluded(poses, points, cells(spark, walls)).collect()}
    want = set()
    for r in pairs:
        a, b = np.array(flight[r.seq][2:5]), np.array(spots[r.point_id][2:])
        goal = tuple(np.floor(b).astype(int))
        way = {tuple(np.floor(a + t * (b - a)).astype(int)) for t in np.linspace(0, 1, 4001)}
        if not (way - {goal}) & walls:
            want.add((r.seq, r.point_id))
    assert pairs and len(free ^ want) <= 0.02 * len(pairs)  # the slow walk may step over a corner


def test_mixtures_find_separate_parts(spark):
    from voxelspark.operators import mixtures

    rng = np.random.default_rng(17)
    rows = []
    for scene, centers in enumerate(([(0, 0, 0), (40, 0, 0)], [(0, 0, 0), (0, 50, 0), (60, 0, 0)])):
        for c in centers:
            rows += [(scene, len(rows) + i, *map(float, p)) for i, p in enumerate(rng.normal(c, 1.5, (150, 3)))]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    fits = mixtures.fit_mixtures(points, most=5)
    bics, chosen = mixtures.number_of_parts(fits)
    least = {}
    for r in bics.collect():
        least[r.scene_id] = min(least.get(r.scene_id, (np.inf, 0)), (r.bic, r.k))
    assert {s: k for s, (_, k) in least.items()} == {0: 2, 1: 3} and {r.scene_id: r.k for r in chosen.collect()} == {0: 2, 1: 3}
    labels = {}
    for r in mixtures.label_points(points, fits, chosen).collect():
        labels.setdefault((r.scene_id, (r.point_id % 1000) // 150 if r.scene_id == 0 else (r.point_id - 300) // 150), set()).add(r.label)
    assert all(len(v) == 1 for v in labels.values())


def test_skeletons_of_frames_have_lasting_ids(spark):
    from voxelspark.operators.skeletonize import skeletonize

    along = [(x, y, z) for x in range(-30, 31) for y in range(3) for z in range(3)]
    across = [(x, y, z) for x in range(100, 103) for y in range(-30, 31) for z in range(3)]
    lonely = [(300, 300, k) for k in range(20)]
    clouds_ = [lonely, across, along + across, along + across, along + across + lonely, across[:200]]
    # frame 0 has lonely points alone; 3 is as large as 2; 5 detects one cluster where two have been stable
    rows = [(7, f - 2, i, *map(float, p)) for f, cloud in enumerate(clouds_) for i, p in enumerate(cloud)]
    out = skeletonize(spark.createDataFrame(rows, "scene_id long, frame_id long, point_id long, x double, y double, z double"), most=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.frame_id + 2, []).append(r)
    shows = {f: {r.result_frame + 2 for r in rs} for f, rs in by.items()}
    assert 0 not in by and shows[1] == {1} and shows[3] == shows[2] and all(len(s) == 1 for s in shows.values())
    ids = lambda f, good: {r.track_id for r in by[f] if good(r)}
    assert len({i for f in by for i in ids(f, lambda r: r.x >= 100)}) == 1  # the arm across keeps its id over all frames
    assert all(r.x < 200 for rs in by.values() for r in rs)
    last = max(by)
    key = lambda r: (r.label, r.x, r.y, r.z)
    assert sorted(map(key, by[3])) == sorted(map(key, by[2])) and shows[last] <= {0, 1, 2, 3, 4, 5}
    for f in (4,):
        if shows[f] == {4}:
            assert min(r.x for r in by[f]) <= -24 and max(r.y for r in by[f]) >= 24 and ids(f, lambda r: r.x < 100).isdisjoint(ids(f, lambda r: r.x >= 100))
    assert all(0 <= c <= 255 for r in out for c in (r.r, r.g, r.b))


def test_samples_lie_in_their_triangles(spark):
    t = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0), (0, 2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)], "mesh_id long, face_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    rows = mesh.sample_triangles(mesh.allocate_samples(t, 500)).collect()
    assert len(rows) == 500 and all(r.face_id == 1 and r.x >= 0 and r.y >= 0 and r.x + r.y <= 4 + 1e-9 and r.z == 0 for r in rows)
    assert got(mesh.voxelize_triangles(t.filter("face_id = 1"))) >= {(0, 0, 0), (3, 0, 0), (0, 3, 0)}


def test_files(spark, tmp_path):
    (tmp_path / "a.pcd").write_bytes(b"# c\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 nan\n")
    (tmp_path / "b.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 1\nDATA binary\n" + struct.pack("<3f", 7, 8, 9))
    assert sorted(r.x for r in clouds.read_cloud_pcd(spark, str(tmp_path)).collect()) == [1.0, 4.0, 7.0]
    (tmp_path / "m.stl").write_bytes(b" " * 80 + struct.pack("<I", 1) + struct.pack("<12fH", *range(12), 0))
    assert clouds.read_mesh_stl(spark, str(tmp_path)).first().z2 == 11.0
    (tmp_path / "p.csv").write_text("time,x,y,z,qx,qy,qz,qw\n1,2,3,4,5,6,7,8\nbad\n2,2,3,4,5,6,7,8,9\n")
    assert [r.time for r in poses.read_poses_csv(spark, str(tmp_path / "p.csv"), 1).orderBy("line").collect()] == [1.0, 2.0]
    assert [r.time for r in poses.read_poses_csv(spark, str(tmp_path / "p.csv"), 2).collect()] == [1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    from voxelspark.operators.accumulate import accumulate

    schema = "scene_id long, frame_id long, block_pos int, center_pos long, x double, y double, z double"
    rng = np.random.default_rng(2)
    rows = [(0, int(f), 0, int(c), *map(float, rng.integers(0, 16, 3) / 4)) for f in range(6) for c in range(10)]
    for i in range(3):  # the first file holds the last frames
        spark.createDataFrame([r for r in rows if r[1] % 3 == 2 - i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = maps.stream_accumulate(stream, str(tmp_path / "map"), str(tmp_path / "check"))
    query.awaitTermination(120)
    key = lambda r: (r.ix, r.iy, r.iz, r.frame_id)
    assert sorted(map(key, maps.current_map(spark, str(tmp_path / "map")).collect())) == sorted(map(key, accumulate(spark.createDataFrame(rows, schema)).collect()))
