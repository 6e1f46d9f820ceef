"""End points, merges and paths of skeletons against plain walks over random clouds."""

import math

import numpy as np
import pytest

from voxelspark.operators import neighbours as J
from voxelspark.operators import skeleton as C
from voxelspark.operators import state as T

POINT = "scene_id long, label int, point_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def cloud():
    """Two scenes of three labels: a rod, a cross and a ball; whole numbers, so distances tie."""
    rng = np.random.default_rng(8)
    out = []
    for scene in (0, 3):
        rod = [(x, int(rng.integers(0, 2)), 0) for x in range(60)]
        cross = [(30 + x, 40, z) for x in range(-25, 26) for z in (0, 1)] + [(30, 40 + y, 0) for y in range(-25, 26)]
        ball = [tuple(map(int, p)) for p in np.unique(rng.normal((80, 0, 0), 4, (150, 3)).round(), axis=0)]
        for label, places in enumerate((rod, cross, ball)):
            out += [(scene, label, 1000 * label + i, *map(float, p)) for i, p in enumerate(sorted(set(places)))]
    return out


def groups(rows, n=2):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[:n]), []).append(r)
    return out


def centroid(rows, side=4.0):
    cells = {}
    for *_, x, y, z in rows:
        cells.setdefault(tuple(math.floor(c / side) for c in (x, y, z)), []).append((x, y, z))
    return np.mean([np.mean(v, axis=0) for v in cells.values()], axis=0)


def farthest_first(rows, middle, res=1.0, most=10):
    """The pick of end points by its rules, one candidate at a time."""
    d = {r[2]: math.sqrt(sum((a - b) ** 2 for a, b in zip(r[3:], middle))) for r in rows}
    floor = max(5 * res, 0.25 * max(d.values()))
    picked = []
    for r in sorted(rows, key=lambda r: (-d[r[2]], r[2])):
        way = np.array(r[3:]) - middle
        if d[r[2]] < floor or d[r[2]] == 0:
            break
        cosines = [float(way @ w) / (d[r[2]] * e) for w, e, _ in picked]
        if cosines and max(cosines) > 0.7:
            e = picked[int(np.argmax(cosines))][1]
            if abs(d[r[2]] - e) <= 2 * res + 1e-5 * abs(e) and min(np.linalg.norm(way - w) for w, _, _ in picked) > 4 * res:
                picked.append((way, d[r[2]], r[2]))
            continue
        picked.append((way, d[r[2]], r[2]))
        if len(picked) >= most:
            break
    return [p for *_, p in picked]


def linked(places, eps):
    """Least index of each place's component."""
    label = list(range(len(places)))
    for _ in places:
        for i in range(len(places)):
            for j in range(len(places)):
                if math.dist(places[i], places[j]) <= eps:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def rounded(rows, digits=6):
    return sorted(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


def test_end_points_and_centroids(spark, cloud):
    df = spark.createDataFrame(cloud, POINT).repartition(3)
    out = C.edges_and_centroids(df).collect()
    ends, middles = {}, {}
    for key, rows in groups(cloud).items():
        middles[key] = centroid(rows)
        ends[key] = farthest_first(rows, middles[key])
    assert {key: sorted(v) for key, v in ends.items()} == {k: sorted(r.point_id for r in rs if r.is_edge) for k, rs in groups(out).items()}
    assert rounded((*k, *map(float, m)) for k, m in middles.items()) == rounded((r.scene_id, r.label, r.x, r.y, r.z) for r in out if not r.is_edge)
    assert max(map(len, ends.values())) > 2


def test_end_points_are_merged_within_labels(spark, cloud):
    rng = np.random.default_rng(2)
    ends = [cloud[i] for i in sorted(rng.choice(len(cloud), 40, replace=False))]
    out = C.merge_within_clusters(spark.createDataFrame(ends, POINT), spark.createDataFrame(cloud, POINT)).collect()
    expected = []
    for (scene, label), rows in groups(ends).items():
        of = linked([r[3:] for r in rows], 10.0)
        for part in set(of):
            mean = np.mean([r[3:] for r, p in zip(rows, of) if p == part], axis=0)
            near = min((r for r in cloud if r[0] == scene), key=lambda r: (sum((a - b) ** 2 for a, b in zip(mean, r[3:])), r[2]))
            expected.append((scene, label, near[2], *near[3:]))
    found = [(r.scene_id, r.label, r.point_id, r.x, r.y, r.z) for r in out]
    distance = lambda rows: sorted((s, k) for s, k, *_ in rows)
    assert distance(found) == distance(expected) and rounded(found) == rounded(expected)


def test_skeletons_are_merged_across_labels(spark, cloud):
    rng = np.random.default_rng(6)
    bones = [(s, label, k, *r[3:]) for (s, label), rows in groups(cloud).items() for k, r in enumerate(rows[:: 5 if label else 60])]  # label 0 has one point
    chosen = [bones[i] for i in sorted(rng.choice(len(bones), 14, replace=False))]
    ends = [(s, label, 9000 + k, x + 2e-4, y, z) for k, (s, label, _, x, y, z) in enumerate(chosen)]
    ends.append((0, 1, 9999, *(c + 2e-3 for c in bones[5][3:])))  # not close enough to be that point
    out = C.merge_across_clusters(spark.createDataFrame(bones, POINT.replace("point_id", "ord")), spark.createDataFrame(ends, POINT)).collect()
    flagged = {(s, label, o) for s, label, o, *p in bones for e in ends if e[:2] == (s, label) and math.dist(p, e[3:]) < 1e-3}
    number = {k: len(v) for k, v in groups(bones).items()}
    expected = [(s, label, *p, False, (label,)) for s, label, o, *p in bones if (s, label, o) not in flagged]
    for scene, rows in groups([b for b in bones if b[:3] in flagged and number[b[:2]] >= 2], 1).items():
        of = linked([r[3:] for r in rows], 10.0)
        for part in set(of):
            mine = [r for r, p in zip(rows, of) if p == part]
            union = tuple(sorted({r[1] for r in mine}))
            expected += [(scene[0], label, *map(float, np.mean([r[3:] for r in mine], axis=0)), True, union) for label in union]
    assert rounded(expected) == rounded((r.scene_id, r.label, r.x, r.y, r.z, r.is_edge, tuple(r.clusters)) for r in out)
    assert any(len(r.clusters) > 1 for r in out) or len(flagged) > 5


@pytest.mark.parametrize("task_edges", [1_000_000, 0])
def test_paths_make_the_least_tree(spark, cloud, task_edges):
    few = [r for r in cloud if r[0] == 0]
    ends = [r for rows in groups(few).values() for r in (rows[0], rows[len(rows) // 2], rows[-1], rows[len(rows) // 3])]
    points = spark.createDataFrame(few, POINT)
    nodes = C.geodesic_paths(points, spark.createDataFrame(ends, POINT), 1.0, task_edges)
    tree = {}
    for r in C.geodesic_tree(nodes, points).collect():
        tree.setdefault(r.label, []).append((r.src, r.dst, r.dist))
    for (_, label), rows in groups(few).items():
        place = np.array([r[3:] for r in rows])
        far = np.sqrt(((place[:, None] - place[None]) ** 2).sum(2))
        far[far > 3.5] = np.inf
        for k in range(len(rows)):  # Floyd and Warshall
            far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])
        at = {r[2]: i for i, r in enumerate(rows)}
        mine = sorted({r[2] for r in ends if r[1] == label})
        inside, total = {mine[0]}, 0.0
        parts = []
        while len(inside) < len(mine):  # Prim; a new part where nothing is in reach
            d, nearest = min((far[at[a], at[b]], b) for a in inside for b in mine if b not in inside)
            if np.isfinite(d):
                total += d
                parts.append(d)
            inside.add(nearest)
        found = tree.get(label, [])
        assert all(abs(d - far[at[a], at[b]]) < 1e-9 for a, b, d in found)
        assert abs(sum(d for *_, d in found) - total) < 1e-6 and len(found) == len(parts)


def test_nearest_points_and_ties(spark):
    rng = np.random.default_rng(4)
    points = [(s, int(i), *map(float, p)) for s in (0, 1) for i, p in enumerate(rng.integers(-40, 40, (300, 3)))] + [(2, 5, 1e6, -1e6, 3.0)]
    queries = [(int(rng.integers(0, 3)), int(q), *map(float, p)) for q, p in enumerate(np.concatenate([rng.integers(-50, 50, (80, 3)), rng.normal(0, 3000, (30, 3)), [[0.5, 0.5, 0.5], [1e7, 1e7, -1e7]]]))] + [(9, 1, 0.0, 0.0, 0.0)]
    columns = "scene_id long, {} long, x double, y double, z double"
    left, right = spark.createDataFrame(queries, columns.format("query_id")), spark.createDataFrame(points, columns.format("point_id"))
    expected = {}
    for s, q, *p in queries:
        near = [(sum((a - b) ** 2 for a, b in zip(p, r[2:])), r[1]) for r in points if r[0] == s]
        if near:
            expected[s, q] = min(near)
    for reach in (0.5, 7.0, 500.0):
        out = {(r.scene_id, r.query_id): (r.d, r.point_id) for r in J.nearest_point(left, right, reach).collect()}
        assert out.keys() == expected.keys() and all(out[k][1] == expected[k][1] and math.isclose(out[k][0] ** 2, expected[k][0], abs_tol=1e-9, rel_tol=1e-9) for k in out)
    assert J.nearest_point(left.filter("scene_id = 9"), right, 1.0).count() == 0


def test_prefixes_and_lead_in(spark):
    poses = spark.createDataFrame([(s, q, float(q)) for s in (0, 1) for q in range(9000)], "scene_id long, seq long, x double")
    asked = spark.createDataFrame([(0, 0), (0, 5000), (0, 5000), (1, 20000), (1, -1), (5, 3)], "scene_id long, seq long")
    out = {(r.scene_id, r.upto): r.n for r in T.path_prefix(poses, asked).groupBy("scene_id", "upto").count().withColumnRenamed("count", "n").collect()}
    assert out == {(0, 0): 1, (0, 5000): 5001, (1, 20000): 9000}
    ring = spark.createDataFrame([(0, 200.0, 0.0, 20.0, 120.0)], "scene_id long, cx double, cy double, radius double, height double")
    rows = sorted((r.ord, round(r.x, 6), round(r.y, 6), r.z) for r in T.ring_waypoints(ring, 20, T.LEAD_IN).collect())
    assert rows[0] == (0, 0.0, 0.0, 100.0) and rows[1] == (1, 120.0, 0.0, 130.0) and rows[2][:2] == (2, 180.0) and len(rows) == 22
