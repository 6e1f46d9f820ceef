"""Queries over the operators, each on views of the given tables, and DuckDB's SQL for them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.functions import scalar as S
from voxelspark.operators import accumulate as A
from voxelspark.operators import mesh as M
from voxelspark.operators import mixtures as G
from voxelspark.operators import morphology as V
from voxelspark.operators import neighbours as J
from voxelspark.operators import skeleton as C
from voxelspark.operators import state as T
from voxelspark.operators import visibility as R
from voxelspark.operators.components import checkpoint, shared_folder, stored
from voxelspark.operators.skeletonize import skeletonize
from voxelspark.sources import clouds as IO
from voxelspark.sources import poses as P
from voxelspark.sources.fixtures import VIEWS, view, with_views
from voxelspark.streaming.maps import current_closing, current_first_seen, current_map, stream_accumulate, stream_closing, stream_coverage
from voxelspark.streaming import ordered as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
XYZ, CELL = S.XYZ, S.CELL


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of the named views as a query, with its SQL if there is any."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def numbered(points: DataFrame) -> DataFrame:
    """Distinct voxels as points at their centres, with the packed key as id."""
    return points.select("scene_id", S.pack_voxel().alias("point_id"), *S.voxel_center(1.0))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


#: Pieces of SQL.
KEY = "((CAST(ix AS BIGINT) + 1048576) & 2097151) * 4398046511104 + ((CAST(iy AS BIGINT) + 1048576) & 2097151) * 2097152 + ((CAST(iz AS BIGINT) + 1048576) & 2097151)"
PTS = f"pts AS (SELECT scene_id, {KEY} AS point_id, ix + 0.5e0 AS x, iy + 0.5e0 AS y, iz + 0.5e0 AS z, ix, iy, iz FROM vox)"


def box(name: str, source: str, r: int, erode: bool) -> str:
    """Dilation or erosion by a box of half-width r, an axis at a time."""
    steps = []
    for k, axis in enumerate(CELL):
        to = name if k == 2 else f"{name}_{axis}"
        moved = ", ".join(f"CAST({c} + a AS INT) AS {c}" if c == axis else c for c in CELL)
        tail = f" GROUP BY ALL HAVING count(*) = {2 * r + 1}" if erode else " GROUP BY ALL"
        held = "MATERIALIZED " if to == name else ""  # read twice by some
        steps.append(f"{to} AS {held}(SELECT * FROM (SELECT scene_id, {moved} FROM {source}, (SELECT unnest(range({-r}, {r + 1})) AS a) q) m{tail})")
        source = to
    return ", ".join(steps)


def faces(name: str, source: str) -> str:
    """Empty cells with two faces at least on the source, and the source."""
    offsets = ", ".join(str(o) for o in V.FACES)
    return f"""{name}_n AS (SELECT scene_id, ix + a AS ix, iy + b AS iy, iz + c AS iz FROM {source}, (VALUES {offsets}) o(a, b, c)),
{name} AS MATERIALIZED (SELECT scene_id, ix, iy, iz FROM {source} UNION SELECT scene_id, ix, iy, iz FROM {name}_n GROUP BY ALL HAVING count(*) >= 2)"""


CLOSE = f"{box('d2', 'vox', 2, False)}, {box('e2', 'd2', 2, True)}, added AS (SELECT * FROM e2 ANTI JOIN vox USING (scene_id, ix, iy, iz))"
ACC = """acc AS (SELECT *, row_number() OVER (PARTITION BY scene_id, floor(x), floor(y), floor(z) ORDER BY frame_id, block_pos DESC, center_pos DESC, x DESC, y DESC, z DESC) AS k FROM scan_points)"""


# sources
@query("io1_explode_frames", "scan_points", sql="""SELECT scene_id, frame_id, CAST(dense_rank() OVER (PARTITION BY scene_id, frame_id ORDER BY block_pos) AS INT) AS block_pos,
  CAST(row_number() OVER (PARTITION BY scene_id, frame_id, block_pos ORDER BY center_pos, x, y, z) - 1 AS INT) AS center_pos, x, y, z FROM scan_points""")  # fmt: skip
def _(points):
    frames = A.nest_frames(points)
    empty = F.array().cast(frames.schema["blocks"].dataType.elementType["centers"].dataType)
    none = F.array(F.struct(empty.alias("centers")))
    return A.explode_frames(frames.withColumn("blocks", F.concat(none, "blocks", none)))  # blocks without centres give no rows


POSE_FILE = "concat_ws(',', CAST(event_id AS STRING), '1', '2.5', CAST(user_id AS STRING), '0', '0', '0', '1', 'x')"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a query writes and reads again."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _pose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file a user, as text; every seventh line is short."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("short,line")).otherwise(F.expr(POSE_FILE))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n")
    return events.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.concat(F.lit("time,x,y,z,qx,qy,qz,qw\n"), body).alias("value"))


QUERIES["io2_read_poses_csv"] = lambda spark, sf_dir: P.parse_poses(_pose_files(spark, sf_dir), 3).select("path", "line", "time", "z", "qw")
ORACLE_SQL["io2_read_poses_csv"] = """SELECT CAST(user_id AS VARCHAR) AS path, CAST(line AS INT) AS line, CAST(event_id AS DOUBLE) AS time, CAST(user_id AS DOUBLE) AS z, 1e0 AS qw
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line FROM events) x WHERE line % 3 = 0 AND event_id % 7 <> 0"""


@query("io3_explode_path", "poses", sql="SELECT scene_id, seq, round(time + seq * 1e-9, 6) AS time, x, y, z, qx, qy, qz, qw FROM poses")
def _(poses):
    stamp = F.struct(F.col("seq").alias("k"), F.col("time").cast("int").alias("sec"), F.col("seq").cast("int").alias("nanosec"), *[F.col(n) for n in (*XYZ, "qx", "qy", "qz", "qw")])
    return rounded(P.explode_path(poses.groupBy("scene_id").agg(F.sort_array(F.collect_list(stamp)).alias("poses"))), "time")


def _write_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "poses")
    P.write_poses_csv(view(spark, sf_dir, "poses"), folder)
    return P.read_poses_csv(spark, folder).select(*P.FIELDS)


QUERIES["io3_write_poses_csv"] = _write_poses
ORACLE_SQL["io3_write_poses_csv"] = with_views("SELECT time, x, y, z, qx, qy, qz, qw FROM poses")


def _write_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points; the others lose a coordinate and are left out of the cloud."""
    points = view(spark, sf_dir, "scan_points").withColumn("z", F.when(F.col("label") < 0, F.lit(float("nan"))).otherwise(F.col("z")))
    folder = _folder(spark, "cloud") + ".pcd"
    IO.write_cloud(points, folder)
    return spark.read.parquet(folder).select(F.col("scene_id").cast("long"), *XYZ)


QUERIES["io4_write_cloud"] = _write_cloud
ORACLE_SQL["io4_write_cloud"] = with_views("SELECT scene_id, x, y, z FROM scan_points WHERE label >= 0")


def _read_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "pcd")
    IO.write_cloud_pcd(view(spark, sf_dir, "scan_points"), folder)
    scene = F.regexp_extract("path", "scene_id=([0-9]+)", 1).cast("long").alias("scene_id")
    return IO.read_cloud_pcd(spark, folder, "*.txt").select(scene, *XYZ)


QUERIES["io5_read_cloud_pcd"] = _read_clouds
ORACLE_SQL["io5_read_cloud_pcd"] = with_views("SELECT scene_id, x, y, z FROM scan_points")


def _read_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stl")
    IO.write_mesh_stl(view(spark, sf_dir, "triangles"), folder)
    mesh = F.regexp_extract("path", "mesh_id=([0-9]+)", 1).cast("long").alias("mesh_id")
    return IO.read_mesh_stl(spark, folder, pattern="*.txt").select(mesh, *[f"{n}{i}" for i in range(3) for n in XYZ])


QUERIES["io6_read_mesh_stl"] = _read_meshes
ORACLE_SQL["io6_read_mesh_stl"] = with_views("SELECT mesh_id, x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM triangles")


QUERIES["io7_shell_output_name"] = lambda spark, sf_dir: M.shell_names(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("meshes/m"), F.col("p_partkey").cast("string"), F.lit(".stl")).alias("path")), 0.25)
ORACLE_SQL["io7_shell_output_name"] = "SELECT 'meshes/m' || p_partkey || '.stl' AS path, 'm' || p_partkey || '_outer_shell_voxels_0.2.pcd' AS name FROM part"


# columns
@query("p1_quantize", "scan_points", sql="SELECT scene_id, frame_id, CAST(floor((x - 20) / 0.5e0) AS INT) AS ix, CAST(floor((y - 20) / 0.5e0) AS INT) AS iy, CAST(floor((z - 20) / 0.5e0) AS INT) AS iz FROM scan_points")
def _(points):
    return points.select("scene_id", "frame_id", *[(F.col(n) - 20).alias(n) for n in XYZ]).select("scene_id", "frame_id", *S.quantize(0.5))


@query("p2_quantize_from", "scan_points", sql="""SELECT p.scene_id, CAST(floor((x - mx) / 0.5e0) AS INT) AS ix, CAST(floor((y - my) / 0.5e0) AS INT) AS iy, CAST(floor((z - mz) / 0.5e0) AS INT) AS iz
FROM scan_points p JOIN (SELECT scene_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM scan_points GROUP BY scene_id) m ON p.scene_id = m.scene_id""")  # fmt: skip
def _(points):
    return points.join(V.bounds(points), "scene_id").select("scene_id", *S.quantize(0.5, origin=[F.col(f"min_{n}") for n in XYZ]))


@query("p3_voxel_center", "vox", sql="SELECT scene_id, (ix + 0.5e0) * 2 + 1 AS x, (iy + 0.5e0) * 2 + 1 AS y, (iz + 0.5e0) * 2 + 1 AS z FROM vox")
def _(vox):
    return vox.select("scene_id", *S.voxel_center(2.0, (1.0, 1.0, 1.0)))


@query("p4_pack_voxel", "vox", sql=f"SELECT scene_id, {KEY} AS vkey, ix, iy, iz FROM vox")
def _(vox):
    packed = vox.select("scene_id", S.pack_voxel().alias("vkey"))
    return packed.select("scene_id", "vkey", *S.unpack_voxel())


@query("p5_drop_nan_points", "scan_points", sql="SELECT scene_id, x, y, z FROM scan_points WHERE block_pos <> 3")
def _(points):
    return S.drop_nan_points(points.withColumn("x", F.when(F.col("block_pos") == 3, F.lit(float("nan"))).otherwise(F.col("x")))).select("scene_id", *XYZ)


@query("p6_yaw_from_quaternion", "poses", sql="SELECT scene_id, seq, round(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)), 6) + 0e0 AS yaw FROM poses")
def _(poses):
    return rounded(poses.select("scene_id", "seq", S.yaw_from_quaternion().alias("yaw")), "yaw")


@query("p7_quaternion_from_yaw", "poses", sql="SELECT scene_id, seq, 0e0 AS qx, 0e0 AS qy, round(sin(atan2(5 - y, 25 - x) / 2), 6) + 0e0 AS qz, round(cos(atan2(5 - y, 25 - x) / 2), 6) + 0e0 AS qw FROM poses")
def _(poses):
    return rounded(poses.select("scene_id", "seq", *S.quaternion_from_yaw(S.yaw_toward(25.0, 5.0))), "qz", "qw")


@query("p8_stamp_to_seconds", "poses", sql="SELECT scene_id, seq, round(CAST(time AS INT) + CAST(seq * 1000 AS INT) * 1e-9, 6) AS t FROM poses")
def _(poses):
    return rounded(poses.select("scene_id", "seq", S.stamp_to_seconds(F.col("time").cast("int"), (F.col("seq") * 1000).cast("int")).alias("t")), "t")


@query("p9_in_range", "scan_points", sql="SELECT scene_id, x, y, z FROM scan_points WHERE (x - 10) * (x - 10) + (y - 5) * (y - 5) + (z - 20) * (z - 20) <= 225")
def _(points):
    return points.filter(S.in_range(F.col("x") - 10, F.col("y") - 5, F.col("z") - 20, 15.0)).select("scene_id", *XYZ)


@query("p10_in_frustum", "scan_points", sql="""SELECT scene_id, x, y, z FROM (SELECT *, cos(-0.5e0) * (x - 1.3e0) - sin(-0.5e0) * (y - 2.1e0) AS ahead, sin(-0.5e0) * (x - 1.3e0) + cos(-0.5e0) * (y - 2.1e0) AS side FROM scan_points) s
WHERE ahead BETWEEN 0 AND 20 AND abs(side) <= 10 * (ahead / 20) AND abs(z - 20.3e0) <= 7.5e0 * (ahead / 20)""")  # fmt: skip
def _(points):
    return points.filter(S.in_frustum(F.col("x") - 1.3, F.col("y") - 2.1, F.col("z") - 20.3, F.lit(0.5), 20.0, 20.0, 15.0)).select("scene_id", *XYZ)


_CORNERS = "(0, 0, 0e0, 0e0, 0e0), (0, 1, 20, 10, 7.5e0), (1, 0, 0, 0, 0), (1, 1, 20, -10, 7.5e0), (2, 0, 0, 0, 0), (2, 1, 20, -10, -7.5e0), (3, 0, 0, 0, 0), (3, 1, 20, 10, -7.5e0), (4, 0, 20, 10, 7.5e0), (4, 1, 20, -10, 7.5e0), (5, 0, 20, -10, 7.5e0), (5, 1, 20, -10, -7.5e0), (6, 0, 20, -10, -7.5e0), (6, 1, 20, 10, -7.5e0), (7, 0, 20, 10, -7.5e0), (7, 1, 20, 10, 7.5e0)"


@query("p11_frustum_edges", "poses", sql=f"""SELECT scene_id, seq, edge, tip, round(x + (1 - 2 * (qy * qy + qz * qz)) * px + 2 * (qx * qy - qw * qz) * py + 2 * (qx * qz + qw * qy) * pz, 4) + 0e0 AS x,
  round(y + 2 * (qx * qy + qw * qz) * px + (1 - 2 * (qx * qx + qz * qz)) * py + 2 * (qy * qz - qw * qx) * pz, 4) + 0e0 AS y,
  round(z + 2 * (qx * qz - qw * qy) * px + 2 * (qy * qz + qw * qx) * py + (1 - 2 * (qx * qx + qy * qy)) * pz, 4) + 0e0 AS z
FROM poses, (VALUES {_CORNERS}) c(edge, tip, px, py, pz)""")  # fmt: skip
def _(poses):
    return rounded(S.frustum_edges(poses, 20.0, 20.0, 15.0), *XYZ, digits=4)


@query("p12_observation_flag", "scan_points", sql=f"WITH {CLOSE} SELECT scene_id, TRUE AS observed, count(*) AS n FROM scan_points GROUP BY scene_id UNION ALL SELECT scene_id, FALSE, count(*) FROM added GROUP BY scene_id")
def _(points):
    return V.fill_cavities(points, 2).groupBy("scene_id", "observed").agg(F.count("*").alias("n"))


@query("p13_pack_rgb", "scan_points", sql="SELECT scene_id, frame_id, CAST((block_pos * 30) * 65536 + (center_pos % 256) * 256 + (frame_id % 256 + 256) % 256 AS INT) AS rgb FROM scan_points")
def _(points):
    return points.select("scene_id", "frame_id", S.pack_rgb(F.col("block_pos") * 30, F.col("center_pos") % 256, F.pmod("frame_id", F.lit(256))).alias("rgb"))


@query("p14_stable_color", "triangles", sql="""WITH h AS (SELECT face_id AS id, (face_id * 0.61803398875e0) % 1 AS h, 0.98e0 - 0.08e0 * (((face_id * 97) % 5) / 4e0) AS v FROM triangles),
s AS (SELECT *, CAST(floor(h * 6) AS INT) AS k, h * 6 - floor(h * 6) AS f FROM h), c AS (SELECT id, k, v, v * (1 - 0.92e0) AS p, v * (1 - 0.92e0 * f) AS q, v * (1 - 0.92e0 * (1 - f)) AS t FROM s)
SELECT id, CAST(floor([v, q, p, p, t, v][k + 1] * 255) AS INT) AS r, CAST(floor([t, v, v, q, p, p][k + 1] * 255) AS INT) AS g, CAST(floor([p, p, t, v, v, q][k + 1] * 255) AS INT) AS b FROM c""")  # fmt: skip
def _(triangles):
    return triangles.select(F.col("face_id").alias("id"), *S.stable_color(F.col("face_id")))


AREA = """0.5e0 * sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2))"""


@query("p15_triangle_area", "triangles", sql=f"SELECT mesh_id, face_id, round({AREA}, 6) AS area FROM triangles")
def _(triangles):
    return triangles.select("mesh_id", "face_id", F.round(S.triangle_area(), 6).alias("area"))


@query("p16_crop_points", "scan_points", sql="SELECT scene_id, x, y, z FROM scan_points WHERE z BETWEEN 5 AND 40 AND x * x + y * y + z * z BETWEEN 100 AND 1600")
def _(points):
    return S.crop_points(points, 5.0, 40.0, 10.0, 40.0).select("scene_id", *XYZ)


# morphology
@query("v1_voxelize", "scan_points", sql="SELECT DISTINCT scene_id, CAST(floor(x / 0.5e0) AS INT) AS ix, CAST(floor(y / 0.5e0) AS INT) AS iy, CAST(floor(z / 0.5e0) AS INT) AS iz FROM scan_points")
def _(points):
    return V.voxelize(points, 0.5)


@query("v2_dilate", "vox", sql=f"WITH {box('d', 'vox', 2, False)} SELECT * FROM d")
def _(vox):
    return V.dilate(vox, 2)


@query("v3_erode", "vox", sql=f"WITH {box('d', 'vox', 2, False)}, {box('e', 'd', 1, True)} SELECT * FROM e")
def _(vox):
    return V.erode(V.dilate(vox, 2), 1)


@query("v4_close", "vox", sql=f"WITH {CLOSE} SELECT * FROM added")
def _(vox):
    return V.close(vox, V.closing_radius(5.0, 1.0))


@query("v5_fill_cavities", "scan_points", sql=f"WITH {CLOSE} SELECT scene_id, x, y, z, TRUE AS observed FROM scan_points UNION ALL SELECT scene_id, ix + 0.5e0, iy + 0.5e0, iz + 0.5e0, FALSE FROM added")
def _(points):
    return V.fill_cavities(points, 2)


_UP = "up AS MATERIALIZED (SELECT scene_id, CAST(2 * ix + a AS INT) AS ix, CAST(2 * iy + b AS INT) AS iy, CAST(2 * iz + c AS INT) AS iz FROM {0}, (SELECT unnest([0, 1]) AS a) q1, (SELECT unnest([0, 1]) AS b) q2, (SELECT unnest([0, 1]) AS c) q3)"


@query("v6_upsample2", "vox", sql=f"WITH {_UP.format('vox')} SELECT * FROM up")
def _(vox):
    return V.upsample2(vox)


@query("v7_erode_26", "vox", sql=f"""WITH n AS (SELECT scene_id, ix + a AS ix, iy + b AS iy, iz + c AS iz FROM vox, (VALUES {", ".join(str(o) for o in V.AROUND)}) o(a, b, c)),
g AS (SELECT * FROM n GROUP BY ALL HAVING count(*) >= 12) SELECT vox.* FROM vox SEMI JOIN g USING (scene_id, ix, iy, iz)""")  # fmt: skip
def _(vox):
    return V.erode_26(vox, 12)


@query("v8_dilate_6_selective", "vox", sql=f"WITH {faces('s', 'vox')} SELECT * FROM s")
def _(vox):
    return V.dilate_6_selective(vox)


@query("v9_shell_26", "vox", sql=f"WITH {box('d', 'vox', 1, False)}, {box('e', 'd', 1, True)} SELECT * FROM d EXCEPT SELECT * FROM e")
def _(vox):
    return V.shell_26(V.dilate(vox, 1))


@query("v10_refine_shell", "scan_points", sql=f"""WITH {_UP.format('vox')}, {faces('s1', 'up')}, {_UP.format('s1').replace('up AS', 'up2 AS', 1)}, {box('e1', 'up2', 1, True)}, {box('d1', 'e1', 1, False)}, {box('e2', 'd1', 1, True)}, {faces('s2', 'e2')}, {box('e3', 's2', 1, True)}
SELECT scene_id, (ix + 0.5e0) * 0.25e0 AS x, (iy + 0.5e0) * 0.25e0 AS y, (iz + 0.5e0) * 0.25e0 AS z FROM (SELECT * FROM s2 EXCEPT SELECT * FROM e3) t""")  # fmt: skip
def _(points):
    return V.refine_shell(points, 1.0, 2)


@query("v11_dilate_points", "vox", sql=f"WITH {box('d', 'vox', 1, False)} SELECT scene_id, ix + 0.5e0 AS x, iy + 0.5e0 AS y, iz + 0.5e0 AS z FROM d")
def _(vox):
    return V.dilate_points(vox.select("scene_id", *S.voxel_center(1.0)), 1)


_AIR = """WITH RECURSIVE b AS (SELECT scene_id, min(ix) - 1 AS x0, max(ix) + 1 AS x1, min(iy) - 1 AS y0, max(iy) + 1 AS y1, min(iz) - 1 AS z0, max(iz) + 1 AS z1 FROM vox GROUP BY scene_id),
free AS MATERIALIZED (SELECT scene_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz FROM (SELECT scene_id, ix, iy, unnest(range(z0, z1 + 1)) AS iz FROM (SELECT *, unnest(range(y0, y1 + 1)) AS iy FROM (SELECT *, unnest(range(x0, x1 + 1)) AS ix FROM b)))
  ANTI JOIN vox USING (scene_id, ix, iy, iz)),
air AS (SELECT scene_id, CAST(x0 AS INT) AS ix, CAST(y0 AS INT) AS iy, CAST(z0 AS INT) AS iz FROM b UNION
  SELECT f.scene_id, f.ix, f.iy, f.iz FROM (SELECT scene_id, ix + a AS ix, iy + b AS iy, iz + c AS iz FROM air, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c)) n JOIN free f USING (scene_id, ix, iy, iz))"""


@query("v12_exterior_air", "vox", sql=f"{_AIR} SELECT * FROM air")
def _(vox):
    return V.exterior_air(vox)


@query("v13_outer_shell", "vox", sql=f"{_AIR} SELECT DISTINCT vox.* FROM vox, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c) WHERE (scene_id, ix + a, iy + b, iz + c) IN (SELECT (scene_id, ix, iy, iz) FROM air)")
def _(vox):
    return V.outer_shell(vox)


@query("v14_layer_histogram", "vox", sql="SELECT scene_id, iz, count(*) AS n FROM vox GROUP BY scene_id, iz")
def _(vox):
    return V.layer_histogram(vox)


# meshes
@query("m1_allocate_samples", "triangles", sql=f"""SELECT mesh_id, face_id, CAST(round(10000 * area / total) AS BIGINT) AS n FROM (SELECT mesh_id, face_id, {AREA} AS area, sum({AREA}) OVER (PARTITION BY mesh_id) AS total FROM triangles) t
WHERE round(10000 * area / total) > 0""")  # fmt: skip
def _(triangles):
    return M.allocate_samples(triangles, 10_000).select("mesh_id", "face_id", "n")


_ALLOC = f"al AS (SELECT * FROM (SELECT *, CAST(round({{0}} * area / total) AS BIGINT) AS n FROM (SELECT *, {AREA} AS area, sum({AREA}) OVER (PARTITION BY mesh_id) AS total FROM triangles) t) t WHERE n > 0)"
_UNIT = "CAST('0x' || substr(md5(concat_ws('/', mesh_id, face_id, i, 42, {0})), 1, 13) AS BIGINT) / 4503599627370496e0"
_SAMPLED = f"""sp AS (SELECT mesh_id, face_id, i, sqrt({_UNIT.format(1)}) AS r1, {_UNIT.format(2)} AS r2, x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM (SELECT *, unnest(range(n)) AS i FROM al)),
samples AS (SELECT mesh_id, face_id, {", ".join(f"((1 - r1) * {n}0 + (r1 * (1 - r2)) * {n}1) + (r1 * r2) * {n}2 AS {n}" for n in XYZ)} FROM sp)"""


@query("m2_sample_triangles", "triangles", sql=f"WITH {_ALLOC.format(10000)}, {_SAMPLED} SELECT mesh_id, face_id, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM samples")
def _(triangles):
    return rounded(M.sample_triangles(M.allocate_samples(triangles, 10_000)), *XYZ)


def _touch_sql() -> str:
    """Whether no separating axis parts a triangle, relative to a cell's centre, from the cell."""
    v = [[f"v{n}{i}" for n in XYZ] for i in range(3)]
    edge = [[f"({v[(i + 1) % 3][k]} - {v[i][k]})" for k in range(3)] for i in range(3)]
    axes = [a for e in edges_of(edge) for a in e]
    (ax, ay, az), (bx, by, bz) = edge[0], edge[1]
    axes.append([f"({ay} * {bz} - {az} * {by})", f"({az} * {bx} - {ax} * {bz})", f"({ax} * {by} - {ay} * {bx})"])
    tests = []
    for axis in axes:
        spots = [" + ".join(f"{axis[k]} * {v[i][k]}" for k in range(3)) for i in range(3)]
        reach = " + ".join(f"abs({axis[k]}) * 0.5e0" for k in range(3))
        tests.append(f"least({', '.join(spots)}) <= {reach} AND greatest({', '.join(spots)}) >= -({reach})")
    return " AND ".join(tests)


def edges_of(edge: list[list[str]]) -> list[list[list[str]]]:
    """The three cross products of each edge with the axes."""
    return [[["0", f"-{e[2]}", e[1]], [e[2], "0", f"-{e[0]}"], [f"-{e[1]}", e[0], "0"]] for e in edge]


@query("m3_voxelize_triangles", "triangles", sql=f"""WITH a AS (SELECT *, unnest(range(CAST(floor(least(x0, x1, x2)) AS INT), CAST(floor(greatest(x0, x1, x2)) AS INT) + 1)) AS ix FROM triangles),
b AS (SELECT *, unnest(range(CAST(floor(least(y0, y1, y2)) AS INT), CAST(floor(greatest(y0, y1, y2)) AS INT) + 1)) AS iy FROM a), c AS (SELECT *, unnest(range(CAST(floor(least(z0, z1, z2)) AS INT), CAST(floor(greatest(z0, z1, z2)) AS INT) + 1)) AS iz FROM b),
v AS (SELECT mesh_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, {", ".join(f"{n}{i} - ({c} + 0.5e0) AS v{n}{i}" for i in range(3) for n, c in zip(XYZ, CELL))} FROM c) SELECT DISTINCT mesh_id AS scene_id, ix, iy, iz FROM v WHERE {_touch_sql()}""")  # fmt: skip
def _(triangles):
    return M.voxelize_triangles(triangles, 1.0)


@query("m4_mesh_to_outer_shell", "triangles", sql=f"""WITH RECURSIVE {_ALLOC.format(20000)}, {_SAMPLED}, og AS (SELECT mesh_id AS scene_id, min(x) AS x, min(y) AS y, min(z) AS z FROM samples GROUP BY mesh_id),
mv AS (SELECT DISTINCT s.mesh_id AS scene_id, CAST(floor(s.x - og.x) AS INT) AS ix, CAST(floor(s.y - og.y) AS INT) AS iy, CAST(floor(s.z - og.z) AS INT) AS iz FROM samples s JOIN og ON s.mesh_id = og.scene_id),
{_AIR.removeprefix("WITH RECURSIVE ").replace("vox", "mv")},
sh AS (SELECT DISTINCT mv.* FROM mv, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c) WHERE (scene_id, ix + a, iy + b, iz + c) IN (SELECT (scene_id, ix, iy, iz) FROM air))
SELECT scene_id, round(ix + 0.5e0 + og.x, 5) + 0e0 AS x, round(iy + 0.5e0 + og.y, 5) + 0e0 AS y, round(iz + 0.5e0 + og.z, 5) + 0e0 AS z FROM sh JOIN og USING (scene_id)""")  # fmt: skip
def _(triangles):
    return rounded(M.mesh_to_outer_shell(triangles, 20_000, 1.0), *XYZ, digits=5)


# neighbours and joins
_CAND = f"""{PTS}, q AS (SELECT *, atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)) AS yaw FROM poses),
d AS (SELECT q.scene_id, seq, point_id, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, yaw, q.x AS ax, q.y AS ay, q.z AS az, p.ix AS gx, p.iy AS gy, p.iz AS gz FROM q JOIN pts p ON q.scene_id = p.scene_id),
f AS (SELECT *, cos(-yaw) * dx - sin(-yaw) * dy AS ahead, sin(-yaw) * dx + cos(-yaw) * dy AS side FROM d WHERE dx * dx + dy * dy + dz * dz <= 625),
cand AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM f WHERE ahead BETWEEN 0 AND 20 AND abs(side) <= 10 * (ahead / 20) AND abs(dz) <= 7.5e0 * (ahead / 20))"""


def _packed(scene: str, x: str, y: str, z: str) -> str:
    """A scene's cell as one number, for cells within 4096 of the origin."""
    return f"((CAST({scene} AS BIGINT) * 8192 + {x} + 4096) * 8192 + {y} + 4096) * 8192 + {z} + 4096"


def _ray_sql(packed: bool = False) -> str:
    """Cells of the candidates' rays (``cells``), without the target's: the first one, and those that crossings of each axis enter.

    ``packed``: a ray is a row number ``rid`` of ``cand``, and a cell one number, ``cell``.
    """
    one = lambda a: f"""d{a} / dist AS u{a}, CAST(floor(a{a}) AS INT) AS c{a}"""
    two = lambda a: f"""CASE WHEN u{a} > 0 THEN 1 ELSE -1 END AS s{a}, CASE WHEN abs(u{a}) < 1e-12 THEN 0 ELSE abs(g{a} - c{a}) END AS n{a},
  CASE WHEN abs(u{a}) < 1e-12 THEN 1e300 ELSE (c{a} + CASE WHEN u{a} > 0 THEN 1 ELSE 0 END - a{a}) / u{a} END AS f{a}, CASE WHEN abs(u{a}) < 1e-12 THEN 1e300 ELSE 1 / abs(u{a}) END AS e{a}"""  # noqa: E731
    names = "rid, scene_id" if packed else "scene_id, seq, point_id"
    ray = f"""{'rays' if packed else 'ray'} AS {'' if packed else 'MATERIALIZED '}(SELECT {names}, gx, gy, gz, cx, cy, cz, {", ".join(map(two, "xyz"))}
FROM (SELECT *, {", ".join(map(one, "xyz"))} FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM cand) WHERE dist >= 1e-9) WHERE cx <> gx OR cy <> gy OR cz <> gz)"""
    if packed:
        # most blocked rays are so by the cell before the target's; where one crossing is clearly the last, that cell is known
        last = lambda a: f"CASE WHEN n{a} > 0 THEN f{a} + (n{a} - 1) * e{a} ELSE -1 END AS l{a}"
        after = lambda a: " AND ".join(f"l{a} > l{o} + 1e-6" for o in "xyz" if o != a)
        before = " ".join(f"WHEN {after(a)} THEN {_packed('scene_id', *[f'g{o} - s{o}' if o == a else f'g{o}' for o in 'xyz'])}" for a in "xyz")
        ray += f""", rest AS MATERIALIZED (SELECT *, coalesce(before IN (SELECT {_packed('scene_id', *CELL)} FROM vox), FALSE) AS hidden FROM (SELECT *, CASE {before} END AS before FROM (SELECT *, {", ".join(map(last, "xyz"))} FROM rays))),
ray AS NOT MATERIALIZED (SELECT * FROM rest WHERE NOT hidden)"""
    shown = f"rid, {_packed('scene_id', *CELL)} AS cell" if packed else "scene_id, seq, point_id, ix, iy, iz"
    parts = [f"SELECT {shown} FROM (SELECT *, cx AS ix, cy AS iy, cz AS iz FROM ray)"]
    for i, a in enumerate("xyz"):
        place = []
        for j, o in enumerate("xyz"):
            if o == a:
                place.append(f"c{o} + s{o} * (k + 1)")
            else:
                passed = f"floor((t - f{o} + {R.TIE}) / e{o}) + 1" if j > i else f"ceil((t - f{o} - {R.TIE}) / e{o})"
                place.append(f"c{o} + s{o} * CASE WHEN n{o} > 0 THEN CAST(least(n{o}, greatest(0, {passed})) AS INT) ELSE 0 END")
        cells = ", ".join(f"CAST({p} AS INT) AS {c}" for p, c in zip(place, CELL))
        parts.append(f"SELECT {shown} FROM (SELECT *, {cells} FROM (SELECT *, f{a} + k * e{a} AS t FROM (SELECT *, unnest(range(n{a})) AS k FROM ray))) WHERE ix <> gx OR iy <> gy OR iz <> gz")
    return f"{ray}, cells AS NOT MATERIALIZED ({' UNION ALL '.join(parts)})"


_SEEN = f"""{_CAND}, {_ray_sql(packed=True)}, blocked AS MATERIALIZED (SELECT DISTINCT rid FROM cells WHERE cell IN (SELECT {_packed('scene_id', *CELL)} FROM vox)),
free AS (SELECT scene_id, seq, point_id FROM cand WHERE rid NOT IN (SELECT rid FROM blocked UNION ALL SELECT rid FROM rest WHERE hidden)), s AS (SELECT scene_id, point_id, min(seq) AS seq FROM free GROUP BY scene_id, point_id)"""


def _seen(poses: DataFrame, vox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The voxels as points, and the first pose that sees each."""
    vox = stored(vox)
    points = numbered(vox)
    return points, R.first_seen_of(poses, points, vox)


@query("j1_visible_candidates", "poses", "vox", sql=f"WITH {_CAND} SELECT scene_id, seq, point_id FROM cand")
def _(poses, vox):
    return J.visible_candidates(poses, numbered(stored(vox)))


@query("j2_ray_voxels", "poses", "vox", sql=f"""WITH {_CAND}, {_ray_sql()}, c AS (SELECT scene_id, seq, count(*) AS cells, sum(ix) AS ix, sum(iy) AS iy, sum(iz) AS iz FROM cells GROUP BY scene_id, seq)
SELECT scene_id, seq, rays, coalesce(cells, 0) AS cells, CAST(coalesce(ix, 0) AS BIGINT) AS ix, CAST(coalesce(iy, 0) AS BIGINT) AS iy, CAST(coalesce(iz, 0) AS BIGINT) AS iz FROM (SELECT scene_id, seq, count(*) AS rays FROM cand GROUP BY scene_id, seq) r LEFT JOIN c USING (scene_id, seq)""")  # fmt: skip
def _(poses, vox):
    return R.ray_lengths(poses, numbered(stored(vox)))


@query("j3_unoccluded", "poses", "vox", sql=f"WITH {_SEEN} SELECT * FROM free")
def _(poses, vox):
    vox = stored(vox)
    return R.unoccluded(poses, numbered(vox), vox)


@query("j4_radius_neighbors", "vox", sql=f"WITH {PTS} SELECT a.scene_id, a.point_id AS src, b.point_id AS dst, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS w FROM pts a, pts b, (VALUES {', '.join(str((x, y, z)) for x in range(-1, 2) for y in range(-1, 2) for z in range(-1, 2) if 0 < x * x + y * y + z * z <= 2)}) o(i, j, k) WHERE a.scene_id = b.scene_id AND b.ix = a.ix + i AND b.iy = a.iy + j AND b.iz = a.iz + k")
def _(vox):
    return rounded(J.radius_neighbors(numbered(vox), 1.5), "w")


@query("j5_nearest_point", "centroids", "vox", sql=f"""WITH {PTS}, n AS (SELECT c.scene_id, c.frame_id * 10 + c.label AS query_id, p.point_id, round(pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2), 9) AS d2 FROM centroids c JOIN pts p ON c.scene_id = p.scene_id)
SELECT scene_id, query_id, round(sqrt(min(d2)), 5) AS d FROM n GROUP BY scene_id, query_id""")  # fmt: skip
def _(centroids, vox):
    found = J.nearest_point(centroids.withColumn("query_id", F.col("frame_id") * 10 + F.col("label")), numbered(vox), 0.5)  # most answers take several rounds
    return rounded(found.select("scene_id", "query_id", "d"), "d", digits=5)


_IDS = "ids AS (SELECT DISTINCT scene_id, frame_id, label, label * 100 + frame_id AS track_id FROM scan_points WHERE label >= 0)"


@query("j7_labels_to_ids", "scan_points", sql=f"WITH {_IDS} SELECT p.scene_id, p.frame_id, p.label, x, y, z, track_id FROM scan_points p JOIN ids USING (scene_id, frame_id, label)")
def _(points):
    ids = points.filter("label >= 0").select("scene_id", "frame_id", "label", (F.col("label") * 100 + F.col("frame_id")).alias("track_id")).distinct()
    return J.labels_to_ids(points.select("scene_id", "frame_id", "label", *XYZ), ids)


@query("j8_clusters_of_point", "vox", sql=f"WITH {PTS} SELECT scene_id, point_id, x, y, z, CAST(unnest([ix % 3, 5]) AS INT) AS label FROM pts")
def _(vox):
    return J.clusters_of_point(numbered(vox).withColumn("clusters", F.array((F.floor("x") % 3).cast("int"), F.lit(5))))


_ASOF = "t AS (SELECT DISTINCT scene_id, ts + INTERVAL 1 MINUTE AS ts FROM odometry), o AS (SELECT scene_id, ts, max(x) AS x FROM odometry GROUP BY scene_id, ts)"


@query("j9_latest_at_tick", "odometry", sql=f"WITH {_ASOF} SELECT t.scene_id, t.ts, o.x FROM t ASOF JOIN o ON t.scene_id = o.scene_id AND t.ts >= o.ts")
def _(odometry):
    return J.latest_at_tick(odometry.select("scene_id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts")).distinct(), odometry, ("x",))


# aggregations
@query("a1_bounds", "scan_points", sql="SELECT scene_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM scan_points GROUP BY scene_id")
def _(points):
    return V.bounds(points)


@query("a2_frame_dedup", "scan_points", sql="""SELECT scene_id, frame_id, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy, CAST(floor(z) AS INT) AS iz, x, y, z FROM (SELECT *, row_number() OVER (
PARTITION BY scene_id, frame_id, floor(x), floor(y), floor(z) ORDER BY block_pos DESC, center_pos DESC, x DESC, y DESC, z DESC) AS k FROM scan_points) s WHERE k = 1""")  # fmt: skip
def _(points):
    return A.frame_dedup(points)


@query("a3_accumulate_static", "scan_points", sql=f"WITH {ACC} SELECT scene_id, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy, CAST(floor(z) AS INT) AS iz, frame_id, x, y, z FROM acc WHERE k = 1")
def _(points):
    return A.accumulate(points)


@query("a4_count_observed", "scan_points", sql=f"WITH {CLOSE} SELECT s.scene_id, s.n AS observed, coalesce(a.n, 0) AS filled FROM (SELECT scene_id, count(*) AS n FROM vox GROUP BY scene_id) s LEFT JOIN (SELECT scene_id, count(*) AS n FROM added GROUP BY scene_id) a USING (scene_id)")
def _(points):
    return A.count_observed(A.static_map(points))


QUERIES["wa_static_map"] = QUERIES["a4_count_observed"]
ORACLE_SQL["wa_static_map"] = ORACLE_SQL["a4_count_observed"]


@query("a5_has_points", "scan_points", sql="SELECT scene_id, frame_id, bool_or(x > 7.6e1) AS has_points FROM scan_points GROUP BY scene_id, frame_id")
def _(points):
    """Frames whose blocks keep only far centres; many then have none."""
    far = F.transform("blocks", lambda b: F.struct(F.filter(b["centers"], lambda c: c["x"] > 76).alias("centers")))
    return A.has_points(A.nest_frames(points).withColumn("blocks", far))


@query("a6_supervoxel_centroid", "scan_points", sql="""SELECT scene_id, label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM (
SELECT scene_id, label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM scan_points GROUP BY scene_id, label, floor(x / 4), floor(y / 4), floor(z / 4)) s GROUP BY scene_id, label""")  # fmt: skip
def _(points):
    return rounded(J.supervoxel_centroid(points), *XYZ)


@query("a7_cluster_sizes", "scan_points", sql="SELECT scene_id, label, count(*) AS n FROM scan_points GROUP BY scene_id, label HAVING count(*) >= 50")
def _(points):
    return J.cluster_sizes(points)


@query("a8_group_mean_and_cluster_union", "scan_points", sql="""SELECT scene_id, frame_id AS component, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z,
  string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS clusters FROM scan_points GROUP BY scene_id, frame_id""")  # fmt: skip
def _(points):
    merged = J.merge_groups(points.select("scene_id", F.col("frame_id").alias("component"), *XYZ, F.array("label").alias("clusters")))
    return rounded(merged.withColumn("clusters", F.array_join(F.array_sort(F.col("clusters").cast("array<string>")), ",")), *XYZ)


@query("a9_first_seen", "poses", "vox", sql=f"WITH {_SEEN} SELECT scene_id, point_id, seq AS first_seq FROM s")
def _(poses, vox):
    return _seen(poses, vox)[1]


@query("a10_coverage", "poses", "vox", sql=f"WITH {_SEEN} SELECT p.scene_id, count(s.point_id) AS seen, count(*) AS total, round(1e2 * count(s.point_id) / count(*), 6) AS percent FROM pts p LEFT JOIN s ON p.scene_id = s.scene_id AND p.point_id = s.point_id GROUP BY p.scene_id")
def _(poses, vox):
    return R.coverage(*_seen(poses, vox))


@query("a11_mixture_bic", "bics", "vox", sql="SELECT scene_id, k, round((10 * k - 1) * ln(n) - 2 * bic, 4) AS bic FROM bics JOIN (SELECT scene_id, count(*) AS n FROM vox GROUP BY scene_id) v USING (scene_id)")
def _(bics, vox):
    """The table's numbers stand for log likelihoods of the scene's voxels."""
    rows = bics.join(V.occupied_count(vox), "scene_id")
    return rounded(rows.select("scene_id", "k", T.mixture_bic(F.col("bic"), F.col("n"), F.col("k")).alias("bic")), "bic", digits=4)


@query("a12_occupied_count", "vox", sql="SELECT scene_id, count(*) AS n FROM vox GROUP BY scene_id")
def _(vox):
    return V.occupied_count(vox)


@query("p17_recolor_seen", "poses", "vox", sql=f"WITH {_SEEN} SELECT p.scene_id, p.point_id, CASE WHEN s.point_id IS NULL THEN 16711680 ELSE 65280 END AS rgb FROM pts p LEFT JOIN s ON p.scene_id = s.scene_id AND p.point_id = s.point_id")
def _(poses, vox):
    points, seen = _seen(poses, vox)
    return points.join(seen, ["scene_id", "point_id"], "left").select("scene_id", "point_id", S.recolor_seen(F.col("first_seq")).alias("rgb"))


# windows
@query("w1_stride_sample", "poses", sql="SELECT scene_id, seq, time FROM poses WHERE seq % 3 = 0")
def _(poses):
    return T.stride_sample(poses, 3).select("scene_id", "seq", "time")


@query("w2_coverage_timeline", "poses", "vox", sql=f"""WITH {_SEEN}, n AS (SELECT scene_id, seq, count(*) AS c FROM s GROUP BY scene_id, seq), t AS (SELECT scene_id, count(*) AS total FROM pts GROUP BY scene_id),
r AS (SELECT q.scene_id, q.seq, coalesce(c, 0) AS new, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY q.scene_id ORDER BY q.seq) AS BIGINT) AS seen FROM q LEFT JOIN n ON q.scene_id = n.scene_id AND q.seq = n.seq)
SELECT r.scene_id, seq, new, seen, round(1e2 * seen / total, 6) AS percent FROM r JOIN t ON r.scene_id = t.scene_id""")  # fmt: skip
def _(poses, vox):
    points, seen = _seen(poses, vox)
    return R.coverage_timeline(poses, seen, points)


@query("w3_path_so_far", "poses", sql="SELECT scene_id, seq, seq + 1 AS n_poses FROM poses")
def _(poses):
    return T.path_so_far(poses)


@query("w3_path_prefix", "poses", sql="""WITH a AS (SELECT scene_id, CAST(floor(max(seq) * q / 4e0) AS BIGINT) AS upto FROM poses, (VALUES (1), (2), (3), (4)) v(q) GROUP BY scene_id, q)
SELECT p.scene_id, upto, seq, time, x, y, z FROM poses p JOIN (SELECT DISTINCT * FROM a) a ON p.scene_id = a.scene_id AND seq <= upto""")
def _(poses):
    """The path at each quarter of the flight."""
    last = poses.groupBy("scene_id").agg(F.max("seq").alias("last"))
    asked = last.select("scene_id", F.explode(F.array(*[F.floor(F.col("last") * q / 4) for q in range(1, 5)])).alias("seq"))
    return T.path_prefix(poses, asked).select("scene_id", "upto", "seq", "time", *XYZ)


@query("w4_elapsed", "poses", sql="SELECT scene_id, seq, round((time - first(time) OVER (PARTITION BY scene_id ORDER BY seq)) / 10, 6) + 0e0 AS elapsed FROM poses")
def _(poses):
    return rounded(T.elapsed(poses, 10.0).select("scene_id", "seq", "elapsed"), "elapsed")


@query("w5_bic_elbow", "bics", sql="""WITH s AS (SELECT *, lag(bic) OVER (PARTITION BY scene_id ORDER BY k) AS last FROM bics)
SELECT scene_id, coalesce(min(CASE WHEN (last - bic) / abs(last) < 0.01e0 THEN k - 1 END), first(k ORDER BY bic, k)) AS k FROM s GROUP BY scene_id""")  # fmt: skip
def _(bics):
    return T.bic_elbow(bics)


_LAST = "c AS (SELECT scene_id, frame_id, count(*) AS n FROM scan_points GROUP BY scene_id, frame_id)"


@query("w7_changed_frames", "scan_points", sql=f"WITH {_LAST} SELECT scene_id, frame_id, n, coalesce(n > max(n) OVER (PARTITION BY scene_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS changed FROM c")
def _(points):
    return A.changed_frames(points, "grows")


@query("w8_edge_points", "scan_points")
def _(points):
    labelled = J.clusters_of_point(_labelled(points))
    return C.edge_points(labelled, J.supervoxel_centroid(labelled))


@query("w9_thin_path", "poses", sql="""WITH RECURSIVE o AS (SELECT scene_id, seq AS i, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM poses WINDOW w AS (PARTITION BY scene_id ORDER BY seq)),
u AS MATERIALIZED (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) AS size, (x - px) * (nx - x) + (y - py) * (ny - y) + (z - pz) * (nz - z) AS dot FROM o),
v AS MATERIALIZED (SELECT *, CASE WHEN size > 0 AND acos(least(1, greatest(-1, dot / size))) > 0.5e0 THEN 20 ELSE 40 END AS need FROM u),
r AS (SELECT scene_id, i, x, y, z, x AS kx, y AS ky, z AS kz, 0e0 AS gone, TRUE AS kept FROM v WHERE i = 0 UNION ALL
  SELECT scene_id, i, x, y, z, CASE WHEN g >= need THEN x ELSE kx END, CASE WHEN g >= need THEN y ELSE ky END, CASE WHEN g >= need THEN z ELSE kz END, CASE WHEN g >= need THEN 0e0 ELSE g END, g >= need
  FROM (SELECT v.*, r.kx, r.ky, r.kz, r.gone + sqrt((v.x - kx) * (v.x - kx) + (v.y - ky) * (v.y - ky) + (v.z - kz) * (v.z - kz)) AS g FROM r JOIN v ON v.scene_id = r.scene_id AND v.i = r.i + 1 WHERE v.nx IS NOT NULL) t),
k AS (SELECT DISTINCT scene_id, x, y, z FROM (SELECT scene_id, x, y, z FROM r WHERE kept UNION ALL SELECT scene_id, x, y, z FROM v WHERE nx IS NULL) t)
SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY x, y, z) - 1 AS BIGINT) AS ord, x, y, z FROM k""")  # fmt: skip
def _(poses):
    """Each scene's flight as one path, thinned for voxels of ten units."""
    return C.thin_paths(poses.select("scene_id", F.lit(0).alias("label"), F.col("seq").alias("ord"), *XYZ), 10.0).drop("label")


@query("w10_ring_waypoints", "poses", sql="""WITH s AS (SELECT scene_id, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM poses GROUP BY scene_id), r AS (SELECT scene_id, i, cx + 30 * cos(2 * pi() * i / 12) AS x, cy + 30 * sin(2 * pi() * i / 12) AS y FROM s, (SELECT unnest(range(0, 12)) AS i) k),
f AS (SELECT *, first(i) OVER (PARTITION BY scene_id ORDER BY round(x * x + y * y + 3600, 6), i) AS f FROM r) SELECT scene_id, CAST((i - f + 12) % 12 AS BIGINT) AS ord, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, 4e1 AS z FROM f""")  # fmt: skip
def _(poses):
    return rounded(T.ring_waypoints(_structures(poses)), *XYZ, digits=5)


@query("w10_ring_with_lead_in", "poses", sql="""WITH s AS (SELECT scene_id, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM poses GROUP BY scene_id), r AS (SELECT scene_id, i, cx + 30 * cos(2 * pi() * i / 12) AS x, cy + 30 * sin(2 * pi() * i / 12) AS y FROM s, (SELECT unnest(range(0, 12)) AS i) k),
f AS (SELECT *, first(i) OVER (PARTITION BY scene_id ORDER BY round(x * x + y * y + 3600, 6), i) AS f FROM r) SELECT scene_id, CAST((i - f + 12) % 12 + 2 AS BIGINT) AS ord, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, 4e1 AS z FROM f
UNION ALL SELECT scene_id, CAST(0 AS BIGINT), 0e0, 0e0, 1e2 FROM s UNION ALL SELECT scene_id, CAST(1 AS BIGINT), 1.2e2, 0e0, 1.3e2 FROM s""")  # fmt: skip
def _(poses):
    return rounded(T.ring_waypoints(_structures(poses), lead_in=T.LEAD_IN), *XYZ, digits=5)


@query("w11_next_waypoints", "poses", sql="""WITH s AS (SELECT scene_id, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM poses GROUP BY scene_id), r AS (SELECT scene_id, i, cx + 30 * cos(2 * pi() * i / 12) AS x, cy + 30 * sin(2 * pi() * i / 12) AS y FROM s, (SELECT unnest(range(0, 12)) AS i) k),
f AS (SELECT *, first(i) OVER (PARTITION BY scene_id ORDER BY round(x * x + y * y + 3600, 6), i) AS f FROM r), g AS (SELECT scene_id, (i - f + 12) % 12 AS ord, x, y FROM f)
SELECT scene_id, CAST(t AS BIGINT) AS step, CAST(ord AS BIGINT) AS ord, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, 4e1 AS z, round(atan2(-y, -x), 5) + 0e0 AS yaw FROM g JOIN (SELECT unnest(range(0, 6)) AS t) k ON ord = (t + 9) % 12""")  # fmt: skip
def _(poses):
    return rounded(T.next_waypoints(T.ring_waypoints(_structures(poses)), 9), *XYZ, "yaw", digits=5)


def _structures(poses: DataFrame) -> DataFrame:
    return poses.groupBy("scene_id").agg(F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy")).withColumns({"radius": F.lit(30.0), "height": F.lit(40.0)})


# sets
@query("s1_union", "scan_points", sql=f"WITH {ACC} SELECT scene_id, x, y, z, 0 AS class FROM acc WHERE k = 1 UNION ALL SELECT scene_id, x, y, z, 1 FROM scan_points WHERE label = 1")
def _(points):
    ours = A.accumulate(points).select("scene_id", *XYZ, F.lit(0).alias("class"))
    return ours.unionByName(points.filter("label = 1").select("scene_id", *XYZ, F.lit(1).alias("class")))


@query("s2_distinct", "scan_points", sql="SELECT DISTINCT scene_id, x, y, z FROM scan_points")
def _(points):
    return points.select("scene_id", *XYZ).distinct()


@query("s3_difference", "vox", sql=f"WITH {box('d', 'vox', 1, False)} SELECT * FROM d ANTI JOIN vox USING (scene_id, ix, iy, iz)")
def _(vox):
    return V.dilate(vox, 1).join(vox, list(V.KEY), "left_anti")


# clusters and skeletons
def _labelled(points: DataFrame) -> DataFrame:
    """Distinct voxels of the labelled points, at their centres."""
    cells = points.filter("label >= 0").select("scene_id", "label", *S.quantize(1.0)).distinct()
    return cells.select("scene_id", F.array("label").alias("clusters"), S.pack_voxel().alias("point_id"), *S.voxel_center(1.0))


def _linked_sql(points: str, eps: float, key: str) -> str:
    """Components of voxels within eps of each other: CTEs to put after WITH RECURSIVE, the last one ``m``, the voxels with their ``component``.

    Nodes are runs along z, whose voxels are linked anyway; runs of near columns are linked if they come near enough in z.
    """
    r = int(eps)
    near = ", ".join(str((x, y, int((eps * eps - x * x - y * y) ** 0.5))) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= eps * eps)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    return f"""isl AS MATERIALIZED (SELECT *, iz - row_number() OVER (PARTITION BY {key}, ix, iy ORDER BY iz) AS g FROM {points}),
n AS MATERIALIZED (SELECT {key}, ix, iy, g, min(iz) AS z0, max(iz) AS z1, min(point_id) AS point_id, row_number() OVER (ORDER BY {key}, min(point_id)) AS id FROM isl GROUP BY {key}, ix, iy, g),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a, (VALUES {near}) o(i, j, k), n b WHERE {same("a", "b")} AND b.ix = a.ix + i AND b.iy = a.iy + j AND b.z0 <= a.z1 + k AND b.z1 >= a.z0 - k AND a.id <> b.id),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM n UNION (SELECT DISTINCT ON (e.b) e.b, c.comp FROM recurring.cc r, cc c, e WHERE e.a = c.id AND r.id = e.b AND c.comp < r.comp ORDER BY e.b, c.comp)),
m AS (SELECT isl.*, h.point_id AS component FROM isl JOIN n ON {same("isl", "n")} AND isl.ix = n.ix AND isl.iy = n.iy AND isl.g = n.g JOIN cc ON n.id = cc.id JOIN n h ON h.id = cc.comp)"""


_CLUSTERS = """lab AS (SELECT DISTINCT scene_id, label, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy, CAST(floor(z) AS INT) AS iz FROM scan_points WHERE label >= 0), labelled AS (SELECT *, """ + KEY + """ AS point_id FROM lab)"""
_ONE = f"{PTS}, {_linked_sql('pts', 1.5, 'scene_id')}"


@query("c1_radius_components", "vox", sql=f"WITH RECURSIVE {_ONE} SELECT scene_id, point_id, component FROM m")
def _(vox):
    return J.radius_components(numbered(vox), 1.5).select("scene_id", "point_id", "component")


_SPREAD = f"""sp AS (SELECT scene_id, CASE WHEN ix < 40 THEN ix ELSE 2 * ix - 40 END AS ix, CASE WHEN ix < 40 THEN iy ELSE 2 * iy END AS iy, CASE WHEN ix < 40 THEN iz ELSE 2 * iz END AS iz FROM vox),
spts AS (SELECT scene_id, {KEY} AS point_id, ix + 0.5e0 AS x, iy + 0.5e0 AS y, iz + 0.5e0 AS z, ix, iy, iz FROM sp)"""


@query("c2_filter_lonely_points", "vox", sql=f"""WITH RECURSIVE {_SPREAD}, {_linked_sql('spts', 5.0, 'scene_id')}
SELECT scene_id, point_id, x, y, z FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, component) AS size FROM m) WHERE size >= 50""")  # fmt: skip
def _(vox):
    """The voxels, with the noise beside the tower twice as far apart: some of it is lonely at five voxels, some is not."""
    noise = F.col("ix") >= 40
    apart = vox.select("scene_id", *[F.when(noise, 2 * F.col(c) - (40 if c == "ix" else 0)).otherwise(F.col(c)).cast("int").alias(c) for c in CELL])
    return J.filter_lonely_points(numbered(apart)).select("scene_id", "point_id", *XYZ)


@query("c4_split_clusters", "scan_points", sql=f"""WITH RECURSIVE {_CLUSTERS}, {_linked_sql('labelled', 3.0, 'scene_id, label')}, g2 AS (SELECT scene_id, label, component, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 50)
SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY label, component) - 1 AS BIGINT) AS new_label FROM g2""")  # fmt: skip
def _(points):
    labelled = J.clusters_of_point(_labelled(points))
    return J.split_clusters(labelled, 3.0).select("scene_id", "label", "component", "n", F.col("new_label").cast("long").alias("new_label"))


@query("w6_relabel_components", "scan_points", sql="""WITH g AS (SELECT scene_id, label, frame_id AS component, count(*) AS n, min(center_pos) AS first FROM scan_points GROUP BY scene_id, label, frame_id HAVING count(*) >= 50)
SELECT scene_id, label, component, n, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY label, first, component) - 1 AS BIGINT) AS new_label FROM g""")  # fmt: skip
def _(points):
    """Parts given beforehand: the frames of each label."""
    found = points.select("scene_id", "label", F.col("frame_id").alias("component"), F.col("center_pos").alias("point_id"))
    return J.relabel_components(found).select("scene_id", "label", "component", "n", F.col("new_label").cast("long").alias("new_label"))


def _ends(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled voxels and their end points."""
    labelled = J.clusters_of_point(_labelled(points))
    return labelled, checkpoint(C.edge_points(labelled, J.supervoxel_centroid(labelled)))


@query("c5_edges_and_centroids", "scan_points")
def _(points):
    return rounded(C.edges_and_centroids(J.clusters_of_point(_labelled(points))), *XYZ)


@query("c6_merge_edge_points_within_cluster", "scan_points")
def _(points):
    labelled, ends = _ends(points)
    return rounded(C.merge_within_clusters(ends, labelled), *XYZ)


@query("c7_geodesic_paths", "scan_points")
def _(points):
    return C.geodesic_paths(*_ends(points))


@query("c8_geodesic_tree", "scan_points")
def _(points):
    labelled, ends = _ends(points)
    return rounded(C.geodesic_tree(C.geodesic_paths(labelled, ends), labelled), "dist")


@query("c9_densify", "scan_points")
def _(points):
    return C.densify(*_ends(points))


@query("c10_merge_edges_across_clusters", "scan_points")
def _(points):
    labelled, ends = _ends(points)
    return rounded(C.merge_across_clusters(C.densify(labelled, ends), ends), *XYZ)


@query("c12_skeletonize", "scan_points")
def _(points):
    """Clouds of four frames a scene to skeletons with lasting ids and colours: the whole job, see :func:`skeletonize`.

    Frames have the first quarter, the first half, all, and again all of each column's voxels, in the order in which they were first seen; the last repeats the result of the one before.
    """
    first = A.first_points(points).select("scene_id", *CELL, F.ntile(4).over(Window.partitionBy("scene_id", "ix", "iy").orderBy("o")).alias("turn"))
    since = F.least(F.col("turn"), F.lit(3)).cast("long") - 1
    upto = F.explode(F.sequence(since, F.lit(3).cast("long"))).alias("frame_id")
    cloud = first.select("scene_id", upto, S.pack_voxel().alias("point_id"), *S.voxel_center(1.0))
    return rounded(skeletonize(cloud), *XYZ)


# state
@query("t2_stable_k", "detections", sql="""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) AS i FROM detections),
r AS (SELECT scene_id, frame_id, detected_k, i, detected_k AS k, detected_k AS seen, 1 AS epochs, 0 AS cnt FROM o WHERE i = 1 UNION ALL
  SELECT scene_id, frame_id, d, i, CASE WHEN k = d OR c < need THEN k ELSE d END, d, CASE WHEN k = d THEN epochs + 1 WHEN c >= need THEN 1 ELSE epochs END, CASE WHEN k = d OR c >= need THEN 0 ELSE c END
  FROM (SELECT o.scene_id, o.frame_id, o.detected_k AS d, o.i, r.k, r.epochs, CASE WHEN r.seen = o.detected_k THEN r.cnt + 1 ELSE 1 END AS c,
    least(5, greatest(2, floor((CASE WHEN o.detected_k > r.k THEN 0.1e0 ELSE 0.5e0 END) * r.epochs))) AS need FROM o JOIN r ON o.scene_id = r.scene_id AND o.i = r.i + 1) x)
SELECT scene_id, frame_id, detected_k, k AS stable_k, k <> detected_k AS skipped FROM r""")
def _(detections):
    return T.stable_k(detections)


@query("t3_track_ids", "centroids")
def _(centroids):
    return T.track_ids(centroids)


@query("t4_repeat_last_output", "scan_points", sql=f"""WITH {_LAST}, m AS (SELECT *, coalesce(n <> lag(n) OVER (PARTITION BY scene_id ORDER BY frame_id), TRUE) AS changed FROM c)
SELECT scene_id, frame_id, n, changed, max(CASE WHEN changed THEN frame_id END) OVER (PARTITION BY scene_id ORDER BY frame_id) AS result_frame FROM m""")  # fmt: skip
def _(points):
    return A.repeat_last_output(A.changed_frames(points))


#: Waypoints of the arrival query.
_TOUR = [(45.0, 5.0, 0.0), (25.0, 9.0, 0.0), (5.0, 5.0, 0.0), (25.0, 1.0, 0.0)]


@query("t6_waypoint_arrival", "odometry", sql=f"""WITH RECURSIVE w(k, wx, wy, wz) AS (VALUES {", ".join(str((k, *t)) for k, t in enumerate(_TOUR))}), o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ts, x, y, z) AS i FROM odometry),
r AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST('infinity' AS DOUBLE) AS last FROM o UNION ALL
  SELECT scene_id, i, n + CASE WHEN d > last THEN 1 ELSE 0 END, CASE WHEN d > last THEN CAST('infinity' AS DOUBLE) WHEN d < 5 THEN d ELSE last END
  FROM (SELECT o.scene_id, o.i, r.n, r.last, sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy) + (z - wz) * (z - wz)) AS d FROM o JOIN r ON o.scene_id = r.scene_id AND o.i = r.i + 1 JOIN w ON w.k = r.n % {len(_TOUR)}) t)
SELECT scene_id, max(n) AS arrivals FROM r GROUP BY scene_id""")  # fmt: skip
def _(odometry):
    return T.waypoint_arrival(odometry, _TOUR, 5.0)


# operators that need tables of their own, derived from the clouds
_EDGE = "e AS (SELECT DISTINCT scene_id, label, floor(x) AS x, floor(y) AS y, floor(z) AS z FROM scan_points WHERE label >= 0 AND z > 40)"


@query("j6_flag_edge_points", "scan_points", sql=f"""WITH {_EDGE}, s AS (SELECT DISTINCT scene_id, label, floor(x) AS x, floor(y) AS y, floor(z) AS z FROM scan_points WHERE label >= 0)
SELECT s.scene_id, s.label, s.x + 0.5e0 AS x, s.y + 0.5e0 AS y, s.z + 0.5e0 AS z, e.x IS NOT NULL AS is_edge FROM s LEFT JOIN e ON s.scene_id = e.scene_id AND s.label = e.label AND s.x = e.x AND s.y = e.y AND s.z = e.z""")  # fmt: skip
def _(points):
    skeleton_points = J.clusters_of_point(_labelled(points)).withColumnRenamed("point_id", "ord")
    ends = J.clusters_of_point(_labelled(points.filter("z > 40"))).select("scene_id", "label", *[(F.col(n) + 0.0005).alias(n) for n in XYZ])
    return C.flag_edge_points(skeleton_points, ends).select("scene_id", "label", *XYZ, "is_edge")


@query("c11_extend_endpoints", "scan_points", sql="""WITH c AS (SELECT DISTINCT scene_id, label, floor(x) + 0.5e0 AS x, floor(y) + 0.5e0 AS y, floor(z) + 0.5e0 AS z FROM scan_points WHERE label >= 0),
t AS (SELECT DISTINCT ON (scene_id, label) * FROM c ORDER BY scene_id, label, z DESC, x DESC, y DESC),
n AS (SELECT DISTINCT ON (t.scene_id, t.label) t.scene_id, t.label, t.x AS ex, t.y AS ey, t.z AS ez, c.x, c.y, c.z, (c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y) + (c.z - t.z) * (c.z - t.z) AS d2
  FROM t JOIN c ON t.scene_id = c.scene_id AND t.label = c.label WHERE greatest(abs(c.x - t.x), abs(c.y - t.y), abs(c.z - t.z)) > 1e-8 ORDER BY t.scene_id, t.label, d2, c.x, c.y, c.z)
SELECT scene_id, label, round(ex + k * 3 * (ex - x) / sqrt(d2), 6) + 0e0 AS x, round(ey + k * 3 * (ey - y) / sqrt(d2), 6) + 0e0 AS y, round(ez + k * 3 * (ez - z) / sqrt(d2), 6) + 0e0 AS z FROM n, (VALUES (1), (2)) v(k)""")  # fmt: skip
def _(points):
    cells = J.clusters_of_point(_labelled(points)).select("scene_id", "label", *XYZ)
    tips = cells.groupBy("scene_id", "label").agg(F.max(F.struct("z", "x", "y")).alias("t"))
    marked = cells.join(tips, ["scene_id", "label"]).withColumn("is_edge", F.struct("z", "x", "y") == F.col("t"))
    return rounded(C.extend_endpoints(marked.select("scene_id", "label", *XYZ, "is_edge", F.array("label").alias("clusters"))), *XYZ)


@query("c3_fit_mixtures", "vox")
def _(vox):
    """Points of each part, with the number of parts by the elbow of the BIC, fitted on the dilated cloud."""
    points = numbered(vox)
    fits = G.fit_mixtures(V.dilate_points(points.select("scene_id", *XYZ), 1))
    chosen = G.number_of_parts(fits)[1]
    return G.label_points(points, fits, chosen).groupBy("scene_id", "label").agg(F.count("*").alias("n")).join(chosen, "scene_id")


def _fed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """A table as a stream of four micro-batches, by way of files."""
    rows.repartition(4).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _in_turn(spark: SparkSession, rows: DataFrame, place: str, folder: str, last: DataFrame, parts: int = 4) -> tuple[DataFrame, int]:
    """A table as a stream whose parts come in the order of ``place``, and the width of a part: no row comes later than that.  ``last`` comes at the end."""
    low, high = rows.agg(F.min(place), F.max(place)).first()
    width = (high - low) // parts + 1
    for k in range(parts):
        rows.filter(F.floor((F.col(place) - low) / width) == k).drop(*[place] * (place == "_at")).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 8).parquet(folder), width


def _last(rows: DataFrame, **values) -> DataFrame:
    """A row a scene that says that its stream is over: ``values``, and nulls."""
    scenes = rows.select("scene_id").distinct()
    return scenes.select(*[values.get(f.name, F.col("scene_id") if f.name == "scene_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def _by_frame(start: Callable, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, rows = _folder(spark, name), view(spark, sf_dir, name)
        stream, width = _in_turn(spark, rows, "frame_id", f"{folder}/in", _last(rows))
        start(stream, f"{folder}/out", f"{folder}/progress", hold=width).awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    return run


def _by_time(rows: DataFrame, name: str, start: Callable) -> DataFrame:
    """What a stream of timed rows gives; ``start`` gets the stream, its folders and how late rows may come."""
    spark = rows.sparkSession
    folder = _folder(spark, name)
    numbered_ = rows.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    stream, width = _in_turn(spark, numbered_, "_at", f"{folder}/in", _last(rows, ts=F.lit("2100-01-01 00:00:00")))
    start(stream, f"{folder}/out", f"{folder}/progress", f"{width // 1_000_000 + 1} seconds").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES["t2_stream_stable_k"] = _by_frame(O.stream_stable_k, "detections")
ORACLE_SQL["t2_stream_stable_k"] = ORACLE_SQL["t2_stable_k"]
QUERIES["t3_stream_track_ids"] = _by_frame(O.stream_track_ids, "centroids")


def _stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "odometry")
    found = _by_time(rows, "arrivals", lambda stream, table, progress, delay: O.stream_arrivals(stream, _TOUR, table, progress, 5.0, delay))
    counted = found.groupBy("scene_id").agg(F.count("*").alias("n"))
    return rows.select("scene_id").distinct().join(counted, "scene_id", "left").select("scene_id", F.coalesce("n", F.lit(0)).alias("arrivals"))


QUERIES["t6_stream_arrivals"] = _stream_arrivals
ORACLE_SQL["t6_stream_arrivals"] = ORACLE_SQL["t6_waypoint_arrival"]


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "odometry").withColumn("is_tick", F.lit(False))
    ticks = rows.select("scene_id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts")).distinct()
    both = stored(rows.unionByName(ticks.select("scene_id", "ts", *[F.lit(None).cast("double").alias(n) for n in XYZ], F.lit(True).alias("is_tick"))))  # else each part of the stream makes it anew
    found = _by_time(both, "latest", lambda stream, *more: O.stream_latest_at_tick(stream.withColumn("is_tick", F.coalesce("is_tick", F.lit(False))), *more))
    return found.select("scene_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "x")


QUERIES["j9_stream_latest_at_tick"] = _stream_latest
ORACLE_SQL["j9_stream_latest_at_tick"] = ORACLE_SQL["j9_latest_at_tick"]


def _mapped(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the running map of all frames."""
    folder = _folder(spark, "stream")
    points = _fed(spark, view(spark, sf_dir, "scan_points"), f"{folder}/in")
    stream_accumulate(points, f"{folder}/map", f"{folder}/progress").awaitTermination()
    return f"{folder}/map"


QUERIES["t1_stream_accumulate"] = lambda spark, sf_dir: current_map(spark, _mapped(spark, sf_dir))
ORACLE_SQL["t1_stream_accumulate"] = ORACLE_SQL["a3_accumulate_static"]


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "closing")
    stream_closing(_fed(spark, view(spark, sf_dir, "scan_points"), f"{folder}/in"), f"{folder}/tiles", f"{folder}/progress").awaitTermination()
    return current_closing(spark, f"{folder}/tiles")


QUERIES["t1_stream_closing"] = _closed
ORACLE_SQL["t1_stream_closing"] = ORACLE_SQL["v4_close"]


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "coverage")
    vox = checkpoint(view(spark, sf_dir, "vox"))
    poses = _fed(spark, view(spark, sf_dir, "poses"), f"{folder}/in")
    stream_coverage(poses, numbered(vox), vox, f"{folder}/seen", f"{folder}/progress").awaitTermination()
    return current_first_seen(spark, f"{folder}/seen")


QUERIES["t5_stream_coverage"] = _covered
ORACLE_SQL["t5_stream_coverage"] = ORACLE_SQL["a9_first_seen"]
