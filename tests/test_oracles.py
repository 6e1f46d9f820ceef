"""Queries against DuckDB on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__
from voxelspark.jobs.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """io1_explode_frames io2_read_poses_csv io3_write_poses_csv io4_write_cloud io5_read_cloud_pcd io6_read_mesh_stl io7_shell_output_name p11_frustum_edges p14_stable_color v4_close v8_dilate_6_selective v9_shell_26 v10_refine_shell v12_exterior_air v13_outer_shell
m1_allocate_samples m2_sample_triangles m3_voxelize_triangles j2_ray_voxels j3_unoccluded j4_radius_neighbors j5_nearest_point j9_latest_at_tick a3_accumulate_static a11_mixture_bic w2_coverage_timeline w9_thin_path w11_next_waypoints c2_filter_lonely_points c4_split_clusters c11_extend_endpoints t1_stream_accumulate t1_stream_closing t2_stable_k t2_stream_stable_k t6_stream_arrivals j9_stream_latest_at_tick t5_stream_coverage t6_waypoint_arrival""".split()


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    show = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return names, sorted(map(tuple, plain.map(show).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
