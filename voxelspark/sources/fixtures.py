"""Test inputs: views over the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "scan_points": """
SELECT l_orderkey % 4 AS scene_id,
       CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS frame_id,
       l_linenumber AS block_pos, l_orderkey AS center_pos,
       CASE WHEN l_linenumber <= 4 THEN 0 WHEN l_linenumber <= 6 THEN 1 ELSE -1 END AS label,
       CAST(CASE WHEN l_linenumber <= 4 THEN l_partkey % 7
                 WHEN l_linenumber <= 6 THEN 7 + l_partkey % 24
                 ELSE 40 + l_partkey % 41 END AS DOUBLE) + 2.5e-1 * (l_linenumber % 4) + 1.25e-1 AS x,
       CAST(CASE WHEN l_linenumber <= 4 THEN l_suppkey % 7
                 WHEN l_linenumber <= 6 THEN 2 + l_suppkey % 3
                 ELSE l_suppkey % 37 END AS DOUBLE) + 2.5e-1 AS y,
       CAST(CASE WHEN l_linenumber BETWEEN 5 AND 6 THEN 48 + CAST(l_quantity AS INT) % 3
                 ELSE CAST(l_quantity AS INT) END AS DOUBLE) + 7.5e-1 AS z
FROM lineitem
WHERE NOT (l_linenumber <= 4 AND l_partkey % 7 BETWEEN 2 AND 4 AND l_suppkey % 7 BETWEEN 2 AND 4)""",
    "vox": """
SELECT DISTINCT scene_id, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy, CAST(floor(z) AS INT) AS iz
FROM scan_points""",
    "poses": """
SELECT user_id % 4 AS scene_id,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
       CAST(event_id AS DOUBLE) AS time,
       CASE event_id % 4 WHEN 0 THEN -(1.037e1 + event_id % 7) WHEN 2 THEN 1.737e1 + event_id % 7
            ELSE user_id % 10 - 1.63e0 END AS x,
       CASE event_id % 4 WHEN 1 THEN -(1.037e1 + event_id % 7) WHEN 3 THEN 1.737e1 + event_id % 7
            ELSE user_id % 10 - 1.63e0 END AS y,
       event_id % 55 + 4.1e-1 AS z, 0e0 AS qx, 0e0 AS qy,
       CASE event_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 7.071067811865476e-1 WHEN 2 THEN 1e0
            ELSE -7.071067811865476e-1 END AS qz,
       CASE event_id % 4 WHEN 0 THEN 1e0 WHEN 2 THEN 0e0 ELSE 7.071067811865476e-1 END AS qw
FROM events""",
    "triangles": """
SELECT p_partkey % 8 AS mesh_id, p_partkey AS face_id,
       CAST(p_partkey % 20 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0, CAST(p_partkey % 13 AS DOUBLE) AS z0,
       CAST(p_partkey % 20 + 1 + p_partkey % 5 AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS y1,
       CAST(p_partkey % 13 + p_size % 4 AS DOUBLE) AS z1,
       CAST(p_partkey % 20 AS DOUBLE) AS x2,
       CAST(p_size + CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 1 + p_partkey % 7 END AS DOUBLE) AS y2,
       CAST(p_partkey % 13 + CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_size % 3 END AS DOUBLE) AS z2
FROM part""",
    "detections": """
SELECT user_id % 4 AS scene_id, CAST(dayofmonth(ts) AS BIGINT) AS frame_id,
       CAST(3 + sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 3 AS BIGINT) AS detected_k
FROM events GROUP BY user_id % 4, dayofmonth(ts)""",
    "bics": """
SELECT p_partkey % 4 AS scene_id, 1 + CAST(floor(p_partkey / 4e0) AS BIGINT) AS k,
       1e5 / (1 + floor(p_partkey / 4e0)) + 1e2 * (p_partkey % 4) * (1 + floor(p_partkey / 4e0)) AS bic
FROM part""",
    "centroids": """
SELECT scene_id, frame_id, label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM scan_points WHERE label >= 0
GROUP BY scene_id, frame_id, label""",
    "odometry": """
SELECT user_id % 4 AS scene_id, ts, value AS x, CAST(user_id % 10 AS DOUBLE) AS y, 0e0 AS z FROM events""",
}
TABLES = ("lineitem", "events", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a lazy plan over the given tables."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if re.search(rf"FROM {v}\b", sql)}
    for t in used:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """DuckDB's text for a query over the fixtures that it names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v not in needed and re.search(rf"\b{v}\b", text):
                need(VIEWS[v])
                needed.append(v)

    need(sql)
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        body = body.split(None, 2 if recursive else 1)[-1]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {body}"
    return f"WITH {ctes} {body}"
