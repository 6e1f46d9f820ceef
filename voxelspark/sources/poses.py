"""Pose logs as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.scalar import stamp_to_seconds

FIELDS = ("time", "x", "y", "z", "qx", "qy", "qz", "qw")


def parse_poses(files: DataFrame, stride: int = 1) -> DataFrame:
    """Rows of log files (``path``, ``value``: a file's text): header skipped, short lines dropped, extra fields ignored.

    Every ``stride``-th line is kept, counted over short lines too.
    """
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "text")).filter("line > 0")
    kept = lines.withColumn("line", F.col("line") - 1).filter(F.pmod("line", F.lit(max(stride, 1))) == 0)
    fields = F.split("text", ",")
    parsed = kept.withColumn("f", fields).filter(F.size("f") >= len(FIELDS))
    return parsed.select("path", "line", *[F.expr(f"try_cast(trim(f[{i}]) AS DOUBLE)").alias(n) for i, n in enumerate(FIELDS)])


def read_poses_csv(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """One row a file first: only a whole file has an order of lines."""
    return parse_poses(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), stride)


def explode_path(messages: DataFrame) -> DataFrame:
    """Poses of path messages (``poses``: array of sec, nanosec, place and quaternion), in order."""
    p = messages.select("scene_id", F.posexplode("poses").alias("seq", "p"))
    return p.select("scene_id", F.col("seq").cast("long").alias("seq"), stamp_to_seconds(F.col("p.sec"), F.col("p.nanosec")).alias("time"), *[F.col(f"p.{n}").alias(n) for n in FIELDS[1:]])


def write_poses_csv(poses: DataFrame, path: str) -> None:
    poses.select(*FIELDS).write.mode("overwrite").option("header", True).csv(path)
