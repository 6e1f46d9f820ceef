"""Running maps: Structured Streaming over frames and poses.

The map of points is a table, not state: it grows with the scenes and never expires, so there is no watermark.  Each
micro-batch is written under its own number, so a batch that is run again after a failure replaces its own rows.  Its closing is kept by
tiles in the state store, where a batch reads and changes only the tiles that its voxels concern.  Coverage looks only at points that a batch's poses can still be the first to see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxelspark.functions.scalar import CELL, quantize
from voxelspark.operators.accumulate import first_points, placed
from voxelspark.operators.tiles import SIDE, TILE, core, dealt, dilated, eroded
from voxelspark.operators.neighbours import views
from voxelspark.operators.visibility import first_sights, still_open
from voxelspark.streaming.ordered import rocks


def stream_accumulate(points: DataFrame, table: str, checkpoint: str, res: float = 1.0) -> StreamingQuery:
    """Adds each micro-batch's first points a voxel to ``table``; :func:`current_map` reads the result."""

    def write(batch: DataFrame, number: int) -> None:
        first_points(batch, res).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_map(spark: SparkSession, table: str) -> DataFrame:
    """One observed point a voxel: of all batches the first in the batch job's order, so late frames, and frames cut by batches, do no harm."""
    return placed(spark.read.parquet(table).groupBy("scene_id", *CELL).agg(F.min("o").alias("o")))


class TileClosing(StatefulProcessor):
    """One tile: the bits of its block with the halo, and those that closing fills inside the tile.

    A tile gives a row, with the next version number, when what closing fills has changed.
    """

    schema = "scene_id long, tx int, ty int, tz int, version long, filled binary"

    def __init__(self, r: int, side: int) -> None:
        self.r, self.side, self.width = r, side, side + 4 * r

    def init(self, handle) -> None:
        self.held = handle.getValueState("tile", "version long, block binary, filled binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, block, filled = self.held.get() if self.held.exists() else (0, None, b"")
        size = self.width**3
        bits = np.zeros(size, bool) if block is None else np.unpackbits(np.frombuffer(block, np.uint8), count=size).astype(bool)
        before = int(bits.sum())
        for batch in rows:
            bits[batch["at"].to_numpy()] = True
        if int(bits.sum()) == before:
            return
        cube = bits.reshape((self.width,) * 3)
        now = np.packbits(core(eroded(dilated(cube, self.r), self.r) & ~cube, 2 * self.r)).tobytes()
        changed = now != filled and bool(filled or any(now))
        self.held.update((version + int(changed), np.packbits(bits).tobytes(), now))
        if changed:
            yield pd.DataFrame({"scene_id": [key[0]], "tx": [key[1]], "ty": [key[2]], "tz": [key[3]], "version": [version + 1], "filled": [now]})

    def close(self) -> None: ...


def stream_closing(points: DataFrame, table: str, checkpoint: str, r: int = 2, res: float = 1.0, side: int = SIDE) -> StreamingQuery:
    """Keeps the closing of a stream of points, by tile, and appends the tiles that a micro-batch changes to ``table``.

    A voxel goes to the tiles within 2r of it, eight at most if a tile is larger than 4r; no other state is read, however large the map has grown.
    Order and cuts of the stream do no harm, nor do repeated points.
    """
    cells = dealt(points.select("scene_id", *quantize(res)), 2 * r, side)
    with rocks(points.sparkSession):
        out = cells.groupBy("scene_id", *TILE).transformWithStateInPandas(TileClosing(r, side), TileClosing.schema, "Append", "None")
        return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def current_closing(spark: SparkSession, table: str, side: int = SIDE) -> DataFrame:
    """The cells that closing has filled so far: of each tile the last version."""
    last = spark.read.schema(TileClosing.schema).parquet(table).groupBy("scene_id", *TILE).agg(F.max_by("filled", "version").alias("filled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = [batch.column(t).to_pylist() for t in TILE]
            for k, (scene, filled) in enumerate(zip(batch.column("scene_id").to_pylist(), batch.column("filled").to_pylist())):
                bits = np.unpackbits(np.frombuffer(filled, np.uint8), count=side**3).reshape((side,) * 3)
                found = [(f + t[k] * side).astype(np.int32) for f, t in zip(np.nonzero(bits), tiles)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), scene)), *map(pa.array, found)], ["scene_id", *CELL])

    return last.mapInArrow(run, "scene_id long, ix int, iy int, iz int")


def stream_coverage(poses: DataFrame, points: DataFrame, occupied: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Adds the first sight of points by each micro-batch of poses to ``table``.

    A batch tests only points that no earlier batch saw, or that were first seen by a pose after this batch's first one, so work falls
    as coverage grows, and poses that come late are right too.
    """
    spark = poses.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = views(batch).persist()
        if number:
            seen = spark.read.schema("scene_id long, point_id long, first_seq long, batch long").parquet(table).filter(F.col("batch") != number)
            seen = seen.groupBy("scene_id", "point_id").agg(F.min("first_seq").alias("first_seq"))
            left = still_open(points, batch, seen).join(seen, ["scene_id", "point_id"], "left")
        else:
            left = points
        first_sights(batch, left, occupied).write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.unpersist()

    return poses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_first_seen(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("scene_id", "point_id").agg(F.min("first_seq").alias("first_seq"))
