"""Folds over streams: hysteresis, lasting ids, arrivals and as-of rows with state by scene.

Each operator is the batch fold of :mod:`voxelspark.operators.state`, one step of it at a time, with its state in Spark's state store.  Rows
reach a step in order, however micro-batches cut or shuffle them:

* Frames have no clock.  A row waits in the state until one ``hold`` frames later has come (``hold=1``: until its frame is over), and goes in the order of
  frames then.  A row without a frame says that its scene is over: all that waits is worked off.
* Odometry has one.  A row waits until the watermark has passed it, on a timer.

Late rows, which belong before what has been worked off already, change nothing.  Of frames they come out with a null result; rows behind the watermark are dropped by Spark, which
counts them in the progress of the query (``numRowsDroppedByWatermark``).

What a scene holds is what waits, and a fixed or pruned state: it does not grow with the stream.  A micro-batch's rows of one scene are read in Arrow batches and pass
through the state, where RocksDB may spill them.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxelspark.functions.scalar import XYZ
from voxelspark.operators.state import Arrival, Hysteresis, Tracks

#: Spark's setting of the state store, and the one store that arbitrary state needs.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows that wait for the watermark, and how many of them are one value of the state.
ROW, BLOCK = np.dtype([("at", "<i8"), ("kind", "<i8"), *[(n, "<f8") for n in XYZ]]), 1 << 12
#: Blocks that are handed to the state at a time.
AT_ONCE = 16
#: RocksDB's memory of an executor, whose caches and buffers else grow with the number of stores.
SETTINGS = {PROVIDER: ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """A query that starts in here keeps its state in RocksDB, in bounded memory of an executor; the session's own settings return afterwards."""
    held = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ByFrame(StatefulProcessor):
    """Rows ``scene_id, frame_id``, a whole number and doubles of a scene, a frame at a time and in that order inside it."""

    def __init__(self, hold: int, row: str) -> None:
        self.hold, self.row = hold, row

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", self.row)
        self.place = handle.getValueState("place", "worked long, newest long")

    def frame(self, number: int, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def late(self, row: tuple) -> tuple:
        raise NotImplementedError

    def load(self) -> None:
        """Before the frames of a call, and :meth:`save` after."""

    def save(self) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        worked, newest = self.place.get() if self.place.exists() else (None, None)
        over, out = False, []
        for batch in rows:
            fresh = []
            for row in batch.drop(columns="scene_id").itertuples(index=False, name=None):
                # pandas makes doubles of whole numbers beside a null
                row = tuple(None if v is None or v != v else int(v) if k < 2 else float(v) for k, v in enumerate(row))
                if row[0] is None:
                    over = True
                elif worked is not None and row[0] <= worked:
                    out.append(self.late(row))
                else:
                    fresh.append(row)
                    newest = row[0] if newest is None else max(newest, row[0])
            if fresh:
                self.waiting.appendList(fresh)
        ready, left = {}, []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (ready.setdefault(row[0], []) if over or row[0] <= newest - self.hold else left).append(row)
        if ready:
            self.load()
            for number in sorted(ready):
                out += self.frame(number, sorted(ready[number], key=lambda r: tuple((v is None, v) for v in r[1:])))
            self.save()
            worked = max(ready)
            self.waiting.put(left) if left else self.waiting.clear()
        if newest is not None:
            self.place.update((worked, newest))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns).astype(self.types)

    def close(self) -> None: ...


class StableK(ByFrame):
    """Hysteresis of the number of clusters: ``scene_id, frame_id, detected_k, stable_k, skipped``."""

    schema = "scene_id long, frame_id long, detected_k long, stable_k long, skipped boolean"
    columns = ["scene_id", "frame_id", "detected_k", "stable_k", "skipped"]
    types = {"scene_id": "int64", "frame_id": "int64", "detected_k": "int64", "stable_k": "Int64", "skipped": "boolean"}

    def __init__(self, hold: int = 0) -> None:
        super().__init__(hold, "frame_id long, detected_k long")

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("stable", "k long, seen long, epochs long, count long")

    def load(self) -> None:
        self.now = Hysteresis(*self.held.get()) if self.held.exists() else None

    def save(self) -> None:
        self.held.update((self.now.k, self.now.seen, self.now.epochs, self.now.count))

    def frame(self, number: int, rows: list[tuple]) -> list[tuple]:
        out = []
        for _, k in rows:
            self.now = self.now or Hysteresis.of(k)
            self.now.detect(k)
            out.append((number, k, self.now.k, self.now.k != k))
        return out

    def late(self, row: tuple) -> tuple:
        return (*row, None, None)


class TrackIds(ByFrame):
    """Lasting ids of centroids: ``scene_id, frame_id, label, track_id``.  Tracks are a map in the state and leave it after their misses."""

    schema = "scene_id long, frame_id long, label long, track_id long"
    columns = ["scene_id", "frame_id", "label", "track_id"]
    types = {"scene_id": "int64", "frame_id": "int64", "label": "Int64", "track_id": "Int64"}

    def __init__(self, gate: float, hold: int = 1) -> None:
        super().__init__(hold, "frame_id long, label long, x double, y double, z double")
        self.gate = gate

    def init(self, handle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "track_id long", "x double, y double, z double, age long, missed long")
        self.next = handle.getValueState("next", "track_id long")

    def load(self) -> None:
        known = {k[0]: ([*v[:3]], v[3], v[4]) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        self.known = set(known)
        self.now = Tracks(self.gate, rows={k: known[k] for k in sorted(known)}, next_id=self.next.get()[0] if self.next.exists() else 0)

    def save(self) -> None:
        for k in self.known - self.now.rows.keys():
            self.tracks.removeKey((k,))
        for k, (place, age, missed) in self.now.rows.items():
            self.tracks.updateValue((k,), (*map(float, place), int(age), int(missed)))
        self.next.update((self.now.next_id,))

    def frame(self, number: int, rows: list[tuple]) -> list[tuple]:
        rows = [r for r in rows if r[1] is not None]
        ids = self.now.step(np.array([r[2:] for r in rows], float).reshape(len(rows), 3))
        return [(number, int(r[1]), i) for r, i in zip(rows, ids)]

    def late(self, row: tuple) -> tuple:
        return (row[0], row[1], None)


def _run(out: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def stream_stable_k(detections: DataFrame, table: str, checkpoint: str, hold: int = 0) -> StreamingQuery:
    """``stable_k`` of a stream of ``scene_id, frame_id, detected_k``, appended to ``table``."""
    rows = detections.select("scene_id", "frame_id", "detected_k").groupBy("scene_id")
    with rocks(detections.sparkSession):
        return _run(rows.transformWithStateInPandas(StableK(hold), StableK.schema, "Append", "None"), table, checkpoint)


def stream_track_ids(centroids: DataFrame, table: str, checkpoint: str, res: float = 1.0, hold: int = 1) -> StreamingQuery:
    """``track_ids`` of a stream of ``scene_id, frame_id, label, x, y, z``, appended to ``table``; rows without a label stand for frames without centroids."""
    rows = centroids.select("scene_id", "frame_id", F.col("label").cast("long").alias("label"), *XYZ).groupBy("scene_id")
    with rocks(centroids.sparkSession):
        return _run(rows.transformWithStateInPandas(TrackIds(5 * res, hold), TrackIds.schema, "Append", "None"), table, checkpoint)


class ByTime(StatefulProcessor):
    """Rows ``scene_id, at, kind, x, y, z`` of a scene in the order of ``at`` (microseconds), each when the watermark has passed it.

    Rows wait in blocks, arrays of up to ``BLOCK`` rows that are one value of the state each, and are read only when the oldest of them is ready.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.oldest = handle.getValueState("oldest", "at long")

    def rows(self, rows: np.ndarray) -> pd.DataFrame:
        """What rows in order give; ``BLOCK`` rows at most at a time."""
        raise NotImplementedError

    def load(self) -> None: ...

    def save(self) -> None: ...

    def _wait(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), BLOCK * AT_ONCE):
            part = rows[at : at + BLOCK * AT_ONCE]
            self.waiting.appendList([(part[k : k + BLOCK].tobytes(),) for k in range(0, len(part), BLOCK)])

    def _work(self, watermark: int) -> Iterator[pd.DataFrame]:
        oldest = self.oldest.get()[0] if self.oldest.exists() else None
        if oldest is not None and oldest <= watermark * 1000:
            ready, left = [], []
            for (block,) in self.waiting.get():
                rows = np.frombuffer(block, ROW)
                now = rows["at"] <= watermark * 1000
                ready.append(rows[now])
                left.append(rows[~now])
            left, ready = np.concatenate(left), np.concatenate(ready)
            self.waiting.clear()
            self.oldest.clear()
            oldest = None
            if len(left):
                oldest = int(left["at"].min())
                self._wait(left)
                self.oldest.update((oldest,))
            del left
            ready = ready[np.lexsort([ready[n] for n in (*reversed(XYZ), "kind", "at")])]  # nulls, here NaN, come last
            self.load()
            for k in range(0, len(ready), BLOCK):
                out = self.rows(ready[k : k + BLOCK])
                if len(out):
                    yield out
            self.save()
        if oldest is not None:  # the next to be ready
            self.handle.registerTimer(math.ceil(oldest / 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.key = key
        fresh = []
        for batch in rows:
            part = np.empty(len(batch), ROW)
            for n in ROW.names:
                part[n] = batch[n].to_numpy(dtype=ROW[n])
            fresh.append(part)
        fresh = np.concatenate([np.empty(0, ROW), *fresh])
        if len(fresh):
            least = int(fresh["at"].min())
            self.oldest.update((min(least, self.oldest.get()[0]) if self.oldest.exists() else least,))
            self._wait(fresh)
        del fresh
        yield from self._work(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.key = key
        yield from self._work(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


def _times(at: np.ndarray) -> pd.DatetimeIndex:
    return pd.DatetimeIndex(at.astype("datetime64[us]")).tz_localize("UTC")


class Arrivals(ByTime):
    """Arrivals at targets in turn: ``scene_id, arrival`` (1, 2, ...) ``, target, ts``, a row each."""

    schema = "scene_id long, arrival long, target long, ts timestamp"

    def __init__(self, targets: Sequence[tuple[float, float, float]], reach: float) -> None:
        self.targets, self.reach = targets, reach

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "arrivals long, last double")

    def load(self) -> None:
        self.now = Arrival(self.targets, self.reach, *(self.held.get() if self.held.exists() else ()))

    def save(self) -> None:
        self.held.update((self.now.arrivals, self.now.last))

    def rows(self, rows: np.ndarray) -> pd.DataFrame:
        rows = rows[~np.any([np.isnan(rows[n]) for n in XYZ], axis=0)]
        before, move = self.now.arrivals, self.now.move
        came = np.fromiter((move(*place) for place in zip(*[rows[n].tolist() for n in XYZ])), bool, len(rows))
        number = np.arange(before + 1, self.now.arrivals + 1)
        return pd.DataFrame({"scene_id": np.full(len(number), self.key[0], np.int64), "arrival": number, "target": (number - 1) % len(self.targets), "ts": _times(rows["at"][came])})


class Latest(ByTime):
    """The newest row at or before each tick: ``scene_id, ts, x, y, z``; ticks before any row give none."""

    schema = "scene_id long, ts timestamp, x double, y double, z double"

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "x double, y double, z double")

    def load(self) -> None:
        self.now = self.held.get() if self.held.exists() else None

    def save(self) -> None:
        if self.now is not None:
            self.held.update(self.now)

    def rows(self, rows: np.ndarray) -> pd.DataFrame:
        place = np.stack([rows[n] for n in XYZ], 1)
        own = rows["kind"] == 0
        newest = np.maximum.accumulate(np.where(own, np.arange(len(rows)), -1))
        known = self.now
        if newest[-1] >= 0:
            self.now = tuple(None if v != v else float(v) for v in place[newest[-1]])
        tick = np.flatnonzero(~own if known is not None else ~own & (newest >= 0))
        place = np.where((newest[tick] >= 0)[:, None], place[newest[tick]], np.array(known or (None,) * 3, float))
        return pd.DataFrame({"scene_id": np.full(len(tick), self.key[0], np.int64), "ts": _times(rows["at"][tick])} | {n: place[:, k] for k, n in enumerate(XYZ)})


def _timed(rows: DataFrame, delay: str, kind=None) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return rows.select("scene_id", ts.alias("ts"), F.unix_micros(ts).alias("at"), (F.lit(0) if kind is None else kind).cast("long").alias("kind"), *XYZ).withWatermark("ts", delay)


def _by_time(rows: DataFrame, processor: ByTime) -> DataFrame:
    return rows.groupBy("scene_id").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")


def stream_arrivals(odometry: DataFrame, targets: Sequence[tuple[float, float, float]], table: str, checkpoint: str, reach: float = 2.0, delay: str = "10 seconds") -> StreamingQuery:
    """Arrivals of a stream of ``scene_id, ts, x, y, z`` whose rows come up to ``delay`` late; rows without a place only move the watermark on."""
    with rocks(odometry.sparkSession):
        return _run(_by_time(_timed(odometry, delay), Arrivals(targets, reach)), table, checkpoint)


def stream_latest_at_tick(rows: DataFrame, table: str, checkpoint: str, delay: str = "10 seconds") -> StreamingQuery:
    """As-of rows of one stream of both: ``scene_id, ts, is_tick, x, y, z``; of equal times the greatest place is the newest, and a tick sees it.

    Rows without a place and that are no ticks only move the watermark on.
    """
    with rocks(rows.sparkSession):
        kept = _timed(rows, delay, F.col("is_tick").cast("int"))
        return _run(_by_time(kept, Latest()), table, checkpoint)
