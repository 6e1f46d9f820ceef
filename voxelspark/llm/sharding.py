"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``SLICES`` arcs.  Each shard owns ``VIRTUAL_NODES`` points on it, and
an arc belongs to the shard of the next point clockwise.  A document's place is the hash of
its text, so equal texts share an arc.  No shard may hold more than ``(1 + SLACK)`` of the
mean bytes: an arc whose shard is full continues clockwise to the next shard with
room.  Large arcs are placed first, small ones fill up what is left, so
sizes are near equal, and adding rows moves only arcs at full shards.

Law: ``bytes``.  What reaches the driver is one row an arc, ``SLICES`` at most, plus the rows of
heavy texts, of which there are at most ``heavy`` times as many as shards.  A text whose
copies weigh over a ``heavy``-th part of a shard cannot stay whole in a balanced ring: its rows get places of
their own by doc_id as well.  All other groups of equal texts stay in one shard.  With ``heavy=None`` all groups
stay whole, and shards are as equal as that allows.

Slots are gapless in each shard: ranks inside an arc plus the rows of the arcs
before it, so no task sees a whole shard.  Arcs with many rows are ranked in parts.

Null texts count as empty.  Repeated ids and texts keep a row each, ties in no
set order.  An empty table gives an empty result.  A text of any length is hashed in its row; columns of other names are not read.
"""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxelspark.llm.common import checkpoint, text_input

SLICES, VIRTUAL_NODES, SLACK, HEAVY = 1 << 16, 128, 0.001, 4
#: An arc with over a PART-th of all rows is ranked in PARTS parts.
PART, PARTS = 1024, 64


def ring(shards: int, nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Points of the virtual nodes on the ring of arcs, and their shards."""
    points = sorted((int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big") % SLICES, s) for s in range(shards) for v in range(nodes))
    return [p for p, _ in points], [s for _, s in points]


def place(weights: dict[int, int], shards: int, slack: float = SLACK) -> dict[int, int]:
    """Shard of each arc: the owner, or clockwise from it the next with room."""
    points, owners = ring(shards)
    loads, out = [0] * shards, {}
    mean = sum(weights.values()) / shards
    for arc in sorted(weights, key=lambda a: (-weights[a], a)):
        w, at, extra = weights[arc], bisect.bisect_left(points, arc), slack
        while arc not in out:
            room, seen = (1 + extra) * mean, set()
            for k in range(len(points)):
                shard = owners[(at + k) % len(points)]
                if shard not in seen and loads[shard] + w <= room:
                    out[arc] = shard
                    break
                seen.add(shard)
                if len(seen) == shards:
                    break
            extra = max(2 * extra, 1e-6)  # an arc larger than any room: the bound gives way for it alone
        loads[out[arc]] += w
    return out


def _arc(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SLICES)).cast("int")


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", heavy: float | None = HEAVY) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = text_input(docs, key, text).select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"))
    rows = checkpoint(rows.withColumn("arc", _arc("h")))  # a few numbers a row, so texts are read once
    sizes = {r["arc"]: r["size"] for r in rows.groupBy("arc").agg(F.sum("size").alias("size")).collect()}
    limit = sum(sizes.values()) / (shards * heavy) if heavy else float("inf")
    heavy_arcs = [arc for arc, size in sizes.items() if size > limit]  # fewer than shards * heavy
    if heavy_arcs:
        texts = rows.filter(F.col("arc").isin(heavy_arcs)).groupBy("h").agg(F.sum("size").alias("size")).filter(F.col("size") > limit)
        spread = [r["h"] for r in texts.select("h").collect()]
        rows = rows.withColumn("arc", F.when(F.col("h").isin(spread), _arc("h", "doc_id")).otherwise(F.col("arc"))) if spread else rows
    counted = rows.groupBy("arc").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in counted)
    wide = [r["arc"] for r in counted if r["n"] * PART > total]  # fewer than PART
    part = F.when(F.col("arc").isin(wide), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int") if wide else F.lit(0)
    rows = rows.drop("h").withColumn("part", part)
    number = {(r["arc"], 0): r["n"] for r in counted if r["arc"] not in set(wide)}
    if wide:
        number |= {(r["arc"], r["part"]): r["n"] for r in rows.filter(F.col("arc").isin(wide)).groupBy("arc", "part").agg(F.count("*").alias("n")).collect()}
    shard_of = place({r["arc"]: r["size"] for r in counted}, shards)
    before, table = [0] * shards, []
    for arc, p in sorted(number):
        shard = shard_of[arc]
        table.append((arc, p, shard, before[shard]))
        before[shard] += number[arc, p]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "before" else T.IntegerType()) for n in ("arc", "part", "shard", "before")])
    # at most SLICES + PART * PARTS rows of 20 bytes
    arcs = spark.createDataFrame(pd.DataFrame(table, columns=schema.names), schema) if table else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("arc", "part").orderBy("doc_id", "text_crc32"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(arcs), ["arc", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
