"""Connected components of an edge table, by label propagation with pointer jumping.

Each round every node takes the least label among its own and its neighbours', then the label of
that label's node, so a path of n nodes takes about log(n) rounds.  The only value that reaches the driver is
whether a label changed.  Rounds are cut by tables in the shared folder, so a lost
executor costs a task, not the loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes the shuffle files of a query at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names.  Where it names none, a local session gets one of its own; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A folder of its own in the shared one."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, for loops.  A loop may name two folders in turn, so that it leaves two tables and not one a round.

    A checkpoint keeps the optimizer's estimate of its size, and in a loop of joins that number squares itself every round until it
    takes longer to multiply than the data to join.  A table is as large as its files.  Shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark)
    held = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        spark.conf.set(CLEAN, held)
    return spark.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (the least node in it) for every node of an undirected edge table.

    Edges with a null end are left out; loops and repeated edges do no harm; an empty table gives no rows.
    """
    a, b = F.col(src).alias("src"), F.col(dst).alias("dst")
    one_way = edges.select(a, b).dropna()
    both = stored(one_way.union(one_way.select("dst", "src")).distinct())
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    turn, after = (new_folder(edges.sparkSession, "labels") for _ in range(2))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        jumped = stepped.join(far, F.col("component") == F.col("at"), "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        turn, after = after, turn  # not the table that this round reads
        jumped = stored(jumped, turn)
        changed = jumped.filter("component <> old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
