"""Filter interaction audit: what each filter removes in each order of the filters.

Direct relational replay.  Every document's flags, one bit a filter, meet all orders of the filters (a table of 120 rows,
so its broadcast has a fixed size), and each of these rows opens into five steps.  The first step whose filter the
document fails is where that order removes it; every figure is a conditional count by part, order and step, summed
inside the tasks before it is shuffled.

The filters (a word is a maximal run of what is not white space, in the case it has): A under 100 words; B fewer than
80 distinct words of a hundred; C over ten capitals A-Z in a hundred code points; D any of ``#$%&*|``; E the text is that of a smaller doc_id, anywhere
in the table.

Equal texts are found by SHA-256, never by shipping texts.  A group of copies may hold any share of the rows: its least
doc_id is aggregated map-side and joined back on the hash and a salt, so one group is spread over ``SALTS`` tasks.

A null text counts as an empty one (A, and E among the empty ones).  A null lang is the part ``''``.  A row without a
doc_id is counted, but is no one's smaller copy and has none; nor does it have labels.  Rows that repeat a doc_id are documents of
their own; equal ones do not fail E for each other's sake.  Labels that repeat a doc_id count if any of them is 1.
Empty documents give no rows; without labels nothing is good or toxic.  Texts are whole whatever their length.  Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.llm.common import stored

FILTERS = "ABCDE"
#: Tasks that share one group of equal texts in the join.
SALTS = 16


def _failed(text: Column) -> Column:
    """Bits of the filters that read the text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for k, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << k).otherwise(0)
    return bits


def flags(docs: DataFrame, labels: DataFrame, salts: int = SALTS) -> DataFrame:
    """``doc_id, part, fails, good, toxic`` for each row of ``docs``: ``fails`` has bit k where filter k fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    marked = stored(marked.select("doc_id", "part", _failed(F.col("text")).alias("own"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("hash")))
    twins = marked.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least")
    dealt = twins.select("hash", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    marked = salted.join(dealt, ["hash", "salt"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("fails"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good OR toxic")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return marked.join(told, "doc_id", "left").select("doc_id", "part", "fails", no("good"), no("toxic"))


def replay(flagged: DataFrame) -> DataFrame:
    """The counts of :func:`audit` from flags."""
    rows = ", ".join("('{}', {})".format("".join(p), ", ".join(str(1 << FILTERS.index(f)) for f in p)) for p in permutations(FILTERS))
    steps = range(1, len(FILTERS) + 1)
    orders = flagged.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS orders(filter_order, {', '.join(f'f{k}' for k in steps)})")
    crossed = flagged.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders))
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(steps):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"f{k}")) != 0, k).otherwise(first)
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"f{k}").alias("filter")) for k in steps])).alias("at")
    opened = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), step)
    opened = opened.select("part", "filter_order", "fails", "good", "toxic", "first", "at.step", "at.filter")
    removed, fails = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("filter")) != 0
    counts = opened.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("filter")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(same))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step``, then documents ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``."""
    return replay(flags(docs, labels))


AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN lab USING (doc_id)),
g AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT *, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) q),
r AS (SELECT *, contains(fails, own) AS failing, length(translate(before, fails, '')) < length(before) AS gone FROM g, s),
c AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c"""
