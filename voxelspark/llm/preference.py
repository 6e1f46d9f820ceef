"""Chat formatting of preference pairs, in DataFrame expressions only.

A pair is a chosen and a rejected conversation, each an array of turns (role, text) in order.  Their longest
common prefix of turns is rendered once, as the prompt; the rest of each is its completion, with a mask: the
code points [start, end) of the completion that are trained on, which are the assistant's texts with their end marks.

Cases: null arrays are empty conversations, null roles and texts empty strings.  Equal conversations are all
prompt, and both completions are empty; where one conversation is a prefix of the other, its completion is empty.
Repeated pairs stay; an empty table gives no pairs.  A conversation of any length is one row.  Columns of other names are not read.
``conv_id`` is a whole number.  Conversations with repeated turn numbers keep all turns, ordered by turn, role and text; turns without a number come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rendering of a turn, and the role that is trained on.
OPEN, CLOSE, END, TRAINED = "<|", "|>\n", "<|end|>", "assistant"

_TURNS = "array<struct<role:string,text:string>>"


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of the trained texts, by a fold over the turns that carries the place."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        opens = state["at"] + F.char_length(_header(t))
        closes = opens + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(opens.cast("long").alias("start"), closes.cast("long").alias("end")))
        spans = F.when(t["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((closes + 1).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def _clean(turns: str) -> Column:
    filled = F.transform(F.coalesce(F.col(turns), F.array().cast(_TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return filled.cast(_TURNS)


def format_pairs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``pairs``: key, ``chosen``, ``rejected``.  Gives key, ``n_prefix``, ``prompt``, ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``."""
    turns = pairs.select(F.col(f"`{key}`").alias(key), _clean("chosen").alias("c"), _clean("rejected").alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False))), False)
    cut = turns.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("long"))
    rest = {n: F.slice(n, F.col("n_prefix").cast("int") + 1, F.size(n)) for n in "cr"}
    parts = cut.select(key, "n_prefix", F.when(F.col("n_prefix") > 0, F.slice("c", 1, F.col("n_prefix").cast("int"))).otherwise(F.array().cast(_TURNS)).alias("p"), rest["c"].alias("c"), rest["r"].alias("r"))
    return parts.select(key, "n_prefix", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def pair_up(conversations: DataFrame) -> DataFrame:
    """Preference pairs from a table of turns (conv_id, turn, role, text); ``pair_id`` is the rejected conversation's.

    Conversations that open with the same turn are alternatives: the one with the most assistant text (ties: least
    conv_id) is chosen over each other one.  A conversation that is alone with its opening is chosen over itself with its
    last assistant turn replaced by that of the conversation whose id differs in the last bit (none: an empty text).
    The rest of the group never meets in one task: each row joins its group's best.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = F.when(F.col("role") == TRAINED, F.char_length("text")).otherwise(0)
    convs = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"), F.coalesce(F.sum(spoken), F.lit(0)).alias("score"))
    convs = convs.select("conv_id", "score", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = convs.withColumn("opening", F.sha2(F.concat_ws("\n", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256))
    best = convs.groupBy("opening").agg(F.max(F.struct("score", (-F.col("conv_id")).alias("id")))["id"].alias("id"), F.count("*").alias("size")).select("opening", (-F.col("id")).alias("best"), "size")
    ranked = convs.join(best, "opening")
    chosen = convs.select(F.col("conv_id").alias("best"), F.col("turns").alias("chosen"))
    groups = ranked.filter("size > 1 AND conv_id <> best").select(F.col("conv_id").alias("pair_id"), "best", F.col("turns").alias("rejected")).join(chosen, "best").select("pair_id", "chosen", "rejected")
    size, place = F.size("turns"), F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED)), True).cast("int")
    replies = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.coalesce(F.try_element_at(F.filter("turns", lambda t: t["role"] == TRAINED), F.lit(-1))["text"], F.lit("")).alias("reply"))
    alone = ranked.filter("size = 1").join(replies, "conv_id", "left")
    swapped = F.when(place > 0, F.concat(F.slice("turns", 1, size - place), F.array(F.struct(F.lit(TRAINED).alias("role"), F.coalesce("reply", F.lit("")).alias("text"))), F.slice("turns", size - place + 2, size))).otherwise(F.col("turns"))
    return groups.unionByName(alone.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected")))


PAIRS_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END) AS score, max(CASE WHEN p = 1 THEN role || chr(10) || text END) AS opening,
  coalesce(max(CASE WHEN role = '{TRAINED}' THEN p END), 0) AS last FROM t GROUP BY conv_id),
k AS (SELECT *, count(*) OVER (PARTITION BY opening) AS size, first(conv_id) OVER (PARTITION BY opening ORDER BY score DESC, conv_id) AS best FROM v),
c AS (SELECT k.conv_id AS pair_id, t.p, t.role, t.text FROM k JOIN t ON t.conv_id = CASE WHEN size = 1 THEN k.conv_id ELSE best END WHERE size = 1 OR k.conv_id <> best),
r AS (SELECT k.conv_id AS pair_id, t.p, t.role, CASE WHEN size = 1 AND t.p = k.last THEN coalesce(o.text, '') ELSE t.text END AS text
  FROM k JOIN t USING (conv_id) LEFT JOIN v w ON w.conv_id = xor(k.conv_id, 1) LEFT JOIN t o ON o.conv_id = w.conv_id AND o.p = w.last WHERE size = 1 OR k.conv_id <> best),
x AS (SELECT pair_id, coalesce(min(CASE WHEN c.role IS NULL OR r.role IS NULL OR c.role <> r.role OR c.text <> r.text THEN p END) - 1, count(*)) AS n FROM c FULL JOIN r USING (pair_id, p) GROUP BY pair_id),
f AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
g AS (SELECT side, pair_id, p, role, n, p <= n AS common, '{OPEN}' || role || '|>' || chr(10) || text || '{END}' || chr(10) AS s,
  coalesce(sum(CASE WHEN p > n THEN length(role) + length(text) + {len(OPEN) + len(CLOSE) + len(END) + 1} ELSE 0 END) OVER (PARTITION BY side, pair_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_,
  length(role) + {len(OPEN) + len(CLOSE)} AS head, length(text) + {len(END)} AS body FROM f JOIN x USING (pair_id)),
z AS (SELECT pair_id, n, side, coalesce(string_agg(s, '' ORDER BY p) FILTER (common), '') AS prompt, coalesce(string_agg(s, '' ORDER BY p) FILTER (NOT common), '') AS rest,
  coalesce(string_agg(CAST(off_ + head AS BIGINT) || '-' || CAST(off_ + head + body AS BIGINT), ',' ORDER BY p) FILTER (NOT common AND role = '{TRAINED}'), '') AS mask FROM g GROUP BY pair_id, n, side)
SELECT pair_id, n::BIGINT AS n_prefix, a.prompt, a.rest AS chosen, a.mask AS chosen_mask, b.rest AS rejected, b.mask AS rejected_mask
FROM (SELECT * FROM z WHERE side = 'c') a JOIN (SELECT pair_id, rest, mask FROM z WHERE side = 'r') b USING (pair_id)
"""
