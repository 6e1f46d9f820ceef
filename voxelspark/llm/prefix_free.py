"""Suffix-array dedup by prefix-free parsing, over bytes.

A rolling hash marks triggers, and the text around each trigger makes a phrase (see :mod:`repeats`): the
*parse* is the list of phrases of each document, the *dictionary* the distinct ones.  The mark is local - the least
gram of some ``window`` bytes - and not a remainder of the hash, so that no window is without a trigger and no phrase outgrows two windows;
phrases overlap by a window less one byte, so the first ``window`` bytes of every suffix of the corpus lie in one phrase.

As in prefix-free parsing, the order of the corpus's suffixes comes from the two small parts.  The *dictionary's suffix array*
is built by blocks of triggers (:func:`suffix_order`), by sorting bytes and doubling, to a depth of ``window`` bytes; equal windows have equal
triggers, so they meet in one block.  The *parse* gives each dictionary suffix the list of its places in the corpus, in order of
(doc_id, start): suffixes are ordered by the dictionary and, among equal ones, by the parse.  Neighbours in this order that
share ``window`` bytes are repeats: a phrase that the parse has twice or more settles all of its suffixes at once, others do so where the
dictionary's order has an equal neighbour.  Suffixes that agree on ``window`` bytes are not ordered by what follows, as nothing here asks for it,
so the parse needs no suffix ranks of its own.

:func:`dedup` removes every byte covered by a string of ``window`` bytes that also starts anywhere else, the first
copy too; overlaps count and matches never cross documents.  :func:`remove_repeats` keeps the first place of each string.

Null and empty texts are empty; an empty table gives an empty result.  Texts shorter than a window stay whole.  Rows that
repeat a doc_id, or have none, are documents of their own; in :func:`remove_repeats` rows that repeat doc_id and text are one place and stay
alike.  A text is held whole in one task, with some sixty times its bytes of working memory.  ``dedup`` reads doc_id and text alone;
columns of any other names pass through ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import frugal, spare, text_input
from voxelspark.llm.repeats import HOT, Unit, by_id, keyed, pieces, ranks, repeats, spread, stretches

UNIT = Unit("bytes", 200, 40)


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(high << np.int64(32) | low, return_inverse=True)[1]


def suffix_order(data: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at each start in the order of their first ``depth`` bytes, -1 if no other one has the same bytes.

    Ranks of all suffixes by eight bytes are doubled to a third of the depth or more; then the starts that still have an equal
    neighbour are ranked by stretches of that length.  Bytes are compared, not hashes.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    first = np.zeros(len(data), np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : k + len(data)]
    rank, have = np.unique(first, return_inverse=True)[1], 8
    while 4 * have <= depth:
        later = np.zeros_like(rank)
        later[:-have] = rank[have:]
        rank, have = _dense(rank, later), 2 * have
    out = np.full(len(start), -1, np.int64)
    alive, order = np.arange(len(start)), rank[start]
    for at in [*range(have, depth - have, have), depth - have, None]:
        more = np.bincount(order)[order] >= 2
        alive, order = alive[more], order[more]
        if at is not None and len(alive):
            order = _dense(order, rank[start[alive] + at])
    out[alive] = order
    return out


def _resolve(unit: Unit, earlier: bool):
    """Repeated windows of the phrases that the parse has once, or with ``earlier`` of all but their first place."""

    def resolve(table: pa.RecordBatch) -> pa.RecordBatch:
        x = spread(table, unit)
        order = suffix_order(x.values, x.start, unit.window)
        at = np.flatnonzero(order >= 0)
        if earlier:
            place = ranks(table)[x.row]
            array = at[np.lexsort((x.s[at], place[at], order[at]))]
            opens = np.append(True, order[array[1:]] != order[array[:-1]])[: len(array)]
            source = np.empty_like(x.row)
            source[array] = array[opens][np.cumsum(opens) - 1]
            first = source[at]
            at = at[(place[at] != place[first]) | (x.s[at] != x.s[first])]
            at, source = np.sort(at), source
        else:
            at, source = at[table.column("n").to_numpy()[x.row[at]] == 1], np.arange(len(x.row))
        row, s, of = x.row[at], x.s[at], source[at]
        first, last = stretches(row, s, x.row[of], x.s[of])
        return pieces(table, row[first], s[first], s[last], x.row[of[first]], x.s[of[first]])

    return resolve


def _keep(data: np.ndarray, found: list[dict], window: int) -> np.ndarray:
    keep = np.ones(len(data), bool)
    for p in found:
        keep[p["a"] : p["b"] + window] = False
    return keep


def _remove(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column("text")):
                sizes, removed, spans, kept = [], [], [], []
                for i, found in enumerate(batch.column("_pieces").slice(s.first, s.rows).to_pylist()):
                    data = s.data[s.offsets[i] : s.offsets[i + 1]]
                    keep = _keep(data, found or [], unit.window)
                    start, end = K.runs(~keep)
                    sizes.append(len(data))
                    removed.append(len(data) - int(keep.sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
                    kept.append(data[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return frugal(run)


def repeated(rows: DataFrame, unit: Unit, earlier: bool, hot: int) -> DataFrame:
    """``doc_id, v`` and ``_pieces``: first and last starts (a, b) of the windows to remove."""
    return repeats(rows, unit, earlier, _resolve(unit, earlier), hot).groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "b")).alias("_pieces"))


def dedup(docs: DataFrame, unit: Unit = UNIT, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans`` (byte ranges) and ``kept`` (binary) for each row."""
    rows = keyed(text_input(docs, key, text))
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    return by_id(rows, repeated(rows, unit, False, hot), "left").mapInArrow(_remove(unit), out)


def _cut(unit: Unit, held: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, found in zip(texts, batch.column(held).to_pylist()):
                if found:
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    keep = _keep(data, found, unit.window)
                    inner = (data & 0xC0) == 0x80  # a character goes only as a whole
                    first = np.flatnonzero(~inner)
                    whole = np.logical_or.reduceat(keep, first)
                    text = data[np.repeat(whole, np.diff(np.append(first, len(data))))].tobytes().decode("utf-8")
                out.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names if n != held}
            columns["text"] = pa.array(out, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t or "") for t in out], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return frugal(run)


def remove_repeats(docs: DataFrame, unit: Unit = UNIT, hot: int = HOT) -> DataFrame:
    """The documents with their columns, texts without bytes that repeat an earlier place; characters cut in part stay."""
    held = spare("_pieces", docs)
    found = repeated(keyed(text_input(docs)), unit, True, hot).select(F.struct("doc_id", "v").alias("_of"), F.col("_pieces").alias(held))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row).withColumn("_key", F.struct("_row.doc_id", F.hash(F.col("_row.text").cast("string")).alias("v")))
    met = F.col("_key.doc_id").eqNullSafe(F.col("_of.doc_id")) & (F.col("_key.v") == F.col("_of.v"))
    joined = rows.join(found, met, "left").select("_row.*", held)
    return joined.mapInArrow(_cut(unit, held), docs.schema)
