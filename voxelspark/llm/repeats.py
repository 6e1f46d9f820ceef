r"""Routing for :mod:`rlz` (windows of words) and :mod:`prefix_free` (windows of bytes): phrases that can share a window meet.

A rolling hash runs over grams, shorter than a window.  Each window is dealt to the gram in it with the
least hash, its *trigger*; successive windows with one trigger make a *phrase*: the text from the
first window's start to the last window's end.  Triggers and phrases depend only on the text inside, so
equal windows have equal triggers, wherever they are, and every window lies in a phrase.  Thus:

* a trigger found once in the corpus has only windows that occur once: most of a corpus ends here;
* phrases found twice or more (their *copies*) hold only windows that do;
* the other phrases with a repeated trigger - the ends of repeats - are left to the two operators, which get one copy of each
  distinct phrase, with its content, by trigger.

Rows shuffled are one a phrase (about half of ``window - gram`` items), then one for each repeated phrase, and the items of
the distinct phrases at ends of repeats.  A task streams over triggers and holds some of them at a time.  A trigger with more than ``hot``
distinct phrases is not gathered: its windows become rows, counted before their shuffle.  So do all other counts; rows meet counts in joins,
which Spark splits where a key is hot.

Phrases are equal if their trigger's and their own hash are, windows as rows if two hashes are: 128 bits each.  Rows are
known by doc_id and a hash of their text, as a doc_id may be missing or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import frugal, release, stored


class Unit(NamedTuple):
    """What a window is made of."""

    kind: str  # "words" or "bytes"
    window: int
    gram: int


#: Distinct phrases that one trigger may have in one task; windows in a phrase; items that are resolved at a time.
HOT, LONGEST, AT_ONCE = 4096, 1 << 14, 1 << 19
KEY = ["doc_id", "v"]
A_BITS = 18  # below a phrase's first window: 16 bits for its windows less one, 2 for its trigger's number


def keyed(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``v``, which tells rows with one doc_id apart."""
    return rows.select("doc_id", F.hash("text").alias("v"), "text")


def items(s: K.Slice, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """A slice's items, bytes or hashes of words, and the first one of each row (one more than rows)."""
    if unit.kind == "bytes":
        return s.data, s.offsets
    w = K.words(s.data, s.offsets, K.NOT_SPACE)
    return K.Prefix(s.data).of(w.start, w.end), w.first


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _phrases(unit: Unit):
    wide = unit.window - unit.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("doc_id"), batch.column("v")
            for s in K.slices(batch.column("text")):
                values, first = items(s, unit)
                prefix = K.Prefix(values)
                grams = prefix.sliding(unit.gram)
                low = K.sliding_min(grams, wide)
                number = np.maximum(np.diff(first) - unit.window + 1, 0)  # windows of each row
                start = K.ranges(first[:-1], number)
                if not len(start):
                    continue
                row = np.repeat(np.arange(s.rows), number)
                h = low[start]
                opens = np.ones(len(start), bool)
                opens[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(opens)
                size = np.diff(np.append(at, len(start)))
                if size.max() > LONGEST:  # a run of equal grams, cut anywhere: its windows keep their trigger
                    parts = -(-size // LONGEST)
                    at = np.repeat(at, parts) + LONGEST * K.ranges(np.zeros(len(parts), np.int64), parts)
                a, h, row = start[at], h[at], row[at]
                b = start[np.append(at[1:], len(start)) - 1]
                size = b - a + wide
                same = grams[K.ranges(a, size)] == np.repeat(h, size)
                times = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int32)
                take = pa.array(s.first + row)
                at = (a - first[row]) << A_BITS | (b - a) << 2 | np.minimum(times, 2)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(prefix.of(a, b + unit.window)), ids.take(take), v.take(take), pa.array(at)], ["h", "phrase", *KEY, "at"])

    return frugal(run)


def phrases(rows: DataFrame, unit: Unit) -> DataFrame:
    """The parse: ``h`` (trigger), ``phrase``, ``doc_id, v`` and ``at``: one number for its first window, its windows less one, and how
    often the trigger is in it, two at most."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_phrases(unit), f"h long, phrase long, doc_id {kind}, v int, at long")


def _a(at: str = "at") -> Column:
    return F.shiftright(at, A_BITS).cast("int")


def _b(at: str = "at") -> Column:
    return (_a(at) + F.shiftright(at, 2).bitwiseAND((1 << (A_BITS - 2)) - 1)).cast("int")


def _contents(unit: Unit):
    """The items of the phrases asked for: bytes, or hashes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            bounds = asked.offsets.to_numpy()
            fields = asked.values
            h, a, b, n, hot = (fields.field(i) for i in range(5))
            first_of, last_of = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            for s in K.slices(batch.column("text")):
                values, first = items(s, unit)
                low, high = bounds[s.first], bounds[s.first + s.rows]
                row = np.repeat(np.arange(s.rows), np.diff(bounds[s.first : s.first + s.rows + 1]))
                at = low + np.flatnonzero(last_of[low:high] + unit.window <= np.diff(first)[row])  # all, unless two texts of one id have one hash
                row, start = row[at - low], first_of[at]
                size = last_of[at] + unit.window - start
                data = values[K.ranges(first[row] + start, size)]
                offsets = np.concatenate(([0], np.cumsum(size * data.itemsize))).astype(np.int32)
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                of, pick = pa.array(s.first + row), pa.array(at)
                columns = [h.take(pick), batch.column("doc_id").take(of), batch.column("v").take(of), *[x.take(pick) for x in (a, b, n, hot)], content]
                yield pa.RecordBatch.from_arrays(columns, ["h", *KEY, "a", "b", "n", "hot", "content"])

    return frugal(run)


class Spread(NamedTuple):
    """All windows of some phrases: where each is in ``values``, its phrase and its place in the text."""

    values: np.ndarray
    first: np.ndarray  # of each phrase, and the number of values
    start: np.ndarray
    row: np.ndarray
    s: np.ndarray


def spread(table: pa.RecordBatch, unit: Unit) -> Spread:
    content = table.column("content")
    _, offsets, data = content.buffers()
    width = 1 if unit.kind == "bytes" else 8
    offsets = np.frombuffer(offsets, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64) // width
    values = np.frombuffer(data, np.uint8 if width == 1 else np.uint64)[offsets[0] : offsets[-1]]
    first = offsets - offsets[0]
    number = np.diff(first) - unit.window + 1
    start = K.ranges(first[:-1], number)
    row = np.repeat(np.arange(len(content)), number)
    return Spread(values, first, start, row, start - first[row] + table.column("a").to_numpy().astype(np.int64)[row])


def ranks(table: pa.RecordBatch) -> np.ndarray:
    """Rank of each phrase's text among those of the table, by doc_id (null first) and v."""
    ids = table.select(KEY)
    order = pc.sort_indices(ids, sort_keys=[(k, "ascending") for k in KEY], null_placement="at_start").to_numpy()
    code = pc.fill_null(ids.column("doc_id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[order]
    v = ids.column("v").to_numpy()[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(True, (code[1:] != code[:-1]) | (v[1:] != v[:-1])) if len(order) else order)
    return rank


PIECE = "v int, a int, b int, source_v int, source_a int"


def pieces(table: pa.RecordBatch, row: np.ndarray, a: np.ndarray, b: np.ndarray, source: np.ndarray, source_a: np.ndarray) -> pa.RecordBatch:
    """Stretches [a, b] of windows of some phrases, and the place of the first one's content."""
    here, there = (table.select(KEY).take(pa.array(x)) for x in (row, source))
    return pa.RecordBatch.from_arrays(
        [here.column("doc_id"), here.column("v"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), there.column("doc_id"), there.column("v"), pa.array(source_a.astype(np.int32))],
        ["doc_id", "v", "a", "b", "source", "source_v", "source_a"],
    )


def stretches(row: np.ndarray, s: np.ndarray, source: np.ndarray, source_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the maximal runs in which phrase, window and source go on together."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1) | (source[1:] != source[:-1]) | (source_s[1:] != source_s[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(row))[: len(first)] - 1


def by_trigger(resolve):
    """Over rows sorted by trigger: whole triggers together, about ``AT_ONCE`` items at a time, given to ``resolve``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last trigger may go on
            if cut or (held and held[-1].column("h")[-1].as_py() != h[0]):
                held.append(batch.slice(0, cut))
                yield _joined(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            h = table.column("h").to_numpy()
            opens = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.cumsum(pc.binary_length(table.column("content")).to_numpy())
            before = (size - size[0])[opens] // AT_ONCE
            cuts = [*opens[np.append(True, before[1:] != before[:-1])], len(h)]
            for i, j in zip(cuts, cuts[1:]):
                yield resolve(table.slice(i, j - i))

    return frugal(run)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _windows(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = spread(part, unit)
                end, row = x.start + unit.window, pa.array(x.row)
                other = K.Prefix(K.mix(x.values.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [_signed(K.Prefix(x.values).of(x.start, end)), _signed(other.of(x.start, end)), part.column("doc_id").take(row), part.column("v").take(row), pa.array(x.s.astype(np.int32)), part.column("n").take(row)],
                    ["w", "w2", "doc_id", "v", "s", "n"],
                )

    return frugal(run)


def same(key: str = "doc_id", v: str = "v", other: str = "_id", other_v: str = "_v"):
    return F.col(key).eqNullSafe(F.col(other)) & (F.col(v) == F.col(other_v))


def by_id(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, null ids too, and v.  All such joins shuffle the texts alike, so within a query Spark does it once."""
    other = more.withColumnsRenamed({"doc_id": "_id", "v": "_v"})
    return rows.join(other, same(), how).drop("_id", "_v")


def _hot(windows: DataFrame, earlier: bool) -> DataFrame:
    """The pieces of windows as rows."""
    here = [F.col("s").alias("a"), F.col("s").alias("b")]
    if earlier:
        index = windows.groupBy("w", "w2").agg(F.min(F.struct("doc_id", "v", "s")).alias("first"), F.count("*").alias("places")).filter("places >= 2")
        later = windows.join(index, ["w", "w2"]).filter("struct(doc_id, v, s) > first")
        return later.select("doc_id", "v", *here, F.col("first.doc_id").alias("source"), F.col("first.v").alias("source_v"), F.col("first.s").alias("source_a"))
    classes = windows.groupBy("w", "w2").agg(F.sum("n").alias("all")).filter("all >= 2").select("w", "w2")
    return windows.filter("n = 1").join(classes, ["w", "w2"]).select("doc_id", "v", *here, F.col("doc_id").alias("source"), F.col("v").alias("source_v"), F.col("s").alias("source_a"))


def repeats(rows: DataFrame, unit: Unit, earlier: bool, resolve, hot: int = HOT, known: bool = False) -> DataFrame:
    """Windows that occur elsewhere too or, with ``earlier``, at an earlier place (doc_id, v, start).

    ``rows``: see :func:`keyed`.  ``resolve``: record batch of the distinct phrases of some triggers (``h, doc_id, v, a, b, n, content``) to
    pieces.  ``known``: rows without a doc_id take no part.  Gives stretches: ``doc_id, v``, first and last window ``a`` and ``b``, and where the first one's content is from, ``source,
    source_v, source_a``.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    parse = phrases(rows.filter("doc_id IS NOT NULL") if known else rows, unit)
    repeated = parse.groupBy("h").agg(F.sum(F.col("at").bitwiseAND(3)).alias("all")).filter("all >= 2").select("h")
    held = stored(parse.join(repeated, "h"))
    release(rows)
    place = F.struct("doc_id", "v", "at")
    dictionary = held.groupBy("h", "phrase").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(F.col("at").bitwiseAND(3)).alias("times"))
    copies = held.join(dictionary.filter("n >= 2").select("h", "phrase", "first"), ["h", "phrase"])
    copies = copies.filter("struct(doc_id, v, at) > first") if earlier else copies
    copies = copies.select("doc_id", "v", _a().alias("a"), _b().alias("b"), F.col("first.doc_id").alias("source"), F.col("first.v").alias("source_v"), _a("first.at").alias("source_a"))
    several = dictionary.groupBy("h").agg(F.count("*").alias("different"), F.max("times").alias("times")).filter("different >= 2 OR times >= 2").select("h", (F.col("different") > hot).alias("hot"))
    asked = dictionary.join(several, "h").select("h", "first.doc_id", "first.v", _a("first.at").alias("a"), _b("first.at").alias("b"), "n", "hot")
    lists = asked.groupBy("doc_id", "v").agg(F.collect_list(F.struct("h", "a", "b", "n", "hot")).alias("asked"))
    # rows that repeat both doc_id and text hold the same content: any one of them serves
    ends = by_id(rows, lists, "inner").mapInArrow(_contents(unit), f"h long, doc_id {kind}, v int, a int, b int, n long, hot boolean, content binary")
    few = ends.filter("NOT hot").repartition("h").sortWithinPartitions("h").mapInArrow(by_trigger(resolve), f"doc_id {kind}, v int, a int, b int, source {kind}, source_v int, source_a int")
    many = ends.filter("hot").mapInArrow(_windows(unit), f"w long, w2 long, doc_id {kind}, v int, s int, n long")
    return copies.unionByName(few).unionByName(_hot(many, earlier))
