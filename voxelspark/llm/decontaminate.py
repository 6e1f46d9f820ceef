r"""Benchmark decontamination with a broadcast set of n-gram hashes.

Texts are lower-cased in A-Z and cut into words of ASCII letters, digits and all characters beyond
ASCII.  A window is ``n`` consecutive words of a benchmark item, or a shorter item as a whole.
The windows of the benchmark are hashed into a sorted set that is broadcast; every document's windows
are looked up in it, and each hit is verified on its words.

The set is broadcast only up to ``block_bytes`` of benchmark text.  Beyond that the benchmark
is cut by item into blocks of about that size, each is held against all documents in turn, its hits are stored and its broadcast is
destroyed before the next is made; the hits of a row are then put together by a number of its own and joined to maximal runs, so memory stays
bounded for any benchmark and results are those of one block.

Null and empty texts have no words and no hits; empty items have no window.  Items with equal texts are
all reported.  Item ids are reported as strings, once each.  An item without an id hits like any other, so its words count and are cut; as there is nothing
to report it by, it is in no list of items and not counted in them.  Rows that repeat a doc_id, or have none, each keep their own
row and hits.  Empty tables of documents or items give empty results.  A text is held whole in one task with some sixty times its bytes of
working memory, as is the longest item.  Columns of other names are not read; :func:`remove_spans` passes them through, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import checkpoint, frugal, spare, stored, text_input

N, BLOCK_BYTES = 10, 32 << 20
_BITS = 20


class Windows:
    """The windows of one block of items as arrays: some 50 bytes a word and the text itself.

    The items' words are laid end to end with one space between them, so a window is a stretch of that text.  For each width there are the sorted
    hashes of the windows and, beside them, their first words.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int) -> None:
        texts, counts = [], []
        for _, text in items:
            data = K.LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
            w = K.words(data, np.array([0, len(data)]), K.WORD_BYTES)
            raw = data.tobytes()
            texts += [raw[a:b] for a, b in zip(w.start, w.end)]
            counts.append(len(w.start))
        self.text, count = b" ".join(texts), np.array(counts, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.item, self.names = np.repeat(np.arange(len(items), dtype=np.int32), count), [name for name, _ in items]
        data = np.frombuffer(self.text, np.uint8)
        prefix = K.Prefix(K.Prefix(data).of(self.start, self.end))
        first, width = np.cumsum(count) - count, np.minimum(count, n)
        self.sorted, self.at, self.seen = {}, {}, {}
        for k in np.unique(width[width > 0]).tolist():
            at = K.ranges(first[width == k], count[width == k] - k + 1)
            h = prefix.of(at, at + k)
            order = np.lexsort((self.item[at], h))
            h, at = h[order], at[order]
            once = np.ones(len(h), bool)  # of an item's equal windows the first; of different ones with one hash, all
            once[1:] = (h[1:] != h[:-1]) | (self.item[at[1:]] != self.item[at[:-1]]) | np.array([self._words(x, k) != self._words(y, k) if same else True for x, y, same in zip(at[1:].tolist(), at[:-1].tolist(), (h[1:] == h[:-1]).tolist())], bool)
            self.sorted[k], self.at[k] = h[once], at[once]
            self.seen[k] = np.zeros(1 << _BITS, bool)
            self.seen[k][(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _words(self, first: int, width: int) -> bytes:
        return self.text[self.start[first] : self.end[first + width - 1]]

    def hits(self, data: np.ndarray, w: K.Words) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, width, items) of each window that occurs."""
        if not self.sorted or not len(w.start):
            return
        prefix = K.Prefix(K.Prefix(data).of(w.start, w.end))
        for width, hashes in self.sorted.items():
            h = prefix.sliding(width)
            at = np.flatnonzero(self.seen[width][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[w.doc[at] == w.doc[at + width - 1]]
            low = np.searchsorted(hashes, h[at])
            found = hashes[np.minimum(low, len(hashes) - 1)] == h[at]
            at, low = at[found], low[found]
            high = np.searchsorted(hashes, h[at], "right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                text = b" ".join(data[w.start[k] : w.end[k]].tobytes() for k in range(i, i + width))
                if items := {self.names[self.item[k]] for k in self.at[width][a:b].tolist() if self._words(k, width) == text}:
                    yield i, width, items


_ROW = "n_words long, item_ids array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"


def _scan(windows):
    """Hits of each row: words [first, last) and bytes [start, end) of each maximal run of hit words."""
    spans_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            counts, items_of, spans_of = [], [], []
            for s in K.slices(batch.column("text")):
                data = K.LOWER[s.data]
                w = K.words(data, s.offsets, K.WORD_BYTES)
                items: dict[int, set[str | None]] = defaultdict(set)
                hit = np.zeros(len(w.start) + 1, np.int32)
                for i, width, found in known.hits(data, w):
                    items[int(w.doc[i])] |= found
                    hit[i] += 1
                    hit[i + width] -= 1
                spans: dict[int, list] = defaultdict(list)
                if items:
                    inside = np.cumsum(hit[:-1]) > 0
                    for doc in items:
                        a, b = w.first[doc], w.first[doc + 1]
                        for x, y in zip(*K.runs(inside[a:b])):
                            base = s.offsets[doc]
                            spans[doc].append({"first": int(x), "last": int(y), "start": int(w.start[a + x] - base), "end": int(w.end[a + y - 1] - base)})
                counts.append(np.diff(w.first))
                items_of += [sorted(x for x in items.get(i, ()) if x is not None) for i in range(s.rows)]
                spans_of += [spans.get(i, []) for i in range(s.rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(items_of, pa.list_(pa.string())), pa.array(spans_of, spans_type)],
                ["doc_id", "n_words", "item_ids", "spans"],
            )

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _number(items: DataFrame, block_bytes: int) -> int:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return -(-size // block_bytes) or 1


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Windows]:
    items = _items(benchmark)
    blocks = _number(items, block_bytes)
    for i in range(blocks):
        rows = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        yield Windows([(r["item"], r["text"]) for r in rows.collect()], n)


def _broadcasts(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Broadcast]:
    return map(benchmark.sparkSession.sparkContext.broadcast, _blocks(benchmark, n, block_bytes))


def _numbered(rows: DataFrame, name: str = "_row") -> DataFrame:
    """Rows with a number of their own; stored, as it would not be the same when computed again."""
    return checkpoint(rows.withColumn(name, F.monotonically_increasing_id()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Item ids once each, and spans of several blocks that overlap or touch as one."""
    for batch in batches:
        items = [sorted(set(x)) for x in batch.column("item_ids").to_pylist()]
        spans = []
        for found in batch.column("spans").to_pylist():
            runs: list[dict] = []
            for s in sorted(found, key=lambda s: s["first"]):
                if runs and s["first"] <= runs[-1]["last"]:
                    runs[-1] |= {k: max(runs[-1][k], s[k]) for k in ("last", "end")}
                else:
                    runs.append(s)
            spans.append(runs)
        columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(items, batch.column("item_ids").type), pa.array(spans, batch.column("spans").type)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "item_ids", "spans"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, item_ids`` (sorted strings) and ``spans`` (maximal runs of hit words) for each row."""
    rows, blocks = text_input(docs, key, text), _number(_items(benchmark), block_bytes)
    several = blocks > 1
    if several:
        rows = _numbered(rows).select(F.struct("_row", "doc_id").alias("doc_id"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_ROW}"
    parts = []
    for windows in _broadcasts(benchmark, n, block_bytes):
        part = rows.mapInArrow(frugal(_scan(windows)), schema)
        if not several:
            return part
        # a row without hits is needed once, for its number of words; then the block's windows can go
        parts.append(stored(part.filter(F.size("spans") > 0) if parts else part))
        windows.destroy()
    both = reduce(DataFrame.unionByName, parts)
    items, spans = (F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "spans"))
    met = both.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), items, spans)
    return met.mapInArrow(frugal(_joined), schema).select("doc_id.doc_id", "n_words", "item_ids", "spans")


def n_hit(spans: str = "spans"):
    """Number of different words inside spans, which may overlap when they come from several blocks."""
    words = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"] - 1))))
    return F.size(words).cast("long")


def _without(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    out = []
    for t, spans in zip(batch.column("text").to_pylist(), found):
        if spans:
            raw, at, kept = t.encode("utf-8"), 0, []
            for s in spans:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            t = b"".join([*kept, raw[at:]]).decode("utf-8")
        out.append(t)
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns["text"] = pa.array(out, columns["text"].type)
    if "n_chars" in columns:
        columns["n_chars"] = pa.array([len(t or "") for t in out], columns["n_chars"].type)
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _cut(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_batch = _scan(windows)
        for batch in batches:
            texts = batch.column("text")
            view = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
            yield _without(batch, [x for hits in scan_batch([view]) for x in hits.column("spans").to_pylist()])

    return run


def _cut_found(held: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _without(batch.drop_columns([held]), batch.column(held).to_pylist())

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their columns, without the hit spans; ``n_chars`` follows the text.

    Spans of all blocks are found on the text as it came and cut at once.
    """
    if _number(_items(benchmark), block_bytes) == 1:
        return docs.mapInArrow(frugal(_cut(next(_broadcasts(benchmark, n, block_bytes)))), docs.schema)
    row, of, held = (spare(name, docs) for name in ("_row", "_of", "_spans"))
    rows = _numbered(docs, row)
    spans = scan(rows, benchmark, n, block_bytes, row).filter(F.size("spans") > 0).select(F.col("doc_id").alias(of), F.col("spans").alias(held))
    joined = rows.join(spans, F.col(row) == F.col(of), "left").select(*[F.col(f"`{c}`") for c in docs.columns], held)
    return joined.mapInArrow(frugal(_cut_found(held)), docs.schema)


#: DuckDB's SQL for the query's columns.
def _lowered(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


SCAN_SQL = f"""
WITH d AS ({_lowered("documents", "doc_id")}), b AS ({_lowered("benchmark", "item_id")}),
items AS (SELECT item_id, w, least(len(w), {N}) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM wins),
found AS (SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d, sizes s WHERE i + s.n - 1 <= len(w)),
hits AS (SELECT f.doc_id, f.i, f.n, item_id FROM found f JOIN wins USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
