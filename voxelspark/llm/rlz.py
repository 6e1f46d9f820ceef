r"""Substring dedup by relative Lempel-Ziv parsing.

Words are ``[^\x20\x09-\x0D]+``; a window is 20 of them.  The reference is the corpus itself, in order of (doc_id, start), with each phrase
kept at its first place (see :mod:`repeats`); its *blocks* are the hash partitions of the phrases' triggers.  A document's
phrases are dealt to the blocks that can hold a window of theirs, so it is factored against every block that shares
anything with it and no task holds more than its share.

A block is indexed by the hashes of its windows, each with its first place.  A phrase is parsed greedily from left to right
(:func:`factor`): a factor begins at the next window that the index has at an earlier place; that hit is verified on its words, and the factor
grows word by word for as long as it equals the reference from there on.  Windows that cross a factor's end are checked by
themselves, so the next factor may begin inside the last 19 words of the one before.  A phrase that is in the reference as a whole is one factor.
A document's factors are put together from left to right, over the boundaries of phrases, and the words that they cover are duplicates and go.

Null and empty texts have no words; an empty table gives an empty result.  Rows that repeat doc_id and text are one document: a window is
not earlier than itself; of rows that repeat a doc_id alone the text's hash sets the order.  Rows without an id lose nothing and
are no reference.  Texts of under 20 words stay whole.  A text is held whole in one task, with some sixty times its bytes of working memory.
Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import frugal, text_input
from voxelspark.llm.repeats import HOT, Spread, Unit, by_id, keyed, pieces, ranks, repeats, spread, stretches

UNIT = Unit("words", 20, 5)


def indexed(x: Spread, place: np.ndarray, width: int) -> np.ndarray:
    """For each window the one with the same words that comes first by (place, start), verified word by word."""
    h = K.Prefix(x.values).of(x.start, x.start + width)
    order = np.lexsort((x.s, place, h))
    opens = np.append(True, h[order[1:]] != h[order[:-1]])[: len(order)]
    source = np.empty_like(order)
    source[order] = order[opens][np.cumsum(opens) - 1]
    good = np.ones(len(source), bool)
    at = np.flatnonzero(source != np.arange(len(source)))
    for k in range(width):
        good[at] &= x.values[x.start[at] + k] == x.values[x.start[source[at]] + k]
    if not good.all():  # two windows of one hash: their words are the key
        index: dict[bytes, int] = {}
        for i in order[np.isin(h[order], h[~good])].tolist():
            source[i] = index.setdefault(x.values[x.start[i] : x.start[i] + width].tobytes(), i)
    return source


def factor(x: Spread, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all phrases against the reference: first and last window, and the window where the content is from."""
    source = indexed(x, place, width)
    hit = np.flatnonzero((place != place[source]) | (x.s != x.s[source]))
    of = source[hit]
    first, last = stretches(x.row[hit], x.s[hit], x.row[of], x.s[of])
    a, b, of = hit[first], hit[last], of[first]
    end = x.first[1:]
    touches = np.append((x.row[a[1:]] == x.row[b[:-1]]) & (a[1:] == b[:-1] + 1), False)[: len(a)]
    kept = []
    at = 0
    while at < len(a):
        kept.append(at)
        stop = b[at]
        if touches[at]:  # the next window is from elsewhere; the factor may go on all the same
            p, q = x.start[a[at]], x.start[of[at]]
            room = int(min(end[x.row[a[at]]] - p, end[x.row[of[at]]] - q))
            differs = x.values[p : p + room] != x.values[q : q + room]
            stop = b[at] = max(stop, a[at] + (int(differs.argmax()) if differs.any() else room) - width)
        at += 1
        while at < len(a) and b[at] <= stop:
            at += 1
        if at < len(a) and a[at] <= stop:
            skip = stop + 1 - a[at]
            a[at] += skip
            of[at] += skip
    kept = np.array(kept, np.int64)
    return a[kept], b[kept], of[kept]


def _resolve(unit: Unit):
    def resolve(table: pa.RecordBatch) -> pa.RecordBatch:
        x = spread(table, unit)
        a, b, of = factor(x, ranks(table)[x.row], unit.window)
        return pieces(table, x.row[a], x.s[a], x.s[b], x.row[of], x.s[of])

    return resolve


def _parse(unit: Unit, kind: pa.DataType):
    fields = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", kind), ("source_start", pa.int32())])

    def factors(found: list[dict]) -> list[dict]:
        out: list[dict] = []
        for p in sorted(found, key=lambda p: (p["a"], -p["b"])):
            if out and (f := out[-1])["source"] == p["source"] and p["a"] - f["start"] == p["source_a"] - f["source_start"] and p["a"] <= f["start"] + f["length"]:
                f["length"] = max(f["length"], p["b"] + unit.window - f["start"])
            else:
                out.append({"start": p["a"], "length": p["b"] - p["a"] + unit.window, "source": p["source"], "source_start": p["source_a"]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column("text")):
                w = K.words(s.data, s.offsets, K.NOT_SPACE)
                parsed = [factors(p or []) for p in batch.column("_pieces").slice(s.first, s.rows).to_pylist()]
                removed, texts = [], []
                for i, found in enumerate(parsed):
                    x, y = w.first[i], w.first[i + 1]
                    keep = np.ones(y - x, bool)
                    for f in found:
                        keep[f["start"] : f["start"] + f["length"]] = False
                    removed.append(int((~keep).sum()))
                    raw = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()
                    texts.append(b" ".join(np.array(raw.split(), object)[keep]) if found else b" ".join(raw.split()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(parsed, pa.list_(fields))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "factors"],
                )

    return frugal(run)


def dedup(docs: DataFrame, unit: Unit = UNIT, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` and ``factors`` (start, length, source, source_start) for each row."""
    rows = keyed(text_input(docs, key, text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = repeats(rows, unit, True, _resolve(unit), hot, known=True).groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "b", "source", "source_a")).alias("_pieces"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = f"doc_id {kind}, n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,source:{kind},source_start:int>>"
    return by_id(rows, found, "left").mapInArrow(_parse(unit, arrow), out)


DEDUP_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS t, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
