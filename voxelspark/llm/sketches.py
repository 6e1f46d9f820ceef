"""MinHash near-duplicates by fast similarity sketching.

A sketch of t bins is filled in rounds.  In each of the first t rounds every shingle is put into one bin by that round's
hash; in round t + b all go to bin b.  A bin keeps its least value, and later rounds only have greater ones, so a text is done
when all its bins are full: after one or two rounds for a long text, and never without all bins full.  As the shingles of a round fall into different
bins, each wins about its share of them, and the part of bins in which two sketches differ keeps closer to the distance of the
sets than that of t independent minima.

1. One pass over the texts makes the sketch, in bands of a few bins, and the size of the set of distinct shingles.
2. Banding, exact verification on the full sets, and components as in :mod:`near_duplicates`: in each bucket all members meet a leader, and
   those that are still apart meet all others by blocks, so no link that banding offers is lost.  Texts with the same words are one class and
   never pairs of each other.  Bands and rows are chosen for ``RECALL`` at the threshold as if bins were independent.

A set: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in distinct shingles of three; a shorter text is one shingle.  Shingles are compared by 64-bit hashes.

Null texts and texts without words have empty sets and are linked with nothing.  A null doc_id counts after all others: where a whole component has no
other, ``component_id`` is null and ``kept`` true.  Rows that repeat a doc_id and its text are copies and share a component; a doc_id with two texts stands in both components.
An empty table gives no rows.  A very long text is one slice of one task, with some sixty times its bytes.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import checkpoint, frugal, text_input
from voxelspark.llm.near_duplicates import RECALL, Shape, bands_for, classes_of, fingerprints, shingles

#: Links: 100 * intersection >= 85 * union.  A violation is 0.05 at least, so the slack below cannot make or lose one by rounding.
PERCENT, SLACK = 85, 1e-9
SHAPE = Shape(3, K.NOT_SPACE)
_SEED, _OPEN = 12, np.iinfo(np.uint64).max


def fast_sketch(grams: np.ndarray, number: np.ndarray, bins: int) -> np.ndarray:
    """Sketches (rows, bins) of sets of hashes, end to end; ``number`` has their sizes, none empty."""
    rng = np.random.default_rng(_SEED)
    salt = rng.integers(0, 2**63, 2 * bins, dtype=np.uint64)
    held = np.full(len(number) * bins, _OPEN, np.uint64)
    text = np.repeat(np.arange(len(number)), number)
    for turn in range(2 * bins):
        h = K.mix(grams ^ salt[turn])
        at = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(held, text * bins + at, np.uint64(turn << 32) | (h & np.uint64(0xFFFFFFFF)))
        filling = (held.reshape(-1, bins) == _OPEN).any(1)[text]
        if not filling.any():
            break
        grams, text = grams[filling], text[filling]
    return held.reshape(-1, bins)


def _sketched(shape: Shape, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column("text")):
                grams, number, whole, count = shingles(s, shape)
                sets = [np.unique(part) for part in np.split(grams, np.cumsum(number)[:-1])]
                size = np.array([len(x) for x in sets])
                some = size > 0
                keys = np.zeros((int(some.sum()), bands), np.uint64)
                if len(keys):
                    sketch = fast_sketch(np.concatenate(sets), size[some], bands * rows).reshape(-1, bands, rows)
                    keys += np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        keys = K.mix(keys ^ sketch[:, :, k])
                offsets = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), fingerprints(whole, count), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "fp", "n_shingles", "bands"],
                )

    return run


def near_duplicates(docs: DataFrame, shape: Shape = SHAPE, percent: int = PERCENT, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` (least doc_id that links reach), ``kept`` (true for that one)."""
    rows = text_input(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    threshold = percent / 100 - SLACK
    signed = checkpoint(rows.mapInArrow(frugal(_sketched(shape, *bands_for(threshold, recall))), f"doc_id {kind}, fp long, n_shingles long, bands array<long>"))
    owner = classes_of(signed, rows, shape, threshold, links=False).select("fp", "class_fp", "class_id")
    out = signed.select("doc_id", "fp", "n_shingles").join(owner, "fp", "left")
    component = F.when(F.col("class_fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
