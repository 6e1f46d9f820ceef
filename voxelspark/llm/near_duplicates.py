"""N-gram Jaccard join by MinHash banding.

Words are those of the decontamination (lower-cased ASCII letters and digits, all beyond ASCII); a text's set holds
its five-word shingles, or the whole of a shorter text.  Texts with the same words are one *class*, known by the
fingerprint of its words and not by a doc_id, which other texts may share; one row of each class is compared.

1. MinHash signatures in bands; the number of bands and rows is chosen for ``RECALL`` at the threshold (:func:`bands_for`).
2. Shuffle on band hashes.  In each bucket one member, different from bucket to bucket, leads; every other member makes
   a candidate pair with it, so a bucket of n gives n - 1 pairs.
3. Pairs are verified on the full sets, and links make components.  A group of near copies has many times more links than members, so each member first
   stands for its least neighbour, and the rounds of the components go over what links are left between these.
4. In buckets that still hold several components, the members outside of the largest one are verified against all, in
   blocks of ``BLOCK`` members: a task holds two blocks, and only links that join components leave it, as pairs of components.  So no link
   between components that banding offers is lost.
5. Links are counted inside each component, again by pairs of blocks; what leaves a task is a count for each member.

No pairs inside a group are emitted as rows, there is no cap on a bucket, and nothing but
the components' changed-label flag reaches the driver.  Counting links of a group is quadratic in its different texts by
its nature; it is spread over tasks of two blocks each.

Null texts and texts without words are classes of their own without links.  Rows that repeat a doc_id count
as one more copy.  An empty table gives an empty result.  A text is held whole in one task with some sixty times its bytes of working memory, and
its set of shingles is one row.  Columns of other names than doc_id and text are not read; :func:`keep_one` passes them through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import kernels as K
from voxelspark.llm.common import checkpoint, frugal, release, spare, stored, text_input
from voxelspark.operators.components import components

N, THRESHOLD, RECALL, MAX_HASHES, BLOCK = 5, 0.8, 0.99999, 128, 256
_SEED = 7


class Shape(NamedTuple):
    """What a text's set is made of: words of these bytes, ASCII letters lower-cased, in shingles of ``n``."""

    n: int = N
    word: np.ndarray = K.WORD_BYTES


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that keep the recall within the hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within the hashes has this recall")
    return best


def shingles(s: K.Slice, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, end to end, their number by row, the rows' word hashes and number of words."""
    data = K.LOWER[s.data]
    n, w = shape.n, K.words(data, s.offsets, shape.word)
    count = np.diff(w.first)
    prefix = K.Prefix(K.Prefix(data).of(w.start, w.end))
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = K.ranges(w.first[:-1], number)
    width = np.repeat(np.minimum(count, n), number)
    return prefix.of(start, start + width), number, prefix.of(w.first[:-1], w.first[1:]), count


def fingerprints(whole: np.ndarray, count: np.ndarray) -> pa.Array:
    """A number for the words of each text, null where there are none."""
    with np.errstate(over="ignore"):
        return pa.array(K.mix(whole + count.astype(np.uint64)).view(np.int64), mask=count == 0)


def _fingerprinted(shape: Shape, name: str):
    """Rows as they are, with the fingerprint of their text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column("text")):
                _, _, whole, count = shingles(s, shape)
                part = batch.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, fingerprints(whole, count)], [*part.schema.names, name])

    return run


def _signatures(shape: Shape, bands: int, rows: int):
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column("text")):
                grams, number, whole, count = shingles(s, shape)
                some = np.flatnonzero(number)
                first = (np.cumsum(number) - number)[some]
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        for band in range(bands):
                            key = np.full(len(some), band, np.uint64)
                            for k in range(band * rows, (band + 1) * rows):
                                key = K.mix(key ^ np.minimum.reduceat(grams * factor[k] + shift[k], first))
                            keys[:, band] = key
                offsets = np.concatenate(([0], np.cumsum(np.where(number > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.rows), fingerprints(whole, count), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "fp", "bands"],
                )

    return run


def _sets(shape: Shape):
    """The sets of the classes that a row is asked for; a row may share its doc_id with other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            for s in K.slices(batch.column("text")):
                grams, number, whole, count = shingles(s, shape)
                ends = np.cumsum(number)
                ids = fingerprints(whole, count).to_pylist()
                at = [i for i, x in enumerate(ids) if x in asked[s.first + i]]
                sets = [np.unique(grams[ends[i] - number[i] : ends[i]]).tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array(sets, pa.binary())], ["id", "grams"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                both = 0
                if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                good.append(both >= threshold * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return run


def _linked(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Matrix of the pairs whose sets reach the threshold."""
    size = np.array([len(x) for x in sets])
    value, index = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(index, minlength=len(value)) > 1
    number = np.cumsum(shared) - 1
    of = shared[index]
    index, member = number[index[of]], member[of]
    order = np.argsort(index, kind="stable")
    index, member = index[order], member[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(index, (at, at + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[member[a:b], index[a:b] - at] = 1
        both += part @ part.T
    return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3


def _compare(threshold: float, count: bool):
    """Links between the two blocks of a group: numbers by member, or as edges of components those that join them."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, label = table.column("id"), table.column("side").to_numpy(), table.column("label").to_pylist()
        weight = table.column("n").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        linked = _linked([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")], threshold)
        np.fill_diagonal(linked, False)
        if not count or i != j:
            linked &= side[:, None] != side[None, :]
        if count:
            return pa.table({"id": ids, "links": pa.array(linked @ weight, pa.int64())})
        parent = {x: x for x in label}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        src, dst = [], []
        for a, b in zip(*np.nonzero(np.triu(linked))):
            x, y = sorted((top(label[a]), top(label[b])))
            if x != y:
                parent[y] = x  # the least, so that tasks name the same ones
                src.append(x)
                dst.append(y)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (``g``, ``id``, ``label``, ``n``) dealt to all pairs of blocks of their group, with their sets."""
    sized = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sized, "g").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("g", "id", "label", "n", "own", other)
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "n", F.col("own").alias("side"))
    return dealt.join(sets, "id")


def _against_rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: those outside of the bucket's largest one against all."""
    sizes = members.groupBy("g", "label").agg(F.count("*").alias("c"))
    heads = sizes.groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    number = lambda c: F.ceil(c / BLOCK).cast("int")
    heads = heads.select("g", F.col("top.label").alias("main"), number(F.col("all")).alias("blocks"), number(F.col("all") - F.col("top.c")).alias("few"))
    placed = checkpoint(members.join(heads, "g"))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.col(n)).cast("int")
    rest = ["id", "label", "n"]
    every = placed.select("g", own("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("j"), *rest, F.lit(1).alias("side"))
    some = placed.filter("label <> main").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), own("few").alias("j"), *rest, F.lit(0).alias("side"))
    return every.unionByName(some).join(sets, "id")


def _grouped(edges: DataFrame) -> DataFrame:
    """``id, label`` (the least id of its component) for every end of an edge.

    Ends stand for their least neighbours first: edges between these join the same components, the least id of each is still there, and most
    edges of a dense group become one.
    """
    ends = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = stored(ends.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("near")))
    src, dst = (near.select(F.col("id").alias(end), F.col("near").alias(f"{end}_near")) for end in ("src", "dst"))
    fewer = edges.join(src, "src").join(dst, "dst").select(F.least("src_near", "dst_near").alias("src"), F.greatest("src_near", "dst_near").alias("dst"))
    found = components(fewer.filter("src <> dst").distinct()).select(F.col("node").alias("near"), F.col("component").alias("label"))
    return stored(near.join(found, "near", "left").select("id", F.coalesce("label", "near").alias("label")))


def classes_of(signed: DataFrame, rows: DataFrame, shape: Shape, threshold: float, links: bool) -> DataFrame:
    """``fp, first, class_fp, class_id`` for each class: its least doc_id, and the group's least one with its fingerprint; ``n_links``."""
    least = lambda at, fp: F.min(F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("doc_id"), F.col(fp).alias("fp")))
    classes = signed.filter("fp IS NOT NULL").groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = checkpoint(classes)
    buckets = classes.select("id", "n", F.explode("bands").alias("g"))
    leaders = buckets.groupBy("g").agg(F.min(F.struct(F.xxhash64("g", "id").alias("h"), "id"))["id"].alias("leader"), F.count("*").alias("members")).filter("members >= 2")
    held = checkpoint(buckets.join(leaders.drop("members"), "g"))
    wanted = classes.join(held.select("id").distinct(), "id", "left_semi").groupBy(F.xxhash64("first").alias("at")).agg(F.collect_list("id").alias("asked"))
    texts = rows.select(F.xxhash64("doc_id").alias("at"), "text").join(wanted, "at").select("text", "asked")
    sets = checkpoint(texts.mapInArrow(frugal(_sets(shape)), "id long, grams binary").dropDuplicates(["id"]))
    release(rows)
    pairs = held.filter("id <> leader").select(F.least("id", "leader").alias("src"), F.greatest("id", "leader").alias("dst")).distinct()
    left, right = sets.select(F.col("id").alias("src"), F.col("grams").alias("left")), sets.select(F.col("id").alias("dst"), F.col("grams").alias("right"))
    edges = checkpoint(pairs.join(left, "src").join(right, "dst").select("src", "dst", "left", "right").mapInArrow(frugal(_verify(threshold)), "src long, dst long"))
    release(rows)
    found = _grouped(edges)
    marked = held.join(found, "id", "left").select("g", "id", F.coalesce("label", "id").alias("label"), "n")
    groups = _against_rest(marked, sets)
    more = groups.groupBy("g", "i", "j").applyInArrow(_compare(threshold, False), "src long, dst long")
    again = components(more).select(F.col("node").alias("label"), F.col("component").alias("last"))
    alone = again.join(found.select(F.col("id").alias("label")), "label", "left_anti").select(F.col("label").alias("id"), F.col("last").alias("label"))
    found = stored(found.join(again, "label", "left").select("id", F.coalesce("last", "label").alias("label")).unionByName(alone))
    heads = classes.join(found, "id").groupBy("label").agg(least("first", "id").alias("head"))
    owner = classes.select("id", "first", "n").join(found.join(heads, "label"), "id", "left")
    owner = owner.select("id", "first", "n", F.coalesce("head.fp", "id").alias("class_fp"), F.when(F.col("head").isNull(), F.col("first")).otherwise(F.col("head.doc_id")).alias("class_id"))
    if links:
        inside = classes.select("id", "n").join(found, "id").select(F.col("label").alias("g"), "id", "label", "n")
        counts = _blocks(inside, sets).groupBy("g", "i", "j").applyInArrow(_compare(threshold, True), "id long, links long")
        counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
        owner = owner.join(counts, "id", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    return owner.select(F.col("id").alias("fp"), "first", "class_fp", "class_id", *(["n_links"] if links else []))


def _signed(rows: DataFrame, shape: Shape, threshold: float, recall: float) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    return checkpoint(rows.mapInArrow(frugal(_signatures(shape, *bands_for(threshold, recall))), f"doc_id {kind}, fp long, bands array<long>"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, links: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` (least doc_id of its group) and, with ``links``, ``n_links``: the documents that are linked to it."""
    rows = text_input(docs, key, text)
    signed = _signed(rows, Shape(n), threshold, recall)
    owner = classes_of(signed, rows, Shape(n), threshold, links)
    extra = ["n_links"] if links else []
    out = signed.select("doc_id", "fp").join(owner.select("fp", "class_id", *extra), "fp", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in extra])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with their columns, one row of each group: that of the least doc_id, and of its copies any one.

    A row is known by its doc_id and its words' fingerprint.  Where such a key is a group's first and several rows have it, one stays.
    Rows without words are no copies of each other and all stay.
    """
    rows = text_input(docs)
    signed = _signed(rows, Shape(), THRESHOLD, RECALL)
    keys = signed.filter("fp IS NOT NULL").groupBy("doc_id", "fp").agg(F.count("*").alias("copies"))
    owner = classes_of(signed, rows, Shape(), THRESHOLD, False).select("fp", "class_fp", "class_id")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("class_fp"))
    mark, id_, of = (spare(n, docs) for n in ("_fp", "_id", "_of"))
    verdicts = keys.join(owner, "fp").select(F.col("doc_id").alias(id_), F.col("fp").alias(of), stays.alias("stays"), "copies")
    verdicts = checkpoint(verdicts.filter("NOT stays OR copies > 1"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = docs.mapInArrow(frugal(_fingerprinted(Shape(), mark)), f"{fields}, {mark} long")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(of))
    alone = marked.join(verdicts.select(id_, of), same, "left_anti")
    repeated = verdicts.filter("stays").select(id_, of)
    if repeated.isEmpty():
        return alone.select(docs.columns)
    return alone.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark])).select(docs.columns)
