"""Ops 6 and 7 piece by piece: suffix order, greedy factors, hot triggers, repeated ids; all against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from voxelspark.llm import kernels as K
from voxelspark.llm import prefix_free, repeats, rlz


def words(n, rng):
    return " ".join("".join(rng.choice("aeioulnst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = [words(n, rng) for n in (30, 45, 80)]
    texts = [" ".join(rng.choice([*shared, words(25, rng)]) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts += ["ab " * 400, "x" * 900, "x" * 250, words(60, rng) + " " + "x" * 300, "", None, "é" * 400]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, words(70, rng)), (3, texts[8] + " " + words(30, rng)), (None, texts[2]), (None, words(50, rng)), (7, texts[7])]


def brute(rows, split, size):
    """Items of each row, and all places of each window that has several, rows in order of (doc_id, hash of the text)."""
    items = [split(t or "") for _, t in rows]
    places = collections.defaultdict(list)
    for k, found in enumerate(items):
        for s in range(len(found) - size + 1):
            places[tuple(found[s : s + size])].append((k, s))
    return items, [p for p in places.values() if len(p) > 1]


def covered(spots, size):
    gone = collections.defaultdict(set)
    for k, s in spots:
        gone[k] |= set(range(s, s + size))
    return gone


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_every_copy_goes_from_each_row(spark, corpus, hot):
    items, several = brute(corpus, lambda t: t.encode(), 200)
    gone = covered([p for spots in several for p in spots], 200)
    want = sorted((i if i is not None else -1, bytes(b for k, b in enumerate(items[r]) if k not in gone[r])) for r, (i, _) in enumerate(corpus))
    out = prefix_free.dedup(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.kept)) for r in out) == want
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept) for r in out)


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_later_copies_go(spark, corpus, hot):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    order = {(r.doc_id, r.text): k for k, r in enumerate(repeats.keyed(df).orderBy("doc_id", "v").collect())}
    rows = sorted(dict.fromkeys(corpus), key=order.get)
    some = [r for r in rows if r[0] is not None]
    items, several = brute(some, lambda t: t.encode().split(), 20)
    gone = covered([p for spots in several for p in sorted(spots)[1:]], 20)
    want = {r: b" ".join(w for k, w in enumerate(items[n]) if k not in gone[n]).decode() for n, r in enumerate(some)}
    left = collections.Counter((i, want.get((i, t), " ".join((t or "").split()))) for i, t in corpus)
    out = rlz.dedup(df, hot=hot).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in out) == left
    assert all(f.length >= 20 for r in out for f in r.factors) and any(r.factors for r in out)

    items, several = brute(rows, lambda t: t.encode(), 200)
    gone = covered([p for spots in several for p in sorted(spots)[1:]], 200)
    kept = {r: len(items[n]) - len(gone[n]) for n, r in enumerate(rows)}
    cut = prefix_free.remove_repeats(df.selectExpr("doc_id", "text", "text AS _pieces", "doc_id AS v"), hot=hot)
    assert cut.columns == ["doc_id", "text", "_pieces", "v"]
    for r in cut.collect():
        assert abs(len((r.text or "").encode()) - kept[r.doc_id, r._pieces]) <= ("é" in (r.text or "")) * 8


def test_suffix_order_sorts_bytes():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 100, 3000), np.zeros(300, int), np.full(500, 97), rng.integers(0, 256, 800)]).astype(np.uint8)
    data[1500:2100] = data[100:700]
    start = np.arange(len(data) - 199)
    order = prefix_free.suffix_order(data, start, 200)
    keys = [data[s : s + 200].tobytes() for s in start]
    count = collections.Counter(keys)
    assert [(o >= 0) for o in order] == [count[k] > 1 for k in keys]
    again = sorted((k, o) for k, o in zip(keys, order) if o >= 0)
    assert [o for _, o in again] == sorted(o for _, o in again) and len({o for _, o in again}) == len({k for k, _ in again})


@pytest.mark.parametrize("bits", [64, 3])
def test_factors_are_greedy_and_hashes_may_collide(monkeypatch, bits):
    if bits < 64:
        real = K.Prefix.of
        monkeypatch.setattr(K.Prefix, "of", lambda self, a, b: real(self, a, b) & np.uint64((1 << bits) - 1))
    rng = random.Random(bits)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(4, 40))] for _ in range(30)]
    rows = [(k // 2, k, 0, np.array(t, np.uint64).tobytes()) for k, t in enumerate(texts)]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "v", "a", "content"]).cast(pa.schema([("doc_id", pa.int64()), ("v", pa.int32()), ("a", pa.int32()), ("content", pa.binary())]))
    width = 4
    x = repeats.spread(table, repeats.Unit("words", width, 2))
    a, b, of = rlz.factor(x, repeats.ranks(table)[x.row], width)
    seen, dup = {}, set()
    for k, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            if seen.setdefault(tuple(t[s : s + width]), (k, s)) != (k, s):
                dup.add((k, s))
    assert {(int(x.row[i]), int(x.s[i])) for p, q in zip(a, b) for i in range(p, q + 1)} == dup
    for p, q, o in zip(a, b, of):
        k, s, m, t = int(x.row[p]), int(x.s[p]), int(x.row[o]), int(x.s[o])
        size = int(q - p) + width
        assert texts[k][s : s + size] == texts[m][t : t + size] and (m, t) < (k, s)
        assert s + size == len(texts[k]) or t + size == len(texts[m]) or texts[k][s + size] != texts[m][t + size]
