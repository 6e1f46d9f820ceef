"""Fast sketches, and the near-duplicates that rest on them, against full sets of all pairs."""

import os
import random
import re

import numpy as np
import pytest

from voxelspark.llm import sketches

DATA = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, n_shingles string, fp int, kept string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def all_pairs(rows):
    """Sets, and the least id that links reach from each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min((x for x in (i, least.get(top(k))) if x is not None), default=None)
    return sets, [least[top(k)] for k in range(len(rows))]


def families(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnstrm") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for size in (3, 6, 9, 12, 40, 90, 200, 60):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.randint(4, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).capitalize() + rng.choice(["", " ", "\n"])))
    chain = [rng.choice(vocabulary) for _ in range(300)]  # each links the next, the ends are apart
    rows += [(500 - k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(30)]
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two Words"), (904, " \t"), (905, "é\x1fü é\x1fü É\x1fü"), (906, "x " * 5000), (907, "x x x")]
    rows += [(0, rows[0][1]), (3, rows[3][1]), (3, rows[40][1]), (None, rows[50][1]), (None, "alone without an id")]
    return rows


def test_components_equal_all_pairs(spark):
    rows = families()
    sets, component = all_pairs(rows)
    out = sketches.near_duplicates(spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out], key=key) == sorted([(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, component)], key=key)
    assert sketches.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_at_the_very_threshold(spark):
    base = [f"w{i}" for i in range(102)]  # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:87])), (3, " ".join([f"v{i}" for i in range(102)])), (4, " ".join([f"v{i}" for i in range(86)]))]  # 85 and 84 of 100
    out = {r.doc_id: r.component_id for r in sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for size in (1, 2, 7, 30, 1000):
        a, b = pool[:size], np.concatenate((pool[: size - size // 5], pool[2000 : 2000 + size // 5]))
        x, y = sketches.fast_sketch(np.concatenate((a, b)), np.array([size, size]), 100)
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (x != sketches._OPEN).all() and abs((x == y).mean() - jaccard) < 0.15
        alone = sketches.fast_sketch(b, np.array([size]), 100)[0]
        assert (alone == y).all()  # what else is in the slice does not matter
    disjoint = sketches.fast_sketch(pool[:60], np.array([30, 30]), 100)
    assert (disjoint[0] == disjoint[1]).mean() < 0.1


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_given_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(DATA)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _, component = all_pairs(rows)
    out = {r.doc_id: r.component_id for r in sketches.near_duplicates(docs).collect()}
    assert out == {i: c for (i, _), c in zip(rows, component)}
