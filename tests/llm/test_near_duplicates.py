"""The Jaccard join against all pairs: groups, numbers of links, recall."""

import os
import random
import re

import pytest

from voxelspark.llm import near_duplicates

DATA = "/root/testdata/sf0.001/documents.parquet"


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def all_pairs(rows):
    """Links of each row by its place, and the least id of its group."""
    sets = [shingles(t) for _, t in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * (len(a) + len(b) - len(a & b)):
                links[i].add(j)
                links[j].add(i)
    group = [i for i, _ in rows]
    for _ in rows:
        for i, near in enumerate(links):
            group[i] = min([group[i], *[group[j] for j in near]])
    return links, group


def test_groups_and_links_equal_all_pairs(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioulnstrm") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).capitalize() + rng.choice(["", ".", " !"])))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two, words!"), (904, "- -")]
    links, group = all_pairs(rows)
    out = {r.doc_id: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [out[i].class_id for i, _ in rows] == group and [out[i].n_links for i, _ in rows] == [len(x) for x in links]


def test_a_dense_group_goes_through_the_rounds_as_few_edges(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnstrm") for _ in range(6))
    rows, handed = [], []
    for copies, edits in ((150, 1), (60, 4)):  # one group of near copies, and one that the threshold cuts to parts
        base = [word() for _ in range(150)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    components = near_duplicates.components

    def counted(edges):
        handed.append(edges.count())
        return components(edges)

    monkeypatch.setattr(near_duplicates, "components", counted)
    out = {r.doc_id: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    links, group = all_pairs(rows)
    assert [out[i].class_id for i, _ in rows] == group and [out[i].n_links for i, _ in rows] == [len(x) for x in links]
    assert len(set(group)) > 2 and sum(handed) < len(rows)  # some ten a row without the first step


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet(DATA)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links, _ = all_pairs(rows)
    out = {r.doc_id: r.n_links for r in near_duplicates.near_duplicates(docs).collect()}
    asked = [k for k, (i, _) in enumerate(rows) if i % 20 == 0]
    assert sum(out[i] for i, _ in rows) >= 0.9 * sum(map(len, links)) and sum(out[rows[k][0]] for k in asked) >= 0.9 * sum(len(links[k]) for k in asked)
