"""The filter audit against a replay one document at a time, and against its SQL."""

import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from voxelspark.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, part string, step int"
DATA = "/root/testdata/sf0.001"


def documents():
    many, few = " ".join(f"word{i}" for i in range(120)), "one two " * 80
    texts = [many, few, many.upper(), many + " #", few.upper() + "$", few, many, None, "", " \t\n\x0b", "LOUD " * 30, "É" * 12 + " é", "a\x1fb " * 100, many + " " + many]
    rows = [(i, t, lang, "clash", 9) for lang in ("en", "de", None, "") for i, t in enumerate(texts, 100 * len(lang or "abc"))]
    rows += [(5000 + i, many, "xx", None, None) for i in range(60)]  # a large group of copies
    rows += [(5003, many, "xx", None, None), (None, many, "xx", None, None), (None, "rare text of no one else", "xx", None, None), (1, "rare", "yy", None, None), (1, "rare", "yy", None, None)]
    rows += [(6000, "word " * 300_000, "yy", None, None)]
    return rows


def labels():
    return [(i, i % 2, int(i % 3 == 0)) for i in range(200, 215)] + [(5000, 1, 1), (5001, 0, 1), (5001, 1, 0), (5002, None, None), (None, 1, 1), (1, 1, None), (6000, 1, 0)]


def replayed(rows, told):
    good = {i for i, q, _ in told if q == 1 and i is not None}
    toxic = {i for i, _, t in told if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(Counter)
    for i, t, lang, *_ in rows:
        t, part = t or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t])) if bad}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c, removed = out[part, order, step], f in fails and not gone
                c["redundant"] += f in fails and gone
                gone = gone or removed
                c["kept"] += not gone
                c["removed"] += removed
                c["unique_fails"] += fails == {f}
                c["good_lost"] += removed and i in good
                c["toxic_lost"] += removed and i in toxic
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(part, order, step): (*[c[n] for n in names], total[part, order[step - 1]]) for (part, order, step), c in out.items()}


def test_counts_equal_the_replay(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(5)
    out = A.audit(docs, spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(out) == len(found) and found == replayed(documents(), labels())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(spark.createDataFrame([], SCHEMA), none).collect() == []
    out = A.audit(spark.createDataFrame(documents()[:3], SCHEMA), none).collect()
    assert len(out) == 600 and {r.good_lost + r.toxic_lost for r in out} == {0}


def test_documents_are_spread_over_salts(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    told = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")
    one, many = (sorted(map(tuple, A.flags(docs, told, salts).collect()), key=str) for salts in (1, 16))
    assert one == many and len(one) == len(documents())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_given_tables_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = A.audit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).toPandas()
    sql = con.sql(A.AUDIT_SQL).df()[out.columns]
    assert sorted(out.itertuples(index=False, name=None)) == sorted(sql.itertuples(index=False, name=None))
