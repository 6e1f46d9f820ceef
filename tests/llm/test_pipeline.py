"""The pipeline against a brute-force version of each stage, on its own input."""

import random
import re

import pytest

import corpus_pipeline
from voxelspark.llm.queries import tokenizer_path


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("sf")
    shared = sentence(rng, 60)
    docs = ["\n".join(sentence(rng, 20) for _ in range(5)) for _ in range(12)]
    docs += [docs[0], docs[1].replace(docs[1].split()[30], "other", 1), docs[2] + "\n" + shared, "\n".join(sentence(rng, 40) for _ in range(3)) + "\n" + shared, "Too short.", None, "", "\n".join(["SHOUT OUT LOUD NOW YES!!"] * 20)]
    leak = " ".join(docs[5].split()[10:30])
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, leak


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    folder, docs, leak = sf_dir
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
        seen.append({r.doc_id: r for r in rows.collect()})
    quality, near, repeats, clean, tokens = seen
    assert set(quality) == set(range(16)) and all(r.text == docs[i] for i, r in quality.items())
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {i: shingles(docs[i]) for i in quality}
    assert set(near) == {i for i in quality if not any(j < i and alike(sets[i], sets[j]) for j in quality)}
    held = {i: near[i].text.encode() for i in near}
    starts = {}
    for i, t in held.items():
        for s in range(len(t) - 199):
            starts.setdefault(t[s : s + 200], []).append((i, s))
    gone = {(i, k) for spots in starts.values() for i, s in sorted(spots)[1:] for k in range(s, s + 200)}  # the first place stays
    assert gone and all(r.text.encode() == bytes(b for k, b in enumerate(held[i]) if (i, k) not in gone) for i, r in repeats.items())
    assert leak in repeats[5].text.replace("\n", " ") and leak not in clean[5].text.replace("\n", " ")
    assert all(clean[i].text == repeats[i].text and clean[i].n_chars == len(clean[i].text) for i in clean if i != 5)
    lib = Tokenizer.from_file(tokenizer_path())
    assert all(r.ids == lib.encode(clean[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for i, r in tokens.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(tokens)


def test_repeated_rows_leave_one_whole_text(spark):
    rng = random.Random(9)
    a, b, c, d, shared = (sentence(rng, 90) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (2, b), (2, a), (3, b), (4, c + shared), (4, d), (5, shared + b[:150]), (None, c), (None, c), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    order = lambda rows: sorted(((r.doc_id or 0, r.text or "") for r in rows))
    assert near.columns == docs.columns
    assert order(near.collect()) == sorted([(1, a), (2, b), (4, c + shared), (4, d), (5, shared + b[:150]), (0, c), (6, ""), (6, "")])
    out = corpus_pipeline.suffix_array_dedup(spark, near, "").collect()
    texts = [r.text or "" for r in out]
    assert a in texts and b in texts and d in texts and len(out) == 8
    assert sum(shared in t for t in texts) == 1  # of a repeat the first place stays
