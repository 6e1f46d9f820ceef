"""Each operator on hostile small inputs, against brute force or a library."""

import collections
import random

import pytest

from voxelspark.llm import bpe, decontaminate, html_extract, near_duplicates, preference, prefix_free, quality, rlz, sharding, url_filter
from voxelspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_words string, pieces int, label string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    a, b, shared = words(120, 1), words(90, 2), words(60, 3)
    texts = [a, a, a.replace(a.split()[50], "changed", 1), b + " " + shared, shared + "\n" + words(40, 4), None, "", "   \n\t", "é" * 300, "x y " * 300, "one", a + " extra tail", words(30, 5) + "\x1f " + words(30, 6), "ñ " + shared + " ü"]
    return [(i, t, "clash", 7, None) for i, t in enumerate(texts)] + [(3, b + " " + shared, None, None, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library_and_survives_anything(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    rows = bpe.encode_decode(docs, tokenizer_path()).collect()
    texts = dict((i, t) for i, t, *_ in corpus())
    assert len(rows) == len(corpus())
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none, tokenizer_path()).collect() == []


def test_bpe_stream_equals_the_whole():
    whole = bpe.encoder(tokenizer_path())
    rng = random.Random(4)
    word = "".join(rng.choice("thinger o"[:7]) for _ in range(9000))
    symbols = [*whole.symbols(word)]
    assert list(whole.stream(symbols, buffer=100)) == whole._merge_long(list(symbols)) == list(whole.piece(word))
    assert "".join(bpe.decode_stream([b"\xc3", b"\xa9 \xe4\xbd", b"\xa0\xff"])) == "é 你\ufffd"


def test_bpe_tokens_go_out_at_cuts():
    """Where no merge joins two symbols, all before them is final: nothing behind a cut is read, and tokens equal those of the whole."""
    found = bpe.encoder(tokenizer_path())
    rng = random.Random(5)
    for _ in range(300):
        symbols = [*found.symbols("".join(rng.choice("etaoinqxzjé0你") for _ in range(rng.randint(1, 60))))]
        out, seen = [], 0

        def feed():
            nonlocal seen
            for seen, symbol in enumerate(symbols, 1):
                yield symbol

        length = 0
        for token in found.stream(feed(), read=1):
            out.append(token)
            length += found._length[token]
            # the last symbol read is the first behind a cut, or the word is at its end
            assert seen == len(symbols) or (symbols[seen - 2], symbols[seen - 1]) not in found.joined and length < seen
        assert out == found._merge_long(list(symbols)) == [*found.stream(symbols)] == [*found.stream(symbols, read=3)]
    two = [*found.symbols("one"), *found.symbols("two")]  # the end of a word is a cut
    assert [*found.stream(two)] == [*found.piece("one"), *found.piece("two")]


def test_special_tokens_and_unicode_follow_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), bpe._Memo(bpe.encoder(tokenizer_path()))
    for text in ("a<|endoftext|>b <|startoftext|>", "ΑΣ İ ß ½ ² e\u0301 12'S", "\x1c\x85\u3000", "don't  we'll"):
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_decontamination(spark, docs, none):
    t = dict((i, x) for i, x, *_ in corpus())
    bench = spark.createDataFrame([(10, " ".join(t[3].upper().split()[20:34])), (2, "one"), (3, None), (4, "absent words here")], "item_id long, text string")
    for size in (1 << 20, 40):  # in one block and in several
        rows = {r.doc_id: r for r in decontaminate.scan(docs, bench, block_bytes=size).select("doc_id", decontaminate.n_hit().alias("hit"), "item_ids").collect()}
        assert rows[3].hit == 14 and rows[3].item_ids == ["10"] and rows[10].item_ids == ["2"] and rows[10].hit == 1
        assert all(r.hit == 0 for i, r in rows.items() if i not in (3, 10))
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert len(cut[3].split()) == len(t[3].split()) - 14 and cut[10] == "" and cut[0] == t[0] and cut[5] is None
    assert decontaminate.scan(none, bench).count() == 0


def test_decontamination_is_the_same_for_any_number_of_blocks(spark):
    w = words(60, 9).split()
    items = [(i, " ".join(w[a:b])) for i, (a, b) in enumerate([(5, 20), (15, 30), (30, 40), (44, 45)])]
    items.append((9, " ".join(w[0:5] + w[40:45])))  # only there where words on both sides of a cut meet
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(w)), (1, " ".join(w[:12]) + "."), (None, " ".join(w[10:35])), (None, "other words"), (1, " ".join(w)), (2, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    order = lambda df: sorted(map(str, df.collect()))
    one, many = ([order(f(docs, bench, block_bytes=size)) for f in (decontaminate.scan, decontaminate.remove_spans)] for size in (1 << 20, 50))
    assert one == many and len(many[0]) == len(many[1]) == len(rows)


PAGE = "page_id long, url string, html string"


def texts_of(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    return out


def test_html(spark):
    frame = "<body><header>Top</header><nav><ul><li>A<li>B</ul></nav><p>Same on all</p><div class='ad x'>Buy</div><div id=c><p>{}<b>bold<p>Two {} &amp; 2&nbsp;x<br>y</div><form>f</form><div class=comments><article class=comment>me</article></div><footer>F"
    pages = [(i, f"http://h/{i}", frame.format(f"Text {i} ", i)) for i in range(6)]
    pages += [(10, None, None), (11, "http://z/", "<article><h1>T</h1>x<script>if(a<b)</script>y<!-- no"), (11, "http://z/", ""), (12, "u", "plain < text")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], PAGE + ", host string, template int")
    out = texts_of(html_extract.extract(df).collect())
    assert out[3] == ["Text 3 bold\nTwo 3 & 2 x y"] and out[10] == [""] and sorted(out[11]) == ["", "T\nxy"] and out[12] == ["plain < text"]
    assert html_extract.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_html_main_slot_comes_from_the_template(spark):
    """No element is called article and no class says what it is: only the pages together tell."""
    frame = "<body><div class=a1><p>Hot today</p><p>{}</p></div><div class=b1><p>Read this {}</p><p>{}</p></div><div class=c1><p>Odd pages say this</p></div>"
    story = lambda i: words(60, i)
    pages = [(i, f"http://h/{i}", frame.format(i, i, story(i)) + ("<p>tail" if i % 2 else "")) for i in range(8)]
    out = texts_of(html_extract.extract(spark.createDataFrame(pages + pages, PAGE)).collect())  # repeated rows are pages too
    assert all(out[i] == [f"Read this {i}\n{story(i)}"] * 2 for i in range(8))
    alone = texts_of(html_extract.extract(spark.createDataFrame(pages[:1], PAGE)).collect())
    assert alone[0] == [f"Hot today\n0\nRead this 0\n{story(0)}\nOdd pages say this"]  # one page has no template


def test_html_classes_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["<p class=x>one</p>", "<p class=y>two</p>", "<section><i>s</i></section>", "<div class=z><em>e</em></div>", "<ul><li>a<li>b</ul>"]
    pages = [(i, f"http://h{i % 2}/{i}", "<body>" + "".join(p for k, p in enumerate(parts) if k == 0 or rng.random() < 0.6)) for i in range(20)]
    df = spark.createDataFrame(pages, PAGE)
    rows = df.selectExpr("page_id AS row", "regexp_extract(url, '://([^/]*)', 1) AS host", "html")
    vectors = collections.defaultdict(lambda: collections.defaultdict(dict))
    parent = {}
    for i, url, source in pages:
        page = html_extract.Page(source)
        tokens = dict(page.tags)
        parent |= page.parents
        for run in page.runs:
            t = html_extract._hash(run.path, "text", run.text)
            tokens[t] = tokens.get(t, 0) + 1
            parent[t] = run.path
        for t, n in tokens.items():
            vectors[url[7:9]][t][i] = n
    for host, by in vectors.items():
        classes = collections.Counter(tuple(sorted(v.items())) for v in by.values())
        good = {t for t, v in by.items() if classes[tuple(sorted(v.items()))] >= 2 and len(v) >= 5}
        parts_of = rows.filter(f"host = '{host}'").mapInArrow(html_extract._vectors, html_extract._SCHEMA).groupBy("host", "token")
        from pyspark.sql import functions as F

        folded = parts_of.agg(F.first("parent").alias("parent"), F.first("is_text").alias("is_text"), F.max("article").alias("article"), F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"))
        found = {r.token for r in html_extract.valid(folded).collect()} - {0}
        assert found == good and good


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert {rows[i].class_id for i in (0, 1, 2, 11)} == {0} and rows[3].class_id == 3 and rows[5].class_id == 5 and rows[6].n_links == 0
    assert rows[0].n_links == 3 and rows[3].n_links == 1  # a row that repeats an id is a copy
    assert near_duplicates.near_duplicates(none).count() == 0
    bands, per = near_duplicates.bands_for(0.8, 0.9)
    assert 1 - (1 - 0.8**per) ** bands >= 0.9


def test_quality(docs, none):
    rows = {r.doc_id: r for r in quality.measure(docs).collect()}
    assert rows[0].kept and not rows[5].kept and rows[9].base_failed and rows[9].n_repeat_words == rows[9].n_words == 600 and rows[6].n_words == 0
    assert quality.measure(none).count() == 0
    kept = quality.clean(docs)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and {0, 1, 3} <= {r.doc_id for r in kept.collect()}


def test_scripts_without_case_do_not_shout(spark):
    rng = random.Random(6)
    script = lambda letters, other="": "\n".join(" ".join(["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] + [other]) for _ in range(6))
    texts = [script("אבגדהוזחט"), script("ابتثجحخدذ", "BBC"), script("कखगघचछजझ"), script("가나다라마바"), script("ABCDEFGHI"), script("ABCDEFGHI", "가")]
    rows = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def brute_repeats(texts, split, size, earlier):
    """Covered items by (doc_id, start): windows that start elsewhere too, or earlier."""
    places = collections.defaultdict(list)
    items = {i: split(t or "") for i, t in texts.items()}
    for i in sorted(items):
        for s in range(len(items[i]) - size + 1):
            places[tuple(items[i][s : s + size])].append((i, s))
    gone = collections.defaultdict(set)
    for spots in places.values():
        for i, s in spots[1:] if earlier else spots if len(spots) > 1 else []:
            gone[i] |= set(range(s, s + size))
    return items, gone


def test_substring_dedup(spark, docs, none):
    texts = dict((i, t) for i, t, *_ in corpus())
    items, gone = brute_repeats(texts, lambda t: t.encode().split(), 20, True)
    for r in rlz.dedup(docs).collect():
        kept = [w for k, w in enumerate(items[r.doc_id]) if k not in gone[r.doc_id]]
        assert r.n_words == len(items[r.doc_id]) and r.n_removed == len(gone[r.doc_id]) and r.kept_text == b" ".join(kept).decode()
    assert rlz.dedup(none).count() == 0


def test_suffix_array_dedup(spark, none):
    rows = [r[:2] for r in corpus()[:-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items, gone = brute_repeats(dict(rows), lambda t: t.encode(), 200, False)
    for r in prefix_free.dedup(df).collect():
        assert bytes(r.kept) == bytes(b for k, b in enumerate(items[r.doc_id]) if k not in gone[r.doc_id]) and r.n_removed == len(gone[r.doc_id])
    assert prefix_free.remove_repeats(df).count() == len(rows) and prefix_free.dedup(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.assign(docs, 4).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(corpus()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.assign(none, 4).count() == 0
    weights = {a: 1 + a % 7 for a in range(4000)}
    before, after = sharding.place(weights, 8), sharding.place({**weights, 4001: 3}, 8)
    loads = collections.Counter()
    for a, s in before.items():
        loads[s] += weights[a]
    assert max(loads.values()) <= 1.01 * min(loads.values()) and sum(before[a] != after[a] for a in weights) < 400


def test_preference(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    pairs = [
        (1, t(("user", "hi"), ("assistant", "yes")), t(("user", "hi"), ("assistant", "né"))),
        (2, t(("user", "a")), t(("user", "a"))),
        (3, None, t(("assistant", None))),
        (4, t(("user", "a"), ("assistant", "b")), t(("user", "a"))),
    ]
    rows = {r.pair_id: r for r in preference.format_pairs(spark.createDataFrame(pairs, f"pair_id long, chosen {preference._TURNS}, rejected {preference._TURNS}")).collect()}
    one = rows[1]
    assert one.n_prefix == 1 and one.prompt == "<|user|>\nhi<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["yes<|end|>"] and [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["né<|end|>"]
    assert rows[2].chosen == rows[2].rejected == "" and rows[3].chosen == "" and rows[3].n_prefix == 0 and rows[4].rejected == "" and rows[4].n_prefix == 1
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "long answer"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (4, 0, "user", "x"), (4, None, None, None), (5, 0, "user", "z"), (5, 1, "assistant", "reply"), (None, 0, "user", "q")]
    made = {r.pair_id: r for r in preference.pair_up(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(made) == {2, 4, 5} and made[2].chosen[1].text == "long answer"


def test_url_filter(spark):
    urls = ["http://a.net/", "https://b.example.net/en/1", "x://EXAMPLE.com/de/?q", "//no", None, "http://h.example.org/fr/x", "http://bad.example.com", "http://bad.example.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.example.com/1", 1)] * 40 + [("http://good.example.com/1", 0)] * 40 + [(None, 1), ("http://q.org", None)], "url string, bad long")
    rows = {r.page_id: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [rows[i].rule for i in range(6)] == ["net/", "example.net/en/", "example.com/de/", None, None, "org/fr/"]
    assert rows[0].verdict == "block" and rows[1].verdict == "allow" and rows[6].verdict == rows[7].verdict == "block" and rows[4].host == "" and rows[2].path == "/de/"
    nothing = spark.createDataFrame([], "url string, bad long")
    assert {r.verdict for r in url_filter.judge(pages, nothing).filter("rule IS NULL").collect()} == {"allow"}


def test_boilerplate_goes_in_four_languages_and_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    body = "\n".join(words(14, i) + "." for i in range(8))
    bad = ["Alle Rechte vorbehalten bei diesem Verlag.", "Wir nutzen ja, bitte alle Cookies akzeptieren.", "Tous droits réservés par la maison.", "Cliquez ici pour lire le texte.", "Todos los derechos reservados para siempre.", "Lea nuestra política de privacidad ahora."]
    scripts = ["אבגדה וזחטי כלמנס עפצקר שתאבג דהוזח", "가나다 라마바 사아자 차카타 파하가 나다라", "ΑΒΓ ΔΕΖ ΗΘΙ ΚΛΜ ΝΞΟ ΠΡΣ"]
    texts = [body + "\n" + line for line in bad] + ["\n".join([line] * 3 + [body]) for line in scripts] + [None, "", body, "\n".join(scripts * 4)]
    rows = list(enumerate(texts))
    out = quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).drop("clean_text").toPandas()
    left = dict(zip(out.doc_id, out.n_left))
    assert all(left[i] == left[len(texts) - 2] for i in range(len(bad)))
    con = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", documents)
    sql = con.sql(quality.MEASURE_SQL).df()[out.columns]
    assert sorted(out.itertuples(index=False, name=None)) == sorted(sql.itertuples(index=False, name=None))


def test_items_without_an_id_hit_too(spark):
    w = words(40, 21).split()
    bench = spark.createDataFrame([(None, " ".join(w[:30])), (None, "other words entirely"), (7, " ".join(w[25:40])), (8, " ".join(w[25:40]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(w[:30])), (2, " ".join(w)), (3, "nothing of it")], "doc_id long, text string")
    for size in (1 << 20, 60):
        rows = {r.doc_id: r for r in decontaminate.scan(docs, bench, block_bytes=size).select("doc_id", decontaminate.n_hit().alias("hit"), "item_ids").collect()}
        assert [rows[i].hit for i in (1, 2, 3)] == [30, 40, 0] and [rows[i].item_ids for i in (1, 2, 3)] == [[], ["7", "8"], []]
        assert {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, block_bytes=size).collect()} == {1: "", 2: "", 3: "nothing of it"}


def test_windows_equal_a_plain_search_and_stay_small():
    import pickle

    import numpy as np

    from voxelspark.llm import kernels as K

    rng = random.Random(2)
    pool = [words(30, i).split() for i in range(40)]
    items = [(str(i), " ".join(rng.choice(pool)[a : a + rng.choice([3, 10, 12, 25])])) for i, a in enumerate(rng.choices(range(15), k=200))]
    held = decontaminate.Windows(items, 10)
    text = " ".join(" ".join(rng.choice(pool)) for _ in range(20))
    data = np.frombuffer(text.encode(), np.uint8)
    w = K.words(data, np.array([0, len(data)]), K.WORD_BYTES)
    parts, plain = text.split(), collections.defaultdict(set)
    for name, item in items:
        x = item.split()
        k = min(10, len(x))
        for i in range(len(x) - k + 1):
            for at in range(len(parts) - k + 1):
                if parts[at : at + k] == x[i : i + k]:
                    plain[at, k].add(name)
    assert {(i, k): found for i, k, found in held.hits(data, w)} == plain
    many = decontaminate.Windows([(str(i), words(200, i)) for i in range(500)], 10)
    assert len(pickle.dumps(many)) < 80 * 100_000 + (1 << 21)


def test_sharding_equals_a_plain_ring(spark):
    rng = random.Random(8)
    rows = [(i, words(rng.randint(1, 60), rng.randint(0, 60))) for i in range(300)] + [(5, None), (5, None), (6, "")]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 6).collect()
    again = sharding.assign(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(2), 6).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))  # order and tasks do not matter
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    load, shard_of = collections.Counter(), collections.defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        shard_of[r.text_crc32, r.size].add(r.shard)
    heaviest = max(sum(len((t or "").encode()) + 8 for _, t in rows if t == x) for _, x in rows)
    assert sum(load.values()) == total and max(load.values()) <= total / 6 * (1 + sharding.SLACK) + heaviest
    assert all(len(s) == 1 for s in shard_of.values()) or heaviest > total / 24
    for shard in range(6):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_phrases_have_their_fragments_and_groups_may_stay_whole(spark):
    assert all(fragment.strip() in phrase for phrase, fragment in quality.PHRASES.items())
    rows = [(i, "same text " * 50) for i in range(40)] + [(100 + i, words(90, i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sharding.assign(df, 4, heavy=None).filter("doc_id < 100").select("shard").distinct().count()
    assert whole == 1 < sharding.assign(df, 4).filter("doc_id < 100").select("shard").distinct().count()
