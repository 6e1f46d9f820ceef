r"""Line-first quality rules, in DataFrame expressions only.

Each text is cut at ``\n``.  A line that has a word is judged by itself:

* symbols: more than a tenth of its code points are ``# * $ % & | < >``;
* navigation: three or more separators (``|``, ``»``, ``›``, ``•``), one for every three words at least;
* shouting: five or more words, and no two small letters side by side but capitals, more than letters of scripts without
  case, or over 60 in 100 of its words end in ``!!``;
* punctuation: fewer than four words and no closing punctuation at its end;
* boilerplate: a licence, cookie, rights or sign-up phrase in English, German, French or Spanish;
* repetition: it equals an earlier line of the text.

Lines that fail go, and with them lines without words.  A text is rejected when fewer than
half of its words are left, or by the base rules: fewer than 50 words, or more than half of
its words in three-word windows that occur twice or more in it.

A document is one row; nothing is exploded, so a long text or a hot source costs
only its own row and there is no shuffle.  Windows are compared by 64-bit hashes
inside one text.  Null and empty texts have no words and are rejected; an empty table gives no rows.  Repeated rows are
judged alike.  A text of any length is judged in its row.  Columns of other names are not read; :func:`clean` passes them through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import text_input

#: White space between words; symbols; closing punctuation; separators.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLOSING = "[.!?…:;\"'”’»)\\]]$"
SEPARATORS = "|»›•"
#: Phrases of boilerplate, each with a fragment that any text with the phrase holds.
PHRASES = {
    "licensed under": "licensed",
    "all rights reserved": "rights res",
    "copyright [(©]": "copyrigh",
    "©": "©",
    "terms of (use|service)": "terms of",
    "privacy policy": " policy",
    "cookie policy": " policy",
    "accept cookies": "cookies",
    "use of cookies": "cookies",
    "javascript": "javascript",
    "subscribe to": "subscrib",
    "newsletter": "newslet",
    "click here": "click he",
    "sign up": "sign up",
    "log in": "log in",
    "read more": "read more",
    "alle rechte vorbehalten": "vorbehalten",
    "datenschutzerklärung": "datenschutz",
    "cookies (zu|akzeptieren|ablehnen)": "cookies",
    "verwendet cookies": "cookies",
    "nutzungsbedingungen": "nutzungsbed",
    "jetzt (abonnieren|anmelden|registrieren)": "jetzt ",
    "hier klicken": "hier klick",
    "weiterlesen": "weiterlesen",
    "tous droits réservés": "tous droits",
    "politique de confidentialité": "confidentialit",
    "(accepter|refuser|utilise des) (les )?cookies": "cookies",
    "conditions d.utilisation": "utilisation",
    "(inscrivez|abonnez)-vous": "-vous",
    "cliquez ici": "cliquez ici",
    "lire la suite": "lire la suite",
    "todos los derechos reservados": "derechos reserv",
    "política de privacidad": "privacidad",
    "(aceptar|rechazar|utiliza|usa) (las )?cookies": "cookies",
    "(condiciones|términos) de uso": " de uso",
    "suscríbete": "suscríb",
    "suscríbase": "suscríb",
    "(haz|haga) clic aquí": "clic aqu",
    "leer más": "leer más",
}
BOILERPLATE, FRAGMENTS = "|".join(PHRASES), tuple(dict.fromkeys(PHRASES.values()))
MIN_WORDS, MAX_REPEAT, MIN_LEFT = 50, 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name: it is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _window(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _covered(starts: Column) -> Column:
    """Words in the three-word windows at some places, which are sorted."""
    steps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _places(hashes: Column) -> Column:
    """Places of the hashes that occur twice or more, sorted: equal ones are neighbours once sorted."""
    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(k: Column) -> Column:
        found = F.filter(k, lambda x, i: (x["h"] == F.get(k, i + 1)["h"]) | (x["h"] == F.get(k, i - 1)["h"]))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    return let(sorted_, again)


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes inside one text, of any length.  Most texts repeat none, which a set of the
    hashes shows without a sort.
    """
    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda _, i: _window(w, i))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_places(h), _covered)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted).cast("long")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def line_fails(line: Column, n: Column, marked: Column, boilerplate: Column) -> Column:
    """n: words of the line; marked, boilerplate: whether the text has a symbol or separator, or a phrase, at all."""
    separators = count_of(line, SEPARATORS)
    noise = F.when(marked, (10 * count_of(line, SYMBOLS) > F.char_length(line)) | ((separators >= 3) & (3 * separators >= n))).otherwise(False)
    marks = F.when(F.contains(line, F.lit("!!")), 200 * F.size(F.split(line, "!!")) > 120 * n + 200).otherwise(False)
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}")) > F.regexp_count(line, F.lit(r"\p{Lo}"))
    shouting = (n >= 5) & ((~line.rlike(r"\p{Ll}\p{Ll}") & capitals) | marks)
    return noise | shouting | ((n < 4) & ~F.rtrim(line).rlike(CLOSING)) | F.when(boilerplate, F.lower(line).rlike(BOILERPLATE)).otherwise(False)


def has_boilerplate(text: Column) -> Column:
    """Whether any phrase can be in a text, by fragments that each phrase has one of."""
    return let(F.lower(text), lambda x: reduce(or_, [F.contains(x, F.lit(f)) for f in FRAGMENTS]))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, verdict and the text that is left, one row for each row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_left`` (words in lines that pass) ``, base_failed, kept, clean_text``.
    """
    rows = text_input(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    body = F.col("text")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def judged(found: Column) -> Column:
        def passed(distinct: Column) -> Column:
            counted = F.transform(distinct, lambda x: F.struct(x.alias("x"), count_words(x).alias("n")))

            def left(good: Column) -> Column:
                return F.struct(F.aggregate(good, F.lit(0), lambda n, x: n + x["n"]).alias("n_left"), F.array_join(good["x"], "\n").alias("clean_text"))

            asked = F.struct(has_boilerplate(body).alias("phrase"), body.rlike(f"[{SYMBOLS}{SEPARATORS}]").alias("mark"))
            return let(asked, lambda some: let(F.filter(counted, lambda x: ~line_fails(x["x"], x["n"], some["mark"], some["phrase"])), left))

        def with_distinct(distinct: Column) -> Column:
            return F.struct((F.size(found) - F.size(distinct)).cast("long").alias("n_dup_lines"), passed(distinct).alias("left"))

        return let(F.array_distinct(found), with_distinct)

    # a column of its own: it is used several times
    out = rows.withColumn("w", split_words(body)).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(body.rlike("[#*$%&|<>]"), count_of(body, SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        let(lines, judged).alias("l"),
    )
    n, left = F.col("n_words"), F.col("l.left.n_left").cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * n)
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        "n_repeat_words",
        left.alias("n_left"),
        failed.alias("base_failed"),
        (~failed & (100 * left >= MIN_LEFT * n)).alias("kept"),
        F.col("l.left.clean_text").alias("clean_text"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns, each text reduced to the lines that pass.

    Rows meet their verdicts without a join: the verdict is an expression on the row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("row"), F.col("text").alias("body"))
    # explode, not filter: a filter would be pushed below the verdict's columns and compute them again
    passed = F.filter(F.array(F.struct("kept", "clean_text")), lambda r: r["kept"])
    kept = measure(held, "row", "body").select("doc_id", F.explode(passed).alias("r"))
    fresh = {"text": F.col("r.clean_text"), "n_chars": F.char_length("r.clean_text").cast("long")}
    return kept.select(*[fresh.get(c, F.col("doc_id").getField(c)).alias(c) for c in docs.columns])


#: The same in DuckDB's SQL.
_N = "len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))"
_SEP = f"(length(x) - length(translate(x, '{SEPARATORS}', '')))"
_LINE_FAILS = f"""(10 * (length(x) - length(translate(x, '{SYMBOLS}', ''))) > length(x)
  OR ({_SEP} >= 3 AND 3 * {_SEP} >= {_N})
  OR ({_N} >= 5 AND ((NOT regexp_matches(x, '\\p{{Ll}}\\p{{Ll}}') AND len(regexp_extract_all(x, '\\p{{Lu}}')) > len(regexp_extract_all(x, '\\p{{Lo}}'))) OR 200 * len(string_split(x, '!!')) > 120 * {_N} + 200))
  OR ({_N} < 4 AND NOT regexp_matches(rtrim(x, ' '), '{CLOSING.replace("'", "''")}'))
  OR regexp_matches(lower(x), '{BOILERPLATE}'))"""
MEASURE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS m FROM t) WHERE m > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, sum({_N}) AS n FROM (SELECT doc_id, unnest(list_distinct(lines)) AS x FROM w) WHERE NOT {_LINE_FAILS} GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        coalesce(l.n, 0)::BIGINT AS n_left
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * n_left >= {MIN_LEFT} * n_words) AS kept
FROM m
"""
