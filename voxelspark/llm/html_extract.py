"""Main text of web pages by template deduction over equivalence classes.

Pages of a host share a template.  A page is read as tokens: its tags, each with the path of open elements (names and
class words, numbers left out), and its runs of text outside an article, with their path.  For each host and token the
occurrence vector - how often the token is in which page - is folded into a fingerprint: the number of pages and the
exclusive or of a hash of (page, count), so vectors are aggregated before any shuffle and a hot
host costs one row a token and task.  Tokens of one host with equal vectors are an equivalence class.
Classes that are large (``MIN_SIZE`` tokens) and frequent (``MIN_SHARE`` of the host's pages, ``MIN_PAGES`` at
least) are valid, and are nested into the template along the paths: a token belongs to it if its parent
does, up to the root.

The template's elements are its slots.  One of them is the *main slot*: each element carries the characters below it over all
pages of the host, less those of template text, and the main slot is the deepest element with ``MAIN_SHARE`` of them - among
the elements called article or main, if the template has any.  From each page the text in its host's main slot is taken,
without nested slots that are not main text: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments.
Here, and only here, the class words of ``MARKS`` count.  Text inside the main slot is data and stays even if pages share it.

A host with too few pages for a template, or without a main slot in it, takes that of all pages together.  A page without that slot is
odd: its own article, if it marks one, or else all its text but template text and marked elements.

Templates meet pages by host.  A template holds tokens of at least half of the pages of its host, so it is no larger than
two pages, and is worked out in one row; all templates are broadcast up to ``BROADCAST_TOKENS`` tokens, as counted, and otherwise joined,
where Spark splits a hot host.

Cases: null html is empty, null urls share the host ''.  Markup may be broken: elements close with what
holds them, comments and scripts without an end reach to the page's end.  Repeated rows are kept, and each counts as a page.  Pages
without text give an empty text, an empty table an empty result.  ``br`` is white space inside its block.  A page is walked as a
whole in one task, however long.  Other columns than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import checkpoint, frugal
from voxelspark.llm.url_filter import HOST

MIN_SHARE, MIN_PAGES, MIN_SIZE, MAIN_SHARE = 0.5, 4, 2, 0.8
BROADCAST_TOKENS = 4 << 20

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NOT_MAIN = frozenset("head nav header footer aside form menu dialog button select textarea iframe object svg canvas noscript template".split())
CLOSES_P = BLOCK - {"option", "body", "html", "head", "caption", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words in class, id and role that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|sidebar|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|disqus|replies|related|shar(?:e|ing)|social|footer|header|masthead|popup|modal|overlay|widgets?|toolbar|pagination|pager|login|signup|search|contentinfo|complementary|alert)(?:$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>|([^<]++|<)",
    re.S | re.I,
)
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Run:
    """A block's text: where it stands, and what holds it."""

    __slots__ = ("article", "inside", "marked", "path", "text")

    def __init__(self, at: Element, text: str) -> None:
        self.path, self.text, self.marked, self.article, self.inside = at.path, text, at.marked, at.article, at.inside


class Element(NamedTuple):
    """An open element: never main text, so by its class words, in an article, in the main slot."""

    name: str
    path: int
    hidden: bool
    marked: bool
    article: bool
    inside: bool


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """One walk over a page: ``runs`` that can be main text, ``tags`` with their parents and the characters below them.

    ``main``: path of the main slot, once it is known.
    """

    def __init__(self, source: str, main: int | None = None) -> None:
        self.runs: list[Run] = []
        self.tags: Counter = Counter()
        self.chars: Counter = Counter()
        self.parents: dict[int, int] = {}
        self.articles: set[int] = set()
        self.has_main = False
        self._main = main
        self._stack = [Element("", 0, False, False, False, False)]
        self._parts: list[str] = []
        for found in _TOKEN.finditer(source):
            text = found[5]
            if text is not None:
                if not self._stack[-1].hidden:
                    self._parts.append(text)
            elif found[3]:
                (self._close if found[2] else self._open)(found[3].lower(), found[4])
        self._flush()
        for path in reversed(self.parents):  # a parent is met before its children
            self.chars[self.parents[path]] += self.chars[path]

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            self._parts.clear()
            if text:
                self.runs.append(Run(self._stack[-1], text))
                self.chars[self._stack[-1].path] += len(text)

    def _pop(self, n: int) -> None:
        """Close elements until n are open."""
        if any(x.name in BLOCK for x in self._stack[n:]):
            self._flush()
        del self._stack[n:]

    def _open(self, name: str, attributes: str) -> None:
        stack = self._stack
        if name == "br" or name == "wbr":
            self._parts.append(" " if name == "br" else "")
            return
        if name in BLOCK:
            self._flush()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    self._pop(i)
                    break
                if stack[i].name in BLOCK:
                    break
        if name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in SIBLINGS[name]:
                    self._pop(i)
                    break
                if stack[i].name in HOLDERS[name]:
                    break
        marks = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)) if attributes and "=" in attributes else ""
        main = name in ("article", "main") and not COMMENTS.search(marks)
        if name == "body" or main:
            for i in range(1, len(stack)):
                if stack[i].name in ("head", "nav", "header", "menu"):  # never closed
                    self._pop(i)
                    break
        if name in VOID:
            return
        above = stack[-1]
        path = _hash(above.path, name, _DIGITS.sub("", marks))
        self.tags[path] += 1
        self.parents[path] = above.path
        hidden = above.hidden or name in NOT_MAIN
        slot = path == self._main and not hidden
        marked = bool(marks) and name not in ("html", "body") and not main and bool(MARKS.search(marks))
        marked = not slot and (above.marked or marked)
        article = not hidden and not marked and (above.article or main)
        if article and main:
            self.articles.add(path)
        self.has_main = self.has_main or slot
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append(Element(name, path, hidden, marked, article, above.inside or slot))

    def _close(self, name: str, _: str) -> None:
        stack = self._stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                self._pop(i)
                return
            if name not in BLOCK and stack[i].name in BLOCK:
                return
        if name in BLOCK:
            self._flush()


_FIELDS = [("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()), ("article", pa.bool_()), ("pages", pa.int64()), ("vector", pa.int64()), ("chars", pa.int64())]
_SCHEMA = "host string, token long, parent long, is_text boolean, article boolean, pages long, vector long, chars long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, vector, parent and characters of each host's tokens, folded over a batch; token 0 is the root."""
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for row, source, host in zip(batch.column("row").to_pylist(), batch.column("html").to_pylist(), batch.column("host").to_pylist()):
            page = Page(source or "")
            tokens = [(path, page.parents[path], False, path in page.articles, n, page.chars[path]) for path, n in page.tags.items()]
            runs = Counter((run.path, run.text) for run in page.runs if not run.article)
            tokens += [(_hash(path, "text", text), path, True, False, n, n * len(text)) for (path, text), n in runs.items()]
            tokens.append((0, 0, False, False, 1, page.chars[0]))
            for token, parent, text, article, n, chars in tokens:
                vector = _hash(row, n)
                if (held := found.get((host, token))) is None:
                    found[host, token] = [parent, text, article, 1, vector, chars]
                else:
                    held[2] |= article
                    held[3] += 1
                    held[4] ^= vector
                    held[5] += chars
        rows = [(h, t, *x) for (h, t), x in found.items()]
        columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])


def nested(tokens: list[dict]) -> tuple[list[int], int | None]:
    """Template text and main slot among a host's valid tokens (token, parent, is_text, article, chars) and its root."""
    by = {t["token"]: t for t in tokens}
    below: dict[int, list[int]] = {}
    for t in tokens:
        if t["token"]:
            below.setdefault(t["parent"], []).append(t["token"])
    depth, order = {0: 0}, [0]
    for token in order:  # from the root down, so what hangs on no valid parent is never met
        for child in below.get(token, ()):
            depth[child] = depth[token] + 1
            order.append(child)
    held = [by[t] for t in order if t in by]
    fixed = Counter({t["token"]: t["chars"] for t in held if t["is_text"]})
    for t in reversed(held):
        if t["token"]:
            fixed[t["parent"]] += fixed[t["token"]]
    size = {t["token"]: t["chars"] - fixed[t["token"]] for t in held if not t["is_text"]}
    slots = [t["token"] for t in held if t["article"]] or [t for t in size if t]
    most = max((size[t] for t in slots), default=0) if any(by[t]["article"] for t in slots) else size.get(0, 0)
    large = [t for t in slots if size[t] > 0 and size[t] >= MAIN_SHARE * most]
    return [t["token"] for t in held if t["is_text"]], max(large, key=lambda t: (depth[t], size[t], t), default=None)


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [nested(tokens) for tokens in batch.column("tokens").to_pylist()]
        columns = [batch.column("host"), pa.array([t for t, _ in made], pa.list_(pa.int64())), pa.array([m for _, m in made], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "template", "main"])


def valid(tokens: DataFrame) -> DataFrame:
    """The tokens in large and frequent equivalence classes of their host, and its root."""
    sizes = tokens.filter("token = 0").select("host", F.col("pages").alias("total"))
    frequent = tokens.join(sizes, "host").filter((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("total")))
    classes = frequent.filter("token <> 0").groupBy("host", "pages", "vector").agg(F.count("*").alias("size")).filter(F.col("size") >= MIN_SIZE)
    return frequent.join(classes, ["host", "pages", "vector"], "left").filter("token = 0 OR size IS NOT NULL").select("host", "token", "parent", "is_text", "article", "chars")


def templates(pages: DataFrame) -> DataFrame:
    """``host, template`` (its text tokens) and ``main`` (path of the main slot, if any); those of all pages under a null host.

    ``pages``: row (different for each), host, html.
    """
    folds = [F.first("parent").alias("parent"), F.first("is_text").alias("is_text"), F.max("article").alias("article"), F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")]
    hosts = checkpoint(pages.mapInArrow(frugal(_vectors), _SCHEMA).groupBy("host", "token").agg(*folds))
    fields = F.struct("token", "parent", "is_text", "article", "chars")
    every = hosts.groupBy("token").agg(*folds).withColumn("host", F.lit("*"))
    lists = valid(hosts).groupBy("host").agg(F.collect_list(fields).alias("tokens"))
    of_all = valid(every).groupBy("host").agg(F.collect_list(fields).alias("tokens")).select(F.lit(None).cast("string").alias("host"), "tokens")
    return lists.unionByName(of_all).mapInArrow(frugal(_nested), "host string, template array<long>, main long")


def _slots(shared_template: list[int], shared_main: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, template, main in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), batch.column("main").to_pylist()):
                page = Page(source or "", shared_main if main is None else main)
                if page.has_main:
                    kept = [run.text for run in page.runs if run.inside and not run.marked]
                elif page.articles:
                    kept = [run.text for run in page.runs if run.article]
                else:
                    known = frozenset(shared_template if template is None else template)
                    kept = [run.text for run in page.runs if not run.marked and not (known and _hash(run.path, "text", run.text) in known)]
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), F.expr(HOST).alias("host"))
    found = checkpoint(templates(rows.select(F.monotonically_increasing_id().alias("row"), "host", "html")))
    shared = found.filter("host IS NULL").first()  # one template, no larger than two pages
    number = found.agg(F.coalesce(F.sum(F.size("template") + 1), F.lit(0))).first()[0]
    by_host = found.filter("host IS NOT NULL")
    joined = rows.join(F.broadcast(by_host) if number <= BROADCAST_TOKENS else by_host, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    slots = _slots(*(([], None) if shared is None else (shared["template"], shared["main"])))
    out = joined.select("page_id", "url", "html", "template", "main").mapInArrow(frugal(slots), f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
