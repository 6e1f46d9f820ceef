r"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding.  A merge list has a *sufficient lookahead*: a number of symbols L such
that what follows more than L symbols behind a token's end cannot change that
token.  What comes later can alter an earlier merge only through a chain of
merges, each of lower priority than the one that it follows and each sharing a
symbol with it, so L is at most the longest stretch such a chain covers;
:func:`sufficient_lookahead` finds it by one pass over the merges in order of
priority.  :class:`Encoder` reads symbols into a buffer of bounded size, merges
there, emits the tokens that end L or more symbols before the buffer's end and
keeps the rest, so memory is constant however long a word is.  L is a bound for
all words; between two symbols that no merge joins the lookahead is none, as no
token can hold both, so at such a *cut* all that the buffer holds goes out at
once.  The last symbol of a word is such a cut.  Every word takes this one way; tokens cannot cross white
space, so texts are fed to it piece by piece; a bounded memo keeps short pieces.

Decoding.  :func:`decode_stream` walks over ids with a state machine that holds
at most one unfinished UTF-8 character: bytes go in, text comes out as soon as a
character is complete, and what is not UTF-8 becomes U+FFFD.

The vocabulary file has the layout of the tokenizers library: NFC, white space
to one space, lower case; a split pattern; byte-level symbols; an end-of-word
suffix; special tokens matched in the raw text.  It is read by each Python
worker through a path, so its cost is one read a worker.

Cases: null and empty texts give no tokens and an empty text.  Rows are kept as
they are, repeated ids and texts too; an empty table gives no rows.  Other columns are dropped, whatever their names.
Memory does not grow with a word's length; a document's ids and text are one row, so they are held whole.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from voxelspark.llm.common import frugal, text_input
from voxelspark.llm.kernels import ranges

#: Pieces of up to so many characters are memoised, at most so many of them.
MEMO_CHARS, MEMO_SIZE = 48, 300_000
#: Symbols that the transducer takes at a time.
READ = 64
_BITS = 20
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62
_NEVER = itertools.repeat(_NONE)
#: Characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(f"[{WHITE_SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


def _symbols(token: str, suffix: str) -> tuple[str, ...]:
    if suffix and token.endswith(suffix) and len(token) > len(suffix):
        token = token[: -len(suffix)]
        return (*token[:-1], token[-1] + suffix)
    return tuple(token)


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """Longest stretch, in symbols, of a chain of merges of falling priority.

    A chain grows to the left: the next merge ends inside or at the left edge of
    the one before, so it starts with a prefix that is compatible with it.
    """
    by_prefix: dict[tuple, int] = {}
    by_whole: dict[tuple, int] = {}
    longest = 1
    for left, right in merges:
        token = _symbols(left.removesuffix(suffix) + right if suffix else left + right, suffix)
        reach = len(token)
        for k in range(len(token)):
            rest = token[k:]
            if k + by_prefix.get(rest, 0) > reach:
                reach = k + by_prefix[rest]
            for j in range(1, len(rest) + 1):
                if k + by_whole.get(rest[:j], 0) > reach:
                    reach = k + by_whole[rest[:j]]
        by_whole[token] = max(reach, by_whole.get(token, 0))
        for j in range(1, len(token) + 1):
            if by_prefix.get(token[:j], 0) < reach:
                by_prefix[token[:j]] = reach
        longest = max(longest, reach)
    return longest


class Encoder:
    """Text to ids for one vocabulary file."""

    def __init__(self, path: str, lookahead: int | None = None) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = lookahead or sufficient_lookahead(pairs, self.suffix)
        ids = self.vocab
        #: A pair to its rank and the new token, in one number that sorts by rank.
        self.merges = {(ids[a], ids[b]): rank << _BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        #: Symbols side by side inside some token; between any two others is a cut.
        self.joined = {(ids[_symbols(a, self.suffix)[-1]], ids[_symbols(b, self.suffix)[0]]) for a, b in pairs}
        table = byte_symbols()
        self.inner = [ids[c] for c in table]
        self.final = [ids[c + self.suffix] for c in table]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Words to their ids as packed 32-bit numbers, which take a fifth of a list's memory.
        self._words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the words seen so far; a worker that waits for its next task then holds the vocabulary alone."""
        self._words.clear()

    def _merge(self, ids: list[int]) -> list[int]:
        """All merges on a buffer, lowest rank first, leftmost first among equals."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        found = [*map(get, zip(ids, ids[1:]), _NEVER)]
        while found:
            best = min(found)
            if best == _NONE:
                break
            at = found.index(best)
            ids[at : at + 2] = [new] = [best & _MASK]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], new), _NONE)
            if at < len(found):
                found[at] = get((new, ids[at + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        alive = [True] * n
        queue: list[tuple[int, int, tuple[int, int]]] = []

        def offer(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if (found := get(pair)) is not None:
                heapq.heappush(queue, (found, i, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            found, i, pair = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = found & _MASK, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x, keep in zip(ids, alive) if keep]

    @functools.cached_property
    def _length(self) -> dict[int, int]:
        """Symbols in each token."""
        return {i: len(_symbols(t, self.suffix)) for t, i in self.vocab.items()}

    def _step(self, held: list[int], seen: int) -> list[int]:
        """One step of the transducer: tokens of the symbols before the last cut, which leave ``held``; ``seen`` of them had been looked at."""
        joined = self.joined
        if joined.issuperset(zip(held, held[1:]) if seen < 2 else zip(held[seen - 1 :], held[seen:])):
            return []
        at, final = 0, []
        for cut in [i for i, pair in enumerate(zip(held[seen - 1 :], held[seen:]), seen) if pair not in joined]:
            final += self._merge(held[at:cut]) if cut - at > 1 else held[at:cut]
            at = cut
        del held[:at]
        return final

    def stream(self, symbols: Iterable[int], buffer: int | None = None, read: int = READ) -> Iterator[int]:
        """The transducer: symbol ids in, ``read`` at a time, and token ids out once nothing to come can change them."""
        room = self.lookahead + max(buffer or 2 * self.lookahead, 1)
        source, held = iter(symbols), []
        while block := [*itertools.islice(source, read)]:
            seen = max(len(held), 1)
            held += block
            yield from self._step(held, seen)
            if len(held) >= room:
                end = 0
                for token in self._merge(held[:]):
                    if end + self._length[token] > room - self.lookahead:
                        break
                    end += self._length[token]
                    yield token
                del held[:end]
                room = max(room, len(held) + self.lookahead)
        yield from self._merge(held)

    def symbols(self, word: str) -> Iterator[int]:
        """A word's bytes as symbols, the last one with the end-of-word suffix."""
        data = word.encode("utf-8")
        return itertools.chain(map(self.inner.__getitem__, data[:-1]), (self.final[data[-1]],))

    def _word(self, word: str) -> list[int]:
        if len(word) > READ // 4:  # several blocks, as a character has up to four bytes
            return [*self.stream(self.symbols(word))]
        held = [*self.symbols(word)]
        final = self._step(held, 1)  # the stream's one step, and its end
        return final + self._merge(held)

    def _plain(self, text: str) -> bytes:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, out = self._words, b""
        for word in self.pattern.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = array("i", self._word(word)).tobytes()
                if len(word) <= MEMO_CHARS:
                    if len(words) >= MEMO_SIZE:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text without white space, or of any text, as packed 32-bit numbers."""
        if not self._special or not self._special.search(text):
            return self._plain(text)
        at, out = 0, b""
        for found in self._special.finditer(text):
            out += self._plain(text[at : found.start()]) + array("i", [self.special[found.group()]]).tobytes()
            at = found.end()
        return out + self._plain(text[at:])

    def piece(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


def pieces(text: str) -> list[str]:
    """Cut at white space; no token and no split reaches across it."""
    return _SPLIT.split(text) if _ODD.search(text) else text.split()


@functools.cache
def encoder(path: str, lookahead: int | None = None) -> Encoder:
    return Encoder(path, lookahead)


def token_bytes(found: Encoder) -> list[bytes]:
    """What each id adds to a decoded text: with no decoder in the file, tokens are joined by spaces."""
    table = {**{i: t for t, i in found.vocab.items()}, **{i: t for t, i in found.special.items()}}
    return [table.get(i, "").encode("utf-8") + b" " for i in range(max(table) + 1)]


def decode_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Bytes in, text out; at most one unfinished character is held."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield machine.decode(chunk)
    yield machine.decode(b"", True)


class _Memo:
    """Pieces to stretches of one growing array; bounded, emptied when it is full."""

    def __init__(self, found: Encoder) -> None:
        self._encoder = found
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._ends = np.zeros(1 << 16, np.int64)
        self._size = self._count = 0

    def _add(self, ids: np.ndarray, sizes: list[int]) -> None:
        for name, used, values in (("_ids", self._size, ids), ("_ends", self._count + 1, self._size + np.cumsum(sizes, dtype=np.int64))):
            held = getattr(self, name)
            if used + len(values) > len(held):
                held = np.resize(held, max(2 * len(held), used + len(values)))
                setattr(self, name, held)
            held[used : used + len(values)] = values
        self._size += len(ids)
        self._count += len(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number for each text."""
        if self._count > MEMO_SIZE:
            self.reset()
        rows, packed, count = self.rows, self._encoder.packed, self._count
        at: list[int] = []
        counts: list[int] = []
        fresh = bytearray()
        sizes: list[int] = []
        for text in texts:
            found = pieces(text)
            counts.append(len(found))
            hits = [*map(rows.get, found)]
            if None in hits:
                for i, row in enumerate(hits):
                    if row is None:
                        p = found[i]
                        row = rows.get(p)
                        if row is None:
                            ids = packed(p)
                            fresh += ids
                            sizes.append(len(ids) >> 2)
                            row = count
                            count += 1
                            if len(p) <= MEMO_CHARS:
                                rows[p] = row
                        hits[i] = row
            at += hits
        self._add(np.frombuffer(fresh, np.int32), sizes)
        order = np.array(at, np.int64)
        first = self._ends[order]
        size = self._ends[order + 1] - first
        text_of = np.repeat(np.arange(len(texts)), counts)
        return self._ids[ranges(first, size)], np.bincount(text_of, size, len(texts)).astype(np.int64)


def _transduce(path: str, lookahead: int, chunk: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(path, lookahead)  # with the lookahead given, no worker computes it again
        memo = _Memo(found)
        table = token_bytes(found)
        length = np.array([len(t) for t in table], np.int64)
        first = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(table), np.uint8)

        def chunks(ids: np.ndarray) -> Iterator[bytes]:
            """Bytes of the tokens, without the space after the last one."""
            for at in range(0, len(ids), chunk):
                part = ids[at : at + chunk]
                data = flat[ranges(first[part], length[part])].tobytes()
                yield data[:-1] if at + chunk >= len(ids) else data

        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(_lengths(texts))
            at = 0
            while at < len(texts):
                limit = (sizes[at - 1] if at else 0) + (1 << 18)
                stop = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
                ids, counts = memo.encode([t or "" for t in texts.slice(at, stop - at).to_pylist()])
                ends = np.concatenate(([0], np.cumsum(counts)))
                decoded = ["".join(decode_stream(chunks(ids[a:b]))) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, stop - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
                at = stop
        found.forget()

    return frugal(run)


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (text of these ids) for each row."""
    rows = text_input(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    lookahead = encoder(path).lookahead
    return rows.mapInArrow(_transduce(path, lookahead), f"doc_id {kind}, ids array<int>, decoded string")
