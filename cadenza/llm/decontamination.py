"""Benchmark decontamination by template canonicalisation.

Words become template tokens: a number is a typed placeholder, so is a unit that follows one, and so
is a name (a capitalised word that doesn't begin a sentence or line); any other word is itself, lower-cased,
without punctuation. Because names are told by their capitals, which a copy may change, items are also
searched with names as plain words. Windows of WINDOW template tokens are hashed.

A document matches an item where a share of at least `similarity` of the item's different windows is
found in it, and where the slots agree: equal slot values of the item stand for equal values in the
document and the other way round, in a share of at least `similarity` of the slots, so that a question
with other numbers or names is caught and a text that is only built alike is not. The slots are compared
at each place that holds enough of the item's windows: those whose positions in the item and in the text
differ by the same number of tokens, or up to half of the item's length more, for words that were put
in. Every such place of a text is tried. If no place holds enough of the windows, because the item is
scattered over the text, all windows found are one place.

The benchmark is the build side of the hash join: its windows, in sorted arrays and in blocks of bounded
size, are sent to the tasks that read the documents. Documents are not shuffled; a larger benchmark
takes more blocks, each a pass over the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import dropped, written

WINDOW, SIMILARITY = 5, 0.8
#: Words of items sent at once at most, words a worker remembers, and bytes of texts looked up at once (or one text).
BLOCK_WORDS, WORDS, GROUP = 250_000, 150_000, 1 << 20
#: Units that a number may bear.
UNITS = frozenset(
    "%|cm|mm|m|km|inch|inches|foot|feet|ft|yard|yards|mile|miles|mg|g|kg|gram|grams|kilogram|kilograms|ton|tons|oz|ounce|ounces|lb|lbs|pound|pounds"
    "|ml|l|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years"
    "|mph|kph|dollar|dollars|cent|cents|euro|euros|usd|eur|percent|degree|degrees|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|j|kj|n|pa|kpa".split("|")
)
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(%|[A-Za-z]{0,3})")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(f"\0{t}")) for t in ("number", "name", "unit"))
_IS_NUMBER, _CAPITAL, _ENDS, _IS_UNIT, _BLANK = 1, 2, 4, 8, 16
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


class Words(dict):
    """What is known of words: numbers of rows of two arrays, the hash of the word and its flags."""

    def __init__(self):
        super().__init__()
        self.hash, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        s = word.decode("utf-8", "replace")
        core = s if s.isalnum() else _EDGE.sub("", s)
        flags = 0
        if s.endswith((".", "!", "?", ":", '."', '!"', '?"', ".)")):
            flags |= _ENDS
        if not core and s != "%":
            flags |= _BLANK
        elif _NUMBER.fullmatch(core) or _NUMBER.fullmatch(s):
            flags |= _IS_NUMBER
        else:
            if core[:1].isupper() and core[1:2] != "" and not core.isupper():
                flags |= _CAPITAL
            if (core or s).lower() in UNITS:
                flags |= _IS_UNIT
        k = self[word] = len(self)
        if k == len(self.hash):
            self.hash, self.flags = np.resize(self.hash, 2 * k), np.resize(self.flags, 2 * k)
        self.hash[k], self.flags[k] = xxhash.xxh64_intdigest((core or s).lower()), flags
        return k

    def texts(self, texts: list[bytes | None]) -> Texts:
        if len(self) > WORDS:
            self.clear()
        words = [(t or b"").replace(b"\n", b" . ").split() for t in texts]  # a line's end ends a sentence
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        return Texts(self.hash[at], self.flags[at], np.repeat(np.arange(len(texts)), n), len(texts))


class Texts:
    """Template tokens of texts, one after another.

    row: the text of each token, starts: where each text begins. tokens: for names as slots and for names
    as plain words. value: the hash of what a token stands for. slots: whether it is a slot, for both.
    """

    def __init__(self, value: np.ndarray, flags: np.ndarray, row: np.ndarray, n: int):
        stay = flags & _BLANK == 0
        first = np.ones(len(row), bool)  # a sentence, line or text begins
        first[1:] = (row[1:] != row[:-1]) | (flags[:-1] & _ENDS != 0)
        self.value, self.row, flags, first = value[stay], row[stay], flags[stay], first[stay]
        number = flags & _IS_NUMBER != 0
        unit = np.zeros(len(flags), bool)
        unit[1:] = (flags[1:] & _IS_UNIT != 0) & number[:-1] & (self.row[1:] == self.row[:-1])
        self.name = (flags & _CAPITAL != 0) & ~first & ~unit
        plain = np.where(number, NUMBER, np.where(unit, UNIT, self.value))
        self.tokens = (np.where(self.name, NAME, plain), plain)
        self.slots = (number | unit | self.name, number | unit)
        self.starts = np.searchsorted(self.row, np.arange(n + 1))


def windows(token: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Hashes of all windows of length tokens; none of fewer tokens."""
    n = max(0, len(token) - length + 1)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out += token[k : k + n] * _POWERS[k]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def agreement(mine: np.ndarray, theirs: np.ndarray) -> float:
    """Share of pairs of slot values that one mapping, one to one, explains; the most frequent pairs come first, then the smallest."""
    pairs = Counter(zip(mine.tolist(), theirs.tolist(), strict=True))
    if not pairs:
        return 1.0
    left, right, agreed = set(), set(), 0
    for (x, y), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            agreed += n
    return agreed / len(mine)


class Block:
    """Benchmark items as sorted arrays of windows; each item twice, with names as slots and as plain words."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item = [i for i, _ in items]
        words = Words()
        self.parts = []
        keys, who, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, (_, text) in enumerate(items):
            t = words.texts([text])
            for plain in (0, 1):
                token = t.tokens[plain]
                w = windows(token, min(WINDOW, len(token))) if len(token) else np.zeros(0, np.uint64)
                self.parts.append((len(token), t.value, t.slots[plain], w))
                keys.append(w)
                who.append(np.full(len(w), 2 * row + plain))
                where.append(np.arange(len(w)))
        keys, who, where = np.concatenate(keys), np.concatenate(who), np.concatenate(where)
        self.keys, which = np.unique(keys, return_inverse=True)
        # items of each different window, each once
        pairs = np.unique(which * max(1, len(self.parts)) + who)
        self.who = pairs % max(1, len(self.parts))
        self.ends = np.searchsorted(pairs // max(1, len(self.parts)), np.arange(len(self.keys) + 1))
        self.different = np.bincount(self.who, minlength=len(self.parts))
        self.lengths = sorted({WINDOW} | {n for n, *_ in self.parts if 0 < n < WINDOW})
        bits = min(24, max(10, (64 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(self.keys >> self.shift).view(np.int64)] = True

    def _found(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows w at places at: the numbers of those keys that are items', and their places."""
        may = np.flatnonzero(self.sieve[(w >> self.shift).view(np.int64)])
        k = np.searchsorted(self.keys, w[may])
        ok = self.keys[np.minimum(k, len(self.keys) - 1)] == w[may]
        return k[ok], at[may[ok]]

    def search(self, t: Texts, similarity: float) -> Iterator[tuple[int, int, int, float, float]]:
        """(text, item's row, windows found, similarity, slot agreement) of the items that texts hold, in order."""
        if not len(self.keys):
            return
        hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for length in self.lengths:
            n = max(0, len(t.row) - length + 1)
            whole = np.flatnonzero(t.row[:n] == t.row[length - 1 : length - 1 + n])
            hits[0].append(self._found(windows(t.tokens[0], length)[whole], whole))
            # with names as plain words only windows that hold one are others
            named = np.zeros(n, bool)
            for k in range(length):
                named |= t.name[k : k + n]
            some = named[whole]
            key, at = hits[0][-1]
            hits[1].append((key[~named[at]], at[~named[at]]))
            if some.any():
                hits[1].append(self._found(windows(t.tokens[1], length)[whole[some]], whole[some]))
        found: dict[tuple[int, int], tuple[int, int, int, float, float]] = {}
        for plain in (0, 1):
            key, at = (np.concatenate(x) for x in zip(*hits[plain], strict=True))
            if not len(key):
                continue
            # different windows of each text, then the items that have them
            seen = np.unique(t.row[at] * len(self.keys) + key)
            text, key_of = seen // len(self.keys), seen % len(self.keys)
            n = self.ends[key_of + 1] - self.ends[key_of]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.ends[key_of], n)
            pair, many = np.unique(np.repeat(text, n) * len(self.parts) + self.who[entry], return_counts=True)
            who = pair % len(self.parts)
            enough = (who % 2 == plain) & (many >= similarity * self.different[who] - 1e-9)
            for g, of, m in zip((pair // len(self.parts))[enough].tolist(), who[enough].tolist(), many[enough].tolist(), strict=True):
                if (g, of // 2) not in found and (agreed := self._agreed(t, g, of, similarity)) is not None:
                    found[g, of // 2] = (g, of // 2, m, m / int(self.different[of]), agreed)
        yield from (found[k] for k in sorted(found))

    def _agreed(self, t: Texts, text: int, of: int, similarity: float) -> float | None:
        """The agreement of slots at the first place in a text that agrees enough, or None."""
        length, values, slot, w = self.parts[of]
        plain, size = of % 2, min(WINDOW, length)
        a, z = t.starts[text], t.starts[text + 1]
        value = t.value[a:z]
        here = windows(t.tokens[plain][a:z], size)
        # all pairs of a window of the item and one of the text that are equal
        order = np.argsort(w, kind="stable")
        low, high = np.searchsorted(w[order], here), np.searchsorted(w[order], here, "right")
        n = high - low
        i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
        p = np.repeat(np.arange(len(here)), n)
        if length < WINDOW and slot.all():
            # nothing but slots: their values must be the same
            return 1.0 if any(np.array_equal(values, value[k : k + length]) for k in p.tolist()) else None
        order = np.lexsort((i, p - i))
        i, p = i[order], p[order]
        shift = p - i
        _, kind = np.unique(w, return_inverse=True)
        need = similarity * (kind.max() + 1) - 1e-9
        begin = np.flatnonzero(np.diff(shift, prepend=shift[0] - 1))
        end = np.searchsorted(shift, shift[begin] + max(size, length // 2), "right")
        held, best = False, None
        for b, e in zip(begin[end - begin >= need].tolist(), end[end - begin >= need].tolist(), strict=True):
            if len(np.unique(kind[i[b:e]])) >= need:
                held = True
                agreed = self._slots_agree(values, slot, value, i[b:e], p[b:e], size)
                if agreed >= similarity:
                    return agreed
        if not held:
            best = self._slots_agree(values, slot, value, i, p, size)
        return best if best is not None and best >= similarity else None

    @staticmethod
    def _slots_agree(values: np.ndarray, slot: np.ndarray, value: np.ndarray, i: np.ndarray, p: np.ndarray, size: int) -> float:
        step = np.arange(size)
        both = np.unique(np.stack([(i[:, None] + step).ravel(), (p[:, None] + step).ravel()]), axis=1)
        mine, theirs = both[:, slot[both[0]]]
        return agreement(values[mine], value[theirs])

    def matches(self, text: bytes | None, similarity: float = SIMILARITY) -> list[tuple[int, int, float, float]]:
        """(item_id, windows found, similarity, slot agreement) of the items that one text holds."""
        return [(self.item[row], *m) for _, row, *m in self.search(Words().texts([text]), similarity)]


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items (item_id, text) in blocks of at most limit words, streamed; a longer item is its own block."""
    held, n = [], 0
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    for r in rows.toLocalIterator():
        size = len(bytes(r["text"]).split())
        if held and n + size > limit:
            yield sorted(held)
            held, n = [], 0
        held.append((r["item_id"], bytes(r["text"])))
        n += size
    if held:
        yield sorted(held)


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows (from, to, texts) of about GROUP bytes."""
    start, size, held = 0, 0, []
    for k, t in enumerate(batch.column(column).cast(pa.binary())):
        held.append(t.as_py())
        size += len(held[-1] or b"")
        if size >= GROUP or k + 1 == batch.num_rows:
            yield start, k + 1, held
            start, size, held = k + 1, 0, []


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, similarity, agreement): a row for each row of docs and item it holds.

    docs has doc_id and text, benchmark item_id and text; other columns are not read. Null, empty and
    blank texts match nothing; texts of any length are searched whole. An item of fewer than WINDOW
    template tokens is one window. Where several places of a text agree, the agreement is that of the
    first. Repeated items and documents are answered each; empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shape = "doc_id long, item_id long, n_windows long, similarity double, agreement double"

    def search(items: list[tuple[int, bytes]]) -> DataFrame:
        # at most block_words words, or one item
        shared = docs.sparkSession.sparkContext.broadcast(Block(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, words = shared.value, Words()
            for batch in batches:
                for a, _, texts in _grouped(batch, 1):
                    out = list(block.search(words.texts(texts), similarity))
                    if out:
                        text, row, n, share, agreed = zip(*out, strict=True)
                        ids = batch.column(0).take(pa.array([a + k for k in text]))
                        columns = [ids, pa.array([block.item[r] for r in row], pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(agreed, pa.float64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_windows", "similarity", "agreement"])

        return rows.mapInArrow(run, shape)

    found = [search(b) for b in blocks(benchmark, block_words)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], shape)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs (text, ...) that hold no item of benchmark (item_id, text), with all their columns.

    Each row is judged by its own text, as leaks() has it, so null, repeated or shared ids do no harm;
    null, empty and blank texts stay. Nothing is shuffled. An empty benchmark leaves all rows. Where the
    benchmark takes several blocks, what one leaves is written for the next.
    """
    at, schema = docs.columns.index("text"), docs.schema
    out, before = docs, None
    for items in blocks(benchmark, block_words):
        if out is not docs:
            out = written(out, "clean")
            dropped(before)
            before = out
        # at most block_words words, or one item
        shared = docs.sparkSession.sparkContext.broadcast(Block(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, words = shared.value, Words()
            for batch in batches:
                for a, z, texts in _grouped(batch, at):
                    stay = np.ones(z - a, bool)
                    stay[[k for k, *_ in block.search(words.texts(texts), similarity)]] = False
                    if stay.any():
                        yield batch.slice(a, z - a).filter(pa.array(stay))

        out = out.mapInArrow(run, schema)
    return out
