"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text accepts every substring of that text. A
document is parsed against it: each phrase is the longest match from where the last one ended, one
character at least. The language with the fewest phrases a character wins. A phrase costs about the
logarithm of the labelled text's length, so the score is the softmax of those costs.

Texts are lower-cased; every run of characters that aren't letters is one blank; all letters are told
apart. The parse of a text is one walk through the automaton from its first to its last character. To
step through many places at once in numpy, texts are cut into segments that are walked side by side,
as if each began a phrase; then each is walked again from the state in which the one before it
ended, until it meets its first walk, after which the two are the same. So the cuts change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import for_worker

#: Bounds of the labelled sample: documents and characters for each language.
DOCS, CHARS = 400, 48_000
#: Characters of a segment, characters parsed at once (or one text), and times that segments are walked again at most before a text is walked alone.
SEGMENT, GROUP, ROUNDS = 512, 1 << 20, 6
_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other than letters is one 0."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_LETTERS[c], c, 0)
    return c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]


class Automaton:
    """The suffix automaton of codes below width, as arrays.

    Transitions are in hash tables by state and code: a slot holds one, others of that slot are in the
    next, smaller table. The transitions of the first state begin phrases and are an array by code, in
    which codes that the text lacks lead to the first state again: a phrase of their own.
    """

    def __init__(self, codes: list[int], width: int):
        self.width = width
        steps = self._states(codes)
        self.root = np.zeros(width, np.int64)
        self.root[list(steps[0])] = list(steps[0].values())
        key = np.array([s * width + c for s, edges in enumerate(steps) if s for c in edges], np.int64)
        to = np.array([t for s, edges in enumerate(steps) if s for t in edges.values()], np.int32)
        self.tables = []
        while len(key) or not self.tables:
            bits = max(4, int(4 * len(key)).bit_length())
            times, down = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables)), np.uint64(64 - bits)
            slot = self._slot(key, times, down)
            taken, first, n = np.unique(slot, return_index=True, return_counts=True)
            keys, tos, more = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
            keys[taken], tos[taken], more[taken] = key[first], to[first], n > 1
            self.tables.append((times, down, keys, tos, more))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, to = key[rest], to[rest]

    @staticmethod
    def _states(codes: list[int]) -> list[dict[int, int]]:
        """For each state its transitions."""
        link, length, step, last = [-1], [0], [{}], 0
        for c in codes:
            here = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = here
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[here] = twin
            last = here
        return step

    @staticmethod
    def _slot(key: np.ndarray, times: np.uint64, down: np.uint64) -> np.ndarray:
        return ((key.view(np.uint64) * times) >> down).view(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        key = state * self.width
        key += code
        times, down, keys, tos, more = self.tables[0]
        slot = self._slot(key, times, down)
        begins = keys[slot] != key
        to = tos[slot].astype(np.int64)
        again = np.flatnonzero(begins & more[slot])
        for times, down, keys, tos, more in self.tables[1:]:
            if not len(again):
                break
            slot = self._slot(key[again], times, down)
            hit = keys[slot] == key[again]
            at = again[hit]
            to[at], begins[at] = tos[slot[hit]], False
            again = again[~hit & more[slot]]
        fresh = np.flatnonzero(begins)
        to[fresh] = self.root[code[fresh]]
        return to, begins

    def count(self, codes: np.ndarray) -> int:
        """Phrases of one text, a character at a time."""
        edges = {k: t for _, _, keys, tos, _ in self.tables for k, t in zip(keys[keys >= 0].tolist(), tos[keys >= 0].tolist(), strict=True)}
        root, width, state, n = self.root.tolist(), self.width, 0, 0
        for c in codes.tolist():
            state = edges.get(state * width + c)
            if state is None:
                state, n = root[c], n + 1
        return n


class Model:
    """Labelled text by language; the automata are made where they are used."""

    def __init__(self, samples: dict[str, str]):
        self.samples = dict(sorted(samples.items()))


def _automata(samples: tuple[str, ...]) -> tuple[np.ndarray, list[Automaton]]:
    """The code of every code point (0: blank, 1: in no sample), and the automaton of each sample."""
    texts = [characters(t) for t in samples]
    letters = np.unique(np.concatenate([*texts, np.zeros(1, np.uint32)]))[1:]
    code = np.ones(0x110000, np.int32)
    code[0] = 0
    code[letters] = np.arange(2, len(letters) + 2)
    return code, [Automaton(code[t].tolist(), len(letters) + 2) for t in texts]


def phrases(texts: list[np.ndarray], automata: list[Automaton]) -> np.ndarray:
    """Phrases of each coded text (rows) by each automaton (columns)."""
    counts = [-(-len(t) // SEGMENT) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.concatenate([np.minimum(SEGMENT, len(t) - SEGMENT * np.arange(n)) for t, n in zip(texts, counts, strict=True)] or [np.zeros(0, int)]).astype(np.int64)
    out = np.zeros((len(texts), len(automata)), np.int64)
    if not len(owner):
        return out
    flat = np.concatenate(texts)
    starts = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.append(True, owner[1:] != owner[:-1])
    before = np.where(first, -1, np.append(0, rank[:-1]))[order]  # the lane of the segment before
    size, starts, owner = size[order], starts[order], owner[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")  # segments longer than j
    grid = np.zeros((size[0], len(size)), np.int32)
    for j, n in enumerate(alive):
        grid[j, :n] = flat[starts[:n] + j]
    ends = (size - 1, np.arange(len(size)))
    for k, a in enumerate(automata):
        trail, begins = np.zeros(grid.shape, np.int32), np.zeros(grid.shape, bool)
        state = np.zeros(len(size), np.int64)
        for j, n in enumerate(alive):
            state[:n], begins[j, :n] = a.step(state[:n], grid[j, :n])
            trail[j, :n] = state[:n]
        entry = np.zeros(len(size), np.int64)
        for _ in range(ROUNDS):
            true = np.where(before >= 0, trail[ends][before], 0).astype(np.int64)
            lane = np.flatnonzero(true != entry)
            if not len(lane):
                break
            state = entry[lane] = true[lane]
            j = 0
            while len(lane):
                state, begins[j, lane] = a.step(state, grid[j, lane])
                on = (trail[j, lane] != state) & (size[lane] > j + 1)
                trail[j, lane] = state
                lane, state, j = lane[on], state[on], j + 1
        out[:, k] = np.bincount(owner, begins.sum(axis=0), len(texts))
        for t in np.unique(owner[np.where(before >= 0, trail[ends][before], 0) != entry]).tolist():
            out[t, k] = a.count(texts[t])
    return out


def fit(docs: DataFrame, keep=None, max_docs: int = DOCS, max_chars: int = CHARS) -> Model:
    """Learn from the rows of docs (doc_id, text, lang) with text and lang that keep (a Column) selects.

    The sample is bounded: for each language whole documents in the order of a hash of doc_id, those of
    at most an eighth of max_chars characters first, until there are max_docs of them or the next would
    make more than max_chars characters; one at least. A language is a value of lang; their number
    times max_chars is what the driver gets and each task is sent. Rows of null doc_id or of one doc_id
    are ordered by text.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if keep is None else rows.where(keep)
    mark = F.xxhash64(F.col("doc_id").cast("string"))
    rate = F.lit(1.0)
    for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect():  # a threshold for each language, so that no large group is sorted
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.5 * max_docs / r["n"]))).otherwise(rate)
    some = rows.where((F.pmod(mark, F.lit(1 << 40)) / float(1 << 40)) < rate).select("lang", mark.alias("mark"), F.col("text").cast("string").alias("text"), F.length("text").alias("size"))
    order = W.partitionBy("lang").orderBy(F.col("size") > max_chars // 8, "mark", "text")
    total = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    chosen = some.withColumns({"k": F.row_number().over(order), "total": total}).where((F.col("k") == 1) | ((F.col("k") <= max_docs) & (F.col("total") <= max_chars)))
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model({lang: " ".join(of) for lang, of in samples.items() if any(c.isalpha() for t in of for c in t)})


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep, lang_pred, score, n_letters and phrase_rate for every row of docs (text, ...).

    lang_pred is "und", with score 0, where text is null or has no letter, and for every text if
    nothing was learned. Equal costs: the language that comes first in the alphabet. phrase_rate is
    phrases a character, 1 for text unlike all that was learned. Texts of any length are parsed whole.
    Repeated rows are answered each; an empty table gives an empty result. The four new columns replace
    columns of those names; only text is read.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "n_letters", "phrase_rate")]
    # a text that is kept anyway is sent once
    own = "text" in kept and dict(docs.dtypes)["text"] == "string"
    rows = docs.select(*kept) if own else docs.select(*kept, F.col("text").cast("string").alias("_text"))
    at = kept.index("text") if own else len(kept)
    shape = rows.select(*rows.columns[: len(kept)]).schema.add("lang_pred", "string").add("score", "double").add("n_letters", "long").add("phrase_rate", "double")
    names = list(model.samples)
    # at most max_chars characters a language
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model.samples.values()))
    nats = np.log([max(2, len(t)) for t in model.samples.values()])

    def answer(batch: pa.RecordBatch, coded: list[np.ndarray], letters: list[int], automata: list[Automaton]) -> pa.RecordBatch:
        found = phrases(coded, automata)
        size = np.array([max(1, len(c)) for c in coded])
        known = np.array([len(c) > 0 for c in coded])
        if names:
            cost = found * nats
            best = cost.argmin(axis=1)
            share = 1 / np.exp(np.minimum(0, cost.min(axis=1, keepdims=True) - cost)).sum(axis=1)
            rate = found[np.arange(len(best)), best] / size
            lang = [names[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        else:
            share, rate, lang = np.zeros(len(size)), np.ones(len(size)), ["und"] * len(size)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(letters, pa.int64()), pa.array(np.where(known, rate, 1.0))],
            [*kept, "lang_pred", "score", "n_letters", "phrase_rate"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = shared.value
        code, automata = for_worker(("language", samples), lambda: _automata(samples))
        for batch in batches:
            start, held, coded, letters = 0, 0, [], []
            for k, t in enumerate(batch.column(at)):
                c = characters(t.as_py() or "")
                letters.append(int(np.count_nonzero(c)))
                coded.append(code[c] if letters[-1] and names else code[:0])
                held += len(coded[-1])
                if held >= GROUP or k + 1 == batch.num_rows:
                    yield answer(batch.slice(start, k + 1 - start), coded, letters, automata)
                    start, held, coded, letters = k + 1, 0, [], []

    return rows.mapInArrow(run, shape)
