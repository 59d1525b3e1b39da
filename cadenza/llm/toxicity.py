"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word, or the first characters (STEMS) of a longer word (so that an insult is
known with endings that were never labelled), hashed to BUCKETS. A text's features are the terms it
holds. Its logit is

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

where the pairwise part learns what only stands together, such as an insult and a mention of a
group. Training sees all terms of the labelled sample. It is AdaGrad with soft thresholds, which leave
all but telling terms at exactly zero: the model is a short list of buckets, and only those are looked
up when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import dropped, written

#: Labelled rows to learn from at most; hash buckets; factors of a term.
ROWS, BUCKETS, FACTORS = 20_000, 1 << 22, 4
#: What each pass over the labelled rows takes from the size of a weight, and of a term's factors; the factors' size at
#: the start: they grow in proportion to one another, so from nothing a rare pair would take too many passes.
LESS_WEIGHT, LESS_FACTORS, START = 0.02, 0.01, 0.1
STEMS = (4, 5, 6, 7)
#: Words a worker remembers at most; beyond it starts anew.
WORDS = 500_000
_CLEAN = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words(text: bytes | None) -> set[bytes]:
    """The different words of UTF-8 text: A-Z lower-cased, ASCII letters and digits and all else beyond ASCII."""
    return set((text or b"").translate(_CLEAN).split())


def buckets(word: bytes) -> list[int]:
    """The buckets of a word's terms."""
    s = word.decode("utf-8", "replace")
    terms = [word, *(b"^" + s[:n].encode() for n in STEMS if len(s) > n)]
    return [xxhash.xxh32_intdigest(t) % BUCKETS for t in terms]


class Model:
    """Bias, and weight and factors by bucket."""

    def __init__(self, bias: float, terms: np.ndarray, weight: np.ndarray, factors: np.ndarray):
        self.bias, self.terms, self.weight, self.factors = bias, terms, weight, factors

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.row = {int(t): k for k, t in enumerate(model.terms)}

    def score(self, text: bytes | None) -> float:
        """The probability of label 1."""
        found, known, row = words(text), self.known, self.row
        if len(known) > WORDS:
            known.clear()
        rows: set[int] = set()
        for w in found:
            if (of := known.get(w)) is None:
                of = known[w] = tuple(row[b] for b in buckets(w) if b in row)
            if of:
                rows.update(of)
        logit, m = self.model.bias, self.model
        if rows:
            at = np.fromiter(sorted(rows), np.int64, len(rows))
            v = m.factors[at]
            logit += m.weight[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, epochs: int = 40, rate: float = 0.3, held: float = 0.75, seed: int = 7) -> Model:
    """Fit on 0/1 labels and each text's terms (sorted, distinct, all of them among the sorted terms).

    The bias stays at the labels' log-odds. Each step shows only a random part, held, of a text's terms,
    so that one telling term must be enough where others are absent, and two still meet. No term is left out beforehand; the
    model lists those that don't end at exactly zero.
    """
    y = labels.astype(np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    flat = np.empty(starts[-1], np.int32)
    for r, a, z in zip(rows, starts[:-1], starts[1:], strict=True):
        flat[a:z] = np.searchsorted(terms, r)
    n = len(terms)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n, np.float32), rng.normal(0, START, (n, FACTORS)).astype(np.float32)
    gw, gv = np.full(n, 0.01, np.float32), np.full((n, FACTORS), 0.1, np.float32)
    done, place, seen = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    step, steps = 0, max(1, -(-len(rows) // 512))

    def less(w, v, k):
        """Weights and factors after k steps' thresholds."""
        size = np.maximum(1e-12, np.sqrt((v**2).sum(axis=1)))
        return np.sign(w) * np.maximum(0, np.abs(w) - k * (LESS_WEIGHT / steps)), v * np.maximum(0, 1 - k * (LESS_FACTORS / steps) / size)[:, None]

    for _ in range(epochs if n else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            f = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            stay = rng.random(len(f), np.float32) < held
            f, own = f[stay], own[stay]
            # only these texts' terms are read and changed; the thresholds that they missed are made up for
            seen[f] = True
            u = np.flatnonzero(seen)
            seen[u] = False
            place[u] = np.arange(len(u))
            f = place[f]
            wu, vu = less(w[u], v[u], step - done[u])
            size = np.bincount(own, minlength=len(part))
            first, some = (np.cumsum(size) - size)[size > 0], size > 0

            def total(x):
                out = np.zeros(len(part))
                if len(f):
                    out[some] = np.add.reduceat(x[f], first)
                return out

            sums = np.stack([total(np.ascontiguousarray(x)) for x in vu.T], axis=1)
            logit = bias + total(wu) + 0.5 * ((sums**2).sum(axis=1) - total((vu**2).sum(axis=1)))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / 32
            dw = np.bincount(f, g[own], len(u))
            dv = np.stack([np.bincount(f, (g * sums[:, c])[own], len(u)) for c in range(FACTORS)], axis=1) - vu * dw[:, None]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u], v[u] = less(wu - rate * dw / np.sqrt(gw[u]), vu - 0.2 * rate * dv / np.sqrt(gv[u]), 1)
            step += 1
            done[u] = step
    w, v = less(w, v, step - done)
    told = (w != 0) | (v != 0).any(axis=1)
    return Model(bias, terms[told], w[told].astype(np.float64), v[told].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = ROWS) -> Model:
    """Learn from labels (doc_id, toxic) of documents (doc_id, text) whose doc_id keep selects.

    The sample is bounded: the max_rows labelled doc_id that come first by a hash. The driver gets the
    bucket numbers of the sample's terms, at most BUCKETS different ones. Rows without a
    label are left out; several labels of one doc_id count as the largest.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if keep is None else rows.where(keep)
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = one.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [np.unique(np.array([b for w in words(t) for b in buckets(w)], np.int32)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(of, pa.binary())], ["doc_id", "toxic", "terms"])

    # at most max_rows pairs of numbers are broadcast
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    held = written(chosen.mapInArrow(run, "doc_id long, toxic int, terms binary"), "labelled")
    got = [(r["doc_id"], r["terms"], r["toxic"]) for r in held.toLocalIterator()]
    dropped(held)
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    of = [np.frombuffer(r[1], np.int32) for r in got]
    seen = np.zeros(BUCKETS, bool)
    for t in of:
        seen[t] = True
    return train(of, np.array([r[2] for r in got]), np.flatnonzero(seen).astype(np.int32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text, ...): the probability that it is toxic.

    Null, empty and blank texts hold no term and get the score of the bias alone; so do all texts if
    nothing was learned. Texts of any length are read whole. Repeated rows are answered each; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
