from __future__ import annotations

import collections
import re

import numpy as np
import pytest
import xxhash
from cadenza.llm import common, embedding_dedup, line_dedup, simhash
from pyspark.sql import functions as F

ODD_DOCS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"), (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE  two"), (8, "Ünïcödé wörds hëre ÄÖ"), (2, "the quick brown fox jumps over the lazy dog again and again"),
    (9, "x " * 30_000), (10, "y" * 50_000), (None, "one two"),
]


def docs(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"fp": F.lit("mine"), "component_id": F.lit(-1), "_text": F.lit("x"), "lang": F.lit(None).cast("string"), "source": F.lit("s")} | {k: F.lit(v) for k, v in extra.items()})


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


@pytest.mark.parametrize("text", [t for _, t in ODD_DOCS])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def plain_components(values, near):
    """Smallest index reachable."""
    out = {}
    for i in range(len(values)):
        if i in out:
            continue
        stack, out[i] = [i], i
        while stack:
            x = stack.pop()
            for y in range(len(values)):
                if y not in out and near(values[x], values[y]):
                    out[y] = i
                    stack.append(y)
    return out


@pytest.mark.parametrize("n", [60, 900])
def test_links_equal_brute_force(spark, n, monkeypatch):
    """Chains at the radius, dense groups, small tiles and tiles that are subdivided."""
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "SHARE", 1)
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n // 3, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(n - len(base))]
    fps = np.unique(np.concatenate([base, np.array([int(rng.choice(base)) ^ f for f in flips], np.uint64)]))
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), 4)
    got = {r.node: r.component for r in common.components(edges).collect()}
    want = plain_components(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    signed = fps.view(np.int64).tolist()
    groups = collections.defaultdict(set)
    for i, root in want.items():
        groups[root].add(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_near_compares_every_pair():
    rng = np.random.default_rng(1)
    left, right = (rng.integers(0, 2**64, 1500, dtype=np.uint64) & np.uint64(0xFFF0FF) for _ in range(2))
    got = {(i, j) for a, b in simhash.near(left, right, 4) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    hit = np.bitwise_count(left[:, None] ^ right[None, :]) <= 4
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True))


def test_near_duplicates_of_odd_documents(spark):
    out = simhash.near_duplicates(docs(spark, ODD_DOCS)).collect()
    assert len(out) == len(ODD_DOCS)
    got = collections.defaultdict(set)
    for r in out:
        got[r.doc_id].add(r.component_id)
    assert got[1] == got[2] == {1} and got[3] == got[4] == got[5] == {3} and got[6] == got[7] == got[None] == {6}
    assert all(len(v) == 1 for v in got.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_each_component(spark):
    rows = [(1, "one two three four five six", "a", None), (1, "One two three  four five six", "a", None), (None, "one two three four five six", "z", 1), (2, "nothing like it at all here", "b", 2), (2, "nothing like it at all here", "b", 2)]
    rows += [(None, "only null ids have this text", None, 3), (None, "only null ids have this text", None, 4), (None, None, None, None), (None, "", None, None), (3, "  ", "c", None), (4, "a" * 300_000, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    for at in (df, df.where("doc_id <> 2 or doc_id is null")):
        got = [tuple(r) for r in simhash.one_of_each(at).collect()]
        base = {plain_fingerprint(r[1]): [] for r in rows}
        for r in rows:
            base[plain_fingerprint(r[1])].append(r)
        groups = plain_components(list(base), lambda a, b: (a ^ b).bit_count() <= 4)
        whole = {}
        for k, of in enumerate(base.values()):
            whole.setdefault(groups[k], []).extend(r for r in of if at is df or r[0] != 2)
        whole = [g for g in whole.values() if g]
        assert len(got) == len(whole)
        for g in whole:
            least = min((r[0] for r in g if r[0] is not None), default=None)
            assert sum(r in g and r[0] == least for r in got) == 1
    assert simhash.one_of_each(df.where("false")).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(100)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(100)) and 5000 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows, label="int"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {label}").withColumns({"cid": F.lit(1), "n_links": F.lit("x")})


def plain_links(rows, threshold):
    good = []
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if ok else None)
    ids = [r[0] for r in rows]
    linked = collections.defaultdict(set)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if ids[a] != ids[b] and good[a] is not None and good[b] is not None and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    linked[ids[a]].add(ids[b])
    component = {}
    for i in sorted(ids):
        if i not in component:
            stack, component[i] = [i], i
            while stack:
                for y in linked[stack.pop()]:
                    if y not in component:
                        component[y] = i
                        stack.append(y)
    return {i: (len(linked[i]), component[i]) for i in ids}


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 2)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(12, 16))
        for k in range(150 if label else 40):
            v = centres[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.4])
            rows.append((len(rows), (v * rng.choice([0.5, 1, 3])).astype(np.float32).tolist(), label))
    rows += [(1000 + k, rows[3][1], 0) for k in range(30)]  # copies
    rows += [(1100 + k, [1.0 + k * 1e-4] + [0.5] * 15, 1) for k in range(120)]  # a dense group
    rows += [(1300, None, 1), (1301, [], 1), (1302, [0.0] * 16, 1), (1303, [float("nan")] + [1.0] * 15, 1), (1304, [None] + [1.0] * 15, 1), (1305, [float("inf")] + [1.0] * 15, 1), (1306, rows[0][1], None), (1307, rows[0][1][:5], 0), (1308, rows[0][1][:5], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, rows), 0.98).collect()}
    assert got == plain_links(rows, 0.98)


def test_embedding_repeats_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, rows), 0.98).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("None", 0, None)]
    assert embedding_dedup.near_duplicates(vectors(spark, []), 0.98).count() == 0
    other = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.001, 1.0], 1)]  # one name, two vectors
    got = sorted(map(tuple, embedding_dedup.near_duplicates(vectors(spark, other), 0.98).collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_embeddings_of_any_size(spark):
    """Double components whose squares overflow or vanish."""
    rows = [(1, [1e200, 0.0], "a"), (2, [1.0, 1e-3], "a"), (3, [1e-200, 0.0], "a"), (4, [0.0, 1e300], "a"), (5, [1e-320, 1e-300], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.98).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def key_of(line):
    k = re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [f"Shared line number {k} \t" for k in range(12)] + ["short", "ÄÖÜßéèêëñ9", "äÖÜßéèêëñ9", "  " + "z" * 9, "\x0bshared LINE number 3"]
    rows = [(int(k), "\n".join(rng.choice(pool + [f"only {k} {j} in one place" for j in range(4)], rng.integers(1, 9)))) for k in rng.permutation(80)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "Shared line number 1\r\nShared line number 1"), (94, "w" * 100_000 + "\n" + "w" * 100_000), (95, "w" * 100_000), (95, "w" * 100_000)]
    hold = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key_of(x)) >= 10:
                hold[key_of(x)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(hold[key_of(x)]) >= 2 and min(hold[key_of(x)]) != i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.dedup_lines(docs(spark, rows, drops=1, at="a"), shard_keys=3).collect()
    assert sorted(map(tuple, out)) == sorted(want)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_packs():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, (5000, 2), dtype=np.uint64).view(line_dedup._PAIR).ravel())
    keys["lo"][:50] = 7  # equal halves are still different keys
    at = line_dedup.PerfectHash.build(keys).find(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    shard = line_dedup.Shard.unpack(line_dedup.Shard(keys, np.full(len(keys), 2), np.arange(len(keys))).pack())
    assert shard.repeated(keys, np.full(len(keys), -1)).all() and not shard.repeated(keys, np.arange(len(keys))).any()
    other = rng.integers(0, 2**64, (5000, 2), dtype=np.uint64).view(line_dedup._PAIR).ravel()
    assert not shard.repeated(other, np.full(len(other), -1)).any()
