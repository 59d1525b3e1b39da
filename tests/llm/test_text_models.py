from __future__ import annotations

import zlib

import numpy as np
import pytest
from cadenza.llm import decontamination, language, queries, sharding, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("x"), "toxic": F.lit(2), "h": F.lit(1)})


def plain_phrases(text, sample):
    """Greedy longest matches against a plain text."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("segment", [7, 512])
def test_cross_parsing_equals_plain_search(monkeypatch, segment):
    """Whole texts, whatever the segments: random ones, and ones whose walks never meet."""
    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    samples = ["".join(rng.choice(list("abcd "), 400)), "abcde" * 50, "a"]
    codes = {c: k for k, c in enumerate(" ?abcde")}
    automata = [language.Automaton([codes[c] for c in s], len(codes)) for s in samples]
    texts = ["", "a", "abcabc", "eee", "".join(rng.choice(list("abcde "), 5000)), samples[0], "abcde" * 1300, "cdeab" * 400 + "?" + "bcdea" * 300]
    got = language.phrases([np.array([codes[c] for c in x], np.int32) for x in texts], automata)
    assert got.tolist() == [[plain_phrases(x, s) for s in samples] for x in texts]
    assert [a.count(np.array([codes[c] for c in texts[4]])) for a in automata] == got[4].tolist()


def test_letters_of_large_alphabets_are_told_apart():
    rng = np.random.default_rng(1)
    a, b = (["".join(map(chr, rng.integers(0x4E00 + k, 0x4E00 + k + 1500, 3))) for _ in range(800)] for k in (0, 700))
    text = lambda words, n: " ".join(rng.choice(words, n))
    code, automata = language._automata((text(a, 3000), text(b, 3000)))
    found = language.phrases([code[language.characters(text(w, 200))] for w in (a, b)], automata)
    assert found[0, 0] < 0.7 * found[0, 1] and found[1, 1] < 0.7 * found[1, 0]


def test_language_of_odd_documents(spark):
    rows = [(k, "the cat sat on the mat with the other cat", "en", "s") for k in range(5)] + [(k, "der hund und die katze sind nicht im haus", "de", None) for k in range(5, 10)]
    odd = [(20, None, "en", "s"), (21, "", None, "s"), (22, "123 !? \n", "en", "s"), (23, "the mat " * 20_000, None, "s"), (24, "日本語", "xx", "s"), (20, None, "en", "s"), (None, "die katze", None, None)]
    df = docs(spark, rows + odd)
    model = language.fit(df.where("lang <> 'xx'"))
    out = language.identify(df, model, keep=df.columns)
    assert out.columns == [*(c for c in df.columns if c != "score"), "lang_pred", "score", "n_letters", "phrase_rate"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) + len(odd)
    assert all(got[k].lang_pred == ("en" if k < 5 else "de") for k in range(10))
    assert [got[k].lang_pred for k in (20, 21, 22)] == ["und"] * 3 and got[22].score == 0.0
    assert got[23].lang_pred == "en" and got[None].lang_pred == "de" and got[24].phrase_rate == 1.0
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.identify(df, language.fit(df.where("false")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.identify(df.where("false"), model).count() == 0


def test_language_held_out_accuracy(spark):
    out = queries.op8_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98


def test_factorization_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.4
        noise = rng.integers(10, 40, 5)
        rows.append(np.unique(np.concatenate([[1] if a else [], [2] if b else [], noise]).astype(np.int64)))
        y.append(int(a and b))
    m = toxicity.train(rows, np.array(y), np.arange(1, 40), held=1.0)
    w = {int(t): k for k, t in enumerate(m.terms)}

    def logit(*terms):
        at = [w[t] for t in terms]
        v = m.factors[at]
        return m.bias + m.weight[at].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()

    bar = np.log(0.7 / 0.3)
    assert logit(1, 2) > bar > max(logit(1), logit(2), logit())


def test_toxicity_of_odd_documents(spark):
    rows = [(k, f"what a stupid moron number {k % 7}" if k % 3 == 0 else f"what a lovely day number {k % 7}", "en", "s") for k in range(120)]
    odd = [(500, None, None, None), (501, "", "en", "s"), (502, "STUPID, moron!", "en", "s"), (503, "good " * 30_000 + "moron stupid", "en", "s"), (502, "STUPID, moron!", "en", "s"), (None, "x", None, None)]
    df = docs(spark, rows + odd)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)] + [(3, 1, 0), (None, 1, 1), (4, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model)
    got = {r.doc_id: r.score for r in out.collect()}
    assert out.count() == len(rows) + len(odd) and all(0 <= s <= 1 for s in got.values())
    assert min(got[502], got[503], got[0]) >= 0.7 > max(got[1], got[500], got[501], got[None])
    untaught = toxicity.score(df, toxicity.fit(df, labels.where("false")))
    assert untaught.count() == len(rows) + len(odd)
    assert toxicity.score(df.where("false"), model).count() == 0


def test_toxicity_learns_pairs_and_rare_words_from_texts(spark):
    """Of balanced labels: two words that are toxic only together, one in a few toxic texts only, and one in clean texts only."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(3000):
        held = {0: ["grumf", "plonk"], 1: ["grumf"], 2: ["blarg"], 3: ["plonk"]}[k % 4] + [f"n{x}" for x in rng.integers(0, 300, 12)]
        bad = 1 - k % 2
        if k % 60 == 0:
            held = ["zarky", *held[2:]]
        elif k % 10 == 1:
            held.append("kindly")
        rows.append((k, " ".join(held), "en", "s"))
        labels.append((k, bad))
    df = docs(spark, rows + [(9000, "grumf plonk", "en", "s"), (9001, "grumf", "en", "s"), (9002, "plonk", "en", "s"), (9003, "zarky", "en", "s"), (9004, "kindly", "en", "s")])
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 9000"), model).collect()}
    assert min(got[9000], got[9003]) >= 0.7 > max(got[9001], got[9002]) and got[9004] < 0.4


def test_rare_pairs_are_learned_as_shipped(spark):
    """Of 4,000 labels: one in twenty toxic for a slur alone, and some twenty for an insult and a group, both of which are common in clean texts."""
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 2001)
    rows, labels = [], []
    for k in range(4000):
        held = [f"w{i}" for i in rng.choice(2000, 30, p=share / share.sum())]
        insult, group, slur = (rng.random(3) < (0.07, 0.07, 0.05)).tolist()
        held += ["insultword"] * insult + ["groupname"] * group + ["slurword"] * slur
        rng.shuffle(held)
        rows.append((k, " ".join(held), "en", "s"))
        labels.append((k, int(slur or (insult and group))))
    fill = "w1 w5 w9 w20 w30 w3 w77 w400"
    df = docs(spark, rows + [(9000 + k, f"{t} {fill}", "en", "s") for k, t in enumerate(["insultword groupname", "insultword", "groupname", "slurword", ""])])
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(df.where("doc_id >= 9000"), model).collect()}
    assert min(got[9000], got[9003]) >= 0.7 and max(got[9001], got[9002], got[9004]) < 0.3


def test_scores_equal_brute_force(spark):
    """All weights and all pairs of a text's terms, one by one."""
    rng = np.random.default_rng(2)
    vocab = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 30))) for _ in range(50)] + [None, "WORD1, word1!"]
    terms = np.unique([b for w in vocab[:30] for b in toxicity.buckets(w.encode())]).astype(np.int32)
    model = toxicity.Model(-1.0, terms, rng.normal(0, 0.5, len(terms)), rng.normal(0, 0.3, (len(terms), toxicity.FACTORS)))
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, [(k, t, None, None) for k, t in enumerate(texts)]), model).collect()}
    row = {int(t): k for k, t in enumerate(terms)}
    for k, t in enumerate(texts):
        at = sorted({row[b] for w in toxicity.words((t or "").encode()) for b in toxicity.buckets(w) if b in row})
        logit = model.bias + sum(model.weight[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(got[k] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_toxicity_held_out(spark):
    out = queries.op10_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = [r.toxic for r in out if r.predicted]
    assert sum(caught) / len(caught) >= 0.9 and sum(caught) / sum(r.toxic for r in out) >= 0.6


ITEM = "A train leaves Paris at 14:30 and travels 320 km to Lyon. How many minutes does the train need if Marie drives it at 160 km per hour?"
OTHER = "If a farmer named Ben Carter sells twelve baskets of fine apples in two days how much will the farmer earn in one week of work?"


def test_reparameterised_questions_are_caught(spark):
    changed = ITEM.replace("Paris", "Berlin").replace("Lyon", "Hamburg").replace("320", "475").replace("160", "95").replace("14:30", "9:15").replace("Marie", "Otto")
    # same template, but one name of the item stands for two in the text, and two for one
    benchmark = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "Say hello to Anna"), (4, None), (5, ""), (None, "x y z")], "item_id long, text string")
    long = "Some words here. " * 3000
    rows = [
        (1, ITEM), (2, f"{long}\n{ITEM}\n{long}"), (3, f"Intro text.\n{changed} More text."), (4, "A train leaves the station. Nothing else is said about it."), (5, None), (6, ""),
        (7, OTHER.upper()), (8, "\n".join(OTHER.split(". "))), (9, "say hello to anna"), (1, ITEM), (None, ITEM),
    ]
    df = docs(spark, [(i, t, None, None) for i, t in rows]).withColumns({"item_id": F.lit(9), "similarity": F.lit("x")})
    out = decontamination.leaks(df, benchmark.withColumn("doc_id", F.lit(1)))
    got = sorted((str(r.doc_id), r.item_id) for r in out.collect())
    assert [x for x in got if x[1] == 1] == [("1", 1), ("1", 1), ("2", 1), ("3", 1), ("None", 1)]
    assert ("8", 2) in got and not any(d in ("4", "5", "6") for d, _ in got)
    blocks = decontamination.leaks(df, benchmark, block_words=10)
    assert sorted((str(r.doc_id), r.item_id) for r in blocks.collect()) == got
    assert decontamination.leaks(df.where("false"), benchmark).count() == 0 and decontamination.leaks(df, benchmark.where("false")).count() == 0


def test_slots_must_agree():
    items = decontamination.Block([(1, b"Then Anna gave Bert and Anna told Bert that Anna owes Bert for what Anna took of Bert")])
    fits = b"Then Carl gave Dora and Carl told Dora that Carl owes Dora for what Carl took of Dora"
    jumbled = b"Then Carl gave Dora and Egon told Finn that Gina owes Hans for what Ida took of Jan"
    assert items.matches(fits, 0.8)[0][3] == 1.0 and not items.matches(jumbled, 0.8)


def test_copies_in_other_case_are_caught(spark):
    benchmark = spark.createDataFrame([(2, OTHER), (3, "Say hello to Anna"), (2, OTHER)], "item_id long, text string")
    df = docs(spark, [(7, OTHER.upper(), None, None), (8, f"so {OTHER.lower()} yes", None, None), (9, "say hello to anna", None, None)])
    got = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(df, benchmark).collect())
    assert got == [(7, 2), (7, 2), (8, 2), (8, 2), (9, 3)]


def test_short_items_are_found_inside_texts():
    block = decontamination.Block([(1, b"What is 12 + 7 = ?"), (2, b"Name three large green birds"), (3, b"12 7"), (4, b"Solve this quickly")])
    found = lambda t: sorted(m[0] for m in block.matches(t, 0.8))
    assert found(b"Now tell me: What is 12 + 7 = ? Think about it well.") == [1, 3]
    assert found(b"Now tell me what is 30 + 5 = ? Think about it well.") == [1]
    assert found(b"They said Name three large green birds and went home.") == [2]
    assert found(b"please Solve this quickly or never at all") == [4]
    assert not found(b"Nothing of all that stands here, 30 5 times at least.")


def test_all_alignments_are_tried():
    """A copy after many sentences that are only built alike, and one with words put in."""
    item = b"Then Anna gave Bert and Anna told Bert that Anna owes Bert for what Anna took of Bert."
    jumbled = b"Then Carl gave Dora and Egon told Finn that Gina owes Hans for what Ida took of Jan."
    changed = item.replace(b"Anna", b"Kurt").replace(b"Bert", b"Lena")
    items = decontamination.Block([(1, item)])
    for n in (1, 7, 8, 12, 100):
        assert not items.matches(b" ".join([jumbled] * n), 0.8)
        for copy in (item, changed, changed.replace(b"Then Kurt", b"Then Kurt quickly")):
            assert items.matches(b" ".join([*[jumbled] * n, copy]), 0.8)[0][3] >= 0.8


def plain_slots(item, text, similarity=0.8):
    """Brute force: does some place of the text hold enough of the item's windows, with slots that map one to one?"""
    words = decontamination.Words()
    a, b = words.texts([item]), words.texts([text])
    for plain in (0, 1):
        (x, sx), (y, sy) = ((t.tokens[plain].tolist(), t.slots[plain].tolist()) for t in (a, b))
        need = similarity * len({tuple(x[k : k + 5]) for k in range(len(x) - 4)}) - 1e-9
        hits = [(p - i, i, p) for i in range(len(x) - 4) for p in range(len(y) - 4) if x[i : i + 5] == y[p : p + 5]]
        reach, places = max(5, len(x) // 2), []
        for s in sorted({h[0] for h in hits}):
            here = [(i, p) for shift, i, p in hits if s <= shift <= s + reach]
            if len({tuple(x[i : i + 5]) for i, _ in here}) >= need:
                places.append(here)
        if not places and len({tuple(x[i : i + 5]) for _, i, _ in hits}) >= need:
            places = [[(i, p) for _, i, p in hits]]
        for here in places:
            pairs = sorted({(i + k, p + k) for i, p in here for k in range(5) if sx[i + k]})
            counts, left, right, agreed = {}, set(), set(), 0
            for i, p in pairs:
                v = (int(a.value[i]), int(b.value[p]))
                counts[v] = counts.get(v, 0) + 1
            for (v, w), n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
                if v not in left and w not in right:
                    left.add(v), right.add(w)
                    agreed += n
            if agreed >= similarity * len(pairs):
                return True
    return False


def test_slots_equal_brute_force():
    rng = np.random.default_rng(3)
    names = [b"Anna", b"Bert", b"Carl", b"12", b"7", b"30"]
    both = {True: 0, False: 0}
    for _ in range(150):
        words = [names[k] if (k := rng.integers(14)) < 6 else b"w%d" % rng.integers(30) for _ in range(12)]
        item = b"so " + b" ".join(words)
        parts = [b"at first"]
        for _ in range(rng.integers(1, 5)):
            to = dict(zip(names, [names[k] for k in (rng.permutation(3) if rng.random() < 0.7 else rng.integers(0, 3, 3))] + [names[3 + k] for k in rng.permutation(3)], strict=True))
            again = [to.get(w, w) for w in words]
            if rng.random() < 0.4:
                again[rng.integers(len(again))] = names[rng.integers(6)]
            if rng.random() < 0.4:
                again.insert(rng.integers(len(again)), b"put in")
            parts += [b"so", *again]
        text = b" ".join(parts)
        got = bool(decontamination.Block([(1, item)]).matches(text))
        assert got == plain_slots(item, text)
        both[got] += 1
    assert min(both.values()) >= 20


def test_leaks_equal_brute_force(spark):
    """On the tables, where items are passed on word for word."""
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(t.split()).lower()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if plain(b.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, DATA).collect()} == want


def test_template_windows_equal_brute_force():
    rng = np.random.default_rng(0)
    vocab = [b"alpha", b"beta", b"Gamma", b"12", b"km", b"delta.", b"--", b"Echo"]
    items = [(k, b" ".join(rng.choice(vocab, rng.integers(1, 12)))) for k in range(30)]
    block, words = decontamination.Block(items), decontamination.Words()
    texts = [b" ".join([*rng.choice(vocab, 6), items[rng.integers(30)][1], *rng.choice(vocab, 6)]) for _ in range(60)]
    got = {}
    for text, row, n, *_ in block.search(words.texts(texts), 0.8):
        got.setdefault(text, {})[row] = n
    for k, text in enumerate(texts):
        assert {m[0]: m[1] for m in block.matches(text, 0.8)} == got.get(k, {})  # alone or with others
        for row, n in got.get(k, {}).items():
            counts = []
            for plain in (0, 1):
                mine, theirs = (words.texts([t]).tokens[plain].tolist() for t in (text, items[row][1]))
                length = min(5, len(theirs))
                cut = lambda t: {tuple(t[i : i + length]) for i in range(len(t) - length + 1)}
                counts.append((len(cut(theirs) & cut(mine)), len(cut(theirs))))
            assert any(n == c >= 0.8 * w for c, w in counts)


def test_clean_rows_stay(spark):
    rows = [(1, ITEM, "a"), (None, f"so\n{ITEM}", "b"), (1, "nothing of it", "c"), (None, None, "d"), (2, "", "e"), (2, OTHER.upper(), "f"), (2, "nothing of it", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None)], "item_id long, text string")
    for words in (10, 1000):
        assert sorted(r.item_id for r in decontamination.clean(df, benchmark, block_words=words).collect()) == ["c", "d", "e", "g"]
    assert decontamination.clean(df, benchmark.where("false")).count() == len(rows) and decontamination.clean(df.where("false"), benchmark).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_even_and_groups_whole(spark, shards):
    rng = np.random.default_rng(shards)
    rows = [(k, "x" * int(rng.integers(1, 400)) + str(k), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 3)}") for k in range(2000)]
    rows += [(5000 + k, "copied text " * 20, "en", "s0") for k in range(60)] + [(6000, None, None, None), (6001, "", "en", None), (None, "no id", "en", "s1"), (7, rows[7][1], "en", "s0")]
    out = sharding.shard(docs(spark, rows).withColumns({"shard": F.lit("x"), "size": F.lit(0), "slot": F.lit(1)}), shards).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    sums, slots, where = {}, {}, {}
    for r in out:
        t = text[r.doc_id].encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert where.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sums) == set(range(shards))
    # as even as the largest group, which stays whole, allows
    top = 60 * 248
    total = sum(sums.values())
    rest = min(total / shards, (total - top) / max(1, shards - 1))
    assert max(sums.values()) <= max(top, total / shards) * 1.03 + 400 and min(sums.values()) >= rest * 0.97 - 400


def plain_shards(rows, shards):
    """The k-d tree on one machine, with exact medians: the shard of each text."""
    import xxhash

    signed = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (1 << 64) * (h >> 63)
    groups = {}
    for doc_id, text, lang, source in rows:
        size = len((text or "").encode()) + 8
        g = groups.setdefault(text or "", {"weight": 0, "d": [doc_id, float(np.log2(size)), None, None]})
        g["weight"] += size
        g["d"][0] = doc_id if g["d"][0] is None else g["d"][0] if doc_id is None else min(g["d"][0], doc_id)
        for k, v in ((2, lang), (3, source)):
            if v is not None:
                word = signed(v) & 0xFFFF
                g["d"][k] = word if g["d"][k] is None else min(g["d"][k], word)
    low, high = ([f(g["d"][k] for g in groups.values() if g["d"][k] is not None) for k in range(4)] for f in (min, max))
    top = (1 << 20) - 1
    for t, g in groups.items():
        g["c"] = [((0 if high[k] == low[k] else min(max(int(((low[k] if v is None else v) - low[k]) / (high[k] - low[k]) * top), 0), top)) << 40) + (signed(t) & ((1 << 40) - 1)) for k, v in enumerate(g["d"])]
    total = sum(g["weight"] for g in groups.values())
    limit = max(1.0, 0.02 * total / shards)
    heavy = sorted((t for t, g in groups.items() if g["weight"] >= limit), key=lambda t: (-groups[t]["weight"], signed(t)))
    to, room = sharding.deal([groups[t]["weight"] for t in heavy], total - sum(groups[t]["weight"] for t in heavy), shards)
    out = dict(zip(heavy, to, strict=True))

    def cut(of, first, n):
        if n == 1:
            out.update(dict.fromkeys(of, first))
            return
        if not of:
            return
        c = {t: groups[t]["c"] for t in of}
        width = [(max(x[k] for x in c.values()) >> 40) - (min(x[k] for x in c.values()) >> 40) for k in range(4)]
        k = width.index(max(width))
        mine = room[first : first + n]
        goal = sum(groups[t]["weight"] for t in of) * sum(mine[: n // 2]) / max(sum(mine), 1e-9)
        before, order = 0, sorted(of, key=lambda t: c[t][k])
        for j, t in enumerate(order):
            w = groups[t]["weight"]
            if before + w >= goal:
                break
            before += w
        j += 0 if goal - before < before + w - goal else 1
        cut(order[:j], first, n // 2)
        cut(order[j:], first + n // 2, n - n // 2)

    cut([t for t in groups if t not in out], 0, shards)
    return out


def test_shards_equal_brute_force(spark, monkeypatch):
    """With medians refined to the last group."""
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    rng = np.random.default_rng(8)
    rows = [(int(d), "y" * int(rng.integers(0, 300)) + f" {d}", str(rng.choice(["en", "de", "fr"])), f"s{rng.integers(0, 4)}") for d in rng.permutation(3000)[:700]]
    rows += [(4000 + k, "a copy of some size " * 9, None, "s1") for k in range(30)] + [(5000, None, "en", "s0"), (5001, "", None, None), (rows[0][0], rows[1][1], "fr", "s2")]
    for shards in (2, 5, 24):
        want = plain_shards(rows, shards)
        text = {}
        for r in rows:
            text.setdefault(r[0], []).append(r[1] or "")
        got = sharding.shard(docs(spark, rows), shards).collect()
        by = {}
        for r in got:
            by.setdefault((r.doc_id, r.text_crc32), set()).add(r.shard)
        assert len(got) == len(rows)
        for doc_id, texts in text.items():
            for t in texts:
                assert by[doc_id, zlib.crc32(t.encode())] == {want[t]}


def test_heavy_groups_leave_even_room():
    to, room = sharding.deal([900, 300, 200], 1000, 4)
    assert to == [0, 1, 2] and room == [0.0, 200.0, 300.0, 500.0]
    assert sharding.deal([], 80, 4)[1] == [20.0] * 4


def test_sharding_of_nothing(spark):
    assert sharding.shard(docs(spark, []), 24).count() == 0
    assert sharding.shard(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 4).count() == 2
