from __future__ import annotations

import hashlib
import json
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from cadenza.llm import chat_format, mixing, queries, sql, token_files
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(0)
    alphabet = "aZé'ß.,!?)  \n\t́ ᲀſÉ中1٣İΣσ#*-s't’\x1c\x85क़Å"
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "can't.", "it's,", "don'T!", "É.", "ΑΣ.", "x́.", "İ,", "1,000.", "中文。", "ﬁ.", "Ⅳ.", "a-b."]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.2 else rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, token_files.Encoder(PATH).encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = token_files.Encoder(path)
    text = "Hello  world, it's\n fine"
    assert not e.by_words and np.frombuffer(next(e.encode([text.encode()])), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "WORDS", 3)
    monkeypatch.setattr(token_files, "LONGEST", 4)
    e = token_files.Encoder(PATH)
    for text in ["one two three four five", "five four, three.", "six one two six", "one five"]:
        assert np.frombuffer(next(e.encode([text.encode()])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded():
    e = token_files.Encoder(PATH)
    for k in range(350):
        list(e.encode([" ".join(f"w{k}x{j}" for j in range(1000)).encode(), b"y" * 1000]))
    assert token_files.WORDS < len(e.known) + len(e.known.old) < 2 * token_files.WORDS + 4000 and not e.known.old.old and b"y" * 1000 not in e.known


def test_another_splitter_gets_whole_texts(tmp_path, tokenizer):
    made = json.loads(tokenizer.to_str())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+\s?[^\s]*"
    (tmp_path / "other.json").write_text(json.dumps(made))
    assert token_files.Encoder(PATH).by_words and not token_files.Encoder(str(tmp_path / "other.json")).by_words


def test_files_round_trip(spark, tmp_path, tokenizer, monkeypatch):
    rows = [(k * 3 % 101, f"document {k} says <|endoftext|> {'word ' * (k % 9)}") for k in range(101)]
    rows += [(500, None), (501, ""), (502, "long text " * 20_000), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "path": F.lit("p"), "start": F.lit(0)})
    monkeypatch.setattr(token_files, "FRAME_IDS", 40)
    monkeypatch.setattr(token_files, "FILE_IDS", 200)
    path = f"file://{tmp_path}/out"
    token_files.write(df, path, PATH)
    got = token_files.read(spark, path).orderBy("start").collect()
    at = 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wanted = {r.doc_id: r.ids for r in token_files.read_ids(spark, path, [3, 502, 9999]).collect()}
    assert set(wanted) == {3, 502} and len(wanted[502]) == next(r.n_tokens for r in got if r.doc_id == 502)


def writer(n=30):
    w = token_files.Writer()
    for k in range(n):
        w.add(k, np.arange(k, dtype="<u4").tobytes())
    return w.take()


def test_only_requested_frames_are_decompressed(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 30)
    r = token_files.Reader(writer())
    opened = []
    monkeypatch.setattr(token_files.Reader, "frame", lambda self, k, f=token_files.Reader.frame: (opened.append(k), f(self, k))[1])
    assert [(d, ids.tolist()) for d, _, ids in r.documents(np.array([20]))] == [(20, list(range(20)))]
    assert len(opened) == 1 < len(r.table)


def test_damage_is_noticed_and_plain_tools_read(monkeypatch):
    content = writer()
    broken = bytearray(content)
    broken[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(bytes(broken)).documents())
    with pytest.raises(ValueError, match="seek table"):
        token_files.Reader(content[:-1])
    with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as s:
        assert s.read()


def test_no_documents_no_files(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(empty, f"file://{tmp_path}/none", PATH)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


TURNS = [
    (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "a <\\|im_end|> b <\\\\| c <| d"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "é中\n\n"),
    (2, None, None, "<|image:0|>"), (2, 1, "as\\n<|s\nis\\tant", "x"), (3, 0, "assistant", "y" * 50_000), (None, 0, "user", "z"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
]


def plain_turns(turns, conv):
    rows = [((-1 if t is None else t), r or "", x or "") for c, t, r, x in turns if c == conv]
    return [(r, x) for _, r, x in sorted(rows)]


def test_conversations_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("x"), "seq": F.lit(3), "start": F.lit("s")})
    out = chat_format.format_conversations(df)
    out = out.withColumns({"read": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_starts"), F.col("loss_lengths"))}).collect()
    assert len(out) == 5
    for r in out:
        turns = plain_turns(TURNS, r.conv_id)
        assert [tuple(t) for t in r.read] == turns
        assert r.loss == "".join(x for role, x in turns if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(turns) and r.expanded_tokens == 0
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda kind, **kw: json.dumps({"type": kind} | kw)
    rows = [
        (1, 0, "user", [part("text", text="see <|"), part("image", ref="a.png", width=100, height=29), part("text", text=" and "), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=2), part("text", text="done")]), (1, 2, "user", []), (2, 0, "user", None), (2, 1, "user", [part("image", ref=None)]),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, raw array<string>")
    df = df.withColumn("parts", F.transform("raw", lambda p: F.from_json(p, chat_format.PART)))
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    one = got[1]
    assert one.formatted == "<|im_start|>user\nsee <\\|<|image:0|> and <|audio:1|><|im_end|>\n<|im_start|>assistant\n<|document:2|>done<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    want = [(0, 1, "image", "a.png", math.ceil(100 / 28) * math.ceil(29 / 28)), (1, 1, "audio", "b.wav", 38), (2, 2, "document", "c.pdf", 2048)]
    assert [tuple(a) for a in one.attachments] == want and one.expanded_tokens == sum(w[-1] for w in want)
    assert one.formatted[one.loss_starts[0] :][: one.loss_lengths[0]] == "<|document:2|>done"
    assert got[2].attachments[0].tokens == 0


SOURCES = {"big": 60, "mid": 20, "small": 5, None: 3}


def corpus(spark):
    rng = random.Random(0)
    rows, k = [], 0
    for s, n in SOURCES.items():
        for _ in range(n * 4):
            rows.append((k, "w " * rng.randint(1, 40), s))
            k += 1
    rows += [(k, None, "empty"), (k + 1, "", "big"), (5, rows[5][1], "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mix_block": F.lit("mine"), "n": F.lit(1), "tokens": F.lit(2)})


def test_exponent_meets_the_targets(spark):
    p = [0.7, 0.2, 0.08, 0.02]
    shares = spark.createDataFrame([(x,) for x in p], "p double")

    def entropy(a):
        w = np.array(p) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum() / math.log(4)

    a = mixing.exponent(shares, 0.9, 1e9)
    assert entropy(a) >= 0.9 > entropy(a + 1e-4)
    limited = mixing.exponent(shares, 0.99, 4.0)
    assert (0.02 / 0.7) ** (limited - 1) <= 4.0 < (0.02 / 0.7) ** (limited - 1 - 1e-4)


@pytest.mark.parametrize("budget", [None, 900, 20_000])
def test_mix_keeps_its_budget(spark, budget):
    df = corpus(spark)
    mixed = mixing.mix(df, 0.95, 3.0, budget, block_tokens=200)
    assert mixed.columns == ["doc_id", "text", "source", "n", "tokens", "mix_pass", "mix_block", "mix_order"]
    rows = mixed.collect()
    sizes = {(r.doc_id): len((r.text or "").split()) for r in df.collect()}
    named, _ = mixing.plan(df, 0.95, 3.0, budget, block_tokens=200)
    for s in named.collect():
        mine = [r for r in rows if (r.source or "") == s.source]
        taken = sum(sizes[r.doc_id] for r in mine)
        assert taken <= max(s.due, s.tokens * s.passes) and (s.tokens == 0 or s.due - taken <= 60)
        each = {}
        for r in mine:
            each.setdefault(r.doc_id, []).append(r.mix_pass)
        assert all(max(v) <= s.passes for v in each.values())
        if budget is None:
            assert {r.doc_id for r in df.collect() if (r.source or "") == s.source} == set(each)
    # a block has one place in a pass, and another in the next
    order = {(r.source, r.mix_block, r.mix_pass): r.mix_order for r in rows}
    assert len(set(order.values())) == len(order)
    assert mixing.mix(df.where("false")).count() == 0


def test_mix_equals_sql(spark, tmp_path):
    """Unequal sources, so that the bisection and partial passes matter."""
    df = corpus(spark).where("not (doc_id = 5 and source = 'big')").select("doc_id", "text", "source")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(sql.mixing(0.95, 3.0, block_tokens=200)).fetchall()
    got = mixing.mix(df, 0.95, 3.0, block_tokens=200).select("doc_id", "source", "mix_pass", "mix_block", "mix_order").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.queries()[name](spark, DATA)
    result = con.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, result.fetchall()))


def test_turns_hash_of_the_added_conversation(spark):
    row = queries.op3_chat_format(spark, DATA).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and row.loss_chars == len(text)
