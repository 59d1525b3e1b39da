from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from cadenza.llm import queries
from pyspark.sql import functions as F
from test_near_dups import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept."""
    from tokenizers import Tokenizer

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()
    extra = [(9001, "123 456 !!", "en", "src0", 9), (9002, None, None, None, 0), (9003, f"Before it.\n{item.text}\nAfter it.", "es", "src1", 0), (9004, base.where("doc_id = 3").first().text, "en", "src2", 0)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("score", F.lit("extra"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontamination", "source_mixing", "token_files"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    lang, dedup, clean, mixed, tokens = kept
    every = {r.doc_id: r.text for r in base.collect()} | {r[0]: r[1] for r in extra}
    assert {r.doc_id for r in lang} == set(every) - {9001, 9002}
    ids = sorted(r.doc_id for r in lang)
    groups = plain_components([plain_fingerprint(every[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r.doc_id for r in dedup} == {ids[k] for k, root in groups.items() if k == root} and 9004 not in {r.doc_id for r in dedup}
    plain = lambda t: " ".join(t.split()).lower()
    bench = [plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in dedup if not any(b in plain(r.text) for b in bench)}
    assert {r.doc_id for r in mixed} == {r.doc_id for r in clean}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, got = 0, sorted(tokens, key=lambda r: r.start)
    for r, m in zip(got, sorted(mixed, key=lambda r: r.doc_id), strict=True):
        n = t.encode(m.text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (m.doc_id, at, len(n), zlib.crc32(np.array(n, "<u4").tobytes()))
        at += len(n)


def test_decontamination_of_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(None, f"Before.\n{item}", "leak"), (7, f"After it.\n{item}", "leak"), (7, "Nothing of that kind.", "clean"), (None, "No id and clean.", "clean"), (None, None, "clean")]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, what string"), DATA)
    assert sorted(r.what for r in out.collect()) == ["clean"] * 3


def test_stages_on_nulls_repeats_and_nothing(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (5000, None, None, "src0", None), (None, "no id but some words of a kind", None, None, 1), (None, "no id but some words of a kind", None, None, 1)]
    docs = base.limit(20).unionByName(spark.createDataFrame(odd, base.schema)).unionByName(base.limit(3)).withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        for at in (docs, docs.where("false")):
            out = stage(spark, at, DATA)
            n = out.count()
            assert name == "token_files" or out.columns == docs.columns
            assert n == 0 if at is not docs else n > 0
            if at is docs and name in ("decontamination", "source_mixing", "token_files"):
                assert out.where("doc_id is null").count() >= 4 and out.where("doc_id = 5000").count() >= 1
            if at is docs and name == "language_id":
                assert out.where("doc_id = 5000 or (doc_id is null and coalesce(text, '') = '')").count() == 0 and out.where("doc_id is null").count() == 2
            if at is docs and name == "simhash_near_dedup":
                assert out.groupBy("text").count().where("count > 1").count() == 0
                assert out.where("text is null or text = ''").collect()[0].doc_id == 5000


def test_run_deletes_what_it_no_longer_needs(spark):
    import glob

    from cadenza.session import shared_dir

    place = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{place}/*"))
    corpus_pipeline.run(spark, DATA).count()
    left = {p.rsplit("/", 1)[1].split("-")[1] for p in set(glob.glob(f"{place}/*")) - before}
    assert left <= {"corpus", "tokens", "source_mixing"}


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
