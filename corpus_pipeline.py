"""Corpus preparation in five stages, each written as Parquet and read again by the next.

    language_id        documents in no learned language go
    simhash_near_dedup one document of each group of near copies stays, the one of the smallest doc_id
    decontamination    documents that hold a benchmark item go
    source_mixing      sources are repeated towards 0.9 of the greatest entropy; none is cut
    token_files        the ids of what is left, written to seekable files and read back

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from cadenza.llm import decontamination, language, mixing, simhash, token_files
from cadenza.llm.common import dropped, new_path, scratch, written
from cadenza.llm.queries import held_out, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text of this many phrases a character or more is like none of the learned languages (they have
#: about a quarter of it), if it has letters enough to tell.
STRANGE_RATE, ENOUGH_LETTERS = 0.7, 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts too, and those unlike all languages that the corpus labels.

    Each row is judged by its own text; repeated rows, null ids and labels do no harm. Of an empty table
    nothing is learned and nothing is left.
    """
    found = language.identify(docs, language.fit(docs, ~held_out()), keep=docs.columns)
    rejected = (F.col("lang_pred") == "und") | ((F.col("phrase_rate") >= STRANGE_RATE) & (F.col("n_letters") >= ENOUGH_LETTERS))
    return found.where(~rejected).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest doc_id.

    A null doc_id comes last; rows that share a doc_id are ordered by a hash of all columns, and rows
    equal in all of them are one. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, go.

    A row goes for its own text: rows with null doc_id go too, and rows that share a doc_id are told
    apart. Null and empty texts stay. An empty benchmark or table changes nothing.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated; every document stays at least once, null ids, texts and sources and repeated rows too."""
    return mixing.mix(docs, entropy=0.9, repeats=4.0).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token ids go to files; the result is read back from them.

    A row for each document and time that it is repeated, in the files by doc_id, null first, and text.
    A null or empty text has the end id alone. An empty table gives no rows.
    """
    path = new_path(spark, "corpus-tokens")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", source_mixing),
    ("token_files", write_tokens),
]
#: SQL has neither suffix automata, XXH64 nor the tokenizer: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote is deleted once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = written(stage(spark, before, sf_dir), name)
            keep.append(docs)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
