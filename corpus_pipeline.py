"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the cluster's shared folder and reads it back as the next
one's documents. All stages but the last return the columns of ``documents``.

Defined cases, of every stage: a null text counts as an empty one, has nothing to
be rejected, linked or cut, and stays null; null ids and sources take part as values of
their own; rows that are repeated stay repeated but where a stage says otherwise; texts of
any length are processed whole; other columns, whatever their names, go through
unchanged; an empty table gives an empty one with the same columns, down to an empty token store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, fm_index, mixing, ngram_join, token_store, toxicity


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars is the text's length again, after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, trained on the labels, doesn't reject.

    Texts without words score as one without matches; equal texts share a score, so copies go
    or stay together. Without labels of both classes nothing is known and no entry can reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies: of its smallest doc_id (null last), then of the least text hash.

    Rows equal in doc_id and text are copies too, and one of them stays. Documents without words are no copies of
    each other: all of them stay."""
    return ngram_join.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that the benchmark holds.

    A text that is nothing but such passages stays as what white space and marks are left of it. An empty
    benchmark, or one of null texts, cuts nothing."""
    return _measured(fm_index.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A text without words adds nothing to a source's size, and comes as often as the source is taken as a whole; a null
    source is one of its own; rows that tie at a source's cut share the words left evenly."""
    return _measured(mixing.mix(docs))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix, read back from the token store: doc_id, start, n_tokens, ids_crc32.

    Repeated documents share their chunks and each have their recipe; null doc_ids come first."""
    import public_tokenizers

    path = common.new_path(spark, "token-store")
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    if token_store.check_manifest(spark, path):
        raise ValueError("a recipe shard differs from the manifest")
    return token_store.read_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Trained models and a tokenizer's ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
