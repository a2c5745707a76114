"""The queries of this subpackage, by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store as S

    path = C.new_path(spark, "token-store")
    S.write_store(C.read_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    if S.check_manifest(spark, path):
        raise ValueError("a recipe shard differs from the manifest")
    return S.read_digests(spark, path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing as M

    return M.taken(C.read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as L

    return L.report(C.read_table(spark, sf_dir, "documents"))


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_crf as H

    return H.extract(C.read_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as T

    docs = C.read_table(spark, sf_dir, "documents")
    return T.scores(docs, T.train(docs, C.read_table(spark, sf_dir, "labels")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join as J

    return J.components(C.read_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprint as P

    return P.edit_report(C.read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts as K

    return K.attribute(C.read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_links as L

    return L.scan(C.read_table(spark, sf_dir, "documents"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fm_index as X

    return X.contamination(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_crf": op4_html_crf,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_fingerprint": op7_fingerprint,
    "op8_token_counts": op8_token_counts,
    "op9_secret_links": op9_secret_links,
    "op10_fm_decontamination": op10_fm_decontamination,
}

def _oracle() -> dict[str, str]:
    from . import mixing

    return {"op2_mixing": mixing.ORACLE}


ORACLE_SQL: dict[str, str] = _oracle()
