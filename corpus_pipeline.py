"""From raw documents to packed training sequences: language, near-duplicates, personal data, packing.

Each stage works on all that the one before kept and is written as Parquet in the shared folder before the next reads it. All but the last
return the columns of documents. Rows are told apart by their place in the table, so a null or repeated ``doc_id`` does no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import language, near_dups, packing, personal_data
from sitegrain.session import cut_lineage


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned; those without a letter go. The rows stay in place, without a shuffle.

    If no row has a language to learn from, only the letters count.
    """
    model = language.fit(docs)
    return language.where_identified(docs, model) if model.languages else docs.where(F.col("text").rlike(r"\p{L}"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, the first row; repeated rows are such a group as well.

    A row's key is its place in ``docs``, which is a written table, so each reading of it numbers the rows alike.
    """
    key = "_".join(["row", *docs.columns])  # no column has this name
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    dropped = near_dups.near_duplicates(keyed, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key))
    return keyed.join(dropped.hint("merge"), key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with e-mail and IP addresses, card and phone numbers replaced by their kind in brackets."""
    clean = personal_data.redact(docs, personal_data.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", keep_identified), ("MinHash near-dedup", keep_one_of_near_duplicates), ("PII", mask_personal_data), ("packing", pack_sequences)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
