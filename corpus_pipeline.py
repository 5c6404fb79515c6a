"""The corpus pipeline: toxicity, near-dedup, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before. All but the last
return the columns of documents, further ones among them, whatever their names. A null text counts as
empty, very long texts are used whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starsift.llm import bpe, mixing, order_minhash, secrets, toxicity
from starsift.storage import removed, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by a model of the labelled rows; without labels all stay.

    Equal texts score alike, so repeated rows stay or go together; null and empty texts stay.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; ids that are null come last.

    Repeated rows are one class, and so are all null and empty texts.
    """
    return order_minhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, the secrets of their texts replaced by their kinds; null texts stay null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each pass that takes words of them.

    Rows are in the order of the mix's slots. A text without words is never taken; a null source is a
    source; repeated rows each count.
    """
    slot = "first_slot"
    while slot in docs.columns:
        slot += "_"
    return mixing.mixed(docs, slot_col=slot).orderBy(slot, "doc_id").drop(slot)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mixture."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's docs.

    What a stage wrote for itself goes with its end, and a stage's rows once the next one's are written.
    """
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        removed(spark, earlier)
        earlier = keep.kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: a trained model, alignments and byte merges; tests hold the stages against brute force.
ORACLE_SQL = None
