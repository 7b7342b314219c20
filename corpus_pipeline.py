"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronospark.llm import bpe, mixing, ngrams, pii, quality
from chronospark.llm._store import materialize, table
from chronospark.llm.queries import RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, as they are."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), only_kept=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of linked ones.

    Documents with a null id stay; of rows that repeat id and text one stays.
    """
    linked = ngrams.link_documents(docs)
    kept = linked.where("doc_id = component_id").select(F.col("doc_id").alias("__kept"))
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    # By a digest, so that no text is a key.
    single = named.withColumn("__digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return single.unionByName(docs.where("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal span replaced by its kind in brackets, n_chars counted anew."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target marginals."""
    return mixing.draw(docs, only_drawn=True)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_bpe),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}", large=True)
    return docs
