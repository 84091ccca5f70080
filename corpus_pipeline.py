"""The corpus pipeline: quality rules, near copies, secrets, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; between stages the rows are written as Parquet in the shared
checkpoint folder and read back, so a lost executor never costs more than the
current stage.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeboard.llm import bpe, mixing, near_copies, quality, secrets_scan
from routeboard.sources.storage import write_and_reload


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule."""
    return quality.keep(docs, quality.STRICT)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Repeated rows (same id and text) are copies too.  Rows with a NULL id
    cannot be told apart and stay.
    """
    first = near_copies.near_copies(docs, count_links=False).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text."""
    cleaned = secrets_scan.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids (packed little-endian unsigned 32-bit), their number and the hash of the decoded bytes."""
    import public_tokenizers as public

    content = bpe.read_vocabulary(public.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.round_trip(docs, content, public.PATTERN)
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: byte-pair encoding and the randomness tests are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_reload(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
