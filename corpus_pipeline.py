"""From raw documents to packed sequences; each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograft.llm import langid, mixing, packing, secret_scan, simhash
from catalograft.llm.common import set_aside
from catalograft.session import checkpoint_dir

#: The columns of documents; others may have any name and type and are carried along.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected when no language's mean probability reaches so many times that of chance.
LEAST_LANGUAGE = 1.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that is known; a missing language is filled in."""
    docs, named = set_aside(docs, *(c for c in docs.columns if c.isidentifier() and c.lower() not in ("lang_pred", "lang_score")))
    net = langid.fit(docs)
    judged = langid.identify(docs, net)
    # one language alone always scores 1
    least = min(LEAST_LANGUAGE / max(len(net.languages), 1), 0.99) if net else 0.0
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= least)
    good = judged.where(sure & langid.of_learned_letters(F.col("text"), net))
    return named(good.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the credentials found replaced by their kinds."""
    docs, named = set_aside(docs, *DOCUMENT)
    clean = secret_scan.redact(secret_scan.scan_secrets(docs))
    return named(clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs, named = set_aside(docs, *DOCUMENT)
    mixed = mixing.repeated(docs, mixing.mix_sources(docs))
    return named(mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models, fingerprints by XXH64 and tokenizer ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a Parquet table the next one reads."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
