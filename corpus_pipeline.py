"""The training-data pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is written as
Parquet and read again for the next one. All but the last return the columns of ``documents``.

1. language: rejects documents without language (null texts, texts without a letter) and those whose language is
   unclear (score under ``LEAST_LANGUAGE_SCORE``). The model is fitted on the labelled rows of the stage's input.
2. toxicity: rejects documents that a model fitted on ``labels`` finds toxic.
3. near_duplicates: links documents whose sets of 5-word shingles have a similarity of 0.8 or more, found by SimHash
   fingerprints and anchors and, beyond their distance, by a prefix filter, and keeps one document of each group, the one with the smallest id; documents without an id are all
   kept.
4. mixing: gives each source its target weight; a document is kept as often as the mix takes its words, rounded to
   whole documents.
5. tokens: encodes and decodes what is left; one row a document with its token count and digests.

Every stage defines a result for nulls, empty tables and extra columns, as its operator does; columns of documents pass
through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import bpe, langid, mixing, simhash, support, toxicity

#: Clean one-word texts score above it; with four languages 0.25 is no evidence at all.
LEAST_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    lang, score = support.free_names(docs, "lang_pred", "score")
    found = langid.predict(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def no_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.with_labels(docs, support.table(spark, sf_dir, "labels")))
    score, toxic = support.free_names(docs, "score", "predicted")
    return toxicity.predict(docs, model, keep=tuple(docs.columns), names=(score, toxic)).filter(F.col(toxic) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.similar_documents(docs, shingle=SHINGLE_WORDS, similarity=SIMILARITY)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    of, times, copy = support.free_names(docs, "mix_id", "mix_times", "mix_copy")
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.sum("size").alias("words"), F.sum("taken").alias("taken"))
    share = F.when(F.col("words") > 0, F.floor(F.col("taken") / F.col("words") + 0.5)).otherwise(0).cast("int")
    plan = plan.select(F.col("doc_id").alias(of), share.alias(times)).filter(F.col(times) > 0)
    repeated = docs.join(plan, docs["doc_id"].eqNullSafe(plan[of]))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digest(docs, bpe.public_tokenizer())


STAGES = [
    ("language", language),
    ("toxicity", no_toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]

#: The learned stages are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared folder until the next one is there."""
    docs = support.table(spark, sf_dir, "documents")
    folder = f"{support.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        support.release(spark)
        if k:
            support.delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
