"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage takes the documents that its predecessor kept, as written to the
shared folder, and returns documents with the same columns:

1. language ID: profiles are fitted on these documents; texts without a letter
   (``und``) and texts that are near to no language's profile go;
2. n-gram Jaccard join: of each component one document stays, the one with the
   smallest id (of rows alike in it, one with the smallest class number; of
   rows alike in that too, one with the smallest hash of its text);
3. decontamination: documents that contain a benchmark item go;
4. PII: spans are replaced by their kind, no document goes;
5. byte-pair encoding: the last stage's rows are encoded and decoded again.

Null and empty texts are ``und`` and go in the first stage; an empty table
gives an empty table in each stage. Extra columns are kept through stage 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import bpe, decontamination, langid, pii, setjoin
from eventfold.llm.common import staged

#: Least score of a document that is kept; prose of a learned language is far above.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("t")), profiles, keep=["row"], text_col="t")
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pii", redact_pii), ("bpe", encode)]

#: SQL cannot fit profiles, join sets or merge tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
