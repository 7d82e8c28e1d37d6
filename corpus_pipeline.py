"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

* language: documents without a letter (``und``) and ambiguous ones go.
* exact: of texts equal up to white space one stays.
* near: of each group linked by near-duplicates one stays, the smallest identifier.
* mix: sources get their target weights; a document stands there as often as the mix takes
  it, a part of one taking counting if it is half the document or more, in the order of the
  mix's slots. What the mix does not take goes: that is the stage's purpose, not a cap.
* pack: pieces of at most 2048 tokens with their sequences.

Operators store the rows they judge and carry the other columns with them, so rows that repeat
and null identifiers are dealt with as the operators say. Tables that a stage stores for its
result are deleted when no result reads them any more (see ``common.free_unused``), so stages
may run in any order, several at a time, and again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import exact, langid, mixing, near, packing
from arbora.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BESIDE = tuple(c for c in COLUMNS if c != "text")
#: SQL can express neither the trained classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = langid.predict(docs, langid.train(docs), keep=tuple(COLUMNS))
    return out.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*COLUMNS)


def _documents(df: DataFrame, text) -> DataFrame:
    return df.select(*(text.alias(c) if c == "text" else F.col(f"row.{c}") for c in COLUMNS))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(exact.dedup(docs, carry=BESIDE).where("kept"), F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(near.near_dedup(docs, carry=BESIDE).where("kept"), F.col("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.Mix(docs, carry=tuple(COLUMNS)).in_order(), F.col("row.text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact_copies), ("near", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
