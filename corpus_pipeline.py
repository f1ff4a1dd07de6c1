"""From raw documents to token shards: quality, near duplicates, benchmark passages, source mix, token ids.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns of any name: null texts are empty ones; a null doc_id, language or source is a value of its own; of rows that are equal in doc_id and text the
near-duplicate stage keeps one; an empty table stays empty. This module needs tracewright.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, row_key, table
from tracewright.llm.decontaminate import contaminated
from tracewright.llm.mixing import mix_sources, mixed_documents
from tracewright.llm.quality import score_quality
from tracewright.llm.queries import tokenizer_path
from tracewright.llm.simhash import one_of_each_group
from tracewright.llm.wavelet import read_token_shards, write_token_shards


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject: all of them where no labels of both classes are at hand."""
    n = len(docs.columns)
    scored = score_quality(docs.toDF(*[c if c in ("doc_id", "text", "lang", "source") else f"c{i}" for i, c in enumerate(docs.columns)]), table(spark, sf_dir, "labels"))
    return scored.where("keep").select(*scored.columns[:n]).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = materialize(contaminated(docs, table(spark, sf_dir, "benchmark")).select("row").distinct(), "contaminated")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    return plain.withColumn("row", row_key(doc_id, text)).join(found, "row", "left_anti").drop("row").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, as documents: a row per pass that takes words of a document."""
    return mixed_documents(docs, *mix_sources(docs))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards written and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_shards(write_token_shards(docs, tokenizer_path()))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix", mix), ("token_shards", token_shards)]

#: The classifier, the latent space and the tokenizer have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
