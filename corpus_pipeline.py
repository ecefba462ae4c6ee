"""Documents to packed training sequences: five stages, each written as Parquet and reread by the next.

Every stage keeps all columns (the last has its own), reads only doc_id and text, and works on whole texts
of any length. Null and empty texts are clean, linked with nothing, and packed as one separator each. An
empty table passes through. Rows without a doc_id are scored, cleaned and packed like others, and can't
be told apart as copies, so all stay. Rows of one doc_id but different texts go or stay together; a row that
comes several times whole stays once. A stage's table is removed when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontam, jaccard, packing, pii, tokens, toxicity
from ridgeline.llm.blocks import drop, kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the toxicity operator predicts to be toxic."""
    return toxicity.without_toxic(docs, toxicity.examples(docs, toxicity.labelled(spark, sf_dir)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id; rows without an id can't be told apart and all stay."""
    groups = jaccard.near_groups(docs.select(F.col("doc_id").alias("id"), "text"))
    first = groups.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id"))
    rows = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    if not first.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates()
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item, or nearly one."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of the permitted lengths."""
    counts = tokens.token_counts(docs, ledger=False).select("id", F.col("n_tokens").alias("tokens"))
    counted = kept(counts, "token-counts")
    return packing.packed(counted).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: The stages learn, link and verify texts in ways that SQL can't express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
