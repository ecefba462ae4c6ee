"""A hundred thousand rows without an id, of one id, or alike in everything: groups and shards stay within bounds."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import packing, sharding

from .conftest import DATA

MANY = 100_000


@pytest.mark.parametrize("hot", [None, 5])
def test_packing_deals_a_hot_id(spark, hot, tmp_path):
    df = spark.range(MANY).select(F.lit(hot).cast("long").alias("id"), F.lit(99).cast("long").alias("tokens"))
    df.unionByName(spark.range(20_000).select("id", (F.col("id") % 900).alias("tokens"))).write.parquet(str(tmp_path / "t"))
    rows = packing.packed(spark.read.parquet(str(tmp_path / "t")))
    assert rows.count() == MANY + 20_000
    groups = rows.groupBy(F.shiftright("bin_id", 32).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in groups) <= packing.OVER * packing.GROUP and len(groups) >= (MANY + 20_000) / packing.GROUP
    bins = rows.groupBy("bin_id").agg(F.sum("length").alias("used"), F.max("capacity").alias("c"), F.min("capacity").alias("d"), F.count_distinct("bin_offset").alias("k"), F.count(F.lit(1)).alias("n"))
    assert bins.filter("used > c OR c <> d OR k <> n").isEmpty()


@pytest.mark.parametrize("hot", [None, 5, (1 << 60) + 1])
def test_shards_are_even_with_a_hot_id(spark, monkeypatch, hot):
    """Half of all rows alike in everything, the others with ids beyond 2 ** 53 that are neighbours."""
    monkeypatch.setattr(sharding, "NUMBERED", 500)
    df = spark.range(20_000).select(F.lit(hot).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    df = df.unionByName(spark.range(20_000).select((F.lit(1 << 60) + F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang")))
    rows = sharding.sharded(df, 8, ["doc_id", "lang"])
    found = rows.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("k")).collect()
    assert len(found) == 8 and max(r.b for r in found) - min(r.b for r in found) <= 4 * 21
    assert all((r.lo, r.hi, r.k) == (0, r.n - 1, r.n) for r in found)


def test_near_duplicate_stage_keeps_rows_that_differ_elsewhere(spark):
    rows = [(1, "some text of five words", "en", "a", 1), (1, "some text of five words", "en", "b", 1), (1, "some text of five words", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.source for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()) == ["a", "b"]
