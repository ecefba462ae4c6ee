import zlib

from pyspark.sql import functions as F

from ridgeline.llm import sharding

from .conftest import DATA


def test_query(spark, docs):
    rows = sharding.op9_sharding(spark, DATA).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(text) and len(rows) == len(text)
    shards = {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(24))
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))


def test_bytes_are_near_equal(spark):
    """Even with all values of a dimension equal, and sizes that differ much."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', CAST(pmod(hash(id), 400) AS INT))").alias("text"), F.lit("one").alias("source"))
    rows = sharding.sharded(df, 24, ["source"]).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in rows]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 5 * 408


def test_result_does_not_depend_on_partitions(spark, docs):
    one = {r.id: (r.shard, r.slot) for r in sharding.sharded(docs, 5, ["doc_id", "lang"]).collect()}
    two = {r.id: (r.shard, r.slot) for r in sharding.sharded(docs.repartition(7), 5, ["doc_id", "lang"]).collect()}
    assert one == two


def test_slots_over_many_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    rows = sharding.sharded(docs, 3, ["doc_id"]).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_edges(edge, none):
    rows = {r.id: r for r in sharding.sharded(edge, 24, ["doc_id", "source", "n_chars"]).collect()}
    assert len(rows) == edge.count() and rows[0].size == 8 and rows[0].text_crc32 == 0 and rows[1].size == 8
    assert sharding.sharded(none, 24, ["doc_id", "source"]).count() == 0


def plain_shards(rows, leaves, dims):
    """Weighted medians by sorting: rows of (values by dimension, weight, hash, id)."""
    whole = [max(1e-12, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(dims)]
    out = {}

    def cut(rows, first, n):
        if n == 1 or not rows:
            out.update({r[3]: first for r in rows})
            return
        wide = max(range(dims), key=lambda d: ((max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / whole[d], -d))
        rows = sorted(rows, key=lambda r: (r[0][wide], r[2], r[3]))
        want, total, left = sum(r[1] for r in rows) * (n // 2) / n, 0, 0
        for left, r in enumerate(rows):  # noqa: B007
            if total + r[1] >= want or left == len(rows) - 1:
                break
            total += r[1]
        left += want - total > rows[left][1] / 2
        cut(rows[:left], first, n // 2)
        cut(rows[left:], first + n // 2, n - n // 2)

    cut(rows, 0, leaves)
    return out


def test_equals_plain_medians(spark, docs):
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("tie")
    axis = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("double").alias(c)
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")
    rows = [((float(r.doc_id), r.lang, r.source, float(r.size)), r.size, r.tie, r.doc_id) for r in docs.select("doc_id", axis("lang"), axis("source"), size, tie).collect()]
    got = {r.doc_id: r.shard for r in sharding.op9_sharding(spark, DATA).select("doc_id", "shard").collect()}
    assert got == plain_shards(rows, 24, 4)


def test_equal_hashes_and_nan(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_HASH_BITS", 2)
    rows = [(i, "x" * (i % 7), float("nan") if i % 5 == 0 else None if i % 5 == 1 else float("inf") if i % 5 == 2 else 1.0 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, v double")
    sizes = [r.b for r in sharding.sharded(df, 6, ["v"]).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 4 * 15
