"""Every contract query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ridgeline.contract import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{DATA}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        v = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(v) else round(v, 5) + 0.0


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours = queries()[name](spark, DATA)
    theirs = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    got, want = rows(ours.columns, ours.collect()), rows(columns, theirs.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-5) for a, b in zip(g, w, strict=True))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    queries()[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_min_by_model_with_large_keys(spark, duck, tmp_path):
    """Keys over 100,000 outweigh a cent in SQL's order; rows without a price or key don't count."""
    rows = [(250_000, "a", 900.0), (100_001, "a", 900.01), (1, "b", 901.0), (None, "b", 1.0), (7, "b", None), (3, "c", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, queries()["min_by_model"](spark, str(tmp_path)).collect()))
    sql = oracle_sql()["min_by_model"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(duck.execute(sql).fetchall()) == [("a", 100_001), ("b", 1), ("c", None)]


@pytest.mark.parametrize("name", ["interval_merge_islands", "interval_merge_touching"])
def test_islands_of_tied_rows(spark, name):
    """Rows alike in customer and day: no island overlaps another of its customer, and copies only count."""
    from pyspark.sql import functions as F

    from ridgeline.contract.base import QUERIES, Tables

    once = queries()[name](spark, DATA)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    copies = orders.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).drop("copy").repartition(7)
    fn = QUERIES[name].__closure__[0].cell_contents

    class Copied(Tables):
        def __getattr__(self, table):
            return copies

    got = fn(Copied(spark, DATA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.withColumn("n", F.col("n") * 6).collect()))


@pytest.mark.parametrize("name", ["interval_merge_islands", "interval_merge_touching"])
def test_islands_of_rows_without_a_date(spark, duck, tmp_path, name):
    """SQL puts nulls last: such a row falls into its customer's last island, and is one by itself only where no other row has a date."""
    days = [(1, 7, "1995-01-01"), (2, 7, "1995-01-31"), (3, 7, None), (4, 7, "1996-03-01"), (5, 8, None), (6, 8, None), (7, None, "1995-01-01"), (8, None, None)]
    spark.createDataFrame(days, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "CAST(d AS TIMESTAMP_NTZ) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    ours = queries()[name](spark, str(tmp_path))
    sql = oracle_sql()[name].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    theirs = duck.execute(sql)
    assert rows(ours.columns, ours.collect()) == rows([d[0] for d in theirs.description], theirs.fetchall())


def test_having_semi_join_deals_by_rows(spark, monkeypatch):
    """Tasks grow in number with the rows, not in size; the result is the same."""
    from ridgeline.contract import joins

    once = queries()["having_semi_join"](spark, DATA)
    monkeypatch.setattr(joins, "ROWS_A_TASK", 500, raising=False)
    many = queries()["having_semi_join"](spark, DATA)
    assert many.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect()))


def test_chunks_are_cut_in_one_pass(spark):
    """Whole chunks only, over line ends; no substring per chunk, which would read a long text from its start each time."""
    from pyspark.sql import functions as F

    from ridgeline.functions import text

    rows = [("the of and", True), ("xxxxxxxxxxthe of\nand", True), ("x" * 10 + "the of an", False), ("the of an", False), ("", False), ("z" * 400_000 + "the of add", True), ("qqq of qqq", True), ("qqqq of qq", False)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    near = df.select("want", text.any_chunk_near(F.col("s"), F.lit("the of and"), 10, 7).alias("got"))
    assert [r.got for r in near.collect()] == [want for _, want in rows]
    assert "substr" not in near._jdf.queryExecution().optimizedPlan().toString().lower()
