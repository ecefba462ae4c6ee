import duckdb

from ridgeline.llm import quality

from .conftest import DATA


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = con.execute(quality.ORACLE_SQL)
    names = [d[0] for d in theirs.description]
    ours = quality.op6_quality(spark, DATA).select(*names)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())


def test_measure():
    assert quality.measure(None) == quality.measure("") == (0,) * 7
    m = dict(zip(quality.MEASURES, quality.measure("a b c a b c\n\na b c\nÄ #|\nÄ #|\n"), strict=True))
    assert m == {"n_words": 13, "word_chars": 15, "n_symbols": 4, "n_dup_lines": 1, "n_repeat_words": 9, "n_lines": 4, "n_upper": 0}


def test_overlapping_repeats():
    assert quality.measure("x x x x")[4] == 4
    assert quality.measure("a b a b")[4] == 0


def test_policies_and_ablation(spark):
    names = quality.NAMES
    assert tuple(quality.rules()) == names
    bits = [0, 1, 3, 4, 5, 64]
    df = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    kept = lambda v: [b for b in bits if not b & quality.mask(*quality.POLICIES[v])]
    for v in quality.POLICIES:
        assert [r.fail_bits for r in df.filter(quality.verdict(df.fail_bits, v)).collect()] == kept(v)
        for r in quality.ablation(df, v).collect():
            one = quality.mask(r.rule)
            held = [b & quality.mask(*quality.POLICIES[v]) for b in bits]
            assert r.n_failed == sum(bool(b & one) for b in held) and r.n_only == sum(b == one for b in held)


def test_edges(edge, none):
    rows = {r.id: r for r in quality.ledger(edge).collect()}
    assert rows[0].n_words == rows[2].n_words == 0 and rows[0].fail_bits & 1 and rows[4].fail_bits == rows[5].fail_bits
    assert quality.ledger(none).count() == 0
