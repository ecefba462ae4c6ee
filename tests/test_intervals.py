import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.operators import intervals as iv

INTERVALS = [("x", 0, 10), ("x", 10, 20), ("x", 12, 14), ("x", 19, 25), ("x", 40, 41), ("y", 0, 10), ("y", 5, 6)]


def frame(spark, rows, names="k string, s long, e long"):
    return spark.createDataFrame(rows, names)


def test_merge_strict_touching_nested(spark):
    df = frame(spark, INTERVALS)
    got = lambda t: sorted(map(tuple, iv.merged(df, ["k"], "s", "e", t).collect()))
    assert got(False) == [("x", 0, 10, 1), ("x", 10, 25, 3), ("x", 40, 41, 1), ("y", 0, 10, 2)]
    assert got(True) == [("x", 0, 25, 4), ("x", 40, 41, 1), ("y", 0, 10, 2)]


def test_merge_in_bins_gives_the_same(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.randrange(3000), s + rng.randrange(1, 60)) for _ in range(300)]
    for touching in (False, True):
        got = [sorted(map(tuple, iv.merged(frame(spark, rows), ["k"], "s", "e", touching, w).collect())) for w in (None, 50, 700)]
        assert got[0] == got[1] == got[2]


def test_merge_is_idempotent(spark):
    once = iv.merged(frame(spark, INTERVALS), ["k"], "s", "e").drop("n")
    assert sorted(map(tuple, iv.merged(once, ["k"], "s", "e").drop("n").collect())) == sorted(map(tuple, once.collect()))


def test_atomic_segments_cover_gaps(spark):
    got = sorted(map(tuple, iv.atomic_segments(frame(spark, [("x", 0, 4), ("x", 2, 8), ("x", 10, 12)]), ["k"], "s", "e").collect()))
    assert got == [("x", 0, 2), ("x", 2, 4), ("x", 4, 8), ("x", 8, 10), ("x", 10, 12)]


def test_binned_join_equals_plain_join(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(1, 90)) for _ in range(n)]
    left, right = frame(spark, make(120), "k string, as long, ae long"), frame(spark, make(120), "k string, bs long, be long")
    plain = left.join(right, "k").filter((F.col("as") < F.col("be")) & (F.col("ae") > F.col("bs")))
    for width in (1, 7, 50, 1000):
        got = iv.overlap_join(left, right, ["k"], width, ("as", "ae"), ("bs", "be"))
        assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_touching_is_no_overlap(spark):
    left, right = frame(spark, [("x", 0, 10)], "k string, as long, ae long"), frame(spark, [("x", 10, 20), ("x", 9, 10)], "k string, bs long, be long")
    assert [r.bs for r in iv.overlap_join(left, right, ["k"], 5, ("as", "ae"), ("bs", "be")).collect()] == [9]


def test_band_join_and_anti_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(1000)) for i in range(80)], "i long, k string, a long")
    right = spark.createDataFrame([(rng.choice("ab"), rng.randrange(1000)) for _ in range(40)], "k string, b long")
    plain = left.join(right, "k").filter(F.abs(F.col("a") - F.col("b")) <= 12)
    got = iv.band_join(left, right, ["k"], 12, "a", "b")
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    none = iv.band_anti_join(left, right, ["k"], 12, "a", "b", ["i"])
    assert {r.i for r in none.collect()} == set(range(80)) - {r.i for r in plain.collect()}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 20), st.integers(1, 10), st.integers(0, 20), st.integers(1, 10))
def test_relations_agree(a, la, b, lb):
    s, e, t, u = a, a + la, b, b + lb
    assert (s < u and e > t) == (not (e <= t or s >= u))


def test_relations_columns(spark):
    df = spark.createDataFrame([(0, 5, 5, 9), (0, 6, 5, 9), (5, 9, 5, 9), (6, 8, 5, 9), (9, 12, 5, 9)], "s long, e long, t long, u long")
    cols = iv.relations(F.col("s"), F.col("e"), F.col("t"), F.col("u"))
    rows = [{k for k in cols if r[k]} for r in df.select(*[c.alias(k) for k, c in cols.items()]).collect()]
    assert rows == [{"before", "adjacent"}, {"partial_left", "overlapping"}, {"within", "contains", "equal", "overlapping"}, {"within", "overlapping"}, {"after", "adjacent"}]


def test_tss_windows(spark):
    exons = spark.createDataFrame([("g", "+", "t1", 100, 150), ("g", "+", "t1", 200, 220), ("g", "+", "t2", 130, 160), ("h", "-", "t3", 10, 50), ("i", "+", "t4", 3, 9)], "gene string, strand string, tr string, s long, e long")
    got = sorted(map(tuple, iv.tss_windows(exons, ["gene"], "tr", "s", "e", "strand", 20).collect()))
    assert got == [("g", "+", 80, 150, 2), ("h", "-", 30, 70, 1), ("i", "+", 1, 23, 1)]


def test_nearest_before(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, a long")
    right = spark.createDataFrame([("x", 2), ("x", 5), ("x", 7)], "k string, b long")
    assert sorted((r.k, r.a, r.nearest) for r in iv.nearest_before(left, right, ["k"], "a", "b").collect()) == [("x", 1, None), ("x", 5, 5), ("y", 9, None)]


def test_nested_bins_equal_plain_join(spark):
    """Lengths from zero to the whole axis, also below zero; nothing twice."""
    rng = random.Random(9)

    def make(n, most):
        rows = []
        for i in range(n):
            s = rng.randrange(-2000, 100_000)
            rows.append((i, rng.choice("ab"), s, s + rng.choice([0, 1, 2, 3, 17, 300, 5000, most])))
        return rows

    for most in (4, 200_000):
        left, right = frame(spark, make(150, most), "i long, k string, as long, ae long"), frame(spark, make(150, 64), "j long, k string, bs long, be long")
        plain = left.join(right, "k").filter((F.col("as") < F.col("be")) & (F.col("ae") > F.col("bs")))
        got = iv.overlap_join(left, right, ["k"], None, ("as", "ae"), ("bs", "be"))
        assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    none = iv.overlap_join(left, right.limit(0), ["k"], None, ("as", "ae"), ("bs", "be"))
    assert none.count() == 0


def test_nested_bins_copy_rows_by_levels_only(spark):
    long = frame(spark, [("x", 0, 1 << 30), ("x", 5, 6)] * 20, "k string, as long, ae long")
    short = frame(spark, [("x", i, i + 1 + i % 3) for i in range(0, 3000, 7)], "k string, bs long, be long")
    one, two = iv._nested(long, short, ("as", "ae"), ("bs", "be"))
    assert one.count() <= 40 * 2 * 3 and two.count() <= short.count() * 2 * 4


def test_nearest_equals_search(spark):
    """Both sides over many bins, with ties, equal positions, keys without any, and rows without a key or position."""
    rng = random.Random(2)
    spots = [rng.randrange(-500, 500) if rng.random() < 0.5 else rng.randrange(3_000_000) for _ in range(80)]
    left = [(i, rng.choice("abc"), rng.choice(spots) + rng.randrange(-2, 3), rng.choice("+-")) for i in range(200)] + [(900, None, 5, "+"), (901, "a", None, "-"), (902, "a", spots[0], None)]
    right = [(rng.choice("ab"), x) for x in spots] + [("a", spots[0])] * 3 + [(None, 5), ("a", None)]
    for width in (16, 1 << 14):
        got = iv.nearest(frame(spark, left, "i long, k string, a long, strand string"), frame(spark, right, "k string, b long"), ["k"], "a", "b", "strand", width).collect()
        assert len(got) == len(left)
        for r in got:
            known = [b for k, b in right if k == r.k and k is not None and b is not None and r.a is not None]
            before, after = max((b for b in known if b <= r.a), default=None), min((b for b in known if b >= r.a), default=None)
            near = before if after is None or (before is not None and r.a - before <= after - r.a) else after
            assert (r.before, r.after, r.nearest, r.distance) == (before, after, near, None if near is None else near - r.a)
            assert (r.upstream, r.downstream) == ((before, after) if r.strand == "+" else (after, before))


def test_nearest_has_no_window_over_a_key(spark):
    left, right = frame(spark, [("x", 5)], "k string, a long"), frame(spark, [("x", 2)], "k string, b long")
    plan = iv.nearest(left, right, ["k"], "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) >= 5 and sum("_bin" not in line.split("], [")[1] and "_group" not in line.split("], [")[1] for line in windows) <= 2  # the last level's: one row for 2 ** 30 bins


def test_atomic_segments_in_bins_are_the_same(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.randrange(-90_000, 90_000), s + rng.randrange(1, 400)) for _ in range(150)]
    want = sorted(map(tuple, iv.atomic_segments(frame(spark, rows), ["k"], "s", "e").collect()))
    for width in (8, 1000):
        assert sorted(map(tuple, iv.atomic_segments(frame(spark, rows), ["k"], "s", "e", width).collect())) == want


def test_band_pairs_equal_plain_join(spark):
    """Rows alike in all but the key, equal positions, a key that comes twice, rows without a group or position."""
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.randrange(0, 4000) / 100) for i in range(150)] + [(200 + i, "a", rng.choice("xy"), 7.25) for i in range(30)]
    rows += [(0, "a", "x", 7.3), (300, None, "x", 7.3), (301, "a", "y", None)]
    got = iv.band_pairs(spark.createDataFrame(rows, "i long, k string, t string, p double"), ["k"], 2, "p", "i", ["t"])
    seen = sorted((r.k, *min((r.lo_i, r.lo_t), (r.hi_i, r.hi_t)), *max((r.lo_i, r.lo_t), (r.hi_i, r.hi_t)), round(r.gap, 6)) for r in got.collect())
    known = [(i, k, t, p) for i, k, t, p in rows if k and p is not None]
    want = sorted((k, i, t, j, u, round(abs(p - q), 6)) for i, k, t, p in known for j, m, u, q in known if i < j and k == m and abs(p - q) <= 2)
    assert seen == want


def test_band_pairs_are_spread_over_tasks(spark):
    """Pairs outgrow the rows, so the engine must not size the join's tasks by the rows."""
    rows = spark.range(4000).selectExpr("id AS i", "chr(65 + id div 100 % 2) AS k", "id % 100 AS p")
    sizes = [r["count"] for r in iv.band_pairs(rows, ["k"], 20, "p", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * sum(20 * 19 // 2 + 20 * 20 * min(20, 99 - p) for p in range(100))
    assert max(sizes) < sum(sizes) / 8, (max(sizes), sum(sizes), len(sizes))


def test_band_pairs_send_few_copies(spark):
    """Rows that differ in everything: what is shuffled is a small multiple of them, whatever the deals."""
    df = spark.range(1000).selectExpr("id AS i", "chr(65 + id % 2) AS k", "id * 0.37 AS p")
    pairs = iv.band_pairs(df, ["k"], 20, "p", "i")
    pairs.collect()
    todo, sent = [pairs._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            sent += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    assert 1000 < sent <= 10_000


def test_band_pairs_of_rows_alike_come_in_order(spark):
    """The smaller key stays over a run of pairs, and the larger one rises in it."""
    rows = spark.range(1200).selectExpr("id * 7919 % 1200 AS i", "'a' AS k", "id % 3 * 1.5 AS p")
    got = [sorted((r.lo_i, r.hi_i)) for r in iv.band_pairs(rows, ["k"], 2, "p", "i").collect()]
    assert len(got) == 2 * 400 * 400 + 3 * (400 * 399 // 2)
    assert sum(a != c or b > d for (a, b), (c, d) in zip(got, got[1:], strict=False)) < len(got) / 20


def test_overlap_summary_pairs_no_copies(spark, monkeypatch):
    """As the plain join counts, and copies of intervals make no more pairs."""
    rng = random.Random(10)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(1, 40)) for _ in range(n)]
    left, right = make(40) + [(None, 3, 9)], make(30) + [(None, 3, 9), ("a", 900, 901)]
    pairs, join = [], iv.overlap_join
    monkeypatch.setattr(iv, "overlap_join", lambda *x: (got := join(*x), pairs.append(got.count()))[0])
    for width in (30, None):
        for copies in (1, 8):
            a = [(i, *x) for i, x in enumerate(left * copies)]
            b = [(i // 2, *x) for i, x in enumerate(right * copies)]
            got = iv.overlap_summary(frame(spark, a, "i long, k string, as long, ae long"), frame(spark, b, "j long, k string, bs long, be long"), ["k"], width, ("as", "ae"), ("bs", "be"), "i", "j")
            want = {}
            for j, k, s, e in b:
                for i, m, t, u in a:
                    if k and k == m and t < e and u > s:
                        n, first, shared = want.get(j, (0, i, 0))
                        want[j] = (n + 1, min(first, i), shared + min(e, u) - max(s, t))
            assert {r.j: (r.n, r["first"], r.shared) for r in got.collect()} == want
        assert pairs[-1] == pairs[-2]
