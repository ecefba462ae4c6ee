"""Interval algebra. Intervals are half-open, [start, end), in long columns.

Joins on overlap or distance are equi-joins on bins: each side is laid into every bin that it
touches, and a pair is kept only in the bin where the later of the two starts lies, so it
comes once. The planner sees a hash or sort-merge join and can deal with skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict: intervals that only touch don't overlap."""
    return (a_start < b_end) & (a_end > b_start)


def covers(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = 3) -> Column:
    """a covers b, each end up to ``tolerance`` outside."""
    return (b_start >= a_start - tolerance) & (b_end <= a_end + tolerance)


def relations(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> dict[str, Column]:
    """How a lies to b."""
    return {
        "before": a_end <= b_start,
        "after": a_start >= b_end,
        "partial_left": (a_start < b_start) & (a_end > b_start) & (a_end < b_end),
        "partial_right": (a_start > b_start) & (a_start < b_end) & (a_end > b_end),
        "within": (a_start >= b_start) & (a_end <= b_end),
        "contains": (a_start <= b_start) & (a_end >= b_end),
        "equal": (a_start == b_start) & (a_end == b_end),
        "overlapping": overlaps(a_start, a_end, b_start, b_end),
        "adjacent": (a_end == b_start) | (a_start == b_end),
    }


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins that [start, end) touches; an empty interval has the bin of its start."""
    first = F.floor(start / F.lit(width)).cast("long")
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / F.lit(width)).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int | None, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs with equal ``on`` whose intervals overlap strictly. a, b: (start, end) columns, named apart.

    width: about a median interval; short bins copy long intervals, wide ones compare more pairs. None: nested
    bins, for lengths that differ by orders of magnitude."""
    hit = overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))
    if width is None:
        one, two = _nested(left, right, a, b)
        cell = lambda x: F.expr(f"shiftright(cast({x} AS bigint), _level)")
        pairs = one.join(two, [*on, "_level", "_side", "_bin"])
        return pairs.filter(hit & (F.col("_bin") == F.greatest(cell(f"`{a[0]}`"), cell(f"`{b[0]}`")))).drop("_level", "_side", "_bin")
    cut = lambda x: F.floor(F.col(x) / F.lit(width)).cast("long")
    one = left.withColumn("_bin", F.explode(_bins(F.col(a[0]), F.col(a[1]), width)))
    two = right.withColumn("_bin", F.explode(_bins(F.col(b[0]), F.col(b[1]), width)))
    return one.join(two, [*on, "_bin"]).filter(hit & (F.col("_bin") == F.greatest(cut(a[0]), cut(b[0])))).drop("_bin")


def overlap_summary(left: DataFrame, right: DataFrame, on: list[str], width: int | None, a: tuple[str, str], b: tuple[str, str], least: str, key: str) -> DataFrame:
    """key (of right), n, first, shared: how many left intervals overlap with it, the least ``least`` among them, and the lengths of the common parts added up.

    Equal intervals of a side are one: those are joined, and what they found is handed to each row, so copies make no pairs."""
    one = left.groupBy(*on, *a).agg(F.count(F.lit(1)).alias("_n"), F.min(least).alias("_least"))
    two = right.select(*on, *b).distinct()
    common = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    pairs = overlap_join(one, two, on, width, a, b).withColumn("_shared", F.col("_n") * common)
    found = pairs.groupBy(*on, *b).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.sum("_shared").alias("_shared"))
    rows = right.select(key, *[c for c in (*on, *b) if c != key]).join(found, [*on, *b])
    return rows.groupBy(key).agg(F.sum("_n").alias("n"), F.min("_least").alias("first"), F.sum("_shared").alias("shared"))


#: Each level's bins are 2 ** LEVEL_BITS times as wide as those of the one below.
LEVEL_BITS = 2


def _level(start: str, end: str) -> Column:
    """Bits of the width of the narrowest bins that are no shorter than the interval."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    return (F.ceil(F.log2(length) / LEVEL_BITS) * LEVEL_BITS).cast("int")


def _nested(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides by ``_level``, ``_side`` and ``_bin``: a pair meets in the bins of its longer interval's level.

    At its own level an interval touches two bins at most, and the shorter one touches two at most there, so a row becomes
    at most two rows for each level that the other side has (there are at most 32, asked for in one pass over each side)."""
    levels = lambda df, x: sorted(r[0] for r in df.select(_level(*x).alias("l")).filter("l IS NOT NULL").distinct().collect())
    of_left, of_right = levels(left, a), levels(right, b)

    def cells(bits: int | str, side: int) -> Column:
        """The bins of that level (a number or a column's name) that the interval touches."""
        first, last = (F.expr(f"shiftright({c}, {bits})") for c in ("_first", "_last"))
        level = F.lit(bits) if isinstance(bits, int) else F.col(bits)
        return F.transform(F.sequence(first, last), lambda n: F.struct(level.alias("level"), F.lit(side).alias("side"), n.alias("bin")))

    def laid(df: DataFrame, x: tuple[str, str], others: list[int], mine: int, strict: bool) -> DataFrame:
        """Side ``mine``: the pairs in which these rows are the longer ones. They lie at their own level, the other's rows probe there."""
        df = df.withColumns({"_own": _level(*x), "_first": F.col(x[0]).cast("long"), "_last": F.greatest(F.col(x[0]), F.col(x[1]) - 1).cast("long")})
        none = F.array().cast("array<struct<level:int,side:int,bin:bigint>>")
        probes = [F.when(F.col("_own") < k if strict else F.col("_own") <= k, cells(k, 1 - mine)).otherwise(none) for k in others]
        shortest = F.lit(min(others, default=99))
        lying = F.when(shortest <= F.col("_own") if strict else shortest < F.col("_own"), cells("_own", mine)).otherwise(none)
        every = F.explode(F.flatten(F.array(lying, *probes)))
        return df.withColumn("_x", every).withColumns({f"_{c}": F.col(f"_x.{c}") for c in ("level", "side", "bin")}).drop("_x", "_own", "_first", "_last")

    return laid(left, a, of_right, 0, False), laid(right, b, of_left, 1, True)


def band_join(left: DataFrame, right: DataFrame, on: list[str], distance: int | float, a: str, b: str) -> DataFrame:
    """Pairs with equal ``on`` whose positions a and b are at most ``distance`` apart; positions may be fractions."""
    width = max(1, distance)
    cell = lambda x: F.floor(F.col(x) / F.lit(width)).cast("long")
    one = left.withColumn("_bin", cell(a))
    two = right.withColumn("_bin", F.explode(F.sequence(cell(b) - 1, cell(b) + 1)))
    return one.join(two, [*on, "_bin"]).filter(F.abs(F.col(a) - F.col(b)) <= distance).drop("_bin")


#: Tasks of a join whose pairs outgrow its rows: the engine would size them by the rows. And into how many deals each side's rows alike in position are cut.
PAIR_TASKS, PAIR_DEALS = 192, 2


def band_pairs(df: DataFrame, on: list[str], distance: int | float, at: str, key: str, rest: list[str] = ()) -> DataFrame:
    """Pairs of rows of one table with equal ``on``, unlike keys and positions at most ``distance`` apart, each pair once:
    on, ``gap``, then ``lo_`` and ``hi_`` with ``key`` and ``rest`` of the lower and the higher of both by (position, key).

    Rows alike in all but the key meet others as one and are multiplied out behind the join. They look for lower ones only, in bins
    of half the distance; both sides' deals meet in a square, so a key is sent 4 * PAIR_DEALS times at most. Of two groups alike, the pairs in which a
    key is the smaller one follow one another, by the other key, so what is written of them packs well."""
    width = distance / 2 if distance > 0 else 1
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    deal = F.pmod(F.xxhash64(key), F.lit(PAIR_DEALS)).cast("int")
    alike = df.groupBy(*on, at, *rest, deal.alias("_deal")).agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    side = lambda p, mine: alike.select(*on, F.col("_deal").alias(mine), *[F.col(c).alias(f"{p}_{c}") for c in ("_keys", at, *rest)])
    keys, low, high = [*on, "_bin", "_row", "_column"], F.col(f"lo_{at}"), F.col(f"hi_{at}")
    deals = F.explode(F.array(*[F.lit(i) for i in range(PAIR_DEALS)]))
    one = side("lo", "_row").withColumn("_bin", cell(low)).withColumn("_column", deals).repartition(PAIR_TASKS, *keys)
    two = side("hi", "_column").withColumn("_bin", F.explode(F.sequence(cell(high - distance), cell(high)))).withColumn("_row", deals).repartition(PAIR_TASKS, *keys)
    pairs = one.join(two.hint("shuffle_hash"), keys).withColumn("gap", high - low).filter(F.col("gap").between(0, distance))
    names = [f"{p}_{c}" for p in ("lo", "hi") for c in rest]
    way = lambda a, b, up: F.struct(F.col(f"{a}__keys").alias("a"), F.col(f"{b}__keys").alias("b"), F.lit(up).alias("up"))
    ways = F.when(F.col("gap") > 0, F.array(way("lo", "hi", True), way("hi", "lo", False))).otherwise(F.array(way("lo", "hi", True)))
    pairs = pairs.select(*on, "gap", *names, F.explode(ways).alias("_way")).select(*on, "gap", *names, "_way.up", "_way.b", F.explode("_way.a").alias("_less"))
    pairs = pairs.select(*on, "gap", *names, "up", "_less", F.explode("b").alias("_more")).filter("_less < _more")
    lower, higher = (F.when(F.col("up"), F.col(a)).otherwise(F.col(b)) for a, b in (("_less", "_more"), ("_more", "_less")))
    return pairs.select(*on, "gap", *names, lower.alias(f"lo_{key}"), higher.alias(f"hi_{key}"))


def band_anti_join(left: DataFrame, right: DataFrame, on: list[str], distance: int | float, a: str, b: str, key: list[str]) -> DataFrame:
    """Rows of left without any right position within ``distance``. key: left's unique key."""
    near = band_join(left.select(*key, *[c for c in on if c not in key], *([a] if a not in [*key, *on] else [])), right.select(*on, b), on, distance, a, b)
    return left.join(near.select(*key).distinct(), key, "left_anti")


def islands(df: DataFrame, on: list[str], start: str, end: str, touching: bool = False) -> DataFrame:
    """df with ``island``: a number for each chain of overlapping (or touching) intervals, within ``on``. Rows without a start come last, so they begin no island but where there is no other."""
    order = Window.partitionBy(*on).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    df = df.withColumn("_reach", reach)
    new = F.when(F.col("_reach").isNull() | apart, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_new")


def merged(df: DataFrame, on: list[str], start: str, end: str, touching: bool = False, width: int | None = None) -> DataFrame:
    """on, start, end, n: the union of each chain of intervals. Nested intervals keep the larger end.

    width: merge inside bins of starts first. Where ``on`` has few values (chromosomes), that spreads the
    work over tasks, and only the unions of the bins meet in the task of their key."""
    rows = df.select(*on, start, end).withColumn("n", F.lit(1).cast("long"))
    for keys in [[*on, "_bin"], on] if width else [on]:
        if "_bin" in keys:
            rows = rows.withColumn("_bin", F.floor(F.col(start) / F.lit(width)))
        rows = islands(rows, keys, start, end, touching).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("island", "_bin")
    return rows


#: Bins whose summaries are carried together, as a power of two, and how many times: the last window sees bins of bins of bins.
FAN_BITS, CARRIES = 10, 3


def _carried(bins: DataFrame, on: list[str], times: int = CARRIES) -> DataFrame:
    """bins (on, _bin, _lo, _hi) with ``_prev``: the last _hi of the bins before, and ``_next``: the first _lo of those after.

    A scan in levels: bins are scanned within groups of 2 ** FAN_BITS, and what comes from outside a group is found
    by the same scan over the groups. So a window holds 2 ** FAN_BITS rows, on the last level one for
    2 ** (FAN_BITS * CARRIES) bins."""
    keys = [*on, "_group"] if times else on
    rows = bins.withColumn("_group", F.shiftright("_bin", FAN_BITS)) if times else bins
    order = Window.partitionBy(*keys).orderBy("_bin")
    rows = rows.withColumn("_prev", F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_next", F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    if not times:
        return rows
    groups = rows.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).withColumnRenamed("_group", "_bin")
    outside = _carried(groups, on, times - 1).select(*on, F.col("_bin").alias("_group"), F.col("_prev").alias("_far_prev"), F.col("_next").alias("_far_next"))
    rows = rows.join(outside, keys).withColumn("_prev", F.coalesce("_prev", "_far_prev")).withColumn("_next", F.coalesce("_next", "_far_next"))
    return rows.drop("_group", "_far_prev", "_far_next")


def atomic_segments(df: DataFrame, on: list[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """on, start, end: consecutive borders of the intervals, gaps included.

    width: look for the next border within bins, and carry it over from bin to bin; for few and long ``on`` (chromosomes)."""
    borders = df.select(*on, F.col(start).alias("start")).unionByName(df.select(*on, F.col(end).alias("start"))).distinct()
    if width is None:
        return borders.withColumn("end", F.lead("start").over(Window.partitionBy(*on).orderBy("start"))).filter(F.col("end").isNotNull())
    borders = borders.withColumn("_bin", F.floor(F.col("start") / F.lit(width)).cast("long"))
    bins = _carried(borders.groupBy(*on, "_bin").agg(F.min("start").alias("_lo"), F.max("start").alias("_hi")), on)
    rows = borders.withColumn("end", F.lead("start").over(Window.partitionBy(*on, "_bin").orderBy("start"))).join(bins, [*on, "_bin"])
    return rows.select(*on, "start", F.coalesce("end", "_next").alias("end")).filter(F.col("end").isNotNull())


def nearest(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, strand: str | None = None, width: int = 1 << 14) -> DataFrame:
    """left with ``before`` and ``after``: the last right position at or before its own, and the first at or after it;
    ``nearest``: the closer one (at equal distances, before), and ``distance``: nearest less its own position.
    With ``strand`` (a column of left) also ``upstream`` and ``downstream``: on + before and after, otherwise the other way.

    No rows are paired. Positions are distinct integers by then, so a bin has at most ``width`` of each side, and what lies
    beyond a bin is carried from bin to bin (see ``_carried``). Rows without a position or key have nulls."""
    names = {c: f"_on{i}" for i, c in enumerate(on)}
    keys = list(names.values())
    at = lambda df, c, mine: df.select(*[F.col(k).alias(v) for k, v in names.items()], F.col(c).alias("_at"), F.lit(mine).alias("_mine")).distinct()
    both = at(left, a, 1).unionByName(at(right, b, 0)).dropna().withColumn("_bin", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    theirs = F.when(F.col("_mine") == 0, F.col("_at"))
    bins = _carried(both.groupBy(*keys, "_bin").agg(F.min(theirs).alias("_lo"), F.max(theirs).alias("_hi")), keys)
    inside = Window.partitionBy(*keys, "_bin").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_before", F.last(theirs, ignorenulls=True).over(inside.orderBy("_at", "_mine")))
    found = found.withColumn("_after", F.last(theirs, ignorenulls=True).over(inside.orderBy(F.col("_at").desc(), "_mine"))).filter("_mine = 1")
    found = found.join(bins, [*keys, "_bin"]).select(*keys, "_at", F.coalesce("_before", "_prev").alias("before"), F.coalesce("_after", "_next").alias("after"))
    rows = left.join(found, [*[F.col(k) == F.col(v) for k, v in names.items()], F.col(a) == F.col("_at")], "left").drop(*keys, "_at")
    back, ahead = F.col(a) - F.col("before"), F.col("after") - F.col(a)
    rows = rows.withColumn("nearest", F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after")))
    rows = rows.withColumn("distance", F.col("nearest") - F.col(a))
    if strand:
        plus = F.col(strand) == "+"
        rows = rows.withColumns({"upstream": F.when(plus, F.col("before")).otherwise(F.col("after")), "downstream": F.when(plus, F.col("after")).otherwise(F.col("before"))})
    return rows


def nearest_before(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """left with ``nearest``: the last right position at or before its own."""
    return nearest(left, right, on, a, b).drop("nearest", "distance", "after").withColumnRenamed("before", "nearest")


def tss_windows(exons: DataFrame, gene: list[str], transcript: str, start: str, end: str, strand: str, span: int) -> DataFrame:
    """gene, start, end, n: windows of ``span`` around each transcript's start site, merged per gene; starts are 1 at least."""
    site = exons.groupBy(*gene, strand, transcript).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    at = F.when(F.col(strand) == "+", F.col("_lo")).otherwise(F.col("_hi"))
    windows = site.select(*gene, strand, F.greatest(at - span, F.lit(1)).alias("start"), (at + span).alias("end"))
    return merged(windows, [*gene, strand], "start", "end", width=100_000)


def clipped(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """The part of [start, end) inside [lo, hi), relative to lo; null where there is none."""
    s, e = F.greatest(start, lo) - lo, F.least(end, hi) - lo
    return F.when(s < e, s), F.when(s < e, e)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
