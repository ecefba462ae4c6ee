"""Counting, ratios, reshaping and correlation over sparse (row, cell, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def molecule_counts(hits: DataFrame, site: list[str], cell: list[str], umi: str) -> DataFrame:
    """Distinct molecules of each site and cell."""
    return hits.groupBy(*site, *cell).agg(F.count_distinct(umi).alias("n"))


def psi(counts: DataFrame, group: str, row: str, cell: str, value: str, more_rows_than: int = 0) -> DataFrame:
    """value / sum of the group's values in the cell. Groups of at most ``more_rows_than`` rows are left out.

    Both sums are aggregates joined back, so no group's rows meet in one task."""
    totals = counts.groupBy(group, cell).agg(F.sum(value).alias("_total"))
    out = counts.join(totals, [group, cell])
    if more_rows_than:
        wide = counts.groupBy(group).agg(F.count_distinct(row).alias("_rows")).filter(F.col("_rows") > more_rows_than)
        out = out.join(wide.select(group), group, "left_semi")
    return out.withColumn("psi", F.try_divide(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def wide(df: DataFrame, row: list[str], column: str, values: list, agg: Column, fill=0) -> DataFrame:
    """Long to wide over a given list of columns, missing cells filled."""
    return df.groupBy(*row).pivot(column, values).agg(agg).na.fill(fill)


def long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def correlation(pairs: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """key, n, r: Pearson over the rows of each key; null where one side is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))


def sparse_correlation(values: DataFrame, pairs: DataFrame, row: str, cell: str, value: str, n_cells: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] a, b, r for pairs of rows (columns a, b) over all ``n_cells`` cells, absent cells counting as 0, in closed form.

    by: keys of values and pairs within which cells are counted; n_cells may be a column of pairs then (and is kept as n)."""
    x = values.groupBy(*by, row).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    left, right = (values.select(*by, F.col(row).alias(k), cell, F.col(value).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = pairs.select(*by, "a", "b").join(left, [*by, "a"]).join(right, [*by, "b", cell]).groupBy(*by, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = pairs.join(both, [*by, "a", "b"], "left")
    for k in ("a", "b"):
        out = out.join(x.select(*by, F.col(row).alias(k), F.col("s").alias(f"s_{k}"), F.col("q").alias(f"q_{k}")), [*by, k], "left")
    n = n_cells.cast("double") if isinstance(n_cells, Column) else F.lit(float(n_cells))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    top = n * z("xy") - z("s_a") * z("s_b")
    bottom = F.sqrt((n * z("q_a") - z("s_a") ** 2) * (n * z("q_b") - z("s_b") ** 2))
    return out.select(*by, "a", "b", F.try_divide(top, bottom).alias("r"), *([n.cast("long").alias("n")] if by else []))


def average_rank(df: DataFrame, group: list[str], value: str) -> Column:
    """Rank within the group, ties at their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2


def value_ranks(df: DataFrame, key: list[str], value: str, sums: dict[str, Column], cuts: int = 64, buckets: bool = False) -> DataFrame:
    """key, value, n, rank (ties at their mean) and the given sums, one row for each distinct value of a key; with ``buckets`` also _b.

    For keys with any number of rows: equal values are counted before the shuffle, a key's values are
    dealt into buckets by approximate quantiles, and ranks are sums of the buckets before and inside."""
    spread = df.groupBy(*key).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 1000).alias("_q"))
    rows = df.join(spread, key).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(value))))
    counts = rows.groupBy(*key, "_b", value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in sums.items()])
    totals = counts.groupBy(*key, "_b").agg(F.sum("n").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*key, "_b", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_inside", inside).join(totals, [*key, "_b"])
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_inside") + (F.col("n") + 1) / 2).drop("_before", "_inside")
    return ranked if buckets else ranked.drop("_b")


def adjusted(df: DataFrame, key: list[str], p: str, name: str = "p_adj") -> DataFrame:
    """df with the p-values adjusted for the false discovery rate within ``key``: the least p * n / rank of this and all larger ones, 1 at most.

    The running minimum is taken inside buckets of values and over the buckets' minima, so a key of any size spreads
    over tasks. Rows without a p-value count in no rank and get null."""
    known = df.filter(F.col(p).isNotNull())
    ranked = value_ranks(known, key, p, {}, buckets=True)
    total = known.groupBy(*key).agg(F.count(F.lit(1)).alias("_total"))
    ranked = ranked.join(total, key).withColumn("_raw", F.col(p) * F.col("_total") / (F.col("rank") + (F.col("n") - 1) / 2))
    later = F.min("_least").over(Window.partitionBy(*key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))
    least = ranked.groupBy(*key, "_b").agg(F.min("_raw").alias("_least")).withColumn("_later", later).drop("_least")
    inside = F.min("_raw").over(Window.partitionBy(*key, "_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = ranked.withColumn("_inside", inside).join(least, [*key, "_b"]).select(*key, p, F.least(F.lit(1.0), "_inside", "_later").alias(name))
    return df.join(found, [*key, p], "left")


def recovery(values: DataFrame, sets: DataFrame, n_rows: int, top: float = 0.05) -> DataFrame:
    """set, col_id, auc: the area under the recovery curve of each set of rows among the ``top`` share of a cell's rows by value.

    values: row_id, col_id, value, once each, zeros absent; sets: set, row_id. A cell's rows are ranked from the largest value, ties by
    id; ranks that can't be in the top are dropped before the shuffle (a limited row number). Cells that recover nothing are absent."""
    most = max(1, round(n_rows * top))
    ranks = F.row_number().over(Window.partitionBy("col_id").orderBy(F.desc("value"), "row_id"))
    best = values.withColumn("_rank", ranks).filter(F.col("_rank") <= most - 1)
    sizes = sets.groupBy("set").agg(F.count_distinct("row_id").alias("_size"))
    hits = best.join(sets.distinct(), "row_id").groupBy("set", "col_id").agg(F.sum(most - F.col("_rank")).alias("_area"))
    return hits.join(sizes, "set").select("set", "col_id", (F.col("_area") / (most * F.col("_size"))).alias("auc"))


def rank_sum(df: DataFrame, key: list[str], first: Column, value: str) -> DataFrame:
    """key, n1, n2, u, z, auc of the Wilcoxon rank-sum test (normal approximation, tie-corrected)."""
    rows = df.select(*key, value, F.when(first, 1).otherwise(0).alias("_first"))
    ranked = value_ranks(rows, key, value, {"_n1": F.sum("_first")})
    n = F.col("n").cast("double")
    s = ranked.groupBy(*key).agg(
        F.sum("_n1").alias("n1"), F.sum(F.col("n") - F.col("_n1")).alias("n2"), F.sum(F.col("_n1") * F.col("rank")).alias("_r"), F.sum(n * n * n - n).alias("_t")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("_r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.try_divide(F.col("_t"), (n1 + n2) * (n1 + n2 - 1))))
    return s.select(*key, "n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2, spread).alias("z"), F.try_divide(u, n1 * n2).alias("auc"))
