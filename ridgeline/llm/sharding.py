"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, down to the target bytes.

A node with several leaves to make is cut along the dimension in which its rows spread
widest (relative to the whole corpus), at the point that gives each side the bytes its
leaves need. A cut is a distributed selection: each round counts bytes in a bounded number
of bins over the node's open interval and goes on in the bin that the cut falls into; all
nodes of a level share the rounds. Ties along a dimension are ordered by the id's hash, then by a hash of
the whole row, and at last by the row's place in the stored table, so a cut can fall inside any run of equal
values, ids or rows, however large. Only what is equal in everything else depends on places.

Law ``bytes``: leaves differ by little more than the largest row.

Edge cases: null and empty texts weigh 8 bytes, with crc32 0; null and NaN metadata count as 0; fewer rows
than shards leave some shards empty; rows of one id, or without any, may part, as may equal texts; a very long text weighs its bytes and can't be cut; an empty table gives an empty result.
Outputs are named here and only the columns named are read, so others never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import documents, drop, kept

#: Bins of one round of a selection, for each node; what reaches the driver is nodes times bins.
BINS = 1024
#: Rows in one group while rows are numbered.
NUMBERED = 50_000
_HASH_BITS = 31


def kd_shards(rows: DataFrame, leaves: int, dims: list[str], weight: str, order: str) -> DataFrame:
    """rows with a column ``shard``: 0 to leaves - 1. dims: numeric columns; order: a long column that breaks ties.

    rows should be short; each level of the tree stores them once, with their cell."""
    rows = kept(rows.withColumn("_tie", F.pmod(F.xxhash64(order), F.lit(1 << _HASH_BITS))).withColumn("_order", F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 52))).withColumn("_place", F.monotonically_increasing_id()).withColumn("_cell", F.lit(0)), "cells")
    spread = [f(_number(d)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    bounds = rows.agg(*spread).first()
    whole = {d: max(1e-12, (bounds[f"hi_{d}"] or 0.0) - (bounds[f"lo_{d}"] or 0.0)) for d in dims}
    cells = {0: leaves}  # first leaf of a cell -> its leaves
    while any(n > 1 for n in cells.values()):
        stats = {r["_cell"]: r for r in rows.groupBy("_cell").agg(F.sum(weight).alias("w"), *spread).collect()}
        cuts = {}
        for cell, n in cells.items():
            if n > 1 and cell in stats:
                s = stats[cell]
                wide = max(dims, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / whole[d], -dims.index(d)))
                cuts[cell] = {"dim": wide, "want": s["w"] * (n // 2) / n, "before": 0, "lo": s[f"lo_{wide}"], "hi": s[f"hi_{wide}"], "stage": "value"}
        _narrow(rows, cuts, weight)
        moved = F.col("_cell")
        for cell, cut in cuts.items():
            moved = F.when((F.col("_cell") == cell) & ~cut["left"], F.lit(cell + cells[cell] // 2)).otherwise(moved)
        last, rows = rows, kept(rows.withColumn("_cell", moved), "cells")
        drop(last)
        cells = {k: m for cell, n in cells.items() for k, m in (((cell, n // 2), (cell + n // 2, n - n // 2)) if n > 1 and cell in cuts else ((cell, 1),))}
    return rows.withColumn("shard", F.col("_cell").cast("int")).drop("_tie", "_order", "_cell")


#: What orders a run of equal values: stage -> its column and greatest number. Places are exact as doubles up to a million partitions.
_TIES = {"tie": ("_tie", float((1 << _HASH_BITS) - 1)), "order": ("_order", 2.0**52), "place": ("_place", 2.0**63)}


def _narrow(level: DataFrame, cuts: dict, weight: str) -> None:
    """Finds every node's cut: by value, then among equal values by the stages of _TIES."""
    while open_ := {i: c for i, c in cuts.items() if c["stage"] != "done"}:
        bin_of, inside = F.lit(0), F.lit(False)
        for i, c in open_.items():
            column = _column(c)
            at = F.floor((column - F.lit(c["lo"])) / F.lit((c["hi"] - c["lo"]) or 1.0) * BINS)
            here = (F.col("_cell") == i) & (column >= F.lit(c["lo"])) & (column <= F.lit(c["hi"]))
            for fixed, value in c.get("equal", ()):
                here = here & (fixed == F.lit(value))
            bin_of = F.when(F.col("_cell") == i, F.least(F.lit(BINS - 1), F.greatest(F.lit(0), at.cast("int")))).otherwise(bin_of)
            inside = inside | here
        value = F.lit(None).cast("double")
        for i, c in open_.items():
            value = F.when(F.col("_cell") == i, _column(c)).otherwise(value)
        found = (
            level.filter(inside).select("_cell", bin_of.alias("bin"), value.alias("v"), F.col(weight).alias("w"))
            .groupBy("_cell", "bin").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        )
        for i, c in open_.items():
            total = c["before"]
            bins = sorted((r["bin"], r["w"], r["lo"], r["hi"], r["n"]) for r in found if r["_cell"] == i)
            for k, (_, w, lo, hi, n) in enumerate(bins):
                if total + w >= c["want"] or k == len(bins) - 1:  # the cut falls here
                    c["before"], c["lo"], c["hi"], c["w"], c["n"] = total, lo, hi, w, n
                    break
                total += w
            if c["lo"] == c["hi"]:
                _settle(c)


def _number(dim: str) -> Column:
    """A dimension as a finite number: null and NaN are 0."""
    value = F.nanvl(F.col(dim).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(-1e300), F.least(F.lit(1e300), F.coalesce(value, F.lit(0.0))))


def _column(c: dict) -> Column:
    if c["stage"] == "value":
        return _number(c["dim"])
    return F.col(_TIES[c["stage"]][0]).cast("double")


def _settle(c: dict) -> None:
    """One value is left: on among its rows, by the next order, or done: it goes to the side that it brings nearer to its bytes."""
    column = _column(c)
    smaller = column < F.lit(c["lo"])
    for fixed, value in reversed(c.get("equal", [])):
        smaller = (fixed < F.lit(value)) | ((fixed == F.lit(value)) & smaller)
    whole = smaller | _all_equal(c, column)
    stages = ["value", *_TIES, None]
    if c["n"] > 1 and (after := stages[stages.index(c["stage"]) + 1]):
        c.setdefault("equal", []).append((column, c["lo"]))
        c |= {"stage": after, "lo": 0.0, "hi": _TIES[after][1]}
    else:
        near = c["want"] - c["before"] > c["w"] / 2
        c |= {"stage": "done", "left": whole if near else smaller}


def _all_equal(c: dict, column: Column) -> Column:
    out = column == F.lit(c["lo"])
    for fixed, value in c.get("equal", []):
        out = out & (fixed == F.lit(value))
    return out


def numbered(rows: DataFrame, n_rows: int, key: str = "shard", order: str = "id", place: str = "_place") -> DataFrame:
    """rows with ``slot``: gapless from 0 in each key. Rows are numbered in groups of about NUMBERED; the groups'
    offsets are sums over the groups before, so no key's rows meet in one task. What is alike in everything but its
    ``place`` shares a group: one that is far too large is dealt again by places."""
    from pyspark.sql import Window

    groups = max(1, math.ceil(n_rows / NUMBERED))
    alike = [c for c in rows.columns if c != place]
    rows = rows.withColumn("_like", F.xxhash64(F.lit(7), *alike)).withColumn("_group", F.pmod("_like", F.lit(groups)).cast("int")).withColumn("_sub", F.lit(0))
    sizes = rows.groupBy(key, "_group").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > 4 * NUMBERED)
    if not large.isEmpty():  # few: at most n_rows / (4 * NUMBERED)
        parts = F.broadcast(large.select(key, "_group", F.ceil(F.col("_n") / NUMBERED).alias("_parts")))
        rows = rows.join(parts, [key, "_group"], "left").withColumn("_sub", F.coalesce(F.pmod(F.xxhash64(place), "_parts"), F.lit(0)).cast("int")).drop("_parts")
        sizes = rows.groupBy(key, "_group", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    else:
        sizes = sizes.withColumn("_sub", F.lit(0))
    before = Window.partitionBy(key).orderBy("_group", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_group", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_group", "_sub").orderBy(order, "_like", place)
    rows = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return rows.join(sizes, [key, "_group", "_sub"]).withColumn("slot", (F.col("_before") + F.col("_row")).cast("long")).drop("_group", "_sub", "_before", "_row", "_like")


def sharded(df: DataFrame, leaves: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot of every row. dims: df's numeric columns, or columns to be hashed if strings."""
    kinds = dict(df.dtypes)
    axes = {f"d{i}": (F.pmod(F.xxhash64(d), F.lit(1 << 20)) if kinds[d] == "string" else F.col(d)).cast("double") for i, d in enumerate(dims)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = kept(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in axes.items()]), "sizes")
    cells = kd_shards(rows, leaves, [*axes, "size"], "size", "id")
    out = kept(numbered(cells, rows.count()).drop("_place", *axes), "shards")
    drop(cells)
    drop(rows)
    return out


def op9_sharding(spark: SparkSession, sf_dir: str, leaves: int = 24) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return sharded(docs, leaves, ["doc_id", "lang", "source"]).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
