"""CIGAR strings, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exon_parts(start: Column, cigar: Column, deletions_advance: bool = True) -> Column:
    """array<struct<start, end>>: the stretches between skipped regions (N).

    M, = and X advance, D too (not with ``deletions_advance=False``); I, S, H and P don't. Null and ``*`` give no parts."""
    steps = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"\d+[MIDNSHP=X]"), 0)
    moves = "M=XD" if deletions_advance else "M=X"
    size = lambda s: F.regexp_extract(s, r"\d+", 0).cast("long")
    kind = lambda s: F.substring(s, -1, 1)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    begin = F.struct(start.cast("long").alias("from"), start.cast("long").alias("at"), none.alias("parts"))

    def close(acc: Column) -> Column:
        part = F.array(F.struct(acc["from"].alias("start"), acc["at"].alias("end")))
        return F.when(acc["at"] > acc["from"], F.concat(acc["parts"], part)).otherwise(acc["parts"])

    def step(acc: Column, s: Column) -> Column:
        moved = F.struct(acc["from"].alias("from"), (acc["at"] + F.when(F.lit(moves).contains(kind(s)), size(s)).otherwise(F.lit(0))).alias("at"), acc["parts"].alias("parts"))
        skipped = F.struct((acc["at"] + size(s)).alias("from"), (acc["at"] + size(s)).alias("at"), close(acc).alias("parts"))
        return F.when(kind(s) == "N", skipped).otherwise(moved)

    return F.aggregate(steps, begin, step, close)
