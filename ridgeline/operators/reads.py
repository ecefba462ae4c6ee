"""Read filters, strands, deduplication and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of the alignment format's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, QCFAIL = 1, 2, 4, 8, 16, 32, 64, 128, 512


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def passes_qc(flag: Column, hits: Column | None = None) -> Column:
    """Mapped, not failed, properly paired if paired; at most one hit where hits are known."""
    ok = ~has(flag, UNMAPPED) & ~has(flag, QCFAIL) & (~has(flag, PAIRED) | has(flag, PROPER))
    return ok if hits is None else ok & (F.coalesce(hits, F.lit(1)) <= 1)


def strand(flag: Column) -> Column:
    """Of the transcript: read 2 gives its own strand, read 1 and single reads the other way round for pairs."""
    own = F.when(has(flag, REVERSE), "-").otherwise("+")
    other = F.when(has(flag, REVERSE), "+").otherwise("-")
    return F.when(has(flag, PAIRED) & has(flag, READ2), other).otherwise(own)


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_row = 1").drop("_row")


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def deduplicated(df: DataFrame, key: list[str], umi: str, order: list) -> DataFrame:
    """First read of each molecule; reads without a molecule id are left out."""
    return first_per_key(df.filter(F.col(umi).isNotNull()), [*key, umi], order)


def paired(reads: DataFrame, name: str, is_first: Column, how: str = "inner") -> DataFrame:
    """name, start, end of fragments: both mates' least start and greatest end ("left": of the first mate if it is alone)."""
    one = reads.filter(is_first).select(name, F.col("start").alias("s1"), F.col("end").alias("e1"))
    two = reads.filter(~is_first).select(name, F.col("start").alias("s2"), F.col("end").alias("e2"))
    return one.join(two, name, how).select(name, F.least("s1", "s2").alias("start"), F.greatest("e1", "e2").alias("end"))
