"""Extension: molecule counts over a stream of reads, deduplicated inside the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def molecule_counts(stream: DataFrame, time: str, site: list[str], umi: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of new molecules by window and site. A molecule that returns within ``delay`` counts once; later rows than that are late."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    fresh = timed.dropDuplicatesWithinWatermark([*site, umi])
    return fresh.groupBy(F.window(time, window).alias("w"), *site).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from"), *site, "n")
