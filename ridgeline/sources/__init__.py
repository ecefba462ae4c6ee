"""Readers and writers of the domain's files."""

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Makes ``bam`` and ``bigwig`` known as formats of spark.read."""
    from ridgeline.sources.bam import BamSource
    from ridgeline.sources.bigwig import BigWigSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the bam reader takes filters on chrom
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BigWigSource)
