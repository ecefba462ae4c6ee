"""Writers of the tab-separated outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, header: bool = True, compress: bool = False, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, compression="gzip" if compress else "none")


def counts(df: DataFrame, path: str, compress: bool = False) -> None:
    """row_id, col_id, value without zeros and without a header."""
    table(df.filter("value > 0").select("row_id", "col_id", "value"), path, False, compress)


def isoforms(df: DataFrame, path: str, compress: bool = False) -> None:
    """ats, gene_id, transcript_ids, ws, with ``.`` for what is missing."""
    text = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")), F.lit(".")).alias(c)
    table(df.select("ats", F.coalesce("gene_id", F.lit(".")).alias("gene_id"), text("transcript_ids"), text("ws")), path, True, compress)


def wide_matrix(df: DataFrame, path: str, columns: list[str], min_total: float = 0, compress: bool = True) -> None:
    """row_id and one column for each of ``columns``, zeros filled in; rows whose sum is over ``min_total``."""
    enough = df.groupBy("row_id").agg(F.sum("value").alias("total")).filter(F.col("total") > min_total)
    rows = df.join(enough, "row_id", "left_semi").groupBy("row_id").pivot("col_id", columns).agg(F.first("value")).na.fill(0)
    table(rows, path, True, compress, ",")
