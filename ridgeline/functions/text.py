"""Text column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = r"^([^:]+):(\d+)-(\d+):([+-])$"


def region_key(chrom: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start, F.lit("-"), end, F.lit(":"), strand)


def parse_region(key: Column) -> tuple[Column, Column, Column, Column]:
    """chrom, start, end, strand; nulls where the key has another form."""
    part = lambda i: F.nullif(F.regexp_extract(key, REGION, i), F.lit(""))
    return part(1), part(2).cast("long"), part(3).cast("long"), part(4)


def any_chunk_near(s: Column, target: Column, size: int, less_than: int) -> Column:
    """Does one of the whole chunks of ``size`` characters lie under that edit distance from the target?"""
    chunks = F.regexp_extract_all(s, F.lit(f"(?s).{{{size}}}"), F.lit(0))  # in one pass: each substring would count characters from the text's start
    return F.exists(chunks, lambda c: F.levenshtein(c, target, less_than - 1) >= 0)


def feature_id(feature: Column, gene: Column, transcript: Column, exon: Column) -> Column:
    """The id that names a record: the gene's, the exon's, or else the transcript's (each a name, or the id where there is none)."""
    return F.when(feature == "gene", gene).when(feature == "exon", exon).otherwise(transcript)


def several_names(name: Column) -> Column:
    """Does a record carry several names, joined by commas?"""
    return F.coalesce(name.contains(","), F.lit(False))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def attributes(s: Column) -> Column:
    """A map of an annotation line's attributes: ``key "value";`` or ``key=value;``. Values keep their blanks."""
    pairs = F.regexp_extract_all(s, F.lit(r'([\w.]+)[ =]+("[^"]*"|[^;]+)'), 0)
    name = lambda p: F.regexp_extract(p, r"^([\w.]+)", 1)
    value = lambda p: F.trim(F.replace(F.regexp_extract(p, r'^[\w.]+[ =]+("[^"]*"|[^;]+)', 1), F.lit('"'), F.lit("")))
    entries = F.transform(pairs, lambda p: F.struct(name(p).alias("key"), value(p).alias("value")))
    # a key that comes twice keeps its first value
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)
