"""Shared plumbing: Arrow batches in and out, corpus sizes, hashing, tables in the shared folder.

Every operator reads only the id and text columns it names, so further columns (even
ones named like an output) never clash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python call works on at a time.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about ``most`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_CLAIMS: dict[str, Callable[[], object]] = {}


def claim(owner: str, clear: Callable[[], object]) -> None:
    """Inside a worker: from now on only ``owner`` keeps a cache there; those of other operators are cleared."""
    for other in [k for k in _CLAIMS if k != owner]:
        _CLAIMS.pop(other)()
    _CLAIMS[owner] = clear


def map_rows(df: DataFrame, fn: Callable[..., dict], schema: str, *cols: str) -> DataFrame:
    """``fn(column lists...) -> {name: values}`` on slices of each partition, Arrow both ways."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(*[c.to_pylist() for c in part.columns])
                arrays = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type, from_pandas=True) for f in kind]
                yield pa.RecordBatch.from_arrays(arrays, schema=kind)

    return df.select(*cols).mapInArrow(run, schema)


def keep_where(df: DataFrame, keep: Callable[[list], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of df whose text ``keep`` accepts, every column as it was; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where the session names none."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if not set_by:
        import os
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_by = "file://" + os.path.join(tempfile.gettempdir(), "ridgeline-shared")
    return set_by


#: Spark's own setting: shuffle files of a query go as soon as it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors. The shuffles behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by kept()."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes) of the corpus; sizes shuffles, never drops anything."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def parts_for(size: int, part_bytes: int) -> int:
    """Partitions of about so many bytes each, at any size of the corpus."""
    return max(2, math.ceil(size / part_bytes))


def crc_mod(col: str, mod: int):
    """crc32 of an id written as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for uint64 arrays."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
