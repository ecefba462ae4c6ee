"""A data source for BigWig signals: ``spark.read.format("bigwig").load(path)`` gives chrom, start, end, value.

The file's R-tree names its data blocks. Filters on ``chrom``, ``start`` and ``end`` (or the option ``regions``) are
taken down the tree, so only nodes and blocks that overlap them are read; a partition is a run of blocks of one
chromosome. Windows around many places are read by ``window_vectors`` and ``window_means``: the places are dealt
by position, and each task walks the tree for its own.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.sources import files
from ridgeline.sources.regions import EVERYWHERE, Wanted

MAGIC, CHROM_TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BLOCKS = 2048
#: Decoded blocks and tree nodes that a task keeps.
KEPT = 256


class BigWig:
    """One file. ``opened`` counts the data blocks that were read, ``nodes`` those of the tree."""

    def __init__(self, uri: str):
        system, path = files.store(uri)
        self.uri, self.file, self.opened, self.nodes = uri, system.open_input_file(path), 0, 0
        head = self._bytes(0, 64)
        self.order = "<" if len(head) == 64 and struct.unpack_from("<I", head)[0] == MAGIC else ">"
        if len(head) < 64 or struct.unpack_from(f"{self.order}I", head)[0] != MAGIC:
            raise ValueError(f"{uri} is no BigWig file")
        _, levels, tree, _, self.index, *_ = struct.unpack_from(f"{self.order}HHQQQ", head, 4)
        self.packed = struct.unpack_from(f"{self.order}I", head, 52)[0] > 0
        #: (bases a value stands for, index of that level), finest first
        self.zooms = sorted((z[0], z[3]) for z in (self._get(64 + 24 * i, "IIQQ") for i in range(levels)))
        self.chroms = dict(sorted(self._chroms(tree)))
        self.number = {name: i for i, (name, _) in self.chroms.items()}
        self._cache: OrderedDict = OrderedDict()

    def __enter__(self) -> BigWig:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _get(self, at: int, form: str) -> tuple:
        form = self.order + form
        data = self._bytes(at, struct.calcsize(form))
        if len(data) < struct.calcsize(form):
            raise ValueError(f"{self.uri} is cut short")
        return struct.unpack(form, data)

    def _held(self, key: tuple, make):
        if key in self._cache:
            self._cache.move_to_end(key)
        else:
            self._cache[key] = make()
            if len(self._cache) > KEPT:
                self._cache.popitem(last=False)
        return self._cache[key]

    def _chroms(self, at: int) -> Iterator[tuple[int, tuple[str, int]]]:
        magic, _, key, _, _, _ = self._get(at, "IIIIQQ")
        if magic != CHROM_TREE:
            raise ValueError(f"{self.uri}: bad chromosome tree")
        nodes = [at + 32]
        while nodes:
            at = nodes.pop()
            leaf, _, count = self._get(at, "BBH")
            for i in range(count):
                if leaf:
                    name, number, size = self._get(at + 4 + i * (key + 8), f"{key}sII")
                    yield number, (name.rstrip(b"\0").decode(), size)
                else:
                    nodes.append(self._get(at + 4 + i * (key + 8) + key, "Q")[0])

    def _node(self, at: int) -> tuple[bool, list[tuple]]:
        """(leaf, its entries: first chromosome and start, last chromosome and end, and the child or the block)."""
        leaf, _, count = self._get(at, "BBH")
        form = struct.Struct(self.order + ("IIIIQQ" if leaf else "IIIIQ"))
        data = self._bytes(at + 4, form.size * count)
        if len(data) < form.size * count:
            raise ValueError(f"{self.uri} is cut short")
        self.nodes += 1
        return bool(leaf), list(form.iter_unpack(data))

    def blocks(self, chrom: int | None = None, lo: int = 0, hi: int = EVERYWHERE, index: int | None = None) -> list[tuple[int, int, int, int, int]]:
        """(chromosome, start, end, offset, size) of the data blocks that overlap [lo, hi) of a chromosome (None: all of them), in order."""
        index = self.index if index is None else index
        if self._held(("magic", index), lambda: self._get(index, "I")[0]) != INDEX:
            raise ValueError(f"{self.uri}: bad index")
        out, nodes = [], [index + 48]
        while nodes:
            at = nodes.pop()
            leaf, entries = self._held(("node", at), lambda at=at: self._node(at))
            for c0, s, c1, e, *rest in entries:
                if chrom is not None and not ((c0, s) < (chrom, hi) and (c1, e) > (chrom, lo)):
                    continue
                if leaf:
                    out.append((c0, s, e if c1 == c0 else 1 << 32, *rest))
                else:
                    nodes.append(rest[0])
        return sorted(out)

    def _data(self, offset: int, size: int) -> bytes:
        raw = self._bytes(offset, size)
        self.opened += 1
        try:
            return zlib.decompress(raw) if self.packed else raw
        except zlib.error as e:
            raise ValueError(f"{self.uri}: the block at {offset} is damaged ({e})") from e

    def runs(self, offset: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(chromosome, starts, ends, values) of a data block."""

        def decoded():
            raw, o = self._data(offset, size), self.order
            number, start, _, step, span, kind, _, count = struct.unpack_from(f"{o}IIIIIBBH", raw)
            form = {1: [("s", f"{o}u4"), ("e", f"{o}u4"), ("v", f"{o}f4")], 2: [("s", f"{o}u4"), ("v", f"{o}f4")], 3: [("v", f"{o}f4")]}[kind]
            rows = np.frombuffer(raw, np.dtype(form), count, 24)
            starts = start + step * np.arange(count, dtype=np.int64) if kind == 3 else rows["s"].astype(np.int64)
            return number, starts, rows["e"].astype(np.int64) if kind == 1 else starts + span, rows["v"].astype(np.float64)

        return self._held(("block", offset), decoded)

    def summaries(self, offset: int, size: int) -> np.ndarray:
        """The records of a zoom block: c, s, e, n (bases with a value), low, high, sum, squares."""
        kind = np.dtype([(c, f"{self.order}u4") for c in "csen"] + [(c, f"{self.order}f4") for c in ("low", "high", "sum", "squares")])
        return self._held(("zoom", offset), lambda: np.frombuffer(self._data(offset, size), kind))

    def named(self, chrom: str) -> int | None:
        """A chromosome's number, with or without ``chr``."""
        return self.number.get(chrom, self.number.get(chrom.removeprefix("chr") if chrom.startswith("chr") else f"chr{chrom}"))

    def vector(self, chrom: str | None, lo: int, hi: int) -> np.ndarray:
        """The signal at each position of [lo, hi); gaps and NaN are 0."""
        out = np.zeros(max(0, hi - lo))
        number = None if chrom is None else self.named(chrom)
        for _, _, _, offset, size in self.blocks(number, max(0, lo), hi) if number is not None else ():
            c, starts, ends, values = self.runs(offset, size)
            if c == number:
                for i in range(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi))):
                    out[max(0, starts[i] - lo) : ends[i] - lo] = 0.0 if np.isnan(values[i]) else values[i]
        return out

    def means(self, chrom: str | None, lo: int, hi: int, bins: int, exact: bool = False) -> np.ndarray:
        """The mean of the values there are, in each of ``bins`` parts of [lo, hi); NaN where there are none.

        Not ``exact``: from the coarsest zoom level with at least two summaries in a part, cut in proportion at its ends."""
        edges = lo + (hi - lo) * np.arange(bins + 1) / bins
        total, weight = np.zeros(bins), np.zeros(bins)
        number = None if chrom is None else self.named(chrom)
        index = None if exact else max(((r, i) for r, i in self.zooms if 2 * r <= (hi - lo) / bins), default=(0, None))[1]
        for _, _, _, offset, size in self.blocks(number, max(0, lo), hi, index) if number is not None else ():
            if index is None:
                c, s, e, v = self.runs(offset, size)
                there, sums = np.where(np.isnan(v), 0, e - s), np.where(np.isnan(v), 0, v * (e - s))
                mine = np.flatnonzero((e > lo) & (s < hi)) if c == number else []
            else:
                rows = self.summaries(offset, size)
                s, e, there, sums = rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["n"], rows["sum"].astype(np.float64)
                mine = np.flatnonzero((rows["c"] == number) & (e > lo) & (s < hi))
            for i in mine:
                share = np.clip(np.minimum(edges[1:], e[i]) - np.maximum(edges[:-1], s[i]), 0, None) / (e[i] - s[i])
                total += share * sums[i]
                weight += share * there[i]
        return np.divide(total, weight, out=np.full(bins, np.nan), where=weight > 0)


@dataclass
class Part(InputPartition):
    path: str
    blocks: list


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.wanted = files.listed(options["path"], ".bw"), Wanted(options.get("regions"))

    def pushFilters(self, filters):
        for f in filters:
            self.wanted.push(f)
            yield f

    def partitions(self):
        out = []
        for path in self.paths:
            with BigWig(path) as f:
                within = self.wanted.within([f.chroms.get(i, ("", 0)) for i in range(max(f.chroms, default=-1) + 1)])
                found = f.blocks() if within is None else sorted({b for c, cut in within.items() for lo, hi in cut for b in f.blocks(c, lo, hi)})
            last: Part | None = None
            for b in found:
                if last is None or last.blocks[0][0] != b[0] or len(last.blocks) >= BLOCKS:
                    last = Part(path, [])
                    out.append(last)
                last.blocks.append(b)
        return out or [Part("", [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with BigWig(part.path) as f:
            for _, _, _, offset, size in part.blocks:
                number, starts, ends, values = f.runs(offset, size)
                yield pa.RecordBatch.from_arrays([pa.array([f.chroms[number][0]] * len(starts)), pa.array(starts), pa.array(ends), pa.array(values)], names=["chrom", "start", "end", "value"])


class BigWigSource(DataSource):
    """Options: path (several by commas, patterns and folders allowed), regions (``chrom:start-end`` by commas, half-open, 0-based)."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start long, end long, value double"

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def _windows(centres: DataFrame, path: str, column: str, values) -> DataFrame:
    """centres with ``column``: values(file, chrom, at), computed where the centres lie after they were dealt by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with BigWig(path) as f:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):  # vectors are long
                    part = batch.slice(at, 512)
                    places = zip(part["chrom"].to_pylist(), part["at"].to_pylist(), strict=True)
                    made = pa.array([None if p is None else values(f, c, p) for c, p in places], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, column])

    rows = centres.drop(column).repartitionByRange("chrom", "at").sortWithinPartitions("chrom", "at")
    fields = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, {column} array<double>")


def window_vectors(centres: DataFrame, path: str, span: int = 500) -> DataFrame:
    """centres (chrom, at, ...) with ``features``: the signal from at - span up to at + span, gaps as 0.

    Only the blocks around the centres are read; no signal is shuffled. A chromosome that the file has not gives zeros."""
    return _windows(centres, path, "features", lambda f, c, p: f.vector(c, p - span, p + span))


def window_means(centres: DataFrame, path: str, span: int = 500, bins: int = 10, exact: bool = False) -> DataFrame:
    """centres with ``means``: the mean signal of ``bins`` parts of the window, NaN where there is none; by zoom levels unless ``exact``."""
    return _windows(centres, path, "means", lambda f, c, p: f.means(c, p - span, p + span, bins, exact))


def feature_vectors(signal, centres, span: int = 500):
    """centres (chrom, at) with ``features``: the signal at each position from at - span to at + span, gaps as 0.

    For a signal that is a table: its runs meet the windows in a binned overlap join; only overlapping pieces are exploded."""
    from ridgeline.operators.intervals import overlap_join

    windows = centres.withColumn("lo", F.col("at") - span).withColumn("hi", F.col("at") + span)
    pieces = overlap_join(signal.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "value"), windows, ["chrom"], 2 * span, ("s", "e"), ("lo", "hi"))
    pieces = pieces.select("chrom", "at", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"), "value", "lo")
    at = pieces.select("chrom", "at", F.explode(F.sequence(F.col("s") - F.col("lo"), F.col("e") - F.col("lo") - 1)).alias("pos"), F.nanvl("value", F.lit(0.0)).alias("value"))
    found = at.groupBy("chrom", "at").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    zeros = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))
    rows = centres.join(found, ["chrom", "at"], "left").withColumn("m", F.coalesce("m", zeros))
    fill = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2 * span - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.withColumn("features", fill).drop("m")
