"""A data source for BAM alignments: ``spark.read.format("bam").load(path)``, and its writer ``write_bam``.

Files are cut at block borders, and a partition starts at the first record that starts in its blocks: it finds
that record by trying positions until a chain of records reads well, so a whole file needs no index. A region
(filters on ``chrom``, ``start`` and ``end``, or the option ``regions``) is read through the binning index beside
the file, if there is one: partitions are then stretches of the file that may hold its records. ``index_bam``
makes missing indexes. A damaged or cut file raises an error, unless ``damaged`` is ``skip``: then reading goes
on at the next sound block and record.

Written alignments are a folder of complete BAM files in one order by position, each with its own index.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ridgeline.sources import bai, bgzf, files
from ridgeline.sources.regions import Wanted, batches, hits

SCHEMA = "file string, name string, flag int, chrom string, start long, end long, mapq int, cigar string, mate_chrom string, mate_start long, tlen long, nh int, cb string, ub string"
_SEQ = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
SPLIT_BYTES = 64 << 20


def header(uri: str) -> tuple[list[tuple[str, int]], int, int]:
    """(names and lengths of the references, offset of the block with the first record, place in it)."""
    with bgzf.Blocks(uri) as blocks:
        data, offset, starts = b"", 0, []

        def need(n: int) -> None:
            nonlocal data, offset
            while len(data) < n:
                got = blocks.block(offset)
                if got is None:
                    raise bgzf.Damaged(f"{uri} ends within its header")
                starts.append((len(data), offset))
                data += got[0]
                offset += got[1]

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{uri} is no BAM file")
        text = struct.unpack_from("<i", data, 4)[0]
        need(12 + text)
        count, at, refs = struct.unpack_from("<i", data, 8 + text)[0], 12 + text, []
        for _ in range(count):
            need(at + 4)
            size = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + size)
            refs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
            at += 8 + size
        if at == len(data):
            return refs, offset, 0
        place = next((s, o) for s, o in reversed(starts) if s <= at)
        return refs, place[1], at - place[0]


def head(refs: list[tuple[str, int]]) -> bytes:
    """A header's bytes."""
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in refs)
    out = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)


def _sound(data: bytes, at: int, n_refs: int) -> bool:
    """Could a record start here?"""
    if len(data) < at + 36:
        return False
    size, ref, pos, name, _, _, ops, _, seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    need = 32 + name + 4 * ops + (seq + 1) // 2 + seq
    if not (32 < need <= size < 1 << 24 and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name > 0 and seq >= 0):
        return False
    end = at + 36 + name - 1
    return end >= len(data) or (data[end] == 0 and all(33 <= c <= 126 for c in data[at + 36 : end]))


def _first_record(data: bytes, n_refs: int, chain: int = 5) -> int | None:
    """The first place from which ``chain`` records (or all to the data's end) read well."""
    for at in range(max(0, len(data) - 36)):
        here, good = at, 0
        while good < chain and _sound(data, here, n_refs):
            here += 4 + struct.unpack_from("<i", data, here)[0]
            good += 1
            if here + 36 > len(data):
                good = chain
        if good >= chain:
            return at
    return None


class Records:
    """Records from a place on: (virtual offset, offset behind, bytes after the size).

    ``found``: the place is a record's; otherwise it is a block's, and the first record that starts in it or
    later is looked for. ``skip``: damage is skipped in the same way instead of raised."""

    def __init__(self, blocks: bgzf.Blocks, n_refs: int, begin: int, found: bool, skip: bool = False):
        self.blocks, self.n_refs, self.skip = blocks, n_refs, skip
        self.offset, self.at, self.found = begin >> 16, begin & 0xFFFF, found
        self.data, self.starts = b"", []  # starts: (place in data, offset) of the blocks in data

    def _more(self) -> bool:
        """Appends a block; False at the file's end."""
        try:
            got = self.blocks.block(self.offset)
        except bgzf.Damaged:
            if not self.skip:
                raise
            self.offset = self.blocks.next_block(self.offset + 1, self.blocks.size)
            self.data, self.starts, self.at, self.found = b"", [], 0, False
            return self.offset < self.blocks.size and self._more()
        if got is None:
            return False
        self.starts.append((len(self.data), self.offset))
        self.data += got[0]
        self.offset += got[1]
        return True

    def _place(self, at: int) -> int:
        if at >= len(self.data):
            return self.offset << 16
        start, offset = next(x for x in reversed(self.starts) if x[0] <= at)
        return offset << 16 | at - start

    def _wanted(self, n: int) -> bool:
        """Are n bytes from the record's place there? Reads on; False if the file or (when skipping) sound data end before."""
        while len(self.data) < self.at + n:
            known = self.found
            if not self._more():
                if self.found and len(self.data) > self.at and not self.skip:
                    raise bgzf.Damaged(f"{self.blocks.uri} ends within a record")
                return False
            if known and not self.found:
                return False
        return True

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        while True:
            if not self.found:
                while (at := _first_record(self.data, self.n_refs)) is None:
                    if not self._more():
                        return
                self.at, self.found = at, True
            if not self._wanted(4) or not self._wanted(4 + (size := struct.unpack_from("<i", self.data, self.at)[0])):
                if self.found:
                    return
                continue
            if size < 32 or size >= 1 << 29:
                if not self.skip:
                    raise bgzf.Damaged(f"{self.blocks.uri}: no record at {self._place(self.at) >> 16}")
                self.found, self.data, self.starts, self.at = False, self.data[self.at + 1 :], [(0, self.offset)], 0
                continue
            end = self.at + 4 + size
            yield self._place(self.at), self._place(end), self.data[self.at + 4 : end]
            self.at = end
            if end > 1 << 20:
                cut = next(i for i in range(len(self.starts) - 1, -1, -1) if self.starts[i][0] <= end)
                drop = self.starts[cut][0]
                self.starts = [(s - drop, o) for s, o in self.starts[cut:]]
                self.data, self.at = self.data[drop:], end - drop


def _tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode("latin1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[tag] = data[at:end].decode("latin1")
            at = end + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        elif kind == "A":
            out[tag] = chr(data[at])
            at += 1
        else:
            out[tag] = struct.unpack_from(_CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return out


def span(raw: bytes) -> tuple[int, int, int]:
    """(reference, start, end) of a record; one without operations ends where it starts."""
    ref, pos, l_name, _, _, n_ops = struct.unpack_from("<iiBBHH", raw)
    ops = struct.unpack_from(f"<{n_ops}I", raw, 32 + l_name)
    return ref, pos, pos + sum(o >> 4 for o in ops if _SEQ[o & 15] in "MDN=X")


def parse_record(raw: bytes, refs: list[tuple[str, int]], file: str) -> tuple:
    """A row of SCHEMA; raw begins after the record's size."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    cigar = "".join(f"{o >> 4}{_SEQ[o & 15]}" for o in ops) or "*"
    reach = sum(o >> 4 for o in ops if _SEQ[o & 15] in "MDN=X")
    at += 4 * n_ops + (l_seq + 1) // 2 + l_seq
    tags = _tags(raw[at:])
    name = lambda i: refs[i][0] if i >= 0 else None
    number = tags.get("NH")
    return (file, raw[32 : 31 + l_name].decode("latin1"), flag, name(ref), pos if pos >= 0 else None, pos + reach if pos >= 0 else None, mapq, cigar, name(mate), mate_pos if mate_pos >= 0 else None, tlen, int(number) if number is not None else None, tags.get("CB"), tags.get("UB"))


def encoded(row: dict, ref_of: dict[str, int]) -> bytes:
    """A record's bytes (without its size) from the columns of SCHEMA, and ``seq`` if there is one; or its own from ``raw``."""
    if row.get("raw") is not None:
        return row["raw"][4:]
    name = (row["name"] or "*").encode("latin1") + b"\0"
    ops, number = [], ""
    for c in "" if row.get("cigar") in (None, "*") else row["cigar"]:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | _SEQ.index(c))
            number = ""
    seq = row.get("seq") or ""
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    start = -1 if row.get("start") is None else row["start"]
    reach = start + sum(o >> 4 for o in ops if _SEQ[o & 15] in "MDN=X")
    place = lambda c: -1 if row.get(c) is None else ref_of[row[c]]
    tags = b"".join(t + k + v for t, k, v in (
        (b"NH", b"i", None if row.get("nh") is None else struct.pack("<i", row["nh"])), *[(t, b"Z", None if row.get(c) is None else row[c].encode("latin1") + b"\0") for t, c in ((b"CB", "cb"), (b"UB", "ub"))],
    ) if v is not None)
    fixed = struct.pack(
        "<iiBBHHHiiii", place("chrom"), start, len(name), 255 if row.get("mapq") is None else row["mapq"], bai.bin_of(max(0, start), max(1, start + 1, reach)), len(ops), row.get("flag") or 0, len(seq),
        place("mate_chrom"), -1 if row.get("mate_start") is None else row["mate_start"], row.get("tlen") or 0,
    )
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    return fixed + name + struct.pack(f"<{len(ops)}I", *ops) + bases + b"\xff" * len(seq) + tags


def index_of(uri: str) -> bai.Index | None:
    """The index beside a file, if there is one."""
    for beside in (uri + ".bai", uri.removesuffix(".bam") + ".bai"):
        if files.size(beside) >= 0:
            return bai.Index.parse(files.read_all(beside))
    return None


@dataclass
class Part(InputPartition):
    """Blocks from ``start`` up to ``end``, or with ``chunks`` those stretches of virtual offsets."""

    path: str
    start: int
    end: int
    chunks: list[tuple[int, int]] = field(default_factory=list)


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = files.listed(options["path"], ".bam")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.skip = options.get("damaged", "fail") == "skip"
        self.indexed = options.get("index", "use") == "use"
        self.raw = "raw" in schema.fieldNames()
        self.wanted = Wanted(options.get("regions"))

    def pushFilters(self, filters):
        for f in filters:
            self.wanted.push(f)
            yield f

    def partitions(self):
        out = []
        for path in self.paths:
            refs, first, _ = header(path)
            with bgzf.Blocks(path) as blocks:
                if not self.skip and not blocks.whole():
                    raise bgzf.Damaged(f"{path} has no end-of-file block: it is cut short")
                size = blocks.size
            within = self.wanted.within(refs)
            index = index_of(path) if self.indexed and within is not None else None
            if index:
                chunks = bai.joined(c for ref, cut in within.items() for lo, hi in cut for c in index.chunks(ref, lo, hi))
                held: list[tuple[int, int]] = []
                for c in chunks:  # a long chunk isn't cut: records can be entered where it starts only
                    held.append(c)
                    if sum((b >> 16) - (a >> 16) for a, b in held) >= self.split:
                        out.append(Part(path, 0, 0, held))
                        held = []
                out += [Part(path, 0, 0, held)] if held else []
            elif within is None or within:
                cuts = [first, *range(first + self.split, size, self.split), size]
                out += [Part(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.split(", ") + ["raw binary"] * self.raw
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        yield from batches(self.rows(part), pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names]))

    def rows(self, part: Part, blocks: bgzf.Blocks | None = None) -> Iterator[tuple]:
        if not part.path:
            return
        refs, first, place = header(part.path)
        within = self.wanted.within(refs)
        with blocks or bgzf.Blocks(part.path) as blocks:
            for _, _, raw in placed(blocks, len(refs), part, first << 16 | place, self.skip, within):
                row = parse_record(raw, refs, part.path)
                yield (*row, struct.pack("<i", len(raw)) + raw) if self.raw else row


def placed(blocks: bgzf.Blocks, n_refs: int, part: Part, first: int, skip: bool, within: dict[int, list[tuple[int, int]]] | None) -> Iterator[tuple[int, int, bytes]]:
    """The records of a part that lie in the stretches asked for, with their virtual offsets."""

    def hit(raw: bytes) -> bool:
        ref, start, end = span(raw)
        return ref in within and hits(within[ref], start, end)

    for begin, stop in part.chunks:
        for a, b, raw in Records(blocks, n_refs, begin, True, skip):
            if a >= stop:
                break
            if hit(raw):
                yield a, b, raw
            elif (ref_pos := struct.unpack_from("<ii", raw)) and ref_pos[0] in within and ref_pos[1] >= within[ref_pos[0]][-1][1] and ref_pos[0] == max(within):
                return  # sorted, and behind all that is asked for
    if not part.chunks:
        start = first if part.start == first >> 16 else blocks.next_block(part.start, part.end) << 16
        if start >> 16 < part.end:
            for a, b, raw in Records(blocks, n_refs, start, start == first, skip):
                if a >> 16 >= part.end:
                    return
                if within is None or hit(raw):
                    yield a, b, raw


def index_bam(spark: SparkSession, path: str, rebuild: bool = False) -> list[str]:
    """Writes the index beside each file that has none (or all, with ``rebuild``); returns those files.

    Files are scanned in parallel. An index has at most 37,449 bins and 32,768 windows a reference, and a chunk for some
    blocks of a bin; the driver writes it from rows that it streams."""
    done = []
    for uri in files.listed(path, ".bam"):
        if not rebuild and index_of(uri):
            continue
        refs, first, place = header(uri)
        reader = BamReader({"path": uri}, _Names(()))
        parts = spark.createDataFrame([(i, p.start, p.end) for i, p in enumerate(reader.partitions())], "part int, start long, end long")

        def scan(frames, uri=uri, n=len(refs), first=first << 16 | place):
            import pandas as pd

            for frame in frames:
                for part in frame.itertuples():
                    build, rows, begun, unplaced = bai.Builder(), [], None, False
                    with bgzf.Blocks(uri) as blocks:
                        for a, b, raw in placed(blocks, n, Part(uri, part.start, part.end), first, False, None):
                            ref, lo, hi = span(raw)
                            if ref < 0:
                                unplaced = True
                                continue
                            if unplaced:
                                raise ValueError(f"{uri}: records without a place must come last")
                            begun = begun or (ref, lo)
                            rows += build.add(ref, lo, max(hi, lo + 1), a, b)
                    rows += build.rows()
                    rows += [(-1, part.part, begun[0] << 32 | begun[1], build.last[0] << 32 | build.last[1])] if begun else []
                    yield pd.DataFrame(rows, columns=["ref", "bin", "a", "b"])

        found = parts.repartition(max(1, parts.count()), "part").mapInPandas(scan, "ref int, bin int, a long, b long")
        rows, bounds = [], []
        for r in found.toLocalIterator():
            (bounds if r["ref"] < 0 else rows).append(tuple(r))
        bounds.sort(key=lambda r: r[1])
        if any(x[3] > y[2] for x, y in zip(bounds, bounds[1:], strict=False)):
            raise ValueError(f"{uri} isn't sorted by position, so it can't be indexed")
        files.write_all(uri + ".bai", b"".join(bai.assembled(rows, len(refs)).dump()))
        done.append(uri)
    return done


class _Names(tuple):
    def fieldNames(self):  # noqa: N802  (Spark's name)
        return list(self)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    first: tuple
    last: tuple


class BamWriter(DataSourceArrowWriter):
    """Each task writes a complete file and its index under ``_temporary``; the commit moves them, if the tasks' ranges are in order."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.refs = [(n, int(size)) for n, _, size in (x.rpartition(":") for x in options["references"].split(",") if x)]
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context, ref_of = TaskContext.get(), {n: i for i, (n, _) in enumerate(self.refs)}
        part = context.partitionId()
        file = f"part-{part:05d}-{context.taskAttemptId()}.bam"
        system, folder = files.store(self.temporary)
        out, build, rows, first, last = None, bai.Builder(), [], (), ()
        for batch in iterator:
            for row in batch.to_pylist():
                raw = encoded(row, ref_of)
                ref, lo, hi = span(raw)
                if out is None:
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(f"{folder}/{file}")
                    out = bgzf.Writer(stream)
                    out.write(head(self.refs))
                    out.flush()
                key = (ref if ref >= 0 else len(self.refs), lo)
                if last and key < last:
                    raise ValueError("rows must come sorted by reference and start: use write_bam")
                first, last, begin = first or key, key, out.at
                out.write(struct.pack("<i", len(raw)) + raw)
                if ref >= 0:
                    rows += build.add(ref, lo, max(hi, lo + 1), begin, out.at)
        if out is not None:
            out.close()
            stream.close()
            rows += build.rows()
            files.write_all(f"{self.temporary}/{file}.bai", b"".join(bai.assembled(rows, len(self.refs)).dump()))
        return Written(part, file if out is not None else "", first, last)

    def commit(self, messages) -> None:
        wrote = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part)
        if any(a.last > b.first for a, b in zip(wrote, wrote[1:], strict=False)):
            self.abort(messages)
            raise ValueError("the tasks' ranges aren't in order: use write_bam")
        system, path = files.store(self.path)
        _, temporary = files.store(self.temporary)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in files.listed(self.path, ".bam") + files.listed(self.path, ".bai"):
                system.delete_file(files.store(old)[1])
        run = self.temporary.rsplit("-", 1)[1][:8]
        for m in wrote:
            name = f"part-{m.part:05d}-{run}.bam"
            for suffix in (".bai", ""):  # the index first, so that no file is without one
                system.move(f"{temporary}/{m.file}{suffix}", f"{path}/{name}{suffix}")
        if not wrote:
            empty = pa.BufferOutputStream()
            out = bgzf.Writer(empty)
            out.write(head(self.refs))
            out.close()
            files.write_all(f"{self.path}/part-00000-{run}.bam", empty.getvalue().to_pybytes())
        self._cleared()

    def abort(self, messages) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, temporary = files.store(self.temporary)
        if system.get_file_info(temporary).type.name == "Directory":
            system.delete_dir(temporary)


class BamSource(DataSource):
    """Options: path (several by commas, patterns and folders allowed), split_bytes, regions (``chrom:start-end`` by commas, half-open,
    0-based), index (``use`` or ``none``), damaged (``fail`` or ``skip``), raw (``true``: also each record's bytes, as a last column).
    For writing: path (a folder) and references (``name:length`` by commas)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA + (", raw binary" if self.options.get("raw", "false").lower() == "true" else "")

    def reader(self, schema) -> BamReader:
        return BamReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def write_bam(df: DataFrame, path: str, references: list[tuple[str, int]], parts: int | None = None, mode: str = "append") -> None:
    """Writes rows (columns of SCHEMA, all but ``name`` optional, ``seq``; or ``raw``) as sorted BAM files with indexes.

    Ranges of positions are dealt by sampling, so a crowded place doesn't make a long task; unplaced rows come last."""
    from pyspark.sql import functions as F

    known = {c for c in ("name", "flag", "chrom", "start", "mapq", "cigar", "mate_chrom", "mate_start", "tlen", "nh", "cb", "ub", "seq", "raw") if c in df.columns}
    place = F.array_position(F.array(*[F.lit(n) for n, _ in references]).cast("array<string>"), F.col("chrom"))
    unknown = F.raise_error(F.concat(F.lit("no such reference: "), F.col("chrom")))
    order = F.when(F.col("chrom").isNull(), len(references) + 1).when(place == 0, unknown.cast("long")).otherwise(place)
    rows = df.withColumn("_ref", order.cast("long")).withColumn("_start", F.coalesce(F.col("start"), F.lit(-1)).cast("long"))
    keys = ["_ref", "_start", "name"]
    rows = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    rows.select(*sorted(known)).write.format("bam").option("references", ",".join(f"{n}:{size}" for n, size in references)).mode(mode).save(path)


def subset(spark: SparkSession, path: str, names: DataFrame, out: str, mode: str = "append") -> None:
    """Writes the whole records of ``path`` whose name is in ``names`` (column ``name``), byte for byte."""
    first = files.listed(path, ".bam")[0]
    rows = spark.read.format("bam").option("raw", "true").load(path).join(names.select("name"), "name", "left_semi")
    write_bam(rows.select("name", "chrom", "start", "raw"), out, header(first)[0], mode=mode)


def same_prefix(chrom, like: str | None):
    """A chromosome column with or without ``chr``, as the name ``like`` has it."""
    from pyspark.sql import functions as F

    plain = F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1000)).otherwise(chrom)
    return F.concat(F.lit("chr"), plain) if like and like.startswith("chr") else plain
