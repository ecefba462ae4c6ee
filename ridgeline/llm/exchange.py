"""Sums over a keyed corpus, asked for by blocks of documents and answered by ranges of keys.

A block of documents has a sorted list of distinct keys (hashes) with counts. The sums over all
blocks come back to every block in the order of its question. Keys travel packed in arrays, one
packet for each block and range. So that packets stay as large however many blocks there are, the
exchange takes levels: on each, a block's keys are cut into at most 2 ** BITS ranges, and what 2 ** BITS
blocks hold of one range is merged into a block of the next level. There are as many leaves as
partitions of documents, so a leaf holds about a partition's keys; the packets are proportional to
the corpus times its levels (one up to 2 ** BITS partitions, two up to their square).

Nothing is collected or broadcast, every level is stored in the shared folder, and keys are hashes,
so no range is hot. Edge cases: blocks without keys send and get nothing; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.blocks import drop, kept

#: Ranges that a block's keys are cut into on one level, as a power of two.
BITS = 7
PACKETS = "block long, path long, sub int, keys binary, counts binary"


def levels(parts: int, total: int = 64) -> list[int]:
    """Bits of each level, for about as many leaves as ``parts``; at most ``total`` in all."""
    bits = min(total, max(0, math.ceil(math.log2(max(1, parts)))))
    n = max(1, math.ceil(bits / BITS))
    return [bits // n + (i < bits % n) for i in range(n)]


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising numbers as their steps, in as many bytes each as the largest needs. The bytes lie by place: all lowest ones first, so that few
    of the high ones cost anything."""
    steps = np.diff(x, prepend=x.dtype.type(0)).astype("<u8")
    wide = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return b"%d" % wide + pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T))


def unpack_sorted(blob: bytes) -> np.ndarray:
    wide = int(blob[:1])
    planes = unpack(blob[1:], np.uint8).reshape(wide, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :wide] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and the place of each given key among them."""
    every = np.concatenate([np.zeros(0, np.uint64), *keys])
    if not len(every):
        return every, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")  # of runs in order
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return every[new], np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(new)), place


def dealt(values: np.ndarray, keys: list[np.ndarray]) -> pa.Array:
    """Values of the concatenated keys, packed for each packet."""
    return pa.array([pack(v) for v in np.split(values, np.cumsum([len(k) for k in keys])[:-1])] if keys else [], pa.binary())


def packets(block: int, path: int, keys: np.ndarray, counts: np.ndarray, key_bits: int, used: int, bits: int) -> Iterator[dict]:
    """The rows that a block sends: its keys (below 2 ** key_bits, all beginning with ``path`` in their first ``used`` bits) by range."""
    below = np.uint64(key_bits - used - bits)
    sub = ((keys >> below) & np.uint64((1 << bits) - 1)).astype(np.int64)
    found, first = np.unique(sub, return_index=True)
    for r, k, c in zip(found.tolist(), np.split(keys, first[1:]), np.split(counts, first[1:]), strict=False):
        yield {"block": block, "path": path, "sub": r, "keys": pack_sorted(k), "counts": pack(c.astype(np.int64))}


def batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "path": pa.int64(), "sub": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def opened(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpack_sorted(k) for k in table["keys"].to_pylist()], [unpack(c, np.int64) for c in table["counts"].to_pylist()]


def _group(bits: int) -> list:
    """The block and range of the next level that a packet goes to."""
    return [F.shiftright("block", bits).alias("_block"), F.shiftleft("path", bits).bitwiseOR(F.col("sub").cast("long")).alias("_path")]


def leaf(bits: int) -> list:
    """The grouping that makes the last level's leaves."""
    return _group(bits)[1:]


def _merge(key_bits: int, used: int, bits: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        block, path = (k.as_py() for k in key)
        return pa.Table.from_batches([batch(list(packets(block, path, *merged(*opened(table))[:2], key_bits, used, bits)))])

    return merge


def raised(requests: DataFrame, bits: list[int], key_bits: int) -> list[DataFrame]:
    """The packets of every level; the first are the requests, which are stored already."""
    tables = [requests]
    for at in range(len(bits) - 1):
        merge = _merge(key_bits, sum(bits[: at + 1]), bits[at + 1])
        tables.append(kept(tables[-1].groupBy(*_group(bits[at])).applyInArrow(merge, PACKETS), "level"))
    return tables


def summed(table: pa.Table) -> pa.Table:
    """A leaf's answers: sums of counts. In the first row also the leaf's distinct keys with a count and their sum."""
    keys, counts = opened(table)
    _, sums, place = merged(keys, counts)
    one = [i == 0 for i in range(len(keys))]
    return pa.table({
        **{c: table[c] for c in ("block", "path", "sub")}, "values": dealt(sums[place], keys),
        "distinct": pa.array([int((sums > 0).sum()) * x for x in one], pa.int64()), "total": pa.array([int(sums.sum()) * x for x in one], pa.int64()),
    })


SUMMED = "block long, path long, sub int, values binary, distinct long, total long"


def sums(tables: list[DataFrame], bits: list[int]) -> DataFrame:
    """The last level's answers, stored: see ``summed``."""
    return kept(tables[-1].groupBy(*leaf(bits[-1])).applyInArrow(summed, SUMMED), "sums")


#: Answers in the order of a packet's keys; with the keys, for who can't make them anew.
BARE, ANSWERS = "block long, path long, sub int, values binary", "block long, path long, sub int, keys binary, values binary"


def _reply(kind: type, columns: tuple[str, ...]):
    def reply(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, counts = opened(table)
        _, _, place = merged(keys, counts)
        parts = sorted(zip(answers["sub"].to_pylist(), answers["values"].to_pylist(), strict=True))
        values = np.concatenate([np.zeros(0, kind), *[unpack(v, kind) for _, v in parts]])
        return pa.table({**{c: table[c] for c in columns}, "values": dealt(values[place], keys)})

    return reply


def lowered(tables: list[DataFrame], bits: list[int], answers: DataFrame, kind: type, keyed: bool = False) -> DataFrame:
    """block, sub, values (keyed: and keys) for every request, stored, from the last level's answers (as BARE; as ANSWERS if keyed), which are
    dropped, like the levels between. Keys are as large as the requests, and don't travel back where they aren't asked for."""
    for at in range(len(bits) - 2, -1, -1):
        last = answers
        asked = tables[at].groupBy(*_group(bits[at]))
        replies = asked.cogroup(last.select("block", "path", "sub", "values").groupBy(F.col("block").alias("_block"), F.col("path").alias("_path")))
        with_keys = keyed and at == 0
        answers = kept(replies.applyInArrow(_reply(kind, ("block", "path", "sub", "keys")[: 3 + with_keys]), ANSWERS if with_keys else BARE), "answers")
        drop(last)
        drop(tables[at + 1])
    return answers.select("block", "sub", *["keys"] * keyed, "values")
