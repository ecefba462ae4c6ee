"""Document fingerprints by randomised edit embedding: edit distance becomes Hamming distance.

``WALKS`` shared random walks read a text: at each step a walk emits its character, and a bit that depends on
the step and the character says whether it moves on. Walks over two texts emit the same as long as the texts are
the same, and tend to fall into step again behind an edit. A fingerprint keeps ``SLOTS`` symbols of four bits, each
from one step of one walk. A slot's step is the last of its own fixed series of steps (each a random multiple of
the one before) that the walk reaches; for two texts of any lengths it is the same step with a probability of
the ratio of their walks' lengths, so the share of equal slots estimates likeness, less what chance makes equal.

Near documents are found by bands (samples of ``BAND`` slots of one walk). Those that share a band with the least
document of it are verified by exact edit distance, what remains of the band gets its next least document, and so on:
the work is linear in the band, no pair within it is emitted, and equal fingerprints and texts come once.

A text's successor (the document of the next lower id; the highest after the lowest) is met by moving the texts
once, to ranges of ids; of each range the highest id's text is also sent to the next one. An id that has
more rows than a range holds is dealt over several tasks, each of which gets the one text that follows it.

Edge cases: a null text is empty; the empty text's fingerprint is all ``-``, alike only to itself; texts under three
characters are edited in no place; very long texts are walked whole; a null id comes after all others; rows of one
id have the same successor, of several rows of an id the one with the least text (by UTF-8) is the successor;
one single id is its own successor; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import documents, drop, kept, mix, slices, text_bytes

WALKS, SLOTS = 4, 256
#: Slots of a band, and in how many places texts may differ (a share of the longer one) to be near.
BAND, NEAR = 8, 0.1
#: Steps after which a walk's bits begin anew; its phases fit a byte, its tables a processor's cache.
PERIOD = 1 << 8
#: The share of slots that are equal in unlike texts: by the four bits, and by common characters.
CHANCE = 0.14
#: Texts of an id range, and of one call of the walks. There are at most RANGES ranges; they are streamed, whatever their size.
RANGE_BYTES, WALK_BYTES, RANGES = 32 << 20, 6 << 20, 1 << 16
#: Below so many texts, they are walked one after the other instead of side by side.
FEW = 24
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@dataclass
class Tables:
    phase: np.ndarray  # (walk, character class, phase) -> the phase (steps modulo PERIOD) when the walk has left the character
    steps: np.ndarray  # (slot, i) -> the slot's series of steps, rising
    symbol: np.ndarray  # (slot, character class) -> 4 bits


@cache
def tables() -> Tables:
    n = WALKS * 256 * PERIOD
    moves = (mix(mix(np.arange(n, dtype=np.uint64)) + np.uint64(17)) >> np.uint64(40)).reshape(-1, PERIOD) & np.uint64(1)
    phase, leave = np.zeros(moves.shape, np.int64), np.zeros(len(moves), np.int64)
    for _ in range(2):  # twice round, for what the last phases wait for
        for step in range(PERIOD - 1, -1, -1):
            leave = np.where(moves[:, step] == 1, (step + 1) % PERIOD, leave)
            phase[:, step] = leave
    series = [np.ones(SLOTS)]
    for i in range(64):
        u = (mix(mix(np.arange(SLOTS, dtype=np.uint64) * np.uint64(977) + np.uint64(i))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        series.append(np.minimum(np.floor(series[-1] / np.maximum(u, 1e-9)) + 1, 1 << 50))
    symbol = (mix(mix(np.arange(SLOTS * 256, dtype=np.uint64) + np.uint64(1 << 40))) >> np.uint64(33)).astype(np.uint8) & 15
    return Tables(phase.reshape(-1), np.stack(series, 1).astype(np.int64), symbol.reshape(SLOTS, 256))


def classes(text: str) -> np.ndarray:
    """A character class of one byte for each code point; below 256 the code point itself."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points ^ (points >> 8) * 167) & 255).astype(np.uint8)


def _steps(phases: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Steps taken behind each character, from the phases there (along the first axis) and the steps taken before the first."""
    first = (before & (PERIOD - 1)).astype(phases.dtype)[None]
    return before[None] + np.cumsum(np.diff(phases, axis=0, prepend=first) & (PERIOD - 1), axis=0, dtype=np.int64)


def _alone(text: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
    table = tables().phase.reshape(WALKS, 256, PERIOD)
    for w in range(WALKS):
        rows, taken = [table[w, c].astype(np.uint8).tobytes() for c in range(256)], before[w : w + 1].astype(np.int64)
        for cut in range(0, len(text), 1 << 16):
            at = int(taken[-1]) % PERIOD
            phases = bytes([at := rows[c][at] for c in text[cut : cut + (1 << 16)].tobytes()])
            taken = _steps(np.frombuffer(phases, np.uint8).astype(np.int64), taken[-1])
            out[w, cut : cut + len(taken)] = taken


def walked(texts: list[np.ndarray], starts: np.ndarray, chunk: int = 256) -> list[np.ndarray]:
    """For each text (walk, character) -> steps taken when the walk leaves that character; starts: (text, walk), the steps taken before.

    Texts are walked side by side, a character of each at a time: all that a step of this loop does is to look up the next phases."""
    out = [np.empty((WALKS, len(x)), np.int64 if len(x) > 1 << 28 else np.uint32) for x in texts]
    alive, done = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i])), 0
    taken = starts.astype(np.int64)
    base = (np.arange(WALKS, dtype=np.int64) * 256 * PERIOD)[:, None]
    while len(alive) > FEW:
        size = min(chunk, len(texts[alive[0]]) - done)
        block = np.zeros((size, len(alive)), np.int64)
        for j, i in enumerate(alive):
            part = texts[i][done : done + size]
            block[: len(part), j] = part
        block = block[:, None, :] * PERIOD + base
        phases, now, at = np.empty(block.shape, np.int64), np.ascontiguousarray(taken[alive].T % PERIOD), np.empty(block.shape[1:], np.int64)
        table = tables().phase
        for t in range(size):
            np.add(now, block[t], out=at)
            now = table.take(at, out=phases[t], mode="clip")
        steps = _steps(phases, taken[alive].T)
        for j, i in enumerate(alive):
            part = min(size, len(texts[i]) - done)
            out[i][:, done : done + part] = steps[:part, :, j].T
            taken[i] = steps[part - 1, :, j]
        done += size
        alive = [i for i in alive if len(texts[i]) > done]
    for i in alive:
        _alone(texts[i][done:], taken[i], out[i][:, done:])
    return out


def printed(text: np.ndarray, left: np.ndarray) -> str:
    """The fingerprint of one walked text."""
    if not len(text):
        return "-" * SLOTS
    t, per = tables(), SLOTS // WALKS
    out = np.empty(SLOTS, np.uint8)
    for w in range(WALKS):
        slots = slice(w * per, (w + 1) * per)
        series = t.steps[slots]
        step = series[np.arange(per), (series <= int(left[w, -1])).sum(1) - 1]
        place = np.searchsorted(left[w], step.astype(left.dtype))
        out[slots] = t.symbol[np.arange(w * per, (w + 1) * per), text[place]]
    return _HEX[out].tobytes().decode()


def prints(texts: list[str]) -> list[str]:
    """The fingerprints of texts."""
    known = [classes(x) for x in texts]
    return [printed(x, left) for x, left in zip(known, walked(known, np.zeros((len(known), WALKS), np.int64)), strict=True)]


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal slots beyond chance."""
    if a == b:
        return 1.0
    if "-" in (a[:1], b[:1]):
        return 0.0
    same = float((np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)).mean())
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def bands(a: str) -> list[str]:
    """Samples of the fingerprint, each of one walk's slots; texts that share one are candidates."""
    return [a[i : i + BAND] for i in range(0, SLOTS, BAND)]


def edited(text: str, following: str) -> tuple[int, str]:
    """(characters kept, the ones put after them): the last third gives way to as many of the following text."""
    third = len(text) // 3
    return len(text) - third, following[:third]


def edit_distance(a: str, b: str) -> int:
    """Exact, a bit a character of ``a`` in one long integer."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        h = (((x & up) + up) ^ up) | x
        pos, neg = down | (~(h | up) & every), up & h
        score += bool(pos & top) - bool(neg & top)
        pos, neg = (pos << 1 | 1) & every, neg << 1 & every
        up, down = neg | (~(x | pos) & every), pos & x
    return score


# --- the successor of each document ------------------------------------------------------------------------


@dataclass
class Ranges:
    """Ranges of ids, ascending: where they are cut, how many tasks share each, and which ids' texts each also gets."""

    bounds: np.ndarray  # range of an id: how many bounds are at or below it, plus one; null ids are range 0
    first: np.ndarray  # range -> its first task
    tasks: np.ndarray  # range -> its number of tasks
    sent: dict[int | None, list[int]]  # id -> tasks that get its least text as well

    def of(self, ids: pa.Array) -> np.ndarray:
        known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(self.bounds, known, "right"))

    @property
    def n(self) -> int:
        return int(self.tasks.sum())


def ranges(ids: DataFrame, rows: int, size: int) -> Ranges:
    """ids: one column ``id``. Cuts them into ranges of about RANGE_BYTES; at most 3 * RANGES numbers come to the driver."""
    parts = max(2, min(RANGES, -(-size // RANGE_BYTES)))
    most = max(1, rows // parts)
    steps = [i / parts for i in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("id", steps, max(10_000, 4 * parts))).first()[0] or []
    hot = {r["id"]: r["n"] for r in ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()}  # fewer than ``parts``
    bounds = np.array(sorted({*cuts, *[h + d for h in hot if h is not None for d in (0, 1)]}), np.int64)
    plain = Ranges(bounds, np.zeros(0), np.zeros(0), {})

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = plain.of(batch.column(0)), batch.column(0)
            table = pa.table({"range": at.astype(np.int64), "high": found}).group_by("range").aggregate([("high", "max")])
            yield from table.rename_columns(["range", "high"]).to_batches()

    heads = {r["range"]: r["high"] for r in ids.mapInArrow(highest, "range long, high long").groupBy("range").agg(F.max("high").alias("high")).collect()}
    tasks = np.zeros(len(bounds) + 2, np.int64)
    for at in heads:
        tasks[at] = 1
    for h, n in hot.items():
        tasks[0 if h is None else 1 + int(np.searchsorted(bounds, h, "right"))] = -(-n // most)
    first, sent, there = np.concatenate([[0], np.cumsum(tasks)[:-1]]), {}, sorted(heads)
    for at, before in zip(there, [*there[-1:], *there[:-1]], strict=True):
        sent.setdefault(heads[before], []).extend(range(first[at], first[at] + tasks[at]))
    return Ranges(bounds, first, tasks, sent)


def _dealt(plan: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int | None, str] = {}
        asked, at = pa.array(list(plan.sent), pa.int64()), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            place = plan.of(ids)
            task = plan.first[place] + (at + np.arange(len(place))) % np.maximum(plan.tasks[place], 1)
            at += len(place)
            hit = pc.indices_nonzero(pc.is_in(ids, value_set=asked, skip_nulls=False))
            for i, t in zip(ids.take(hit).to_pylist(), texts.take(hit).to_pylist(), strict=True):
                if i not in least or t.encode("utf-8", "surrogatepass") < least[i].encode("utf-8", "surrogatepass"):
                    least[i] = t
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(np.zeros(len(task), np.int8)), ids, texts], names=["task", "own", "id", "text"])
        for i, t in least.items():
            for task in plan.sent[i]:
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([-1], pa.int8()), pa.array([i], pa.int64()), pa.array([t], pa.string())], names=["task", "own", "id", "text"])

    return run


def beside_successors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """task, own, id, text, in partitions by ``task`` sorted by (own, id, text): rows of id ranges (own is 0), before
    them the text that follows the range's lowest id (own is -1; the first such row counts)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, size = text_bytes(docs)
    plan = ranges(docs.select("id"), rows, size)
    return docs.mapInArrow(_dealt(plan), "task long, own byte, id long, text string").repartitionById(max(1, plan.n), F.col("task").cast("int")).sortWithinPartitions("task", "own", "id", "text")


class Successors:
    """Goes through such a partition; what it keeps is one text and its fingerprint for two ids."""

    def __init__(self):
        self.id, self.mine, self.following, self.begun = None, None, None, False

    def take(self, own: int, i: int | None, text: str, fingerprint: str) -> tuple[str, str] | None:
        """The following text and its fingerprint, for a row of the partition's own."""
        if own < 0:
            self.following = self.following or (text, fingerprint)
            return None
        if not self.begun or i != self.id:
            self.following = self.mine if self.begun else self.following
            self.id, self.mine, self.begun = i, (text, fingerprint), True
        return self.following


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    on, kind = Successors(), pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]]) for c in COLUMNS.split(", ")])
    for batch in batches:
        for part in slices(batch, WALK_BYTES):
            own, ids, texts = (c.to_pylist() for c in part.columns)
            known = [classes(x) for x in texts]
            left = walked(known, np.zeros((len(known), WALKS), np.int64))
            found = [printed(x, y) for x, y in zip(known, left, strict=True)]
            rows = [(j, to) for j, x in enumerate(zip(own, ids, texts, found, strict=True)) if (to := on.take(*x))]
            cuts = [edited(texts[j], to[0]) for j, to in rows]
            tails = [classes(t) for _, t in cuts]
            starts = np.array([left[j][:, n - 1] if n else [0] * WALKS for (j, _), (n, _) in zip(rows, cuts, strict=True)], np.int64).reshape(-1, WALKS)
            out = []
            for (j, to), (n, tail), more, then in zip(rows, cuts, tails, walked(tails, starts), strict=True):
                again = printed(np.concatenate([known[j][:n], more]), np.concatenate([left[j][:, :n], then], 1))
                digest = hashlib.sha256((texts[j][:n] + tail).encode("utf-8", "surrogatepass")).hexdigest()
                shared = sum(a == b for a, b in zip(bands(found[j]), bands(again), strict=True))
                out.append((ids[j], len(texts[j]), digest, found[j], again, likeness(found[j], again), likeness(found[j], to[1]), shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_successors(documents(spark, sf_dir, "doc_id", "text")).select("own", "id", "text").mapInArrow(_compared, COLUMNS)


# --- near documents ---------------------------------------------------------------------------------------


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, fingerprint; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, WALK_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints(part.column(1).to_pylist()))], names=["id", "text", "fingerprint"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "id long, text string, fingerprint string")


def near_links(df: DataFrame, most: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, near, edits: documents that share a band and differ in at most ``most`` of the longer text's characters.

    Of equal texts only the least id takes part. Each band's least document is compared with all others of the
    band; those that aren't near to it stay in the band for the next round, until no band holds two. So of a band's near
    pairs a spanning set comes out, never all of them. Rows without an id aren't compared."""
    docs = fingerprinted(df.filter(F.col(id_col).isNotNull()), id_col, text_col).filter("text <> ''")
    docs = kept(docs.groupBy("text", "fingerprint").agg(F.min("id").alias("id")).groupBy("id").agg(F.min_by("text", "text").alias("text"), F.min_by("fingerprint", "text").alias("fingerprint")), "fingerprints")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda i: F.struct(i.alias("band"), F.substring(F.col("fingerprint"), i * BAND + 1, F.lit(BAND)).alias("key"))))
    open_, found = kept(docs.select("id", at.alias("x")).select("id", "x.band", "x.key"), "bands"), None

    @F.pandas_udf("long")
    def edits(a, b):
        import pandas as pd

        return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    while True:
        leads = open_.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        asked = kept(open_.join(leads, ["band", "key"]).filter("id > lead"), "asked")
        if asked.isEmpty():
            break
        pairs = asked.select("id", "lead").distinct()
        pairs = pairs.join(docs.select("id", F.col("text").alias("a")), "id").join(docs.select(F.col("id").alias("lead"), F.col("text").alias("b")), "lead")
        close = kept(pairs.select("id", F.col("lead").alias("near"), edits("a", "b").alias("edits"), F.greatest(F.length("a"), F.length("b")).alias("n")).filter(F.col("edits") <= most * F.col("n")).drop("n"), "near")
        found = close if found is None else found.unionByName(close)
        rest = kept(asked.join(close.select("id", F.col("near").alias("lead")), ["id", "lead"], "left_anti").drop("lead"), "bands")
        drop(open_)
        drop(asked)
        open_ = rest
    empty = docs.select("id", F.col("id").alias("near"), F.lit(0).cast("long").alias("edits")).limit(0)
    return empty if found is None else found.distinct()
