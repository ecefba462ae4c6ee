"""Conversation structure repair: the cheapest edits that make a conversation ``(system? (user assistant)+)?``.

Edits are arcs of a small weighted automaton over four places in that pattern (``PLACES``). It is determinised
lazily: what a suffix of a conversation costs from each place, less the least of them, is one state of the
deterministic automaton, and what a further row in front does to it is looked up in a table that is filled on
first use. A scan of that table from the last row to the first gives the cost. The trace runs the other way, against
the scan: in each place it takes the ASCII-least of the arcs that are tight (whose cost is what the scan says is
left), so of the cheapest audits the least one is found without comparing strings.

A conversation of up to ``ROWS`` rows and ``BYTES`` of text is repaired in the stream of a sorted partition. Larger
ones are cut into blocks by their turns: blocks are scanned in parallel, each for every state that can
follow it (there are few), the states at the cuts follow from a row per block, and a last pass streams the
rows in order with the state behind each of them. That pass is one task per conversation, because the digest of the
repaired text is a sequential hash; it holds one row at a time.

Edge cases: a null id is a conversation of its own; null roles and texts are one space (no role of the pattern,
and blank); null turns come first; rows of one turn are ordered by role and digest of text; whole repeated rows
are duplicates; very long texts are streamed; a conversation without rows has zeros, an empty audit and the digest of
the empty string; an empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import drop, kept, slices

#: A conversation beyond either is cut into blocks.
ROWS, BYTES = 100_000, 64 << 20
#: At most so many blocks for one conversation: its audit, a character a row, is one value of at most 2 ** 31 bytes.
BLOCKS = 4096
BLANKS = " \t\n\x0b\x0c\r"
#: nothing yet, after system, after user, after assistant; a conversation may end in the first and last.
PLACES = 4
_NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: the role that can be inserted or reroled to in each place, as an index of ROLES.
_WANTED = (1, 1, 2, 1)
ROLES = ("system", "user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's symbol: its role's place in ROLES (3: another role), plus 4 if truncated; GONE if it must be deleted.
GONE, SYMBOLS = 8, 9
FAR = 1 << 20


class Repairs:
    """The deterministic automaton, grown as it is used."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._known: dict[tuple[int, ...], int] = {}
        self._moves: dict[int, tuple[int, int]] = {}
        self._arcs: dict[tuple[int, int, int], tuple[str, int, int]] = {}
        self.end, _ = self._state(self._inserted([0, FAR, FAR, 0]))

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        for _ in range(PLACES - 1):
            costs = [min(c, INSERT + costs[_NEXT[q, _WANTED[q]]]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self._known:
            self._known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._known[vector], least

    @staticmethod
    def _edits(q: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next place) of the arcs that use up a row, in ASCII order."""
        yield "D", DELETE, q
        if symbol < GONE:
            late = TRUNCATED * (symbol >= 4)
            if (q, symbol % 4) in _NEXT:
                yield "K", late, _NEXT[q, symbol % 4]
            yield "R", REROLE + late, _NEXT[q, _WANTED[q]]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """With a row in front of a suffix in that state: the new state, and what its least cost grows by."""
        key = state * SYMBOLS + symbol
        if key not in self._moves:
            after = self.vectors[state]
            self._moves[key] = self._state(self._inserted([min(cost + after[to] for _, cost, to in self._edits(q, symbol)) for q in range(PLACES)]))
        return self._moves[key]

    def arcs(self, state: int, symbol: int, q: int) -> tuple[str, int, int]:
        """From place q before a row, with that state behind it: inserts and the row's edit, their cost, the place reached."""
        key = state, symbol, q
        if key not in self._arcs:
            new, less = self.move(state, symbol)
            letters, cost, after = "", 0, self.vectors[state]
            while True:
                left = self.vectors[new][q] + less
                tight = {x: (c, to) for x, c, to in self._edits(q, symbol) if c + after[to] == left}
                if "D" not in tight and INSERT + self.vectors[new][to := _NEXT[q, _WANTED[q]]] + less == left:
                    letters, cost, q = letters + "I", cost + INSERT, to
                    continue
                x = min(tight)
                self._arcs[key] = letters + x, cost + tight[x][0], tight[x][1]
                break
        return self._arcs[key]

    def ending(self, q: int) -> str:
        """The inserts behind the last row."""
        return {1: "II", 2: "I"}.get(q, "")

    def scan(self, symbols: list[int]) -> tuple[list[int], int]:
        """The state behind each row, and the cost of the whole."""
        state, cost, behind = self.end, 0, []
        for symbol in reversed(symbols):
            behind.append(state)
            state, more = self.move(state, symbol)
            cost += more
        return behind[::-1], cost + self.vectors[state][0]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Every state that can occur: the tables (symbol, state) of next states and costs."""
        at = 0
        while at < len(self.vectors):
            for symbol in range(SYMBOLS):
                self.move(at, symbol)
            at += 1
        moves = np.array([[self._moves[s * SYMBOLS + x] for s in range(at)] for x in range(SYMBOLS)])
        return moves[..., 0], moves[..., 1]


@cache
def repairs() -> Repairs:
    """A worker's automaton, which grows with what it reads."""
    return Repairs()


@cache
def closed() -> Repairs:
    """The automaton with every state that can occur: their numbers are the same in all tasks, so blocks can exchange them."""
    found = Repairs()
    found.close()
    return found


def spelled(symbol: int, n: int, first: bool) -> list[int]:
    """The symbols of n equal rows, of which only the conversation's first may stay."""
    return [symbol if first else GONE] + [GONE] * (n - 1)


class Repair:
    """One conversation, row by row in order."""

    def __init__(self, conv, automaton: Repairs):
        self.automaton = automaton
        self.conv, self.place, self.audit, self.hash, self.any = conv, 0, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.last_role, self.low, self.high = None, None, None

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _edit(self, letters: str, role: str, text: str) -> None:
        self.audit.append(letters)
        for x in letters:
            if x == "D":
                continue
            wanted = _WANTED[self.place]
            if x == "K":
                self._write(role, text)
                wanted = "sua".index(role[0])
            else:
                self._write(ROLES[wanted], text if x == "R" else "")
            self.place = _NEXT[self.place, wanted]

    def rows(self, turn, role: str, text: str | None, n: int, symbol: int, first: bool, behind) -> None:
        """n equal rows; ``first``: none of their role and text came earlier; behind: the state behind each."""
        self.blank += n * (symbol == GONE)
        self.duplicate += (n - first) * (symbol != GONE)
        self.truncated += first * (4 <= symbol < GONE)
        initial = role[:1]
        self.illegal += (self.last_role is not None and self.last_role + initial not in ("su", "ua", "au")) + n - 1
        self.last_role = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        for x, state in zip(spelled(symbol, n, first), behind, strict=True):
            letters, cost, _ = self.automaton.arcs(state, x, self.place)
            self.cost += cost
            self._edit(letters, role, text)

    def result(self) -> tuple:
        letters = self.automaton.ending(self.place)
        self._edit(letters, "", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + INSERT * len(letters), "".join(self.audit), self.hash.hexdigest()


def repaired_rows(conv, rows: list[tuple]) -> tuple:
    """The result of one conversation held whole: rows (turn, role, text, n, symbol, digest) in order."""
    seen, firsts = set(), []
    for _, role, _, _, _, digest in rows:
        firsts.append((role, digest) not in seen)
        seen.add((role, digest))
    symbols = [x for (_, _, _, n, symbol, _), first in zip(rows, firsts, strict=True) for x in spelled(symbol, n, first)]
    behind, _ = repairs().scan(symbols)
    out, at = Repair(conv, repairs()), 0
    for (turn, role, text, n, symbol, _), first in zip(rows, firsts, strict=True):
        out.rows(turn, role, text, n, symbol, first, behind[at : at + n])
        at += n
    return out.result()


RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _emit(results: Iterator[tuple], kind: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in results:
        held.append(x)
        size += len(x[7])
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Results of conversations that follow one another whole: rows (conv, turn, role, text, n, symbol, digest)."""
    conv, held = None, None
    for key, *row in rows:
        if held is None or key != conv:
            if held is not None:
                yield repaired_rows(conv, held)
            conv, held = key, []
        if row[3]:
            held.append(tuple(row))
    if held is not None:
        yield repaired_rows(conv, held)


def _streamed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Results of long conversations: rows (conv, behind, turn, role, text, n, symbol), each block after its states."""
    out, states, at = None, b"", 0
    for key, behind, turn, role, text, n, symbol in rows:
        if out is None or key != out.conv:
            if out is not None:
                yield out.result()
            out = Repair(key, closed())
        if behind is not None:
            states, at = behind, 0
        else:
            out.rows(turn, role, text, n, symbol, text is not None, states[at : at + n])
            at += n
    if out is not None:
        yield out.result()


def _mapped(df: DataFrame, walk, id_type: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = RESULT.format(id_type)
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _emit(walk(_rows(batches)), kind), schema)


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text, n: what the crc32 of ``conv_id:turn`` does to each row; n is 0, 1 or 2 rows."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return df.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("n"),
    )


def symbol() -> Column:
    """The symbol of a row, its being a duplicate aside."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    role = F.substring("role", 1, 1)
    place = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    return F.when(trimmed == "", GONE).otherwise(place + F.when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4)).cast("int")


def _scanned(key: tuple, table: pa.Table) -> pa.Table:
    """What a block makes of each state behind it: the state before it, a byte each."""
    tables, state = closed().close()[0], np.arange(len(closed().vectors))
    for x in reversed(_symbols(table)):
        state = tables[x][state]
    return pa.table({"conv": table["conv"][:1], "block": pa.array([key[1].as_py()], pa.int32()), "before": pa.array([bytes(state.tolist())], pa.binary())})


def _symbols(table: pa.Table) -> list[int]:
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("turn", "role", "digest")], null_placement="at_start")
    rows = zip(*[table[c].take(order).to_pylist() for c in ("symbol", "n", "first")], strict=True)
    return [x for s, n, first in rows for x in spelled(s, n, first)]


def _chained(table: pa.Table) -> pa.Table:
    """One conversation's blocks (at most BLOCKS rows): the state behind each."""
    order = pc.sort_indices(table, sort_keys=[("block", "descending")])
    table, state, behind = table.take(order), closed().end, []
    for before in table["before"].to_pylist():
        behind.append(state)
        state = before[state]
    return pa.table({"conv": table["conv"], "block": table["block"], "behind": pa.array(behind, pa.int32())})


def _behind(table: pa.Table, state: pa.Table) -> pa.Table:
    """The state behind each row of a block, a byte each."""
    at, out = state["behind"][0].as_py(), []
    for x in reversed(_symbols(table)):
        out.append(at)
        at, _ = closed().move(at, x)
    return pa.table({"conv": table["conv"][:1], "block": table["block"][:1], "states": pa.array([bytes(out[::-1])], pa.binary())})


def _long(rows: DataFrame, cuts: DataFrame, id_type: str) -> DataFrame:
    """Results of the conversations in ``cuts`` (conv, cuts: the turns that end their blocks)."""
    rows = rows.filter("n > 0").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("symbol", symbol())
    first = rows.groupBy("conv", "role", "digest", "symbol").agg(F.min(F.struct("turn"))["turn"].alias("turn"), F.any_value("text").alias("text")).withColumn("n", F.lit(0))
    every = rows.withColumn("text", F.lit(None).cast("string")).unionByName(first.select(*rows.columns))
    # A first row meets its copies under a key that has the turn in it, so a text repeated at every turn is no hot key.
    every = every.groupBy("conv", "turn", "role", "digest", "symbol").agg(F.sum("n").cast("long").alias("n"), F.max("text").alias("text"))
    at = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("turn"))), F.lit(0))
    same = every["conv"].eqNullSafe(cuts["conv"])
    every = kept(every.join(F.broadcast(cuts), same).select(every["conv"], at.alias("block"), "turn", "role", "digest", "symbol", "n", "text"), "long-conversations")
    bare = every.select("conv", "block", "turn", "role", "digest", "symbol", "n", F.col("text").isNotNull().alias("first"))
    scans = bare.groupBy("conv", "block").applyInArrow(_scanned, f"conv {id_type}, block int, before binary")
    behind = scans.groupBy("conv").applyInArrow(_chained, f"conv {id_type}, block int, behind int")
    states = bare.groupBy("conv", "block").cogroup(behind.groupBy("conv", "block")).applyInArrow(_behind, f"conv {id_type}, block int, states binary")
    order = ["conv", "block", "states", "turn", "role", "digest"]  # a block's states have no turn, and its rows no states
    ordered = every.unionByName(states.withColumn("head", F.lit(0)), allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "block", F.col("head").asc_nulls_last(), *order[3:])
    return _mapped(ordered.select("conv", "states", "turn", "role", "text", "n", "symbol"), _streamed, id_type)


def repaired(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """rows: conv, turn, role, text, n (0: the row isn't there, but its conversation is). One result for each conv."""
    id_type = dict(rows.dtypes)["conv"]
    sizes = rows.groupBy("conv").agg(F.sum("n").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    blocks = F.greatest(F.col("rows") / most_rows, F.col("bytes") / most_bytes)
    large = kept(sizes.filter(blocks > 1).select("conv", F.least(F.ceil(blocks), F.lit(BLOCKS)).cast("int").alias("blocks")), "sizes")  # at most rows / most_rows + bytes / most_bytes of them
    short = rows
    if any_large := not large.isEmpty():
        short = rows.join(F.broadcast(large), rows["conv"].eqNullSafe(large["conv"]), "left_anti")
    short = short.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("symbol", symbol())
    ordered = short.select("conv", "turn", "role", "text", "n", "symbol", "digest").repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")
    results = _mapped(ordered, _conversations, id_type)
    if not any_large:
        drop(large)
        return results
    long = rows.join(F.broadcast(large), rows["conv"].eqNullSafe(large["conv"])).select(*[rows[c] for c in rows.columns], "blocks")
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    ends = long.groupBy("conv").agg(F.percentile_approx("turn", steps, 4 * BLOCKS).alias("ends"), F.first("blocks").alias("blocks"))
    chosen = F.filter("ends", lambda x, i: F.floor((i + 1) * F.col("blocks") / BLOCKS) > F.floor(i * F.col("blocks") / BLOCKS))
    cuts = kept(ends.select("conv", F.array_distinct(F.coalesce(chosen, F.array().cast("array<bigint>"))).alias("cuts")), "cuts")
    return results.unionByName(_long(long.drop("blocks"), cuts, id_type))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows))
