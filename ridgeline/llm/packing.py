"""Best-fit packing with several permitted sequence lengths.

A document of more tokens than the longest sequence is cut into pieces. Pieces are dealt by
hash into groups of bounded size, and each group is packed on its own: in falling length,
a piece goes to the open bin that it fills best; where none has room, the bin size is opened
whose cost per token, with the pieces still to come laid in greedily, is least; in the end
every bin shrinks to the shortest permitted length that holds its contents.

Edge cases: every document ends with one separator token, so null and empty texts have length
1 and are packed too; equal lengths go by id, then piece; repeated rows with one id keep
their own rows (alike ones fall into one group, or into several if they are many times its size); an empty table gives an empty result; a text of any length is cut into
as many pieces as it needs, and a document's pieces fall into different groups. Only id and tokens are read, so names never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import documents, kept
from ridgeline.llm.tokens import token_counts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of one sequence besides its places, in places.
OVERHEAD = 16
#: Pieces in a group, about.
GROUP = 4096
#: A group of over so many times GROUP pieces is dealt again.
OVER = 4
#: For lengths without a tokenizer: UTF-8 bytes in a token.
BYTES_PER_TOKEN = 4


def place_cost(capacity: int) -> float:
    return capacity + OVERHEAD


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = place_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, capacity of each bin). lengths: in the order of ties; 1 to the longest capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    waiting = Counter(lengths)
    lengths_left = sum(1 << n for n in waiting)  # bit n: some piece of n tokens waits
    space_of: dict[int, list[int]] = {}
    spaces = 0  # bit n: some open bin has n places left
    bins, offsets, used, opened = [0] * len(lengths), [0] * len(lengths), [], []

    def filled(room: int) -> int:
        """Tokens that the waiting pieces, largest first, would lay into the room."""
        taken, got = Counter(), 0
        left = lengths_left
        while n := (left & ((1 << (room + 1)) - 1)).bit_length() - 1:
            if n < 0:
                break
            times = min(room // n, waiting[n] - taken[n])
            taken[n] += times
            got += times * n
            room -= times * n
            left &= ~(1 << n)
        return got

    for i in order:
        n = lengths[i]
        waiting[n] -= 1
        if not waiting[n]:
            lengths_left &= ~(1 << n)
        fit = spaces >> n
        if fit:
            space = n + (fit & -fit).bit_length() - 1
            b = space_of[space].pop()
            if not space_of[space]:
                spaces &= ~(1 << space)
        else:
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + filled(c - n)), c))
            b, space = len(used), size
            used.append(0)
            opened.append(size)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if space > n:
            space_of.setdefault(space - n, []).append(b)
            spaces |= 1 << (space - n)
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


def packed(rows: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """rows: id long, tokens long (without the separator) -> one row per piece with its bin.

    id, piece, start, length, bin_id, bin_offset, capacity. rows should be a stored table: it is read three times."""
    longest = max(capacities)
    total = F.coalesce(F.col("tokens"), F.lit(0)) + 1
    pieces = rows.select("id", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / longest).cast("long"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("total") - F.col("piece") * longest).alias("length"))
    many = rows.agg(F.sum(F.floor((total - 1) / longest) + 1).alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(many / group))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(groups)))
    # Rows alike in all of it (without an id, or of one id) would share a group: one that is far too large is dealt by the rows' places in the table.
    over, base = {}, groups
    for r in pieces.groupBy("group").count().filter(F.col("count") > OVER * group).toLocalIterator():  # at most one for OVER groups' pieces
        over[r["group"]] = base, -(-r["count"] // group)
        base += over[r["group"]][1]
    if over:
        known = rows.sparkSession.createDataFrame([(g, b, n) for g, (b, n) in over.items()], "group long, base long, parts long")
        placed = pieces.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(known), "group", "left")
        pieces = placed.withColumn("group", F.when(F.col("base").isNull(), F.col("group")).otherwise(F.col("base") + F.pmod("place", "parts"))).drop("place", "base", "parts")

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("id", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = pack(table["length"].to_pylist(), capacities)
        group = table["group"][0].as_py()
        longs = {"bin_id": [group << 32 | b for b in bins], "bin_offset": offsets, "capacity": [sizes[b] for b in bins]}
        return pa.table({**{c: table[c] for c in ("id", "piece", "start", "length")}, **{k: pa.array(v, pa.int64()) for k, v in longs.items()}})

    return pieces.groupBy("group").applyInArrow(run, "id long, piece long, start long, length long, bin_id long, bin_offset long, capacity long")


def byte_tokens(text_col: str = "text") -> Column:
    """Tokens by the rule of thumb, without a tokenizer."""
    return F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / BYTES_PER_TOKEN).cast("long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the tokenizer's exact counts; they are stored, as rows are counted and dealt from them."""
    counts = token_counts(documents(spark, sf_dir, "doc_id", "text"), ledger=False)
    return packed(kept(counts.select("id", F.col("n_tokens").alias("tokens")), "token-counts")).withColumnRenamed("id", "doc_id")
