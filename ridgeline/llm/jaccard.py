"""N-gram Jaccard join by token-combination prefixes, for connected groups of near copies.

A document is its set of hashed word shingles. All sets share one order of tokens: by the
number of texts that have a token, then by hash. Two linked sets share a token among the
first n - t + 1 of each (n: size, t: least overlap that a link needs), so tokens that only
one text has, which come first, settle most documents at once: with as many of them as that,
nothing can be linked. What is left is indexed:

- a rare token (fewer than FREQUENT texts) of that prefix alone;
- frequent tokens in pairs, from a prefix extended by g + 1 tokens: linked sets share g + 1
  of them, so two fall into one of g hash groups, and only pairs inside a group are indexed.
  g is a quarter of the size class's least size, so there are about as many pairs as tokens.

Each signature links its documents to the least of them, which gives candidate components by one
sorted scan. A component of up to SQUARE sets is multiplied out inside a task. Texts that share passages
chain up into larger ones, in which few pairs are candidates: there, only pairs that share a signature
of at most FREQUENT sets, agree in size, and whose common token comes early enough in both to leave
room for the overlap are verified, one by one. What still shares more common signatures (large groups
of near copies) is multiplied out in squares of bounded size, of which only a spanning tree of the links
and the counts of links leave the task. Components of the verified links are the groups.

Token frequencies are exact counts over all texts, asked for by blocks of documents and answered by
ranges of tokens (see exchange.py); nothing that grows with the corpus is broadcast or collected.
Equal sets are one node with its number of copies.

Edge cases: null and empty texts have no shingles and no links; under five words the whole
sequence is one shingle; identical texts are linked, however many; a very long text is one set like
any other. Ids should be unique: rows of one id count as that many documents, which get the links and
the group of whichever of their texts is linked, and a row without an id is linked with equal sets only. An empty table
gives an empty result. Only the columns id and text are read, so others never clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import exchange
from ridgeline.llm.blocks import claim, documents, drop, kept, mix, parts_for, slices, text_bytes
from ridgeline.llm.components import components

WORDS, PERCENT = 5, 75
#: Tokens in so many texts or more are indexed in pairs.
FREQUENT = 32
#: Text bytes for each leaf of the exchange, and the blocks of documents that make so many; sets multiplied out at a time; members of a signature that are joined inside a partition, before the shuffle.
PART_BYTES, BLOCKS, SQUARE, LOCAL = 16 << 20, 4, 1024, 64
#: Texts are moved to their blocks in so many passes, each of which has its share of the blocks, so that only this share lies on the executors' disks at a time.
PASSES = 2


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASH = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's hashed shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ mix(h[k : len(h) - size + 1 + k] + np.uint64(k))
    return np.unique(mix(out))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


# --- token frequencies --------------------------------------------------------------------


def _asked(blocks: DataFrame, words: int, key_bits: int, bits: int) -> DataFrame:
    """Packets of each block's distinct token keys, and of how many of its distinct sets have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _HASH.clear)
        held: dict[int, list] = {}
        seen: set = set()
        for batch in batches:
            for part in slices(batch):
                for text, block in zip(part.column("text").to_pylist(), part.column("block").to_pylist(), strict=True):
                    tokens = shingles(text, words)
                    digest = (block, xxhash.xxh3_128_digest(tokens))
                    if digest not in seen:
                        seen.add(digest)
                        held.setdefault(block, []).append(tokens >> np.uint64(64 - key_bits))
        while held:
            block, parts = held.popitem()
            keys = np.sort(np.concatenate(parts))
            at = _runs(keys)
            yield exchange.batch(list(exchange.packets(block, 0, keys[at[:-1]], np.diff(at), key_bits, 0, bits)))

    return blocks.select("text", "block").mapInArrow(run, exchange.PACKETS)


def least_overlap(n, percent: int = PERCENT):
    """The overlap that any link of a set of n tokens needs."""
    return -(-percent * n // 100)


def _profiled(blocks: DataFrame, answers: DataFrame, words: int, percent: int, key_bits: int, frequent: int) -> DataFrame:
    """id, n, h1, h2 of every document; of those that can have links also single, rare, tokens.

    tokens: those that other texts have too, in the common order; single: how many it has alone; rare: how many are rare."""

    def run(_, docs: pa.Table, answers: pa.Table) -> pa.Table:
        sets = [shingles(t, words) for t in docs["text"].to_pylist()]
        every = np.concatenate(sets or [np.zeros(0, np.uint64)])
        df = np.concatenate([np.zeros(0, np.int64), *[exchange.unpack(d, np.int64) for _, d in sorted(zip(answers["sub"].to_pylist(), answers["values"].to_pylist(), strict=True))]])
        keys = every >> np.uint64(64 - key_bits)
        order = np.argsort(keys, kind="stable")
        own = np.empty(len(every), np.int64)
        own[order] = np.repeat(df, np.diff(_runs(keys[order])))
        ends = np.cumsum([len(s) for s in sets])
        h1, h2, single, rare, tokens = [], [], [], [], []
        for s, e in zip(sets, ends, strict=True):
            d, digest = own[e - len(s) : e], xxhash.xxh3_128_digest(s)
            h1.append(int.from_bytes(digest[:8], "little", signed=True))
            h2.append(int.from_bytes(digest[8:], "little", signed=True))
            shared = d > 1
            alone = len(s) - int(shared.sum())
            if len(s) and alone < len(s) - least_overlap(len(s), percent) + 1:
                s, d = s[shared], d[shared]
                tokens.append(s[np.lexsort((s, d))].tobytes())
                single.append(alone)
                rare.append(int((d < frequent).sum()))
            else:
                tokens.append(None)
                single.append(None)
                rare.append(None)
        longs = {"n": [len(s) for s in sets], "h1": h1, "h2": h2, "single": single, "rare": rare}
        return pa.table({"id": docs["id"], **{k: pa.array(v, pa.int64()) for k, v in longs.items()}, "tokens": pa.array(tokens, pa.binary())})

    return blocks.groupBy("block").cogroup(answers.select("block", "sub", "values").groupBy("block")).applyInArrow(run, "id long, n long, h1 long, h2 long, single long, rare long, tokens binary")


# --- signatures ---------------------------------------------------------------------------


def signatures(tokens: np.ndarray, n: int, single: int, rare: int, percent: int = PERCENT) -> np.ndarray:
    """What a set is indexed by. tokens: in the common order, without the ``single`` first ones that it has alone."""
    return placed_signatures(tokens, n, single, rare, percent)[0]


def placed_signatures(tokens: np.ndarray, n: int, single: int, rare: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the place of each in the set's order: that of a rare token, -1 for pairs."""
    spare = n - least_overlap(n, percent)
    alone = tokens[: max(0, min(rare, spare + 1 - single))]
    out, place = [mix(alone)], single + np.arange(len(alone))
    if rare + single < spare + 1:  # the prefix reaches a frequent token
        size_class = int(math.log(n) / math.log(4 / 3) + 1e-9)
        for c in (size_class, size_class + 1):
            g = max(1, math.ceil((4 / 3) ** c - 1e-9) // 4)
            often = tokens[rare : max(0, spare + g + 1 - single)]
            group = mix(often ^ np.uint64(c + 1)) % np.uint64(g)
            order = np.argsort(group, kind="stable")
            often, group = often[order], group[order]
            for apart in range(1, len(often)):
                same = group[apart:] == group[:-apart]
                if not same.any():
                    break
                a, b = often[:-apart][same], often[apart:][same]
                out.append(mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + mix(np.maximum(a, b)) + np.uint64(c + 1)))
    found, first = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate([place, np.full(sum(map(len, out)) - len(place), -1)])[first]


def _stars_of(sigs: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct links as rows (member, leader), which rows lead their signature or stand for themselves).

    sigs sorted, ids rising within; signatures of under ``least`` members give no links."""
    at = _runs(sigs)
    size = np.repeat(np.diff(at), np.diff(at))
    leader = np.repeat(ids[at[:-1]], np.diff(at))
    first = np.zeros(len(sigs), bool)
    first[at[:-1]] = True
    take = (size >= least) & ~first
    return np.unique(np.stack([ids[take], leader[take]], 1), axis=0), first | (size < least)


def candidate_links(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """a, b: every set to the least one that shares a signature with it. sets: rep, n, single, rare, tokens."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids = [], []
        for batch in batches:
            for r in batch.to_pylist():
                found = signatures(np.frombuffer(r["tokens"], np.uint64), r["n"], r["single"], r["rare"], percent)
                sigs.append(found)
                ids.append(np.full(len(found), r["rep"], np.int64))
        if not sigs:
            return
        sigs, ids = np.concatenate(sigs), np.concatenate(ids)
        order = np.lexsort((ids, sigs))
        links, stay = _stars_of(sigs[order], ids[order], LOCAL)
        for near, a, b in ((True, links[:, 1], links[:, 0]), (False, sigs[order][stay].view(np.int64), ids[order][stay])):
            for at in range(0, len(a), 1 << 16):
                x, y = (pa.array(v[at : at + (1 << 16)]) for v in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array([near] * len(x)), x, y], names=["near", "sig", "id"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, leader = None, None
        for batch in batches:
            sigs, ids = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(sigs):
                continue
            at = _runs(sigs)
            leaders = ids[at[:-1]].copy()
            if sigs[0] == sig:
                leaders[0] = leader
            every = np.repeat(leaders, np.diff(at))
            sig, leader = sigs[-1], leaders[-1]
            links = np.unique(np.stack([ids, every], 1)[ids != every], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    rows = kept(sets.select("rep", "n", "single", "rare", "tokens").mapInArrow(index, "near boolean, sig long, id long"), "signatures")
    far = rows.filter("NOT near").select("sig", "id").repartition(parts, "sig").sortWithinPartitions("sig", "id").mapInArrow(scan, "a long, b long")
    out = kept(far.unionByName(rows.filter("near").select(F.col("id").alias("a"), F.col("sig").alias("b"))).distinct(), "candidates")
    drop(rows)
    return out


# --- verification -------------------------------------------------------------------------


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Common tokens of every pair of a left and a right set (right None: left)."""
    sets = left + (right or [])
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    at = _runs(every[order])
    token = np.repeat(np.arange(len(at) - 1), np.diff(at))
    many = np.repeat(np.diff(at) > 1, np.diff(at))
    of, token = of[order][many], token[many]
    token = np.unique(token, return_inverse=True)[1]
    out = np.zeros((len(left), len(right or left)), np.float32)
    step = 2048
    for lo in range(0, int(token.max(initial=-1)) + 1, step):
        s, e = np.searchsorted(token, [lo, lo + step])
        x = np.zeros((len(sets), step), np.float32)
        x[of[s:e], token[s:e] - lo] = 1
        out += x[: len(left)] @ x[len(left) if right else 0 :].T
    return out


def _verified(ids: np.ndarray, n: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(least id that each set reaches inside this task, copies of the sets linked with it). left: sets on one side of a block pair."""
    one = np.arange(len(ids)) if left is None else np.flatnonzero(left)
    two = one if left is None else np.flatnonzero(~left)
    both = _overlaps([sets[i] for i in one], None if left is None else [sets[i] for i in two])
    linked = 100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)
    if left is None:
        np.fill_diagonal(linked, False)
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    links[one] += linked @ copies[two]
    if left is not None:
        links[two] += linked.T @ copies[one]
    a, b = np.nonzero(linked)
    a, b = one[a], two[b]
    while len(a):  # least ids spread along the links
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            break
        root = new
    return root, links


def multiplied(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """rep, root, links: exact links inside each candidate group. groups: id, component (stored)."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = sets.join(groups.withColumnRenamed("id", "rep"), "rep").join(sizes, "component")
    parts = F.ceil(F.col("size") / SQUARE).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("mine", mine)
    # a small group lies in one bundle of groups; a large one in squares (i, j), each set in one row and one column of them
    total = max(1, math.ceil(groups.count() / SQUARE))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    key = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(total)).cast("long")).otherwise(F.xxhash64("component", low, high))
    rows = rows.select(key.alias("key"), "component", low.alias("i"), high.alias("j"), "mine", "rep", "n", "copies", "tokens")

    def run(table: pa.Table) -> pa.Table:
        out = ([], [], [])
        column = {c: table[c].to_numpy() for c in ("component", "i", "j", "mine", "rep", "n", "copies")}
        tokens = table["tokens"].to_pylist()
        order = np.lexsort((column["rep"], column["j"], column["i"], column["component"]))
        name = np.stack([column[c][order] for c in ("component", "i", "j")], 1)
        cuts = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
        for at in np.split(order, cuts):
            i, j = column["i"][at[0]], column["j"][at[0]]
            left = None if i == j else column["mine"][at] == i
            root, links = _verified(column["rep"][at], column["n"][at], column["copies"][at], [np.frombuffer(tokens[k], np.uint64) for k in at], left, percent)
            for held, new in zip(out, (column["rep"][at], root, links), strict=True):
                held.append(new)
        return pa.table({k: np.concatenate(v) for k, v in zip(("rep", "root", "links"), out, strict=True)})

    return rows.groupBy("key").applyInArrow(run, "rep long, root long, links long")


def close_pairs(sets: DataFrame, dense: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """rep, root, links for the pairs that share a signature in ``places`` (sig, rep, n, pos; few rows of each sig) and aren't in one dense group."""
    side = lambda k: places.select("sig", F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("pos").alias(f"pos_{k}"))
    least = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    # the first token that both have stands so early in both that the rest can make up the overlap; linked sets show it there
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= least
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((F.least("pos_a", "pos_b") < 0) | room)
    pairs = side("a").join(side("b"), "sig").filter((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()
    of = lambda k: dense.select(F.col("id").alias(k), F.col("component").alias(f"dense_{k}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("dense_a IS NULL OR dense_b IS NULL OR dense_a <> dense_b").select("a", "b")
    whole = lambda k: sets.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("copies").alias(f"copies_{k}"), F.col("tokens").alias(f"tokens_{k}"))
    rows = kept(pairs, "pairs").join(whole("a"), "a").join(whole("b"), "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y, n, m in zip(*[part.column(c).to_pylist() for c in ("tokens_a", "tokens_b", "n_a", "n_b")], strict=True):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    keep.append(100 * both >= percent * (n + m - both))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b", "copies_a", "copies_b"])

    links = kept(rows.mapInArrow(check, "a long, b long, copies_a long, copies_b long"), "links")
    one = links.select(F.col("a").alias("rep"), F.col("a").alias("root"), F.col("copies_b").alias("links"))
    return one.unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("root"), F.col("copies_a").alias("links")))


def sparse_links(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """rep, root, links among sets of large candidate components."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for r in part.to_pylist():
                    sigs, pos = placed_signatures(np.frombuffer(r["tokens"], np.uint64), r["n"], r["single"], r["rare"], percent)
                    n = len(sigs)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.full(n, r["rep"])), pa.array(np.full(n, r["n"])), pa.array(pos.astype(np.int64))], names=["sig", "rep", "n", "pos"])

    places = kept(sets.select("rep", "n", "single", "rare", "tokens").mapInArrow(place, "sig long, rep long, n long, pos long"), "places")
    # stored, so that the joins have two plain sides, whose hot keys Spark can split
    sizes = kept(places.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("b")).filter("size > 1"), "sizes")
    often = places.join(sizes.filter(F.col("size") > frequent), "sig").select(F.col("rep").alias("a"), "b")
    dense = components(often)
    few = places.join(sizes.filter(F.col("size") <= frequent), "sig").select("sig", "rep", "n", "pos")
    out = kept(close_pairs(sets, dense, few, percent).unionByName(multiplied(sets, dense, percent)), "sparse")
    for table in (places, sizes, dense):
        drop(table)
    return out


def verified(sets: DataFrame, groups: DataFrame, percent: int, frequent: int) -> DataFrame:
    """rep, root, links: exact links inside candidate components. groups: id, component."""
    sizes = kept(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = kept(groups.join(sizes, "component"), "sized")
    out = kept(multiplied(sets, sized.filter(F.col("size") <= SQUARE).select("id", "component"), percent), "verified")
    large = sized.filter(F.col("size") > SQUARE).select(F.col("id").alias("rep"))
    if not large.isEmpty():
        chosen = kept(sets.join(large, "rep", "left_semi"), "large")
        out = out.unionByName(sparse_links(chosen, percent, frequent))
        drop(chosen)
    drop(sizes)
    drop(sized)
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs: id (unique), text -> id, n_shingles, component_id, n_links (documents linked with it, copies included), stored."""
    size = text_bytes(docs)[1]
    parts = parts_for(size, part_bytes)
    bits = exchange.levels(parts)
    key_bits = min(62, max(sum(bits) + 8, math.ceil(math.log2(max(2, size / 5))) + 8))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(BLOCKS * parts))
    passes = [F.pmod("block", F.lit(PASSES)) == at for at in range(PASSES)]
    every = docs.select("id", "text", block.alias("block"))
    blocks = [every.filter(at).repartition(-(-BLOCKS * parts // PASSES), "block") for at in passes]  # blocks fall unevenly, a few into a task at most
    levels = exchange.raised(_united([kept(_asked(b, words, key_bits, bits[0]), "asked") for b in blocks]), bits, key_bits)
    answers = exchange.lowered(levels, bits, exchange.sums(levels, bits), np.int64)
    drop(levels[0])
    profiles = _united([kept(_profiled(b, answers.filter(at), words, percent, key_bits, frequent), "profiles") for b, at in zip(blocks, passes, strict=True)])
    drop(answers)
    # stored, so that the join with all members has two plain sides, whose hot keys Spark can split
    copies = kept(profiles.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    sets = profiles.filter(F.col("tokens").isNotNull()).groupBy("h1", "h2").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "single", "rare", "tokens"))).alias("s"), F.count(F.lit(1)).alias("copies"))
    sets = kept(sets.select(F.col("s.id").alias("rep"), "s.n", "s.single", "s.rare", "copies", "s.tokens").filter("rep IS NOT NULL"), "sets")
    candidates = candidate_links(sets, percent, parts)
    groups = components(candidates)
    drop(candidates)
    found = kept(verified(sets, groups, percent, frequent), "verified")
    drop(sets)
    drop(groups)
    final = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    links = kept(found.groupBy("rep").agg(F.sum("links").alias("links")), "link-counts")
    drop(found)
    members = profiles.select("id", "n", "h1", "h2").join(copies, ["h1", "h2"], "left").join(final, "rep", "left").join(links, "rep", "left")
    out = members.select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )
    out = kept(out, "near-groups")
    for table in (profiles, copies, final, links):
        drop(table)
    return out


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id, (SELECT count(*) FROM e WHERE e.a = r.doc_id)::BIGINT AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
