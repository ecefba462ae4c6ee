"""Language-model scores by context-tree weighting over bytes, beside a unigram base score.

A byte is eight binary decisions along a tree of 255 nodes. Every context of up to DEPTH
bytes holds, for each of these nodes, Krichevsky-Trofimov counts over the whole training
text; context-tree weighting mixes the estimates of all depths with the exact posterior
weight of stopping at each context. After training the mixture is frozen, so the log
probability of every byte in every context is a table cell, and a text's score is a sum.

The counts cover all training texts, and every context that was seen has its own estimates.

Word counts and contexts grow with the corpus, so they are never broadcast: each block of documents
asks ranges of hashed words for its own distinct words' counts, and ranges of contexts for
the log probabilities of its own distinct grams (a byte after DEPTH bytes), see exchange.py. A range
holds whole subtrees below contexts of two bytes; only the 257 contexts above them are shared by all.

Edge cases: null is empty; an empty text has one token, its end; a corpus without training
rows scores every byte by the untrained estimate (one half a bit) and every word by count 0. A very long
text lies whole in one block; repeated rows each count and are scored alike; an empty table gives an empty
result. Only the columns id, train and text are read, so others never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import exchange
from ridgeline.llm.blocks import crc_mod, documents, drop, kept, parts_for, slices

DEPTH = 3
#: Contexts of DEPTH bytes that are worked on at a time, about.
CONTEXTS_AT_ONCE = 2048
#: Text bytes for each leaf of the exchange, and the blocks of documents (one word table each) that make so many.
PART_BYTES, BLOCKS = 32 << 20, 4
CHUNK = 1 << 19


def lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


# --- context-tree weighting ---------------------------------------------------------------


def _laid_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with DEPTH zero bytes before each and after the last; first positions; sizes with the end byte."""
    gap = bytes(DEPTH)
    x = np.frombuffer(gap + gap.join(raws) + gap, np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64) + 1
    return x, np.cumsum(sizes - 1 + DEPTH) - (sizes - 1), sizes


def _sums(raws: list[bytes], cost: Callable[[np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """For each text, the sum of ``cost`` (of the laid-out bytes, from one position up to another) over it and its end."""
    x, first, sizes = _laid_out(raws)
    out = np.zeros(len(raws))
    for lo in range(DEPTH, len(x), CHUNK):
        hi = min(len(x), lo + CHUNK)
        total = np.concatenate([[0.0], np.cumsum(cost(x, lo, hi), dtype=np.float64)])
        begin, end = np.clip(first, lo, hi) - lo, np.clip(first + sizes, lo, hi) - lo
        out += total[end] - total[begin]
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5: Stirling's series at x + 6, brought down."""
    z = x + 6.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of bytes (rows of 256) -> counts of 0 and 1 at the 255 binary nodes, from the root of each row on."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, -1).sum(3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def _estimate(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log KT block probability, probability of a 1) at each binary node."""
    a, b = _decisions(counts)
    block = _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(np.maximum(a + b + 1.0, 0.5))
    return block, (b + 0.5) / (a + b + 1.0)


def _bytes_log10(ones: np.ndarray) -> np.ndarray:
    """log10 probability of the 256 bytes, from the probability of a 1 at each binary node."""
    out = np.zeros((len(ones), 256), np.float32)
    for level in range(8):
        p = ones[:, (1 << level) - 1 : (2 << level) - 1]
        both = np.log10(np.stack([1 - p, p], 2)).reshape(len(ones), 2 << level)
        out += np.repeat(both, 256 >> (level + 1), axis=1).astype(np.float32)
    return out


# --- the tree by ranges of contexts ---------------------------------------------------------


def _grams(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The grams that end at the positions lo to hi: the last byte before highest, then those further back, the byte itself lowest."""
    y = x[lo - DEPTH : hi].astype(np.uint32)
    return (y[2:-1] << 24) | (y[1:-2] << 16) | (y[:-3] << 8) | y[3:]


def _counted(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the texts and their ends, sorted, and how often each comes."""
    x, first, sizes = _laid_out(raws)
    grams = _grams(x, DEPTH, len(x))
    use = np.ones(len(grams), bool)
    for k in range(1, DEPTH):  # the zero byte after a text is predicted, the other gap bytes are not
        gap = first + sizes - 1 + k - DEPTH
        use[gap[gap < len(use)]] = False
    return _summed([np.sort(grams[use])])


def _summed(grams: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the sums of their counts (1 each without; then one sorted array)."""
    if counts is None:
        new = np.flatnonzero(np.concatenate([[True], grams[0][1:] != grams[0][:-1]])) if len(grams[0]) else np.zeros(0, np.int64)
        return grams[0][new], np.diff(np.append(new, len(grams[0])))
    keys, at = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), minlength=len(keys)).astype(np.int64)


#: Context bytes that decide a range are spread by this odd factor and brought back by its inverse.
_SPREAD = 40503
_BACK = pow(_SPREAD, -1, 1 << 16)
#: Bits of a gram, and of what decides its range.
GRAM_BITS, RANGE_BITS = 8 * (DEPTH + 1), 16


def _turned(grams: np.ndarray, factor: int) -> np.ndarray:
    low = GRAM_BITS - RANGE_BITS
    return (((grams >> low) * factor & 0xFFFF) << low) | (grams & ((1 << low) - 1))


def gram_keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams as keys of an exchange, sorted, and the order that sorts them: their last two bytes of context decide the range."""
    keys = _turned(grams.astype(np.int64), _SPREAD)
    order = np.argsort(keys, kind="stable")
    return keys[order].astype(np.uint64), order


def keyed_grams(keys: np.ndarray) -> np.ndarray:
    return _turned(keys.astype(np.int64), _BACK).astype(np.uint32)


class Places:
    """Where each of a block's grams stands in its list, by a hash table; anywhere for other grams (those across the gaps between texts, which no sum holds)."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.bits = grams, max(8, (2 * len(grams)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(grams))
        at = self._hash(grams)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]] = left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = self._hash(grams)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.grams[out] != grams)) if len(self.grams) else np.zeros(0, np.int64)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.grams[out[wrong]] != grams[wrong])]
        return out


class Subtrees:
    """Whole subtrees below contexts of two bytes: their estimates, and their weights of stopping."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: sorted, with their counts."""
        sym = grams & 255
        self.deep, at = np.unique(grams >> 8, return_inverse=True)
        dense = np.zeros((len(self.deep), 256))
        dense[at, sym] = counts
        self.ctx, first, self.parent = np.unique(self.deep >> 8, return_index=True, return_inverse=True)
        self.last = (self.ctx >> 8).astype(np.int64)
        deep_block, self.deep_ones = _estimate(dense)
        block, self.ones = _estimate(np.add.reduceat(dense, first))
        self.both = np.logaddexp(block, np.add.reduceat(deep_block, first)) + math.log(0.5)
        self.weight = np.exp(block + math.log(0.5) - self.both)

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> Iterator[Subtrees]:
        """In pieces of about CONTEXTS_AT_ONCE contexts, never cut inside a subtree."""
        if not len(grams):
            return
        deep = np.cumsum(np.concatenate([[0], (grams[1:] >> 8) != (grams[:-1] >> 8)]))
        first = np.flatnonzero(np.concatenate([[True], (grams[1:] >> 16) != (grams[:-1] >> 16)]))
        piece = deep[first] // CONTEXTS_AT_ONCE
        cuts = [0, *first[np.flatnonzero(piece[1:] != piece[:-1]) + 1].tolist(), len(grams)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield Subtrees(grams[lo:hi], counts[lo:hi])

    def fill(self, out: np.ndarray, asked: np.ndarray, top: Top) -> None:
        """Writes the log10 probabilities of those of the asked grams (sorted) whose two bytes of context are known here."""
        lo, hi = np.searchsorted(asked >> 16, self.ctx[0]), np.searchsorted(asked >> 16, self.ctx[-1], "right")
        mine, sym = asked[lo:hi], asked[lo:hi] & 255
        path = top.path[self.last] + top.left[self.last] * self.weight * self.ones
        left = top.left[self.last] * (1 - self.weight)
        for ctx, of, ones in ((self.ctx, mine >> 16, path + left * 0.5), (self.deep, mine >> 8, path[self.parent] + left[self.parent] * self.deep_ones)):
            at = np.minimum(np.searchsorted(ctx, of), len(ctx) - 1)
            known = np.flatnonzero(ctx[at] == of)
            out[lo + known] = _bytes_log10(ones)[at[known], sym[known]]


class Top:
    """The contexts of no byte and of one byte; a context that was never seen predicts each bit by one half."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        """counts: a row of 256 for each last byte; below: the sums of what its subtrees give, rows of 255."""
        block, ones = _estimate(counts)
        both = np.logaddexp(block, below) + math.log(0.5)
        weight = np.exp(block + math.log(0.5) - both)
        seen = counts.sum(1) > 0
        block, root = _estimate(counts.sum(0, keepdims=True))
        stop = np.exp(block + math.log(0.5) - np.logaddexp(block, both[seen].sum(0)) - math.log(0.5))
        self.path = stop * root + (1 - stop) * weight * ones
        self.left = (1 - stop) * (1 - weight)
        self.table = _bytes_log10(np.where(seen[:, None], self.path + self.left * 0.5, stop * root + (1 - stop) * 0.5))


def summed_grams(requests: DataFrame, bits: list[int]) -> DataFrame:
    """_path, last, grams, counts, below: a row with the leaf's training grams (last: -1), and one for each last byte of context with its counts and its subtrees' sums."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts, _ = exchange.merged(*exchange.opened(table))
        grams, counts = keyed_grams(keys[counts > 0]), counts[counts > 0]
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        last, rows = (grams >> 24).astype(np.int64), np.zeros((256, 256), np.int64)
        np.add.at(rows, (last, grams & 255), counts)
        below = np.zeros((256, 255))
        for part in Subtrees.of(grams, counts):
            np.add.at(below, part.last, part.both)
        seen = np.unique(last).tolist()
        return pa.table({"_path": pa.array([key[0].as_py()] * (1 + len(seen)), pa.int64()), "last": pa.array([-1, *seen], pa.int32()), "grams": pa.array([exchange.pack(grams)] + [None] * len(seen), pa.binary()), "counts": pa.array([exchange.pack(counts), *[rows[i].tobytes() for i in seen]], pa.binary()), "below": pa.array([None, *[below[i].tobytes() for i in seen]], pa.binary())})

    return requests.groupBy(*exchange.leaf(bits[-1])).applyInArrow(run, "_path long, last int, grams binary, counts binary, below binary")


def top_of(sums: DataFrame) -> Top:
    """From summed_grams; at most 256 rows reach the driver."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_path")
        add = lambda c, kind: sum(np.frombuffer(v, kind) for v in table[c].to_pylist()).tobytes()
        return pa.table({"last": table["last"][:1], "counts": pa.array([add("counts", np.int64)]), "below": pa.array([add("below", np.float64)])})

    counts, below = np.zeros((256, 256)), np.zeros((256, 255))
    for r in sums.filter("last >= 0").select("_path", "last", "counts", "below").groupBy("last").applyInArrow(run, "last int, counts binary, below binary").collect():
        counts[r["last"]], below[r["last"]] = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["below"], np.float64)
    return Top(counts, below)


def gram_costs(requests: DataFrame, bits: list[int], trained: DataFrame, top: Top) -> DataFrame:
    """block, path, sub, keys, values: the log10 probability of each gram in the last level's packets. trained: from summed_grams."""
    sent = requests.sparkSession.sparkContext.broadcast(top)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = exchange.opened(table)
        every, _, place = exchange.merged(keys, counts)
        grams = keyed_grams(every)
        order = np.argsort(grams)
        asked = grams[order]
        out = sent.value.table[asked >> 24, asked & 255]
        for g, c in zip(known["grams"].to_pylist(), known["counts"].to_pylist(), strict=True):
            for part in Subtrees.of(exchange.unpack(g, np.uint32), exchange.unpack(c, np.int64)):
                part.fill(out, asked, sent.value)
        costs = np.empty_like(out)
        costs[order] = out
        return pa.table({**{c: table[c] for c in ("block", "path", "sub", "keys")}, "values": exchange.dealt(costs[place], keys)})

    rows = trained.filter("last < 0").select("_path", "grams", "counts")
    return requests.groupBy(*exchange.leaf(bits[-1])).cogroup(rows.groupBy("_path")).applyInArrow(run, exchange.ANSWERS)


# --- unigram base -------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _distinct(words: Iterable[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, their hashes, and the order that sorts the hashes."""
    words = list(words)
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    return words, hashes, np.argsort(hashes, kind="stable")


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """id, train, text, block: dealt by the hash of id and text, equal sizes whatever the ids."""
    return docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(BLOCKS * parts))).repartition(BLOCKS * parts, "block")


def asked(blocks: DataFrame, word_bits: int, gram_bits: int) -> DataFrame:
    """Packets of each block's distinct words (kind 0) and grams (kind 1), with their counts in its training rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        grams: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch):
                raws: dict[tuple[int, bool], list[bytes]] = {}
                for train, text, block in zip(*[part.column(c).to_pylist() for c in ("train", "text", "block")], strict=True):
                    raw = lower(text)
                    held = counts.setdefault(block, Counter())
                    if train:
                        held.update(raw.split())
                    else:  # asked for, not counted
                        for word in raw.split():
                            held.setdefault(word, 0)
                    raws.setdefault((block, bool(train)), []).append(raw)
                for (block, train), texts in raws.items():
                    keys, n = _counted(texts)
                    held = grams.setdefault(block, [])
                    held.append((keys, n * train))
                    if len(held) > 1 and sum(len(k) for k, _ in held) > 2_000_000:
                        held[:] = [_summed(*map(list, zip(*held, strict=True)))]

        def rows(kind: int, found: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * found.num_rows, pa.int32()), *found.columns], names=["kind", *found.schema.names])

        while counts:
            block, held = counts.popitem()
            words, hashes, order = _distinct(held)
            n = np.fromiter(held.values(), np.int64, len(words))[order]
            keys = hashes[order]
            if len(keys):
                yield rows(0, exchange.batch(list(exchange.packets(block, 0, keys, n, 64, 0, word_bits))))
            keys, n = _summed(*map(list, zip(*grams.pop(block), strict=True)))
            keys, order = gram_keys(keys)
            yield rows(1, exchange.batch(list(exchange.packets(block, 0, keys, n[order], GRAM_BITS, 0, gram_bits))))

    return blocks.mapInArrow(run, f"kind int, {exchange.PACKETS}")


def lm_scores(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs: id, train, text -> id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Both scores are made in one pass over the blocks of texts, and stored."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("ends")).first()
    parts, ends = parts_for(size["bytes"], part_bytes), size["ends"]
    blocks = _blocks(docs, parts)
    word_bits, gram_bits = exchange.levels(parts), exchange.levels(parts, RANGE_BITS)
    requests = kept(asked(blocks, word_bits[0], gram_bits[0]), "requests")
    words = exchange.raised(requests.filter("kind = 0").drop("kind"), word_bits, 64)
    sums = exchange.sums(words, word_bits)
    stats = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "total")]).first()
    counted = exchange.lowered(words, word_bits, sums, np.int64)
    grams = exchange.raised(requests.filter("kind = 1").drop("kind"), gram_bits, GRAM_BITS)
    trained = kept(summed_grams(grams[-1], gram_bits), "grams")
    costs = exchange.lowered(grams, gram_bits, kept(gram_costs(grams[-1], gram_bits, trained, top_of(trained)), "gram-costs"), np.float32, keyed=True)
    drop(requests)
    drop(trained)
    n, v = stats["total"] + ends, stats["distinct"] + (ends > 0)
    scale = math.log10(n + v + 1)

    def score(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        texts = docs["text"].to_pylist()
        words, _, order = _distinct({w for t in texts for w in lower(t).split()})
        answers: dict[int, list] = {0: [], 1: []}
        for kind, sub, keys, values in zip(*[replies[c].to_pylist() for c in ("kind", "sub", "keys", "values")], strict=True):
            answers[kind].append((sub, keys, exchange.unpack(values, np.float32 if kind else np.int64)))
        counts = np.concatenate([np.zeros(0, np.int64), *[c for *_, c in sorted(answers[0], key=lambda x: x[0])]])
        mine = np.zeros(len(words), np.int64)
        mine[order] = counts
        cost = dict(zip(words, (np.log10(mine + 1.0) - scale).tolist(), strict=True))
        unknown = {w for w, c in zip(words, mine.tolist(), strict=True) if not c}
        end = math.log10(ends + 1.0) - scale
        tokens, known, base = [], [], []
        for t in texts:
            found = lower(t).split()
            tokens.append(len(found) + 1)
            known.append(len(found) - (sum(map(unknown.__contains__, found)) if unknown else 0) + (ends > 0))
            base.append(math.fsum([*map(cost.__getitem__, found), end]))
        raws = [lower(t) for t in texts]
        at = Places(np.concatenate([np.zeros(0, np.uint32), *[keyed_grams(exchange.unpack_sorted(k)) for _, k, _ in answers[1]]]))
        costs = np.concatenate([np.zeros(0, np.float32), *[c for *_, c in answers[1]]])
        of = lambda x, lo, hi: costs[at.of(_grams(x, lo, hi))]
        model = np.concatenate([_sums(raws[i : i + 2000], of) for i in range(0, len(raws), 2000)] or [np.zeros(0)])
        sizes = np.array([len(r) + 1 for r in raws])
        return pa.table({"id": docs["id"], "train": docs["train"], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * len(texts), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(model), "bits_per_byte": pa.array(-model / sizes / math.log10(2))})

    both = counted.withColumn("kind", F.lit(0)).withColumn("keys", F.lit(None).cast("binary")).unionByName(costs.withColumn("kind", F.lit(1)))
    schema = "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = kept(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda k, d, r: score(k, d, r), schema), "scores")
    drop(counted)
    drop(costs)
    return out


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), (crc_mod("doc_id", 7) != 2).alias("train"), "text")
    return lm_scores(docs).select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
