"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

A text is contaminated by an item if some stretch of it lies within EDITS of the item's length
in edit distance (over lower-case UTF-8 bytes). The steps, all in one pass over the texts:

1. Gate, without loss: a stretch within k edits of an item of L bytes keeps at least
   L + 1 - q - k q of its q-grams, at offsets that differ by k at most. Only places where
   some item has that many grams on about one diagonal are looked at further, and of these
   only where that many lie on k + 1 neighbouring diagonals: the stretch starts within k of them.
   Grams that an item repeats over REPEATS times aren't counted on diagonals (the rest of its grams must then keep
   all k q); an item with too few others is looked for where enough positions have any of its grams.
   Items so short that the rule grants no gram (some under 32 bytes) are cut into k + 1 parts instead,
   of which an edited stretch keeps one whole: wherever a part occurs, the item is verified.
2. Embedding: there, a window of the item's size starts at every byte, whatever the script. The
   CGK random walk writes window and item as longer strings, turning edits into few Hamming differences.
   Items over LONGEST_WALK bytes are walked in several parts, since a walk over very many edits loses its way.
3. LSH: each of TABLES tables samples BITS places of one of WALKS walks; a window and an
   item that agree on one table's sample, in one part, are candidates.
4. Verification: exact bit-parallel edit distance of the item against each stretch of overlapping windows, in
   one go. Stretches without a window that some table named are verified last, so that LSH decides the
   order, not what is found.

Edge cases: null and empty texts hit nothing; null and empty items are skipped; an item under 10 bytes must
occur as it is, however common it be; a very long text is worked on whole, as one string of bytes;
repeated items and repeated rows each give their rows; equal distances go to the first place;
an empty table on either side gives an empty result. Only the columns named are read (without_leaks hands
all others through), so names never clash. The benchmark is held by every worker:
its size is checked against ITEM_BYTES, and larger ones are done in rounds of that size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import claim, documents, keep_where, mix, slices

EDITS = 0.1
Q = 8
#: Repetitions for a recall over 0.95 of items copied with any edits within EDITS (tests/llm).
WALKS, TABLES, BITS = 8, 64, 5
#: Bytes of an item that are walked at once, at most.
LONGEST_WALK = 256
#: Benchmark bytes held by a worker at a time.
ITEM_BYTES = 16 << 20
#: Bytes looked at beyond a window when it is verified, besides the item's edits.
ROOM = 32
_GRAM_SPACE = 22
_CHUNK = 1 << 16
#: Places of one gram in an item up to which they are kept apart; a gram of more isn't counted on diagonals.
REPEATS = 16
#: Windows of one run that are embedded, at most.
WALKED = 1024
#: Places of grams that are looked at together.
PLACES = 1 << 19
_SEED = 20240229


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def edit_search(item: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of text, that stretch's end); bit-parallel over the item."""
    m = len(item)
    if not m:
        return 0, 0
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, d = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | minus
        zero = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if up & top:
            d += 1
        elif down & top:
            d -= 1
        if d < best:
            best, end = d, j + 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return best, end


class Benchmark:
    """Everything a worker needs to know of the items."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS):
        self.q, self.edits = (q := Q), edits
        self.ids, self.raw = [], []
        #: short item -> (bytes, edits, parts with their offsets)
        self.short: list[tuple[int, bytes, int, list[tuple[int, bytes]]]] = []
        texts = [(i, raw) for i, t in items if (raw := normal(t))]
        grams = lambda raw: len(raw) + 1 - q - int(len(raw) * edits) * q
        for i, raw in texts:
            if grams(raw) >= 1:
                self.ids.append(i)
                self.raw.append(raw)
        for i, raw in texts:
            if grams(raw) < 1:
                k = int(len(raw) * edits)
                cuts = [len(raw) * j // (k + 1) for j in range(k + 2)]
                self.short.append((len(self.ids), raw, k, [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]))
                self.ids.append(i)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.most = np.floor(self.size * edits).astype(np.int64)
        self.need = self.size + 1 - q - self.most * q
        self.width = max(64, int(self.most.max(initial=0)) + 1)  # of a band of diagonals
        code = [self.gram(np.frombuffer(r, np.uint8)) for r in self.raw]
        owner, offset = [], []
        #: items whose grams repeat so much that too few are left for the gate: (item, its distinct grams in order)
        self.dense: list[tuple[int, np.ndarray]] = []
        for i, grams_of in enumerate(code):
            distinct, which, times = np.unique(grams_of, return_inverse=True, return_counts=True)
            rare = np.flatnonzero(times[which] <= REPEATS)
            left = len(rare) - int(self.most[i]) * q  # of the rare ones alone, so many must be left by all edits
            if left < 1:
                self.dense.append((i, distinct))
                rare = rare[:0]
            self.need[i] -= len(grams_of) - len(rare) if left >= 1 else 0
            code[i] = grams_of[rare]
            owner.append(np.full(len(rare), i))
            offset.append(rare)
        self.repeated = np.unique(np.concatenate([np.zeros(0, np.int64), *[d for _, d in self.dense]]))
        #: gram -> its stretch of owners and offsets; grams of one hash share theirs, which only adds hits
        keys, at = np.unique(np.concatenate(code or [np.zeros(0, np.int64)]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.owner, self.offset = (np.concatenate(v or [np.zeros(0, np.int64)])[order] for v in (owner, offset))
        self.row = np.zeros(1 << _GRAM_SPACE, np.int32)
        self.row[keys] = np.arange(1, len(keys) + 1)
        self.begin = np.concatenate([[0, 0], np.cumsum(np.bincount(at, minlength=len(keys)))])[: len(keys) + 2]
        rng = np.random.default_rng(_SEED)
        # parts that are walked: item, offset, size; in steps of a quarter of the size, walks end with the smallest part of the step
        parts = [(i, n * j // m, n * (j + 1) // m) for i, n in enumerate(self.size.tolist()) for m in [-(-n // LONGEST_WALK)] for j in range(m)]
        parts = np.array(parts, np.int64).reshape(-1, 3)
        step = np.floor(np.log(np.maximum(parts[:, 2] - parts[:, 1], 1)) / np.log(1.25)).astype(int)
        self.steps = [Step(self, parts[step == s], rng) for s in np.unique(step)]

    def gram(self, x: np.ndarray) -> np.ndarray:
        """A number below 2 ** _GRAM_SPACE for the q = 8 bytes from each position on."""
        if len(x) < self.q:
            return np.zeros(0, np.int64)
        words = np.ndarray((len(x) - self.q + 1,), "<u8", np.ascontiguousarray(x), strides=(1,))
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _GRAM_SPACE)).astype(np.int64)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, first positions of the windows to embed): every byte where a stretch that passes the gate may start.

        The text is looked at in stretches with about PLACES places of grams, each with what the longest window may
        reach into behind it, so that memory doesn't grow with how often grams repeat in the text and the items."""
        at, rows = [], []
        for lo in range(0, len(x), _CHUNK):
            row = self.row[self.gram(x[lo : lo + _CHUNK + self.q - 1])]
            hit = np.flatnonzero(row)
            at.append(hit + lo)
            rows.append(row[hit])
        at, rows = np.concatenate(at), np.concatenate(rows)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.cumsum(self.begin[rows + 1] - self.begin[rows])
        reach, found, low, begin = int((self.size + 2 * self.most).max()) + self.q, [], -(1 << 60), 0
        while begin < len(at):
            end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PLACES, "right"))
            end = max(end, int(np.searchsorted(at, at[begin] + reach)), begin + 1)
            high = int(at[end]) - reach if end < len(at) and at[end] - reach > max(low, at[begin]) else None
            if end < len(at) and high is None:  # stretches advance by a reach at least
                end = int(np.searchsorted(at, at[begin] + 2 * reach))
                high = int(at[begin]) + reach if end < len(at) else None
            item, window = self._gate(at[begin:end], rows[begin:end], len(x))
            inside = window >= low if high is None else (window >= low) & (window < high)
            found.append((item[inside], window[inside]))
            if high is None:
                break
            low, begin = high, int(np.searchsorted(at, high - int(self.most.max())))
        item, window = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((window, item))
        return item[order], window[order]

    def _gate(self, at: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows that these grams (positions and rows) let through."""
        first, many = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        each = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        item = self.owner[each]
        most = int(self.size.max())
        diagonal = np.repeat(at, many) - self.offset[each] + most
        bands = length // self.width + most // self.width + 3
        all_keys = item * bands + diagonal // self.width
        key = np.sort(all_keys)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        key, n = key[new], np.diff(np.append(new, len(key)))
        # a band and the one after it together: no set of diagonals that lie close straddles both ends
        after = np.searchsorted(key, key + 1)
        both = n + np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), n[np.minimum(after, len(key) - 1)], 0) if len(key) else n
        keep = both >= self.need[key // bands]
        # of these bands, the diagonals that begin k + 1 neighbouring ones with enough grams
        passed = np.isin(all_keys, np.concatenate([key[keep], key[keep] + 1]))
        wide = length + 4 * most
        found = np.sort(item[passed] * wide + diagonal[passed])
        enough = np.searchsorted(found, found + self.most[found // wide], "right") - np.arange(len(found)) >= self.need[found // wide]
        found = np.unique(found[enough])
        # the stretch starts within k of such a diagonal; what the one before has covered is left out
        item, diagonal = found // wide, found % wide - most
        lo, hi = diagonal - self.most[item], diagonal + self.most[item] + 1
        again = np.flatnonzero(item[1:] == item[:-1]) + 1
        lo[again] = np.maximum(lo[again], hi[again - 1])
        many = hi - lo
        return np.repeat(item, many), np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))

    def _dense_ranges(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end): where x may hold a repetitive item. Of its gram positions, too many survive k edits for a window
        that has fewer positions with any of its grams; these are counted without regard to diagonals."""
        hits = [lo + np.flatnonzero(np.isin(self.gram(x[lo : lo + _CHUNK + self.q - 1]), self.repeated)) for lo in range(0, len(x), _CHUNK)]
        at = np.concatenate([np.zeros(0, np.int64), *hits])
        out = []
        for i, grams in self.dense if len(at) else ():
            reach, need = int(self.size[i] + self.most[i]), int(self.need[i])
            begins = np.flatnonzero(np.searchsorted(at, at + reach) - np.arange(len(at)) >= need)
            if not len(begins):
                continue
            words = np.ndarray((len(x) - self.q + 1,), "<u8", np.ascontiguousarray(x), strides=(1,))[at]
            mine = at[np.isin(((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _GRAM_SPACE)).astype(np.int64), grams)]
            begins = mine[np.searchsorted(mine, mine + reach) - np.arange(len(mine)) >= need]
            if len(begins):
                new = np.flatnonzero(np.concatenate([[True], begins[1:] - begins[:-1] > 2 * reach]))
                out += [(i, int(a) - reach, int(b) + reach) for a, b in zip(begins[new], begins[np.append(new[1:], len(begins)) - 1], strict=True)]
        return out

    def find(self, raws: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the best stretch of each contaminated pair; places in bytes."""
        out = self._find_short(raws) if self.short else {}
        if self.raw and raws:
            out |= self._find_long(raws)
        return [(d, i, *v) for (d, i), v in sorted(out.items())]

    def _find_short(self, raws: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, text in enumerate(raws):
            for i, item, k, parts in self.short:
                if (at := text.find(item)) >= 0:
                    out[doc, i] = (0, at, at + len(item))
                    continue
                for offset, part in parts if k else ():
                    at = text.find(part)
                    while at >= 0:
                        lo, hi = max(0, at - offset - k), at - offset + len(item) + k
                        d, end = edit_search(item, text[lo:hi])
                        if d <= k:
                            begin = end - edit_search(item[::-1], text[lo : lo + end][::-1])[1]
                            out[doc, i] = min(out.get((doc, i), (d, lo + begin, lo + end)), (d, lo + begin, lo + end))
                        at = text.find(part, at + 1)
        return out

    def _find_long(self, raws: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
        gap = b"\0" * int(self.size.max() + self.most.max())
        x = np.frombuffer(gap.join(raws) + gap, np.uint8)
        size = np.array([len(r) for r in raws], np.int64)
        start = np.cumsum(size + len(gap)) - (size + len(gap))
        items, windows = self.places(x)
        doc = np.maximum(np.searchsorted(start, windows, "right") - 1, 0)
        within = (windows >= start[doc]) & (windows < start[doc] + size[doc])
        ranges = self._ranges(x, np.stack([items[within], windows[within]], 1), doc[within]) if within.any() else []
        for i, a, b in self._dense_ranges(x) if self.dense else ():
            ranges += [(True, d, i, a, b) for d in range(max(0, int(np.searchsorted(start, a, "right")) - 1), int(np.searchsorted(start, b)))]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for _, d, i, a, b in sorted(ranges):
            known = out.get((d, i))
            if known and known[0] == 0:
                continue
            lo, hi = max(int(start[d]), a), min(int(start[d] + size[d]), b)
            found = self._verified(i, x[lo:hi].tobytes())
            if found and (known is None or (found[0], lo - int(start[d]) + found[1]) < known[:2]):
                out[d, i] = (found[0], lo - int(start[d]) + found[1], lo - int(start[d]) + found[2])
        return out

    def _ranges(self, x: np.ndarray, pairs: np.ndarray, doc: np.ndarray) -> list[tuple[bool, int, int, int, int]]:
        """(missed by the tables, doc, item, start, end): windows of an item that overlap, with some room, as one stretch to verify."""
        item = pairs[:, 0]
        lo, hi = pairs[:, 1] - self.most[item] - ROOM, pairs[:, 1] + self.size[item] + self.most[item] + ROOM
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])]))
        last = np.append(new[1:], len(pairs)) - 1
        # of a long run of windows (repetitive text) the tables see some, evenly spread: they only order what is verified
        many = last - new + 1
        seen = np.flatnonzero((np.arange(len(pairs)) - np.repeat(new, many)) % np.repeat(-(-many // WALKED), many) == 0)
        some, agreed = np.zeros(len(seen), bool), np.zeros(len(pairs), bool)
        for step in self.steps:
            step.agree(x, pairs[seen], some)
        agreed[seen] = some
        missed = ~np.logical_or.reduceat(agreed, new)
        return list(zip(missed.tolist(), doc[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True))

    def _verified(self, item: int, text: bytes) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best stretch of text, if it is near enough."""
        raw, k = self.raw[item], int(self.most[item])
        if (exact := text.find(raw)) >= 0:
            return 0, exact, exact + len(raw)
        d, end = edit_search(raw, text)
        if d > k:
            return None
        back = text[max(0, end - len(raw) - k) : end][::-1]
        return d, end - edit_search(raw[::-1], back)[1], end


class Step:
    """Parts of items of about one size: their walks and their LSH tables."""

    def __init__(self, items: Benchmark, parts: np.ndarray, rng: np.random.Generator):
        """parts: rows of item, first byte, end."""
        self.item, self.offset = parts[:, 0], parts[:, 1]  # by item
        least = int((parts[:, 2] - parts[:, 1]).min())
        self.outputs = 2 * least  # windows are walked about as far as the smallest part reaches
        self.moves = rng.integers(0, 2, (WALKS, self.outputs, 256), dtype=np.uint8)
        self.walk_of = np.arange(TABLES) % WALKS
        self.places = [np.sort(rng.choice(self.outputs, min(BITS, self.outputs), replace=False)) for _ in range(TABLES)]
        raws = [np.frombuffer(items.raw[i][a:] + b"\0" * (self.outputs + 1), np.uint8)[: self.outputs + 1] for i, a in parts[:, :2].tolist()]
        #: table -> the parts' keys
        self.tables = self.keys(np.concatenate(raws), np.arange(len(raws)) * (self.outputs + 1))

    def keys(self, x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """A hash of the sampled places of the embedded strings from ``begin`` on, for each table."""
        out: list = [None] * TABLES
        for walk in range(WALKS):
            mine = np.flatnonzero(self.walk_of == walk)
            state = {t: np.full(len(begin), t + 1, np.uint64) for t in mine}
            wanted: dict[int, list[int]] = defaultdict(list)
            for t in mine:
                for place in self.places[t]:
                    wanted[int(place)].append(int(t))
            at, moves = begin.astype(np.int64).copy(), self.moves[walk]
            for j in range(self.outputs):
                c = x[at]
                for t in wanted.get(j, ()):
                    state[t] = mix(state[t] * np.uint64(257) + c + np.uint64(1))
                at += moves[j][c]
            for t in mine:
                out[t] = state[t]
        return out

    def agree(self, x: np.ndarray, pairs: np.ndarray, agreed: np.ndarray) -> None:
        """Marks the pairs (item, window) one of whose parts here falls into the item's bucket in one table at least."""
        # a walk may leave the text's end: there it reads zeros, as an item's does
        padded = np.concatenate([x, np.zeros(self.outputs + 1, np.uint8)])
        first, last = np.searchsorted(self.item, pairs[:, 0]), np.searchsorted(self.item, pairs[:, 0], "right")
        many = last - first
        pair = np.repeat(np.arange(len(pairs)), many)
        part = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(pair))
        for lo in range(0, len(pair), 100_000):
            of, which = part[lo : lo + 100_000], pair[lo : lo + 100_000]
            begin = np.minimum(pairs[which, 1] + self.offset[of], len(x))
            for keys, known in zip(self.keys(padded, begin), self.tables, strict=True):
                agreed[which[keys == known[of]]] = True


def in_rounds(items: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), in lists of at most ``most`` bytes; one list is held at a time."""
    chosen, held = [], 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        size = len(row["text"].encode("utf-8", "surrogatepass"))
        if chosen and held + size > most:
            yield chosen
            chosen, held = [], 0
        chosen.append((row["item_id"], row["text"]))
        held += size
    if chosen:
        yield chosen


def without_leaks(df: DataFrame, items: DataFrame, edits: float = EDITS, text_col: str = "text", most: int = ITEM_BYTES) -> DataFrame:
    """The rows of df that no item contaminates; no shuffle."""
    for chosen in in_rounds(items, most):
        sent = df.sparkSession.sparkContext.broadcast(Benchmark(chosen, edits))

        def clean(texts, sent=sent):
            claim("decontam", lambda: None)
            hit = {d for d, *_ in sent.value.find([normal(t) for t in texts])}
            return [i not in hit for i in range(len(texts))]

        df = keep_where(df, clean, text_col)
    return df


def leaks(df: DataFrame, items: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", most: int = ITEM_BYTES) -> DataFrame:
    """id, item_id, distance, start, end (bytes of the lower-case text) for each contaminated pair. No shuffle.

    items: item_id, text. Rounds of at most ``most`` bytes of items, each one pass over df."""
    spark = df.sparkSession
    schema = "id long, item_id long, distance int, start long, end long"
    out = spark.createDataFrame([], schema)
    for number, chosen in enumerate(in_rounds(items, most)):
        sent = spark.sparkContext.broadcast(Benchmark(chosen, edits))

        def run(batches, sent=sent):
            import pyarrow as pa

            claim("decontam", lambda: None)
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    ids, bench = part.column(0).to_pylist(), sent.value
                    found = bench.find([normal(t) for t in part.column(1).to_pylist()])
                    rows = [(ids[d], bench.ids[i], dist, s, e) for d, i, dist, s, e in found]
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "item_id", "distance", "start", "end"])

        each = df.select(id_col, text_col).mapInArrow(run, schema)
        out = each if number == 0 else out.unionByName(each)
    return out


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(documents(spark, sf_dir), items).withColumnRenamed("id", "doc_id")
