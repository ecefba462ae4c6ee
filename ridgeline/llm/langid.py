"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes long, with escape method C: in
a context of T symbols, U of them distinct, a symbol seen c times costs -log2(c / (T + U))
bits and an unseen one -log2(U / (T + U)) bits and then its cost one byte of context
shorter; below the empty context every byte costs 8 bits. Statistics are frozen after
training, so the exact code length of a text under every language is a sum of table cells;
the tables of all languages share one trie, whose nodes are found for all positions at once.

Edge cases: a null text, or one without a letter (of a Unicode letter category), is ``und`` with score 0; ties go to the
first language in order; without any training row every text is ``und``; other languages
than those learned are taken for the nearest one. A very long text is scored whole, in chunks; repeated rows get equal
results and count once in the sample; an empty table gives an empty result. Only the id, text and language columns are read, so names never clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import crc_mod, documents, map_rows

ORDER = 4
#: The bound of the training sample: bytes of text for each language, from the documents with the smallest id hashes.
SAMPLE_BYTES = 400_000
#: Positions scored at a time.
CHUNK = 1 << 18


def training_sample(rows: DataFrame, most: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """lang -> distinct texts of at most ``most`` bytes in all. rows: id, lang, text."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("id", "text"))
    sizes = {r["lang"]: max(2 * most / max(1, r["b"]), 40 / r["n"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    #: Below that hash lies about twice the sample, and about 40 rows at least; where it is too little, all is taken.
    cut = {k: min(2**63 - 1, int(min(1.0, share) * 2**64) - 2**63) for k, share in sizes.items()}
    limit = F.create_map(*[F.lit(x) for k, v in cut.items() for x in (k, v)])
    out: dict[str, list[str]] = {}
    left = dict.fromkeys(cut, most)
    for r in sorted(rows.filter(F.col("h") <= limit[F.col("lang")]).select("lang", "h", F.substring("text", 1, most).alias("text")).collect(), key=lambda r: (r["h"], r["text"])):
        size = len(r["text"].encode("utf-8", "surrogatepass"))
        if left[r["lang"]] > 0 and r["text"] not in out.setdefault(r["lang"], []):
            out[r["lang"]].append(r["text"].encode("utf-8", "surrogatepass")[: left[r["lang"]]].decode("utf-8", "ignore"))
            left[r["lang"]] -= size
    return out


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class ContextTrees:
    """Frozen PPM statistics of all languages in one trie of byte strings."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        if not texts:
            return
        n = len(self.langs)
        raw = [np.frombuffer(b"".join(b"\n" * order + _bytes(t) for t in texts[k]) or b"\n", np.uint8) for k in self.langs]
        seen = np.unique(np.concatenate(raw))
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no sample has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = a = len(seen) + 1
        text = [self.symbol[r] for r in raw]
        node = [np.zeros(len(t) + 1, np.int64) for t in text]  # of the string ending before each position; 0: empty string
        #: child[m][node of m bytes * width + symbol] -> node of m + 1 bytes, 0 for none
        self.child, self.cost, self.escape = [], [], []
        nodes, shorter = 1, np.full((a, n), 8.0)  # cost of each symbol below the empty context
        tails = np.zeros(1, np.int64)
        for m in range(order + 1):
            ends = [nd[:-1] * a + t if m == 0 else (nd[m - 1 : -2] * a + t[m:] if len(t) > m else np.zeros(0, np.int64)) for nd, t in zip(node, text, strict=True)] if m else [t.astype(np.int64) for t in text]
            keys = np.unique(np.concatenate(ends))
            child = np.zeros(nodes * a if m else a, np.int32)
            child[keys] = np.arange(1, len(keys) + 1)
            ctx, sym = keys // a, keys % a
            count = np.stack([np.bincount(child[e], minlength=len(keys) + 1)[1:] for e in ends], 1).astype(float)
            total, distinct = np.zeros((nodes, n)), np.zeros((nodes, n))
            np.add.at(total, ctx, count)
            np.add.at(distinct, ctx, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = -np.log2(count / (total + distinct)[ctx])
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            # the same string without its oldest byte, one level up
            below = shorter[sym] if m == 0 else shorter[self.child[m - 1][tails[ctx] * a + sym]]
            cost = np.where(count > 0, direct, escape[ctx] + below)
            self.child.append(child)
            self.escape.append(escape.astype(np.float32))
            shorter = np.vstack([np.zeros((1, n)), cost])
            self.cost.append(shorter.astype(np.float32))
            tails = np.concatenate([[0], sym * 0 if m == 0 else self.child[m - 1][tails[ctx] * a + sym]]).astype(np.int64)
            new = []
            for nd, e in zip(node, ends, strict=True):
                x = np.zeros_like(nd)
                x[m : m + len(e)] = child[e]
                new.append(x)
            node, nodes = new, len(keys) + 1

    def bits(self, raws: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        pad, n, a = self.order, len(self.langs), self.width
        x = self.symbol[np.frombuffer(b"".join(b"\n" * pad + r for r in raws), np.uint8)]
        sizes = np.array([len(r) for r in raws])
        start = np.cumsum(sizes + pad) - sizes
        out = np.zeros((len(raws), n))
        for lo in range(0, len(x), CHUNK):
            hi, back = min(len(x), lo + CHUNK), max(0, lo - pad)
            part = x[back:hi]
            ids = [self.child[0][part]]
            for m in range(1, pad + 1):
                deeper = np.zeros(len(part), np.int32)
                deeper[m:] = self.child[m][ids[-1][m - 1 : -1].astype(np.int64) * a + part[m:]]
                # a string is only there where its context is: node 0 stands for none
                deeper[m:][ids[-1][m - 1 : -1] == 0] = 0
                ids.append(deeper)
            skip = lo - back
            cost = self.cost[pad][ids[pad][skip:]]
            open_ = np.flatnonzero(ids[pad][skip:] == 0) + skip
            for m in range(pad, 0, -1):
                if not len(open_):
                    break
                ctx = np.where(open_ > 0, ids[m - 1][open_ - 1], 0)
                cost[open_ - skip] += np.where((ctx > 0)[:, None], self.escape[m][ctx], 0)
                shorter = ids[m - 1][open_]
                cost[open_ - skip] += self.cost[m - 1][shorter]
                open_ = open_[shorter == 0]
            cost[open_ - skip] += self.escape[0][0] + 8.0
            first, last = np.searchsorted(start + sizes, lo, "right"), np.searchsorted(start, hi, "left")
            for i in range(first, last):
                s, e = max(start[i], lo), min(start[i] + sizes[i], hi)
                if e > s:
                    out[i] += cost[s - lo : e - lo].sum(0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if at:
            bits = self.bits([_bytes(texts[i]) for i in at])
            best = bits.argmin(1)
            for i, b, k in zip(at, bits, best, strict=True):
                lang[i], score[i] = self.langs[k], float(1 / np.exp2(-np.minimum(b - b[k], 1000.0)).sum())
        return lang, score


def predictions(df: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, score of each whole text. The model's size is bounded by the training sample's."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        lang, score = sent.value.predict(texts)
        return {"id": ids, "lang": lang, "score": score}

    return map_rows(df, run, "id long, lang string, score double", id_col, text_col)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = ContextTrees(training_sample(docs.filter(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "lang", "text")))
    return predictions(docs, model).select(F.col("id").alias("doc_id"), (crc_mod("id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
