"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows is the example set. Its features are words and word
beginnings that are several times as frequent among toxic examples as among others; their
TF-IDF vectors, with one component for all words, lie in an inverted index whose postings are cut into blocks of examples, with
the largest weight of each feature in each block. A query visits blocks by falling upper
bound and stops where no block can reach its k-th best cosine any more, so the neighbours
are exact. Their votes, weighted by distance and by how many labelled rows each example
stands for, give the score; the neighbours themselves are the evidence.

A text without any feature is searched for in a second block-max index, over the TF-IDF of all words of the
same examples; there a vote falls steeply with distance, so that chance likeness hardly moves the score
from the rate of toxic rows among examples without features, while a copy of a labelled text gets that text's label.

Edge cases: a text without any word of an example (null and empty ones too) gets the rate of toxic
rows among examples without features; equal cosines go to the earlier example; without
labelled rows every score is 0; repeated rows get equal scores. A very long text is one vector of all its
words; an empty table gives an empty result. Only doc_id, text and the labels are read (without_toxic hands all
other columns through), so names never clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import claim, crc_mod, documents, keep_where, map_rows

#: The bounds of the sample and of the index: examples of each label, features, neighbours, examples in a block.
EXAMPLES, FEATURES, NEIGHBOURS, BLOCK = 2048, 1024, 15, 64
#: A feature is so many times as frequent among toxic examples, and so far from chance (chi-square, one degree of freedom).
RATIO, CHI_SQUARE = 4.0, 30.0
BEGINNINGS = (3, 4, 5)
#: Weight of one word of any kind in the vectors' last component, which makes a cosine tell how dense the features are.
OTHER = 0.03
#: The vote of the prior, as that of so many neighbours at cosine 1.
PRIOR_VOTE = 0.1
#: In the index of all words: the power of a cosine that is its vote, and the vote of the prior.
STEEP, PRIOR_WORDS = 8, 0.5
#: Blocks of that index that are looked at first; they set the bound for the others.
FIRST_BLOCKS = 4
CACHE_WORDS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(token: str) -> list[str]:
    """The runs of letters of a token."""
    return [token] if token.isalpha() else _LETTERS.findall(token)


def features(token: str) -> list[str]:
    """Features of a lower-case token between blanks: its words and their beginnings (ended by an asterisk)."""
    out = []
    for word in words_of(token):
        out.append(word)
        out += [word[:n] + "*" for n in BEGINNINGS if len(word) >= n]
    return out


def _features_of(text: str):
    return (f for token in text.lower().split() for f in features(token))


def _chance(c1: int, c0: int, n1: int, n0: int) -> float:
    """Chi-square of a feature that c1 of n1 toxic and c0 of n0 other examples have."""
    both = (c1 + c0) / (n1 + n0)
    return (c1 / n1 - c0 / max(1, n0)) ** 2 / max(1e-12, both * (1 - both) * (1 / n1 + 1 / max(1, n0)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of these starts and sizes, one range after another."""
    ends = np.cumsum(size)
    out = np.repeat(start - ends + size, size)
    out += np.arange(len(out))
    return out


class Words:
    """A block-max inverted index over all words of the examples: unit vectors of (1 + log tf) * log((n + 1) / (df + 1)), at least 1e-3.

    A word's postings lie in order of the examples, so that those of one block are one range; ranges and their largest
    values are the block-max table. A search bounds every block, scores the most promising few, and then all that can still reach the k-th best."""

    def __init__(self, texts: list[str], ids: list[int]):
        counts = [Counter(w for t in text.lower().split() for w in words_of(t)) for text in texts]
        df = Counter(w for c in counts for w in c)
        self.number = {w: i for i, w in enumerate(sorted(df))}
        n = len(texts)
        self.idf = np.array([max(1e-3, math.log((n + 1) / (df[w] + 1))) for w in self.number])
        vectors = [self.vector([self.number[w] for w in c], list(c.values())) for c in counts]
        # examples of one strongest word stand together, so that few blocks have high bounds; those without a word are left out
        self.order = np.array(sorted((i for i, (f, _) in enumerate(vectors) if len(f)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i])), np.int64)
        chosen = [vectors[i] for i in self.order]
        self.blocks = max(1, math.ceil(len(chosen) / BLOCK))
        term = np.concatenate([f for f, _ in chosen]) if chosen else np.zeros(0, np.int64)
        value = np.concatenate([v for _, v in chosen]) if chosen else np.zeros(0)
        at = np.repeat(np.arange(len(chosen)), [len(f) for f, _ in chosen])
        sort = np.lexsort((at, term))
        term, self.at, self.value = term[sort], at[sort], value[sort]
        key = term * self.blocks + self.at // BLOCK
        self.start = np.flatnonzero(np.diff(key, prepend=-1))  # of each word's range in each of its blocks
        self.size = np.diff(np.append(self.start, len(key)))
        self.block = key[self.start] % self.blocks
        self.most = np.maximum.reduceat(self.value, self.start) if len(key) else np.zeros(0)
        self.first = np.searchsorted(key[self.start] // self.blocks, np.arange(len(self.idf) + 1))
        #: Blocks that a search could have scored, and those it did.
        self.met = self.scored = 0

    def numbers(self, token: str) -> list[int]:
        return [self.number[w] for w in words_of(token) if w in self.number]

    def vector(self, words: list[int], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in order, unit vector) of words, some perhaps listed more than once."""
        f, at = np.unique(np.array(words, np.int64), return_inverse=True)
        v = (1 + np.log(np.bincount(at, times, len(f)))) * self.idf[f]
        return f, v / np.sqrt(v @ v) if len(f) else v

    def nearest(self, f: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``order``, cosines) of the k nearest examples, exactly; equal cosines by place."""
        if not len(f):
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.first[f + 1] - self.first[f]
        spans, weight = _ranges(self.first[f], size), np.repeat(v, size)
        block, start, long = self.block[spans], self.start[spans], self.size[spans]
        bound = np.bincount(block, weight * self.most[spans], self.blocks)
        cosine = np.zeros(self.blocks * BLOCK)
        ahead = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        now = np.zeros(self.blocks, bool)
        now[ahead] = True
        done = np.zeros(self.blocks, bool)
        for _ in range(2):
            mine = np.flatnonzero(now[block])
            posts = _ranges(start[mine], long[mine])
            cosine += np.bincount(self.at[posts], np.repeat(weight[mine], long[mine]) * self.value[posts], len(cosine))
            done |= now
            least = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
            now = ~done & (bound > 0) & (bound >= least - 1e-9)
            if not now.any():
                break
        self.met, self.scored = self.met + int((bound > 0).sum()), self.scored + int((done & (bound > 0)).sum())
        cosine = np.round(cosine, 12)
        at = np.flatnonzero(cosine > 0)
        if len(at) > k:
            at = at[cosine[at] >= np.partition(cosine[at], -k)[-k]]
        at = at[np.lexsort((at, -cosine[at]))][:k]
        return at, cosine[at]


class Examples:
    """The block-max inverted indexes over labelled examples: of the telling features, and of all words."""

    def __init__(self, rows: list[tuple[int, int, str]], stands_for: tuple[float, float], k: int = NEIGHBOURS):
        """rows: (id, label, text); stands_for: labelled rows behind each example, by label."""
        self.k = k
        label = np.array([y for _, y, _ in rows], np.int64)
        n1, n0 = int(label.sum()), int((1 - label).sum())
        #: Only what many toxic examples have can become a feature; the rest is not counted any further.
        seen1: Counter = Counter()
        for _, y, text in rows:
            if y:
                seen1.update(set(_features_of(text)))
        seen1 = Counter({f: c for f, c in seen1.items() if _chance(c, 0, n1, n0) >= CHI_SQUARE})
        seen0: Counter = Counter()
        for _, y, text in rows:
            if not y:
                seen0.update(f for f in set(_features_of(text)) if f in seen1)
        rated = []
        for f, c1 in seen1.items():
            p1, p0 = (c1 + 0.5) / (n1 + 1), (seen0[f] + 0.5) / (n0 + 1)
            chance = _chance(c1, seen0[f], n1, n0)
            if p1 >= RATIO * p0 and chance >= CHI_SQUARE:
                rated.append((-chance, f))
        chosen = [f for _, f in sorted(rated)[:FEATURES]]
        self.number = {f: i for i, f in enumerate(chosen)}
        #: The first letters of all features: most words begin with none of these.
        self.heads = {f.rstrip("*")[:3] for f in chosen}
        n = len(rows)
        self.idf = np.array([math.log((n + 1) / (seen1[f] + seen0[f] + 1)) + 1 for f in chosen])
        vectors = [self.vector(Counter(self.number[f] for f in _features_of(text) if f in self.number), len(text.split())) for _, _, text in rows]
        weight = np.array(stands_for)[label]
        empty = np.array([len(v[0]) < 2 for v in vectors], bool)
        #: What a text without features gets: they all are equally near to each other.
        self.prior = float((weight * label)[empty].sum() + 0.5 * stands_for[0] * bool(n)) / max(1e-9, float(weight[empty].sum()) + stands_for[0] + stands_for[1]) if n else 0.0
        # examples with the same strongest feature stand together, so that few blocks have high bounds
        order = sorted(np.flatnonzero(~empty), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1][:-1])]), rows[i][0]))
        # examples without features have one vector: k of them stand for all, with the mean of their labels
        alike = np.flatnonzero(empty)[:k].tolist()
        for i in alike:
            vectors[i] = (np.array([len(chosen)]), np.ones(1))
        self.ids = np.array([rows[i][0] for i in order + alike], np.int64)
        self.label = np.concatenate([label[order], np.full(len(alike), self.prior)])
        self.weight = np.concatenate([weight[order], np.full(len(alike), float(weight[empty].mean()) if alike else 0.0)])
        order += alike
        self.blocks = max(1, math.ceil(len(order) / BLOCK))
        posts: list[list[tuple[int, float]]] = [[] for _ in range(len(chosen) + 1)]
        for at, i in enumerate(order):
            for f, v in zip(*vectors[i], strict=True):
                posts[f].append((at, v))
        self.doc = [np.array([d for d, _ in p], np.int64) for p in posts]
        self.value = [np.array([v for _, v in p]) for p in posts]
        self.start = [np.searchsorted(d, np.arange(self.blocks + 1) * BLOCK) for d in self.doc]
        self.most = np.zeros((len(posts), self.blocks))
        for f, d in enumerate(self.doc):
            np.maximum.at(self.most[f], d // BLOCK, self.value[f])
        self.cache: dict[str, tuple[list[int], list[int]]] = {}
        self.words = Words([text for _, _, text in rows], [i for i, _, _ in rows])
        self.row_ids, self.row_label, self.row_weight = np.array([i for i, _, _ in rows], np.int64), label, weight

    def vector(self, counts: dict[int, int], words: int) -> tuple[np.ndarray, np.ndarray]:
        """(components in order, unit vector); the last component stands for all words."""
        f = np.array([*sorted(counts), len(self.idf)], np.int64)
        v = np.array([*(counts[i] * self.idf[i] for i in f[:-1]), OTHER * max(1, words)])
        return f, v / np.sqrt((v * v).sum())

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The vector of a text over the features."""
        return self._counted(text)[0]

    def _counted(self, text: str):
        """The vector over the features, and the numbers and times of the text's words in the index of all words."""
        cache, heads, number, known = self.cache, self.heads, self.number, self.words.number
        counts, words, times = {}, [], []
        tokens = text.lower().split()
        for token, n in Counter(tokens).items():
            if token.isalpha():
                if token in known:
                    words.append(known[token])
                    times.append(n)
                if token[:3] not in heads:
                    continue
            found = cache.get(token)
            if found is None:
                found = [number[f] for f in features(token) if f in number], [] if token.isalpha() else self.words.numbers(token)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(token) <= 64:
                    cache[token] = found
            telling, others = found
            for f in telling:
                counts[f] = counts.get(f, 0) + n
            for w in others:
                words.append(w)
                times.append(n)
        return self.vector(counts, len(tokens)), words, times

    def nearest(self, f: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples, exactly; equal cosines by place."""
        bound = v @ self.most[f]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == self.k and bound[b] < best[-1] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for i, x in zip(f, v, strict=True):
                s, e = self.start[i][b], self.start[i][b + 1]
                if s < e:
                    scores[self.doc[i][s:e] - b * BLOCK] += x * self.value[i][s:e]
            at = np.flatnonzero(scores > 0)
            best_at, best = np.concatenate([best_at, at + b * BLOCK]), np.round(np.concatenate([best, scores[at]]), 12)
            keep = np.lexsort((best_at, -best))[: self.k]
            best_at, best = best_at[keep], best[keep]
        return best_at, best

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Score between 0 and 1, and the ids of the neighbours that voted."""
        (f, v), words, times = self._counted(text or "")
        if len(f) < 2:
            return self._by_words(words, times)
        at, cosine = self.nearest(f, v)
        vote = self.weight[at] * cosine**2  # far neighbours hardly outweigh the one vote of the prior
        least = PRIOR_VOTE * float(self.weight.min())
        return float(((vote * self.label[at]).sum() + least * self.prior) / (vote.sum() + least)), self.ids[at].tolist()


    def _by_words(self, words: list[int], times: list[int]) -> tuple[float, list[int]]:
        """The score of a text without features, by its neighbours over all words."""
        at, cosine = self.words.nearest(*self.words.vector(words, times), self.k)
        if not len(at):
            return self.prior, []
        at = self.words.order[at]
        vote, least = self.row_weight[at] * cosine**STEEP, PRIOR_WORDS * float(self.row_weight.min())
        return float(((vote * self.row_label[at]).sum() + least * self.prior) / (vote.sum() + least)), self.row_ids[at].tolist()


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Examples:
    """Fits the index. docs: doc_id, text; labels: doc_id, toxic (rows of other values are left out)."""
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    one = lambda y: labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = one(0).unionByName(one(1))  # 2 * most short rows at most
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").collect()
    rows = sorted({(r["text"], r["toxic"]): (r["doc_id"], r["toxic"], r["text"]) for r in sorted(found, reverse=True)}.values())
    taken = Counter(y for _, y, _ in rows)
    return Examples(rows, tuple(sizes.get(y, 0) / max(1, taken[y]) for y in (0, 1)))


def toxicity(df: DataFrame, model: Examples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, evidence (ids of the nearest examples) of each whole text; no shuffle. The index has a fixed size."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        claim("toxicity", sent.value.cache.clear)
        found = [sent.value.score(t) for t in texts]
        return {"id": ids, "score": [s for s, _ in found], "evidence": [e for _, e in found]}

    return map_rows(df, run, "id long, score double, evidence array<long>", id_col, text_col)


def without_toxic(df: DataFrame, model: Examples, text_col: str = "text") -> DataFrame:
    """The rows of df that score under 0.5."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def clean(texts):
        claim("toxicity", sent.value.cache.clear)
        return [sent.value.score(t)[0] < 0.5 for t in texts]

    return keep_where(df, clean, text_col)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity(docs, examples(docs, labelled(spark, sf_dir))).select(
        F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
