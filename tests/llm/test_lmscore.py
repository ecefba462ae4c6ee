import collections
import functools
import math
import zlib

import numpy as np
import pytest

from ridgeline.llm import exchange, lmscore

from .conftest import DATA


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in lmscore.op10_lmscore(spark, DATA).collect()}


def train(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


def test_base_scores(scored, docs):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    counts, ends = collections.Counter(), 0
    for i, w in rows:
        if train(i):
            counts.update(w)
            ends += 1
    n, v = counts.total() + ends, len(counts) + 1
    for i, w in rows:
        r = scored[i]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(w) + 1, n, not train(i))
        assert r.n_known == sum(counts[x] > 0 for x in w) + 1 and r.base_score == pytest.approx(base, abs=1e-6)


class Brute:
    """Context-tree weighting by its recursion."""

    def __init__(self, texts, depth=3):
        self.depth, self.bits = depth, collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
        for t in texts:
            x = bytes(depth) + t + b"\0"
            for i in range(depth, len(x)):
                for d in range(depth + 1):
                    for level in range(8):
                        self.bits[x[i - d : i]][level, x[i] >> (8 - level)][(x[i] >> (7 - level)) & 1] += 1
        self.below = collections.defaultdict(list)
        for c in list(self.bits):
            if c:
                self.below[c[1:]].append(c)

    @functools.cache  # noqa: B019
    def weighted(self, ctx, node):
        a, b = self.bits[ctx].get(node, (0, 0))
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(ctx) == self.depth:
            return own, own
        return np.logaddexp(own, sum(self.weighted(c, node)[0] for c in self.below[ctx])) + math.log(0.5), own

    def one(self, ctx, d, node):
        c = ctx[len(ctx) - d :] if d else b""
        if c not in self.bits:
            return 0.5
        a, b = self.bits[c].get(node, (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return p
        both, own = self.weighted(c, node)
        w = math.exp(own + math.log(0.5) - both)
        return w * p + (1 - w) * self.one(ctx, d + 1, node)

    def log10(self, t):
        x, out = bytes(self.depth) + t + b"\0", 0.0
        for i in range(self.depth, len(x)):
            for level in range(8):
                p = self.one(x[i - self.depth : i], 0, (level, x[i] >> (8 - level)))
                out += math.log10(p if (x[i] >> (7 - level)) & 1 else 1 - p)
        return out


def test_model_scores_equal_the_recursion(spark):
    texts = ["abracadabra abra", "the cat and the dog", "", "Zürich!", None]
    probes = [*texts, "the dog", "qqq\x00\x7f", "ABRA", "the dog the dog"]
    rows = [(i, True, t) for i, t in enumerate(texts)] + [(100 + i, False, t) for i, t in enumerate(probes)]
    got = {r.id: r.score for r in lmscore.lm_scores(spark.createDataFrame(rows, "id long, train boolean, text string")).collect()}
    brute = Brute([lmscore.lower(t) for t in texts])
    for i, probe in enumerate(probes):
        assert got[100 + i] == pytest.approx(brute.log10(lmscore.lower(probe)), rel=1e-4)


def test_many_levels_of_the_exchange(spark, docs, monkeypatch):
    rows = docs.limit(60).selectExpr("doc_id AS id", "doc_id % 5 <> 0 AS train", "text")
    one = {r.id: r for r in lmscore.lm_scores(rows).collect()}
    monkeypatch.setattr(exchange, "BITS", 2)
    size = sum(len(r.text or "") for r in rows.collect())
    assert len(exchange.levels(24)) == 3
    many = {r.id: r for r in lmscore.lm_scores(rows, part_bytes=size // 24).collect()}
    assert many.keys() == one.keys()
    for i, r in one.items():
        assert (many[i].n_known, many[i].train_tokens) == (r.n_known, r.train_tokens)
        assert many[i].base_score == pytest.approx(r.base_score) and many[i].score == pytest.approx(r.score, rel=1e-5)


def test_chunks_do_not_change_sums(docs, monkeypatch):
    raws = [lmscore.lower(r.text) for r in docs.limit(20).collect()]
    cost = lambda x, lo, hi: x[lo:hi].astype(float) + x[lo - 1 : hi - 1]
    whole = lmscore._sums(raws, cost)
    monkeypatch.setattr(lmscore, "CHUNK", 501)
    assert np.allclose(lmscore._sums(raws, cost), whole)


def test_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored.values() if r.held_out and r.n_tokens > 50]
    assert held and np.mean([r.bits_per_byte for r in held]) < 3.0


def test_edges(edge, none, spark):
    rows = edge.selectExpr("doc_id AS id", "doc_id % 2 = 0 AS train", "text")
    got = {r.id: r for r in lmscore.lm_scores(rows).collect()}
    assert len(got) == edge.count() and got[0].n_tokens == got[1].n_tokens == 1 and got[0].score == got[1].score
    untrained = {r.id: r for r in lmscore.lm_scores(rows.selectExpr("id", "false AS train", "text")).collect()}
    assert untrained[3].score == pytest.approx(5 * 8 * math.log10(0.5), rel=1e-5) and untrained[3].n_known == 0 and untrained[3].train_tokens == 0
    assert lmscore.lm_scores(none.selectExpr("doc_id AS id", "true AS train", "text")).count() == 0


def test_every_context_keeps_its_own_estimates(spark, monkeypatch):
    """More contexts of two and of three bytes than the 16,384 that were kept once; the recursion has no bound."""
    monkeypatch.setattr(lmscore, "CONTEXTS_AT_ONCE", 500, raising=False)
    rng = np.random.default_rng(5)
    often = "".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 9000)) * 2
    texts = [often, "rare words, seen once: quixotic zephyr", "quixotic zephyr", "never 見る\x7f", None]
    rows = spark.createDataFrame([(i, i < 2, t) for i, t in enumerate(texts)], "id long, train boolean, text string")
    brute = Brute([lmscore.lower(t) for t in texts[:2]])
    assert sum(len(c) == 3 for c in brute.bits) > 16_384
    got = {r.id: r.score for r in lmscore.lm_scores(rows).collect()}
    for i, t in enumerate(texts[1:], 1):
        assert got[i] == pytest.approx(brute.log10(lmscore.lower(t)), rel=1e-4)
