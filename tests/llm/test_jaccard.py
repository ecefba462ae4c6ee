import collections
import random

import numpy as np
import pytest

from ridgeline.llm import components, exchange, jaccard


def brute(rows, words=5, percent=75):
    sets, where, links = {}, collections.defaultdict(list), collections.Counter()
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
        sets[i], root[i] = s, i
        both = collections.Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def near_copies(n, seed, length=(6, 90)):
    """Families of texts at all distances, passages that many share, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, originals = [], [[word() for _ in range(rng.randrange(*length))] for _ in range(12)]
    for i in range(n):
        text = list(rng.choice(originals))
        for _ in range(rng.randrange(0, max(1, len(text) // 12) + 1)):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.2:
            text = text[: len(text) // 4] + passage
        if rng.random() < 0.1:
            text = [word() for _ in range(rng.randrange(0, 5))]
        rows.append((i * 3 + 1, " ".join(text)))
    return rows


def ours(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, text string")
    return {r.id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.near_groups(df, **options).collect()}


@pytest.mark.parametrize("seed,frequent", [(1, 32), (2, 2), (3, 4)])
def test_equals_brute_force(spark, seed, frequent):
    rows = near_copies(300, seed)
    assert ours(spark, rows, frequent=frequent) == brute(rows)


def test_large_groups_in_squares(spark, monkeypatch):
    # the block size is read on the driver and in the group's key, so a small one puts groups into squares here too
    rows = near_copies(260, 5)
    monkeypatch.setattr(jaccard, "SQUARE", 16)
    assert ours(spark, rows, frequent=3) == brute(rows)


def test_many_levels_of_the_exchange(spark, monkeypatch):
    rows = near_copies(200, 6)
    monkeypatch.setattr(exchange, "BITS", 2)
    assert len(exchange.levels(20)) == 3
    assert ours(spark, rows, frequent=4, part_bytes=sum(len(t) for _, t in rows) // 20) == brute(rows)


def test_disk_holds_a_share_of_the_texts_and_no_key_twice(spark, monkeypatch):
    """Blocks are asked for and profiled in passes that share none; what comes back to them has no keys."""
    rows, seen = near_copies(200, 7), collections.defaultdict(list)
    plain = jaccard.kept

    def watched(df, name="table"):
        out = plain(df, name)
        seen[name].append((out.columns, {r[0] for r in out.select("block").distinct().collect()} if "block" in out.columns else {r.id for r in out.select("id").collect()} if name == "profiles" else set()))
        return out

    monkeypatch.setattr(jaccard, "kept", watched)
    monkeypatch.setattr(exchange, "kept", watched)
    monkeypatch.setattr(exchange, "BITS", 2)
    assert ours(spark, rows, part_bytes=sum(len(t) for _, t in rows) // 20) == brute(rows)
    for name in ("asked", "profiles"):
        one, two = (found for _, found in seen[name])
        assert one and two and not one & two and len(one | two) > 60
    assert seen["sums"] and seen["answers"] and all("keys" not in columns for name in ("sums", "answers") for columns, _ in seen[name])


def test_shared_sentences_stay_near_linear(spark, monkeypatch):
    """Texts of sentences that eight texts share chain up into one candidate component without a link in it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    n = 3000
    pool = [" ".join(word() for _ in range(rng.randrange(28, 40))) for _ in range(n * 20 // 8)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(20))) for i in range(n)]
    rows += [(n + i, rows[i][1] + " and so on") for i in range(0, 40)]  # and some near copies among them
    sizes = collections.defaultdict(int)
    plain = jaccard.kept

    def counted(df, name="table"):
        out = plain(df, name)
        if name in ("pairs", "large"):
            sizes[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "kept", counted)
    got = ours(spark, rows)
    assert sizes["large"] > n / 2 and 40 <= sizes["pairs"] < 3 * n
    assert got == brute(rows)


def test_driver_tables(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(spark, rows) == brute(rows)


def test_every_link_shares_a_signature():
    """The promise of the index, on sets alone: pairs at the threshold, for many sizes and both classes."""
    rng = np.random.default_rng(1)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(2, 60))
        universe = np.sort(rng.integers(0, 2**63 - 1, 400).astype(np.uint64))
        shared = rng.choice(400, n, replace=False)
        own = lambda: rng.choice(400, int(rng.integers(0, max(1, n // 3))), replace=False)
        a, b = np.unique(np.concatenate([shared, own()])), np.unique(np.concatenate([shared, own()]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        tried += 1
        rare_below = int(rng.integers(0, 400))
        sigs = [jaccard.signatures(universe[s], len(s), 0, int((s < rare_below).sum())) for s in (a, b)]
        assert len(np.intersect1d(*sigs)) or (len(a) == len(b) == inter and len(a) < 3)
    assert tried > 500


def test_edges(spark, edge, none):
    got = {r.id: r for r in jaccard.near_groups(edge.select(edge.doc_id.alias("id"), "text")).collect()}
    assert len(got) == edge.count()
    assert all(got[i].n_shingles == 0 and got[i].component_id == i and got[i].n_links == 0 for i in (0, 1, 2, 9))
    assert got[3].n_shingles == 1 and got[5].component_id == 4 and got[4].n_links == 1
    assert jaccard.near_groups(none.select(none.doc_id.alias("id"), "text")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 40)] + [(5, 7), (39, 39), (8, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(7, 40)}, 5: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
