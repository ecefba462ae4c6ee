import random

import numpy as np
import pytest

from ridgeline.llm import decontam

from .conftest import DATA


def distance(a, b):
    """Least edit distance of a to a stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]


def edited(text, rate, rng):
    out = list(text)
    for _ in range(int(len(text) * rate)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [rng.choice("abcdefgh ")], [out[at], rng.choice("abcdefgh ")]])
    return "".join(out)


def test_search_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 15)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40)))
        assert decontam.edit_search(a, b)[0] == distance(a, b)


@pytest.mark.parametrize("rate,recall", [(0.0, 1.0), (0.03, 0.99), (0.06, 0.97), (0.09, 0.9)])
def test_recall(items, docs, rate, recall):
    rng, bench = random.Random(7), decontam.Benchmark(items)
    around = [r.text[:400] for r in docs.select("text").limit(40).collect()]
    texts = [decontam.normal(f"{a} {edited(t, rate, rng)} {a[::-1]}") for a, (_, t) in zip(around * 5, items, strict=False)]
    found = {(d, i) for d, i, *_ in bench.find(texts)}
    inside = [(i, i) for i in range(len(texts)) if decontam.edit_search(bench.raw[i], texts[i])[0] <= bench.most[i]]
    assert len(inside) > 0.9 * len(texts)
    assert sum(p in found for p in inside) >= recall * len(inside)


def test_items_inside_words(items):
    bench = decontam.Benchmark(items)
    texts = [decontam.normal(f"before-and{t}glued to what follows") for _, t in items]
    found = {(d, i): dist for d, i, dist, *_ in bench.find(texts)}
    assert all(found.get((i, i)) == 0 for i in range(len(items)))


def test_rows_are_true_and_complete_for_exact_copies(spark, items):
    rows = decontam.op3_decontam(spark, DATA).collect()
    docs = {r.doc_id: decontam.normal(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    text = {i: decontam.normal(t) for i, t in items}
    for r in rows:
        assert distance(text[r.item_id], docs[r.doc_id][r.start : r.end]) == r.distance <= 0.1 * len(text[r.item_id])
    assert {(d, i) for d, x in docs.items() for i, t in text.items() if t in x} <= {(r.doc_id, r.item_id) for r in rows}


def test_rounds_give_the_same(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    one, many = decontam.leaks(docs, items), decontam.leaks(docs, items, most=2000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    clean = decontam.without_leaks(docs, items, most=2000)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {r.id for r in one.collect()}


def test_edges(edge, none, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "same text here for two rows of it"), (4, "same text here for two rows of it")], "item_id long, text string")
    assert sorted((r.id, r.item_id) for r in decontam.leaks(edge, items).collect()) == [(4, 4), (4, 4), (5, 4), (5, 4)]
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(edge, items.limit(0)).count() == 0
    assert decontam.without_leaks(edge, items).count() == edge.count() - 2


@pytest.mark.parametrize("glue", ["", "\t", "\r", " ", "　"])
def test_texts_without_blanks(glue):
    rng = random.Random(3)
    kanji = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    joined = lambda n: "".join(rng.choice("abcdefghijklmnop(){};=") for _ in range(n))
    items = [kanji(50) for _ in range(10)] + [joined(150) for _ in range(10)]
    bench = decontam.Benchmark(list(enumerate(items)))
    texts = [decontam.normal(make(300) + glue + t + glue + make(300)) for make, t in zip([kanji] * 10 + [joined] * 10, items, strict=True)]
    found = {(d, i): (dist, s, e) for d, i, dist, s, e in bench.find(texts)}
    for i, t in enumerate(items):
        assert found[i, i][0] == 0 and texts[i][slice(*found[i, i][1:])] == decontam.normal(t)
    near = [decontam.normal(joined(300) + glue + edited(t, 0.04, rng) + glue + joined(300)) for t in items[10:]]
    found = {(d, i) for d, i, *_ in bench.find(near)}
    assert sum((i, i + 10) in found for i in range(10)) >= 9


@pytest.mark.parametrize("size", [5, 9, 10, 12, 15, 20, 23, 24, 30, 31, 32, 40, 80, 400, 800, 3000])
def test_nothing_within_the_edits_is_lost_at_any_size(size):
    """Random and evenly placed edits, as many as may be; items of 5 to 3,000 bytes."""
    rng = random.Random(size)
    letters = "abcdefghijklmnop qrstuvwxyz"
    items = [(i, "".join(rng.choice(letters) for _ in range(size))) for i in range(12)]
    bench = decontam.Benchmark(items)
    k = int(size * decontam.EDITS)
    texts, exact = [], []
    for i, t in items:
        even = list(t)
        for j in range(k):
            even[(2 * j + 1) * size // (2 * k)] = rng.choice("0123")
        for copy in (t, edited(t, decontam.EDITS, rng), "".join(even)):
            texts.append(decontam.normal("#" * rng.randrange(40) + copy + "#" * rng.randrange(40)))
            exact.append(i)
    found = {(d, i): dist for d, i, dist, *_ in bench.find(texts)}
    for d, (text, i) in enumerate(zip(texts, exact, strict=True)):
        least = decontam.edit_search(decontam.normal(items[i][1]), text)[0]
        assert (bench.ids.index(i) in [x for y, x in found if y == d]) == (least <= k), (d, least)


def test_tables_name_most_near_copies():
    """The recall of the tables alone, before the windows that they missed are verified."""
    rng = random.Random(3)
    letters = "abcdefghijklmnop qrstuvwxyz"
    for size in (80, 250, 800, 3000):
        items = [(i, "".join(rng.choice(letters) for _ in range(size))) for i in range(40)]
        bench = decontam.Benchmark(items)
        named = 0
        for i, (_, t) in enumerate(items):
            x = np.frombuffer(decontam.normal(edited(t, 0.09, rng)) + b"\0" * (2 * size), np.uint8)
            pairs = np.array([[i, p] for p in range(-0, int(bench.most[i]) + 1)], np.int64)
            agreed = np.zeros(len(pairs), bool)
            for step in bench.steps:
                step.agree(x, pairs, agreed)
            named += agreed.any()
        assert named >= 0.9 * len(items), (size, named)


REPETITIVE = ["a" * 300, "=" * 120, "ab" * 90, "the same phrase again and " * 12, "| --- " * 40, "x" * 60 + " an ending that is not repetitive at all, of some length " + "y" * 60]


@pytest.mark.parametrize("places", [1 << 19, 300])
def test_repetitive_items_equal_brute_force(monkeypatch, places):
    """Against the plain distance to every text: what is near is found, and nothing else; also in many short stretches."""
    monkeypatch.setattr(decontam, "PLACES", places)
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (90, 200)]
    items = REPETITIVE + plain
    bench = decontam.Benchmark(list(enumerate(items)))
    texts = []
    for t in items:
        texts += [t * 2, t[: len(t) // 2], "before " + edited(t, 0.05, rng) + " behind", edited(t, 0.09, rng), edited(t, 0.13, rng), "z" * 200 + t + "z" * 500 + edited(t, 0.08, rng)]
    texts += ["a" * 2000, "=" * 50 + " title " + "=" * 200, "aaaaaaaab" * 200, "=" * 105, "=" * 108, "-" * 500]
    raws = [decontam.normal(t) for t in texts]
    found = {(d, i): dist for d, i, dist, *_ in bench.find(raws)}
    want = {}
    for d, text in enumerate(raws):
        for i, t in enumerate(items):
            least = decontam.edit_search(decontam.normal(t), text)[0]
            if least <= int(len(t) * decontam.EDITS):
                want[d, i] = least
    assert {k[0]: k for k in want} and found == want
    for d, i, dist, lo, hi in bench.find(raws):
        assert distance(decontam.normal(items[i]), raws[d][lo:hi]) == dist


def test_memory_is_bounded_on_repetitive_texts():
    """Rule lines, one letter, repeated phrases: in proportion to the text, some 100 bytes a byte."""
    import tracemalloc

    bench = decontam.Benchmark(list(enumerate(REPETITIVE)))
    for unit in ("a", "=", "the same phrase again and ", "| --- ", "aaaaaaaaaaaaaaaaaaaaaaaaaab"):
        peaks = []
        for size in (1 << 16, 1 << 18):
            tracemalloc.start()
            bench.find([(unit * (size // len(unit))).encode()])
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 160 << 20 and peaks[1] < 4 * peaks[0] + (64 << 20), peaks
