"""op11_fingerprints against a walk step by step and a plain list of successors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import fingerprints as fp

from .conftest import DATA, TEXTS


def plain_print(text):
    """Step by step, from the tables' bits."""
    t = fp.tables()
    if not text:
        return "-" * fp.SLOTS
    phase, out, cls = t.phase.reshape(fp.WALKS, 256, fp.PERIOD), [], fp.classes(text)
    for w in range(fp.WALKS):
        emitted, step = [], 0
        for c in cls.tolist():
            while True:
                emitted.append(c)
                moves = phase[w, c, step % fp.PERIOD] == (step + 1) % fp.PERIOD
                step += 1
                if moves:
                    break
        for slot in range(w * fp.SLOTS // fp.WALKS, (w + 1) * fp.SLOTS // fp.WALKS):
            at = max(s for s in t.steps[slot].tolist() if s <= len(emitted))
            out.append("%x" % t.symbol[slot, emitted[at - 1]])
    return "".join(out)


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
    least = {i: min((t for j, t in rows if j == i), key=lambda t: t.encode()) for i in order}
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    out = []
    for i, t in rows:
        other = least[after[i]]
        made = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        a, b, c = map(plain_print, (t, made, other))
        out.append((i, len(t), hashlib.sha256(made.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return out


def compared(df):
    return [tuple(r)[:7] for r in fp.beside_successors(df).select("own", "id", "text").mapInArrow(fp._compared, fp.COLUMNS).collect()]


def same(found, want):
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_walks_equal_steps():
    rng = random.Random(5)
    texts = ["", "a", "ab", "中文 \U0001f600", "x" * 3000] + ["".join(rng.choice("abcdefgh é中\n") for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    assert fp.prints(texts) == [plain_print(x) for x in texts]
    assert fp.prints(texts[:5]) == [plain_print(x) for x in texts[:5]]  # a few are walked one by one


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(60).collect()]
    same(compared(spark.createDataFrame(rows, "doc_id long, text string")), plain(rows))


def test_query_tells_edited_from_next(spark):
    rows = fp.op11_fingerprints(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.6 and np.mean([r.near_next < 0.2 for r in long]) > 0.95
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


@pytest.fixture(scope="module")
def odd():
    rows = [(2 * i, t) for i, t in enumerate(TEXTS) if len(t or "") < 40_000]
    return rows + [(8, "other text of id 8"), (8, "other text of id 8"), (None, "no id"), (None, None), (None, "aa no id, least"), (9, "é"), (1 << 60, "high"), (-(1 << 60), "low")]


def test_odd_rows(spark, odd):
    table = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS own", "3 AS task", "4 AS fingerprint")
    same(compared(table), plain(odd))
    same(compared(table.repartition(5)), plain(odd))


def test_single_and_empty(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    same(compared(make([(5, "abcdef")])), plain([(5, "abcdef")]))
    same(compared(make([(None, "abcdef")] * 2)), plain([(None, "abcdef")] * 2))
    assert compared(make([])) == []


@pytest.mark.parametrize("hot", [None, 3])
def test_hot_id_is_dealt(spark, monkeypatch, hot):
    """A third of all rows are of one id: it is cut, and every row has its successor."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 1000)
    rows = [(i, f"text number {i}") for i in range(200)] + [(hot, f"one of many {i % 7}") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fp.beside_successors(table).withColumn("p", F.spark_partition_id()).filter("own = 0").groupBy("p").count().collect()
    assert max(r["count"] for r in parts) <= 80 and len(parts) >= 5
    same(compared(table), plain(rows))


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fp.edit_distance(a, b) == slow(a, b)


def test_near_links(spark):
    """Every group of near copies is connected, and no others, as by comparing all pairs."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = []
    for n in (60, 150, 400, 900):
        base = make(n)
        texts += [base, base]
        for _ in range(6):
            x = list(base)
            for _ in range(max(1, n // 80)):
                x[rng.randrange(len(x))] = rng.choice(["", "z", "qq"])
            texts.append("".join(x))
    texts += [make(rng.randrange(40, 600)) for _ in range(30)] + ["", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    links = fp.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = {(i, j) for i, a in rows[:-1] for j, b in rows[:-1] if a and b and i > j and fp.edit_distance(a, b) <= fp.NEAR * max(len(a), len(b))}
    assert all((r.id, r.near) in near and r.edits == fp.edit_distance(texts[r.id], texts[r.near]) for r in links)

    def groups(pairs):
        at = list(range(len(texts)))
        def top(x):
            return x if at[x] == x else top(at[x])
        for a, b in pairs:
            at[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(len(texts))]

    same_text = {(i, texts.index(t)) for i, t in enumerate(texts) if t}
    assert groups({(r.id, r.near) for r in links} | same_text) == groups(near | same_text)
