"""op12_interactions against DuckDB and against every order played document by document."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from ridgeline.llm import interactions

from .conftest import DATA, TEXTS


def played(docs, labels):
    """Every order, one document after the other."""
    good, toxic = ({d for d, *q in labels if d is not None and q[i] == 1} for i in (0, 1))
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, part, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]]
        rows.append((part or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in rows}:
            alive, gone = [r for r in rows if r[0] == part], []
            for step, x in enumerate(order, 1):
                lost = [r for r in alive if x in r[1]]
                redundant = sum(x in r[1] for r in gone)
                alive, gone = [r for r in alive if x not in r[1]], gone + lost
                shapley[part, x] += len(lost)
                unique = sum(r[0] == part and r[1] == {x} for r in rows)
                out[part, "".join(order), step] = [len(alive), len(lost), redundant, unique, sum(r[2] for r in lost), sum(r[3] for r in lost)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(interactions.ORACLE_SQL)
    found = interactions.op12_interactions(spark, DATA)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def rows(edge):
    """Beside the texts of edge: copies over parts and labels, a repeated id, repeated rows, rows without an id."""
    rich, shout, odd = " ".join(f"w{i}" for i in range(250)), "LOUD " * 300, " ".join(f"w{i}" for i in range(220)) + " $5"
    more = [(50, "en", rich), (40, "de", rich), (41, None, rich), (41, None, rich), (40, "en", rich), (60, "de", shout), (61, "de", odd), (61, "de", rich), (62, "", "word"), (None, "en", rich), (None, None, "word"), (None, None, "word")]
    return [(i, None if i % 3 == 0 else "en", t) for i, t in enumerate(TEXTS)] + more


LABELS = [(3, 1, 1), (40, 1, 0), (41, 1, None), (41, 0, 1), (60, None, 1), (61, 1, 1), (999, 1, 1), (None, 1, 1)]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'mine' AS mask", "1 AS n", "2 AS id", "3 AS part", "4 AS good", "5 AS salt")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return interactions.audit(interactions.parity_sums(interactions.counted(docs, known), 5), "ABCDE")


def test_edges_equal_play(spark, rows):
    found = result(audited(spark, rows, LABELS))
    assert found == played(rows, LABELS)
    assert {p for p, *_ in found} == {"", "en", "de"} and len(found) == 3 * 600


def test_empty(spark):
    assert audited(spark, [], LABELS).count() == 0
    assert len(result(audited(spark, [(1, "en", "a")], []))) == 600


def test_one_text_is_a_third(spark):
    """Copies are counted before they meet: no task of the second exchange gets them one by one."""
    rows = [(i, "en", "same text") for i in range(3000)] + [(i, "de", f"text {i}") for i in range(3000, 9000)] + [(7, "en", f"texts of one id {i}") for i in range(3000)]
    found = result(audited(spark, rows, []))
    assert found["en", "EABCD", 1][1] == 2999 and found["en", "ABCDE", 1][:2] == (0, 6000)


def test_labels_are_not_broadcast(spark):
    """They grow with the corpus, and a broadcast table passes whole through the driver."""
    found = interactions.op12_interactions(spark, DATA)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_transform_is_exact():
    for k in (1, 3, 5):
        h, cells = interactions.hadamard(k), np.arange(1 << k, dtype=np.int64) * (1 << 50) // 7
        assert (((h @ (h @ cells)) >> k) == cells).all()
