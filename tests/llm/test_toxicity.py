import math
import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import toxicity

BAD = ["grunk", "blarg", "snorf"]


def made(n, seed, rate=0.3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 80))]
        toxic = rng.random() < rate
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, int(toxic), " ".join(text)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.Examples(made(600, 1), (2.0, 1.0))


def test_neighbours_are_exact(model):
    dense = np.zeros((len(model.ids), len(model.number) + 1))
    for f, (d, v) in enumerate(zip(model.doc, model.value, strict=True)):
        dense[d, f] = v
    for _, _, text in made(200, 2):
        f, v = model.query(text)
        cosine = np.round(dense[:, f] @ v, 12)
        at, best = model.nearest(f, v)
        want = np.lexsort((np.arange(len(cosine)), -cosine))[: model.k]
        assert np.allclose(best, cosine[want], atol=1e-9)
        assert (at == want).mean() > 0.9  # cosines that only differ in the last digits may change places


@pytest.fixture(scope="module")
def topics():
    """Rows of many topics without a telling word, every sixth toxic by its label only."""
    rng = random.Random(8)
    common = ["c" + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
    rows = []
    for i in range(900):
        own = [f"t{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrstuvwxyz'[rng.randrange(26)]}{'abcdefghijklmnopqrstuvwxyz'[rng.randrange(26)]}" for _ in range(20)]
        rows.append((i, int(i // 10 % 6 == 5), " ".join(rng.choice(common) for _ in range(20)) + " " + " ".join(own)))
    return rows


def cosines(rows, text):
    """From dictionaries: the cosine of a text to each row over all words."""
    counted = [toxicity.Counter(t.split()) for _, _, t in rows]
    df = toxicity.Counter(w for c in counted for w in c)
    idf = {w: max(1e-3, math.log((len(rows) + 1) / (d + 1))) for w, d in df.items()}
    unit = lambda c: {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    q = unit(toxicity.Counter(text.split()))
    out = []
    for c in counted:
        v = unit(c)
        out.append(sum(x * v.get(w, 0.0) for w, x in q.items()) / norm(q) / norm(v))
    return out


def test_scores_of_texts_without_features_equal_plain(topics):
    model = toxicity.Examples(topics, (3.0, 1.5))
    assert not model.number and model.words.blocks == 15
    rng = random.Random(9)
    for i in range(0, 900, 30):
        text = " ".join(w for w in topics[i][2].split() if rng.random() < 0.7) + " unseen"
        want = sorted(((-round(c, 9), at) for at, c in enumerate(cosines(topics, text)) if c > 0))[: model.k]
        score, evidence = model.score(text)
        assert {round(cosines(topics, text)[e], 9) for e in evidence} == {-c for c, _ in want} and len(evidence) == model.k
        vote = [(1.5 if topics[at][1] else 3.0, (-c) ** toxicity.STEEP, topics[at][1]) for c, at in want]
        least = toxicity.PRIOR_WORDS * 1.5
        assert abs(score - (sum(w * v * y for w, v, y in vote) + least * model.prior) / (sum(w * v for w, v, _ in vote) + least)) < 1e-6


def test_blocks_are_skipped(topics):
    model = toxicity.Examples(topics, (1.0, 1.0))
    for _, _, text in topics:
        model.score(text)
    assert model.words.met - model.words.scored > len(topics)  # more than one block a search


def test_copy_of_a_toxic_text_without_features(topics):
    model = toxicity.Examples(topics, (1.0, 1.0))
    score, evidence = model.score(topics[57][2])
    assert score > 0.5 and evidence[0] == 57
    assert sum(model.score(t)[0] >= 0.5 for i, y, t in topics if not y) == 0
    assert model.score("neverseen words") == model.score("") == (model.prior, [])


def test_held_out(model):
    rows = made(300, 3)
    assert sum((model.score(t)[0] >= 0.5) == y for _, y, t in rows) / 300 > 0.98
    score, evidence = model.score("grunk blarg " + rows[0][2])
    assert score > 0.5 and 0 < len(evidence) <= model.k


def test_calibration(model):
    rows = made(600, 4)
    s = np.array([model.score(t)[0] for _, _, t in rows])
    y = np.array([y for _, y, _ in rows])
    assert ((s - y) ** 2).mean() < 0.05 and s.min() >= 0 and s.max() <= 1


def test_edges(edge, none, model, spark):
    rows = {r.id: r for r in toxicity.toxicity(edge, model).collect()}
    assert len(rows) == edge.count() and rows[0].score == rows[1].score == model.prior and rows[0].evidence == [] and rows[4].score == rows[5].score
    assert toxicity.toxicity(none, model).count() == 0
    unlabelled = toxicity.examples(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert unlabelled.score("word")[0] == 0
    odd = toxicity.examples(edge, spark.createDataFrame([(3, None), (4, 1), (None, 1), (4, 7)], "doc_id long, toxic int"))
    assert 0 <= odd.score("word")[0] <= 1
    assert toxicity.without_toxic(edge, model).columns == edge.columns


def test_query_learns_nothing_from_held_out_rows(spark):
    from .conftest import DATA

    rows = toxicity.op2_toxicity(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r["doc_id"] for r in toxicity.labelled(spark, DATA).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in held)
