"""Rows without an id, and ids that come twice: nothing crashes, every row stays."""

import pytest

import corpus_pipeline
from ridgeline.llm import decontam, jaccard, langid, lmscore, packing, pii, quality, sharding, tokens, toxicity

from .conftest import DATA

BIG = 2**60 + 1


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "some words of text here"), (None, None), (7, "some words of text here"), (7, "other words"), (BIG, "the last of the words here"), (None, "some words of text here")]
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_row_by_row_operators(spark, odd):
    model = toxicity.Examples([(1, 1, "bad words"), (2, 0, "good words")], (1.0, 1.0))
    trees = langid.ContextTrees({"en": ["some words"]})
    for out in (tokens.token_counts(odd), pii.pii_spans(odd), quality.ledger(odd), toxicity.toxicity(odd, model), langid.predictions(odd, trees)):
        assert sorted(str(r.id) for r in out.collect()) == sorted(["None"] * 3 + ["7", "7", str(BIG)])
    items = spark.createDataFrame([(None, "some words of text here")], "item_id long, text string")
    assert decontam.leaks(odd, items).count() == 3


def test_packing(odd):
    rows = packing.packed(odd.select(odd.doc_id.alias("id"), packing.byte_tokens().alias("tokens"))).collect()
    assert sorted(str(r.id) for r in rows) == sorted(["None"] * 3 + ["7", "7", str(BIG)])


def test_jaccard(odd):
    rows = jaccard.near_groups(odd.select(odd.doc_id.alias("id"), "text")).collect()
    assert len(rows) == 6 and {r.component_id for r in rows if r.id == BIG} == {BIG}


def test_sharding(odd):
    rows = sharding.sharded(odd, 4, ["doc_id", "lang", "source"]).collect()
    assert len(rows) == 6
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_lm_scores(odd):
    rows = lmscore.lm_scores(odd.selectExpr("doc_id AS id", "doc_id IS NOT NULL AS train", "text")).collect()
    assert len(rows) == 6


def test_pipeline(spark, odd):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        now.collect()


def test_pipeline_keeps_rows_without_an_id(spark, odd):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert sorted(str(r.doc_id) for r in now.collect()) == sorted(["None"] * 3 + ["7", "7", str(BIG)])
