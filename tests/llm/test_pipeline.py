"""run() against a plain version of the same decisions."""

import corpus_pipeline
from ridgeline.llm import decontam, packing, pii, tokens, toxicity

from .conftest import DATA
from .test_jaccard import brute


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    model = toxicity.examples(docs, toxicity.labelled(spark, DATA))
    rows = [r for r in docs.collect() if model.score(r.text)[0] < 0.5]
    groups = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(decontam.edit_search(i, decontam.normal(r.text))[0] <= len(i) // 10 for i in items)]
    texts = {r.doc_id: pii.redact(r.text) for r in rows}
    count = tokens.counter(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = {i: tokens.total(count.changes(t)) + 1 for i, t in texts.items()}

    got = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.bin_offset + r.length <= r.capacity and r.capacity in packing.CAPACITIES
    assert got == want

    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == columns
    assert {r.doc_id: r.text for r in now.collect()} == texts


def test_edges(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DATA)
            now.collect()
