import collections
import math

from ridgeline.llm import langid

from .conftest import DATA


def brute(texts, raw, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    text = b"".join(b"\n" * order + langid._bytes(t) for t in texts)
    for i in range(len(text)):
        for m in range(min(i, order) + 1):
            counts[m][text[i - m : i]][text[i]] += 1
    x, bits = b"\n" * order + raw, 0.0
    for i in range(order, len(x)):
        for m in range(order, -1, -1):
            if seen := counts[m].get(x[i - m : i]):
                total, distinct = seen.total(), len(seen)
                if x[i] in seen:
                    bits -= math.log2(seen[x[i]] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(docs):
    texts = {k: [r.text[:1500] for r in docs.filter(docs.lang == k).limit(3).collect()] for k in ("en", "de", "fr")}
    probes = [langid._bytes(r.text[:300]) for r in docs.limit(6).collect()] + [b"", b"\x00zz?\xf0", b"a"]
    for order in (1, 3):
        model = langid.ContextTrees(texts, order)
        got = model.bits(probes)
        for k, lang in enumerate(model.langs):
            for i, raw in enumerate(probes):
                assert abs(got[i, k] - brute(texts[lang], raw, order)) < 1e-3 * max(10, got[i, k])


def test_chunks_do_not_change_code_lengths(docs, monkeypatch):
    texts = {"en": ["the end of the text"], "de": ["das ende vom text"]}
    model = langid.ContextTrees(texts)
    raws = [langid._bytes(r.text) for r in docs.limit(20).collect()]
    whole = model.bits(raws)
    monkeypatch.setattr(langid, "CHUNK", 777)
    assert abs(model.bits(raws) - whole).max() < 1e-2


def test_held_out_accuracy(spark, docs):
    rows = langid.op7_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(edge, none, spark):
    model = langid.ContextTrees({"en": ["word text"], "xx": ["zzz"]})
    rows = {r.id: r for r in langid.predictions(edge, model).collect()}
    assert rows[0].lang == rows[1].lang == rows[2].lang == rows[10].lang == "und" and rows[0].score == 0
    assert rows[3].lang == "en" and rows[4].lang == rows[5].lang
    assert langid.predictions(none, model).count() == 0
    nothing = langid.ContextTrees(langid.training_sample(none.select("id", "lang", "text")))
    assert {r.lang for r in langid.predictions(edge, nothing).collect()} == {"und"}


def test_sample_has_a_bound(spark, docs):
    sample = langid.training_sample(docs.selectExpr("doc_id id", "lang", "text"), 5000)
    assert set(sample) == {"en", "de", "fr", "es"}
    assert all(sum(map(len, v)) <= 5000 + 5000 for v in sample.values())


def test_letters_are_letters_only():
    model = langid.ContextTrees({"en": ["the cat and the dog"], "de": ["der hund und die katze"]})
    assert model.predict(["½ ² ①", "Ⅷ 12", "_", "x", "中"])[0][:3] == ["und"] * 3
    assert "und" not in model.predict(["x", "中", "ª1"])[0]


def test_every_language_is_in_the_sample(spark):
    rows = [(i, "en", "the cat " * 3000) for i in range(300)] + [(1000 + i, "xx", "zq zq zq") for i in range(2)]
    sample = langid.training_sample(spark.createDataFrame(rows, "id long, lang string, text string"), 5000)
    assert set(sample) == {"en", "xx"} and len(sample["en"][0].encode()) <= 5000
