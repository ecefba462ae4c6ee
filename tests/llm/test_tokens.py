import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = [
    "", "I've we'll they're   x  \n\n  y\t\tz 'll ''re don't 12 345  a  ", "a<|endoftext|> b", "<|endoftext|>", "  lead", "trail   ", "中文 café naïve ́x \U0001f600\U0001f600 ok", "!!!'s '' 's", "\n\n\n a\r\n b",
    "\n's x", " \t're", "a" * 500, " " * 300 + "x", "1" * 200, "   x", "ﷺ ½ ² _x_ ٣٤", "'S 'RE",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(PATH)


def test_every_prefix_of_nasty_texts(library, counter):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab 'srevl\n\t.,1é中") for _ in range(40)) for _ in range(150)]
    for text in NASTY[:10] + NASTY[13:] + mixed:
        if "<|" in text:
            continue
        counts = np.cumsum(np.frombuffer(counter.changes(text), np.int8))
        assert counts.tolist() == [len(library.encode(text[:k], add_special_tokens=False)) for k in range(1, len(text) + 1)], text


def test_pairs_stay_as_the_merges_have_it(counter):
    rng = random.Random(2)
    vocabulary, known = counter.tokens, set(counter.tokens)
    pairs = [(rng.choice(vocabulary), rng.choice(vocabulary)) for _ in range(4000)]
    pairs += [(b"a", b"aa"), (b"aa", b"a"), (b"aa", b"aa"), (b" ", b" "), (b" t", b"he"), (b" th", b"e")]
    pairs += [(t[:k], t[k:]) for t in rng.sample(vocabulary, 800) for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
    for a, b in pairs:
        assert counter.pair_stays(a, b) == (counter.merged(a + b) == [a, b]), (a, b)


def test_totals(library, counter, docs):
    texts = NASTY + [r.text for r in docs.select("text").collect()]
    assert [tokens.total(counter.changes(t)) for t in texts] == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ledger_answers_budgets(spark, library):
    text = "The quick brown fox doesn't jump over 12345 lazy dogs.\n\nIt sleeps."
    row = tokens.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    counts = tokens.prefix_counts(row.ledger)
    assert len(counts) == len(text) + 1 and counts[-1] == row.n_tokens
    for budget in range(row.n_tokens + 2):
        k = tokens.longest_within(row.ledger, budget)
        assert len(library.encode(text[:k])) <= budget
        assert all(len(library.encode(text[:j])) > budget for j in range(k + 1, len(text) + 1))


def test_edges(edge, none):
    rows = {r.id: r for r in tokens.token_counts(edge).collect()}
    assert len(rows) == edge.count() and rows[0].n_tokens == rows[0].n_bytes == rows[1].n_tokens == 0 and rows[4].n_tokens == rows[5].n_tokens
    assert tokens.prefix_counts(rows[0].ledger).tolist() == [0]
    assert tokens.token_counts(none).count() == 0


def test_totals_without_a_ledger(library):
    count, rng = tokens.TotalCounter(PATH), random.Random(5)
    letters = [*"ab 'srevl\n\t.,1é中 　\xa0\x1c\x85_½ ", "<|endoftext|>", "don't"]
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text in NASTY + mixed + NASTY:
        assert count.count(text) == len(library.encode(text, add_special_tokens=False)), text
