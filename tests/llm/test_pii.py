import random
import re
import time

import pytest

from ridgeline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            keep = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda: 9 <= len(digits) <= 15,
                "card": lambda: 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
            }[kind]()
            if keep:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS]


def test_equals_plain_expressions():
    rng = random.Random(3)
    pieces = ["a.b+c@d.e-f.gh", "x@y", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4539 1488 0343 6467", "4539-1488-0343-6467", "+49 (0) 170 1234567", "+1", "@", ".", "-", " ", "_", "00", "7", "é", "a@b.c_d@e.f", "a@b.c@d.e", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert base(text) == brute(text), text


def test_whole_texts(docs):
    for r in docs.select("text").collect():
        assert base(r.text) == brute(r.text)


@pytest.mark.parametrize("text", ["x" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000])
def test_linear_time(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 5


def test_iban_and_context():
    found = pii.find("my iban DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01")
    assert [(k, text_end - start) for k, start, text_end, _ in found if k == "iban"] == [("iban", 27)]
    score = lambda text: pii.find(text)[0][3]
    assert score("please call +49 151 1234") > score("x +49 151 1234") > score("version +49 151 1234")


def test_edges(edge, none, spark):
    rows = {r.id: r for r in pii.pii_spans(edge).collect()}
    assert rows[0].kind == [] and rows[1].start == [] and len(rows) == edge.count()
    assert pii.pii_spans(none).count() == 0
    clean = pii.redacted(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    df = spark.createDataFrame([("write a@b.org now",), (None,)], "text string")
    assert [r.text for r in pii.redacted(df).collect()] == ["write [email] now", None]


def test_query(spark):
    from .conftest import DATA

    for r in pii.op4_pii(spark, DATA).collect():
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban)) == len([x for x in r.spans.split(",") if x])


def test_accounts_side_by_side():
    text = "NO9386011117947 DE89370400440532013000, GB82 WEST 1234 5698 7654 32 and SA0380000000608010167519"
    spans = [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"]
    assert spans == ["NO9386011117947", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "SA0380000000608010167519"]
    assert not [s for s in pii.find("DE89370400440532013001 DE8937040044053201300") if s[0] == "iban"]


def test_context_on_both_sides_decides_weak_spans():
    assert pii.redact("see version 10.20.30.40 of it") == "see version 10.20.30.40 of it"
    assert pii.redact("10.20.30.40 is the release") == "10.20.30.40 is the release"
    assert pii.redact("the server at 10.20.30.40 is up") == "the server at [ip] is up"
    assert pii.redact("see version 10.20.30.40 of it", 0.0) == "see version [ip] of it"
