"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

Edge cases: null and empty texts have no spans (and the digest of the empty string); a
digit or letter run of any length, and so a text of any length, is scanned once, in linear time; repeated rows give
repeated results; an empty table gives an empty result. Only the id and text columns are read (redacted hands all
others through), so names never clash.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.blocks import documents, map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of local-part characters starts, unless the last match ended inside that run.
_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")

# Lengths of account numbers by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# The score of a confirmed span without context, and the words near a span that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"), "phone": ("phone", "call", "tel", "mobile", "contact"),
    "iban": ("iban", "bank", "account", "transfer"),
}
AGAINST = ("version", "release", "example", "isbn", "order")
NEAR, AFTER, RAISE, LOWER = 40, 20, 0.1, 0.3
#: Spans that score less stay in the text when it is redacted: of weak kinds, those near words that speak against them.
LEAST = 0.35
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.I) for k, v in CONTEXT.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST) + r")\b", re.I)

_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    if "@" not in text:
        return []
    out, at = [], 0
    while m := (_EMAIL.match(text, at) if at else None) or _EMAIL_RUN.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


_ACCOUNT = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}


def _ibans(text: str) -> list[tuple[int, int]]:
    """Each account ends at its country's length; the next may begin right behind it."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.end()
        rest = _ACCOUNT[want].match(text, at) if (want := IBAN_LENGTHS.get(m[1])) else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            at = rest.end()
            out.append((m.start(), at))
    return out


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    out = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text) if text else ():
            near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + AFTER]
            score = PRIOR[kind] + RAISE * bool(_CONTEXT[kind].search(near)) - LOWER * bool(_AGAINST.search(near))
            out.append((kind, start, end, round(min(1.0, max(0.0, score)), 4)))
    return out


def redact(text: str | None, least: float = LEAST) -> str | None:
    """The text with every span of at least that score replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, score in find(text) if score >= least):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its spans as arrays (kind, start, end, score), over the whole text."""

    def run(ids, texts):
        found = [find(t) for t in texts]
        return {"id": ids, **{name: [[s[i] for s in f] for f in found] for i, name in enumerate(("kind", "start", "end", "score"))}}

    return map_rows(df, run, "id long, kind array<string>, start array<long>, end array<long>, score array<double>", id_col, text_col)


def redacted(df: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """df with the spans of its text column replaced; every other column and row as it was."""
    import pyarrow as pa

    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t, least) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = pii_spans(documents(spark, sf_dir))
    joined = F.zip_with(F.arrays_zip("kind", "start"), "end", lambda a, e: F.concat_ws(":", a["kind"], a["start"], e))
    base = F.filter(joined, lambda s: ~s.startswith("iban:"))
    count = lambda k: F.size(F.filter("kind", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(joined, ",").alias("spans"),
        F.array_join(F.transform("score", lambda s: s.cast("string")), ",").alias("scores"),
    )


def hexdigest(spans: list[tuple[str, int, int, float]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in BASE_KINDS).encode()).hexdigest()
