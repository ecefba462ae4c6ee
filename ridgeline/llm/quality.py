"""Rule bitmask ledger: every rule is evaluated once per document; policies are bit masks over it.

A ledger row holds the measurements and one bit per failed rule. A policy version is a
mask of the rules that reject; verdicts and ablations are bitwise work on the ledger,
without a second look at any text.

Edge cases: null and empty texts have zero words, so they fail ``few_words``; texts of
one line or fewer than three words have no repeats; a very long text is measured whole; repeated rows each have
their line; an empty table gives an empty ledger. Only the id and text columns are read, so others never clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.blocks import documents, map_rows

SYMBOLS, BLANKS, CAPITALS = b"#*$%&|<>", b" \t\n\x0b\x0c\r", bytes(range(65, 91))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def rules() -> dict[str, Column]:
    """name -> failed, a condition on the measures. A rule's bit is its place here, so new rules go last."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 50,
        "repeated_trigrams": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 4 * F.col("n_lines"),
        "short_words": chars < 2 * n,
        "long_words": chars > 16 * n,
        "shouting": 10 * F.col("n_upper") > 4 * chars,
    }


NAMES = ("few_words", "repeated_trigrams", "symbols", "duplicate_lines", "short_words", "long_words", "shouting")
#: version -> the rules that reject under it.
POLICIES = {1: NAMES[:2], 2: NAMES[:4], 3: NAMES}


def mask(*names: str) -> int:
    return sum(1 << NAMES.index(x) for x in names)


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        times, upto = Counter(triples), 0
        for at, triple in enumerate(triples):
            if times[triple] > 1:
                repeated += at + 3 - max(at, upto)
                upto = at + 3
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(text or "") - len(raw) + len(raw.translate(None, BLANKS)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, CAPITALS)),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, fail_bits: one pass over the texts, no shuffle."""

    def run(ids, texts):
        columns = list(zip(*map(measure, texts), strict=True)) or [[]] * len(MEASURES)
        return {"id": ids, **dict(zip(MEASURES, columns, strict=True))}

    bits = F.lit(0).cast("long")
    for at, failed in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << at)).otherwise(F.lit(0)).cast("long"))
    return map_rows(df, run, "id long, " + ", ".join(f"{m} long" for m in MEASURES), id_col, text_col).withColumn("fail_bits", bits)


def verdict(bits: Column, version: int) -> Column:
    """Kept under that policy?"""
    return bits.bitwiseAND(F.lit(mask(*POLICIES[version])).cast("long")) == 0


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: documents it fails, documents that only it rejects (kept without it).

    The ledger is counted by distinct bit pattern first, so what follows is tiny."""
    held = F.lit(mask(*POLICIES[version])).cast("long")
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(held).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(mask(x)).cast("long").alias("bit")) for x in POLICIES[version]]))
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        counts.select("bits", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule"))
        .agg(hit(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), hit(F.col("bits") == F.col("r.bit")).alias("n_only"))
    )


def op6_quality(spark: SparkSession, sf_dir: str, version: int = 3) -> DataFrame:
    rows = ledger(documents(spark, sf_dir))
    return rows.select(
        F.col("id").alias("doc_id"), *MEASURES[:5],
        (F.col("fail_bits").bitwiseAND(F.lit(mask(*POLICIES[1])).cast("long")) != 0).alias("base_failed"),
        verdict(F.col("fail_bits"), version).alias("kept"), "fail_bits", F.lit(version).alias("policy"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g3),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
  len(l.l) AS n_lines, length(regexp_replace(w.text, '[^A-Z]', '', 'g')) AS n_upper
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 16 * n_words)::INT
  + 64 * (10 * n_upper > 4 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits, CAST(3 AS INT) AS policy FROM f
"""
