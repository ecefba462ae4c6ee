"""Filter interaction audit: what each filter removes, alone and in any order, from signed parity sums.

A document's failures are a mask of one bit a filter. For each part and label, 2 ** k signed parity sums
(of +1 or -1, by the parity of the failures that a document shares with a set of filters) are one partial
aggregate over the documents. A Walsh-Hadamard transform turns them back into exact counts of documents by
mask, and every order of the filters is then evaluated on those 2 ** k cells: documents are read once, whatever
the number of orders. The Shapley value has a closed form: a document with f failures gives each of them k! / f
of the k! orders in which it is removed.

Failing ``copy`` means that a smaller id has the same text. Texts are compared by SHA-256 and rows are counted
by text, part and labels before they meet, so a text that makes up a third of all rows is a few rows by then.
Ids with many texts are salted in the join with the labels, of which nothing is broadcast, as they grow with the corpus.

Edge cases: null texts are empty (no words: they fail ``short`` only, and ``copy``); a null part is the empty
string; rows without an id have no label and no smaller id, and nothing is a copy of them; rows of one id
aren't copies of each other; repeated label rows count once, 1 wins; a very long text is measured whole; an
empty table has no parts, so no rows. Only the named columns are read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.blocks import documents

BLANKS = r"[\x20\x09-\x0D]+"
#: Labels' rows are repeated so many times in their join; an id's texts are dealt over as many tasks.
SALT = 8
#: What cells are counted of: all documents, those of good quality, toxic ones.
LABELS = ("every", "good", "toxic")


def filters(text: Column) -> dict[str, Column]:
    """letter -> fails, for the filters that look at one text; the copy filter is the last letter."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(df: DataFrame, failing: dict[str, Column]) -> DataFrame:
    """df with ``mask``: bit i is set if the i-th condition holds."""
    bits = F.lit(0)
    for at, fails in enumerate(failing.values()):
        bits = bits + F.when(fails, F.lit(1 << at)).otherwise(F.lit(0))
    return df.withColumn("mask", bits)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id, digest, ...) with ``good`` and ``toxic``, 0 where there is no label."""
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    known = known.filter("id IS NOT NULL AND good + toxic > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.filter("id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    known = known.hint("merge")  # the engine sizes them by the labels' file, in which a row takes a few bytes, and would send all to the driver
    found = salted.join(known, ["id", "salt"], "left").select(*rows.columns, zero("good"), zero("toxic"))
    return found.unionByName(rows.filter("id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def counted(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: documents by what they fail, copies included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    failing = filters(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    rows = masked(rows, failing).select("id", "part", "mask", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    rows = labelled(rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), labels)
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a text has as many rows as it has parts and labels
    kept = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_null")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + (1 << len(failing))).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    return alike.withColumn("first", first).withColumn("kept", kept).select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "good", "toxic", "x.n")


def parity_sums(cells: DataFrame, k: int) -> DataFrame:
    """part, and an array of 2 ** k signed sums for each of LABELS."""
    def signed(w: int, weight: Column) -> Column:
        return F.sum(weight * (1 - 2 * F.pmod(F.bit_count(F.col("mask").bitwiseAND(F.lit(w))), F.lit(2))))

    weights = {"every": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return cells.groupBy("part").agg(*[F.array(*[signed(w, weights[x]) for w in range(1 << k)]).alias(x) for x in LABELS])


def hadamard(k: int) -> np.ndarray:
    """Its square is 2 ** k times the identity."""
    h = np.ones((1, 1), np.int64)
    for _ in range(k):
        h = np.block([[h, h], [h, -h]])
    return h


def evaluated(part: str, sums: dict[str, np.ndarray], letters: str) -> pd.DataFrame:
    """One row for each order and step, from one part's parity sums."""
    k = len(letters)
    size, masks, h = 1 << k, np.arange(1 << k), hadamard(k)
    cells = {x: (h @ s) >> k for x, s in sums.items()}
    clear = (masks[:, None] & masks[None, :]) == 0
    passing = {x: clear @ c for x, c in cells.items()}  # by set of filters: documents that fail none of it
    failures = np.array([bin(m).count("1") for m in masks])
    bits = {x: 1 << i for i, x in enumerate(letters)}
    total = {x: int(cells["every"][(masks & b) > 0].sum()) for x, b in bits.items()}
    shapley = {x: int((cells["every"] * np.where((masks & b) > 0, factorial(k) // np.maximum(failures, 1), 0)).sum()) for x, b in bits.items()}
    rows = []
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            after = before | bits[x]
            lost = {y: int(passing[y][before] - passing[y][after]) for y in LABELS}
            rows.append((part, "".join(order), step, int(passing["every"][after]), lost["every"], total[x] - lost["every"], int(cells["every"][bits[x]]), lost["good"], lost["toxic"], shapley[x]))
            before = after
        assert before == size - 1
    return pd.DataFrame(rows, columns=COLUMNS)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(sums: DataFrame, letters: str) -> DataFrame:
    """Every order and step of each part, where the sums lie; orders are k!, whatever the size of the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield evaluated(row.part, {x: np.asarray(getattr(row, x), np.int64) for x in LABELS}, letters)

    return sums.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[3:]))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(parity_sums(counted(documents(spark, sf_dir, "doc_id", "text", "lang"), labels), 5), "ABCDE")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, CAST(count(*) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM m GROUP BY part, f),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, x AS step, o[x] AS i, o[:x - 1] AS before FROM o, x),
r AS (SELECT part, o, step, i, f, n, good, toxic, len(list_filter(before, lambda y: f[y])) > 0 AS gone, len(list_filter(f, lambda y: y)) AS k FROM s, c),
a AS (SELECT part, o, step, i,
  sum(CASE WHEN NOT gone AND NOT f[i] THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND f[i] THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND f[i] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f[i] AND k = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND f[i] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND f[i] THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, o, step, i),
h AS (SELECT part, i, sum(removed) AS shapley FROM a GROUP BY part, i)
SELECT part, list_aggregate(list_transform(o, lambda y: substr('ABCDE', y, 1)), 'string_agg', '') AS filter_order, CAST(step AS INT) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM a JOIN h USING (part, i)
"""
