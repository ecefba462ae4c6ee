"""Per-cell normalisation, variable features and principal components of sparse counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.shared import stored


def log_normalised(counts: DataFrame, scale: float = 10_000) -> DataFrame:
    """counts (row_id, col_id, value) as log(1 + share of the cell * scale)."""
    total = counts.groupBy("col_id").agg(F.sum("value").alias("_t"))
    return counts.join(total, "col_id").select("row_id", "col_id", F.log1p(F.try_divide("value", "_t") * scale).alias("value"))


def moments(values: DataFrame, n_cells: int) -> DataFrame:
    """row_id, mean, variance over all cells, absent ones as 0."""
    s = values.groupBy("row_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    return s.select("row_id", mean.alias("mean"), ((F.col("q") - n_cells * mean * mean) / max(1, n_cells - 1)).alias("variance"))


def variable_rows(values: DataFrame, n_cells: int, most: int = 2000) -> DataFrame:
    """The rows of largest variance over mean; ties by id."""
    m = moments(values, n_cells).withColumn("dispersion", F.try_divide("variance", "mean"))
    return m.orderBy(F.desc_nulls_last("dispersion"), "row_id").limit(most)


def stabilised(counts: DataFrame, n_cells: int, bins: int = 50, span: float = 0.3, degree: int = 2) -> DataFrame:
    """row_id, mean, variance, expected (variance), standardised: the variance of counts that are centred, divided by the expected
    deviation and cut at the root of n_cells. counts: row_id, col_id, value, once each, zeros absent.

    The expected variance is a local regression of log variance on log mean (tricube weights over the nearest
    ``span`` of the bins), fitted to the means of ``bins`` bins, which is all that the driver sees, and read off between
    the bins along straight lines."""
    import numpy as np

    rows = moments(counts, n_cells).filter("mean > 0 AND variance > 0").withColumn("_x", F.log10("mean")).withColumn("_y", F.log10("variance"))
    ends = rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if ends["lo"] is None:
        return rows.select("row_id", "mean", "variance", F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("standardised"))
    step = (ends["hi"] - ends["lo"]) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("_x") - ends["lo"]) / step).cast("int"))
    found = sorted(rows.groupBy(place.alias("b")).agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    x, y, n = (np.array([r[c] for r in found], float) for c in ("x", "y", "n"))
    fit = local_regression(x, y, n, span, degree)
    # each stretch between neighbouring bins is a line; outside, the first and last ones go on
    slope = np.diff(fit) / np.diff(x) if len(x) > 1 else np.zeros(1)
    known = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"), F.lit(float(c)).alias("s")) for a, b, c in zip(x, fit, slope, strict=False)])
    at = F.element_at(known, F.greatest(F.lit(1), F.size(F.filter(known, lambda k: k["x"] <= F.col("_x")))))
    rows = rows.withColumn("_k", at).withColumn("expected", F.pow(F.lit(10.0), F.col("_k.y") + F.col("_k.s") * (F.col("_x") - F.col("_k.x"))))
    deviation = F.sqrt("expected")
    one = F.least((F.col("value") - F.col("mean")) / deviation, F.lit(float(n_cells) ** 0.5))
    squares = counts.join(rows.select("row_id", "mean", "expected"), "row_id").groupBy("row_id").agg(F.sum(one * one).alias("_q"), F.count(F.lit(1)).alias("_n"))
    zero = F.col("mean") * F.col("mean") / F.col("expected")
    return rows.join(squares, "row_id").select("row_id", "mean", "variance", "expected", ((F.col("_q") + (n_cells - F.col("_n")) * zero) / max(1, n_cells - 1)).alias("standardised"))


def local_regression(x, y, n, span: float, degree: int):
    """The fitted value at each x: a polynomial over the nearest ``span`` of the points, tricube weights times n."""
    import numpy as np

    near = max(min(len(x), degree + 2), int(np.ceil(span * len(x))))
    out = np.empty(len(x))
    for i, at in enumerate(x):
        away = np.abs(x - at)
        reach = np.sort(away)[near - 1]
        weight = n * np.clip(1 - (away / reach) ** 3, 0, None) ** 3 if reach > 0 else n * (away == 0)
        terms = np.vander(x - at, min(degree, max(0, int((weight > 0).sum()) - 1)) + 1, increasing=True)
        root = np.sqrt(weight)
        out[i] = np.linalg.lstsq(terms * root[:, None], y * root, rcond=None)[0][0]
    return out


def principal_components(values: DataFrame, rows: list[str], k: int = 10, unit: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """col_id, pca (vector): the first k components of each cell over the given rows, centred and (``unit``) scaled to unit variance.

    values: row_id, col_id, value, once each, absent ones as 0; null and NaN count as absent, rows that don't vary have no part. Every
    cell of ``cells`` (col_id; else of values) gets its components, also where it has none of the rows. Each component's largest loading is positive."""
    from pyspark.ml.functions import array_to_vector

    return components(values, rows, k, unit, cells)[0].withColumn("pca", array_to_vector("pca"))


def components(values: DataFrame, rows: list[str], k: int = 10, unit: bool = True, cells: DataFrame | None = None, steps: int = 12, tolerance: float = 1e-10, seed: int = 7):
    """(col_id, pca array; variances of the components; loadings, one line for each of rows): see ``principal_components``.

    Block Krylov: cells stay sparse, and a step sends their rows once through the covariance times a small block of directions. The mean
    and the scale are taken off algebraically, so no cell is ever dense. A task sends back one number for each row and direction; the
    driver holds the directions, len(rows) x (k + 10) x steps numbers at most. ``rows`` is a chosen list (``variable_rows``), so its length is bounded."""
    import numpy as np

    spark, m = values.sparkSession, len(rows)
    place = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], f"row_id {values.schema['row_id'].dataType.simpleString()}, _i int")
    known = values.join(F.broadcast(place), "row_id", "left").withColumn("_v", F.col("value").cast("double"))  # place: as long as rows
    entry = F.when(F.col("_i").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_v") != 0), F.struct("_i", "_v"))
    sparse = known.groupBy("col_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))  # a cell has each row once
    if cells is not None:
        sparse = cells.select("col_id").distinct().join(sparse, "col_id", "left")
    sparse = stored(sparse.select("col_id", F.coalesce(F.col("_e._i"), F.array().cast("array<int>")).alias("i"), F.coalesce(F.col("_e._v"), F.array().cast("array<double>")).alias("v")), "cells")
    n = sparse.count()
    one = F.explode(F.arrays_zip("i", "v"))
    sums = {r["i"]: r for r in sparse.select(one.alias("e")).groupBy(F.col("e.i").alias("i")).agg(F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("q")).collect()} if m else {}
    s, q = (np.array([sums[i][c] if i in sums else 0.0 for i in range(m)]) for c in ("s", "q"))
    mean = s / max(1, n)
    variance = np.maximum(0.0, q - n * mean * mean) / max(1, n - 1)
    moves = variance > 1e-12 * q / max(1, n - 1)
    scale = np.where(moves, 1 / np.sqrt(np.where(moves, variance, 1.0)) if unit else 1.0, 0.0)

    def covariance(block: np.ndarray) -> np.ndarray:
        """The covariance of the centred, scaled rows times block."""
        inner = scale[:, None] * block
        sent = spark.sparkContext.broadcast(inner)
        parts = sparse.select("i", "v").mapInArrow(lambda batches: _gram(batches, sent.value), "i int, w array<double>")
        total = parts.groupBy("i").agg(*[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(block.shape[1])]).collect()
        out = np.zeros((m, block.shape[1]))
        for r in total:
            out[r["i"]] = r[1:]
        sent.unpersist()
        return scale[:, None] * (out - n * mean[:, None] * (mean @ inner)) / max(1, n - 1)

    k = min(k, int(moves.sum()))
    loading, found = _krylov(covariance, moves, k, steps, tolerance, seed) if k and n else (np.zeros((m, 0)), np.zeros(0))
    if loading.shape[1]:
        loading = loading * np.sign(loading[np.argmax(np.abs(loading), axis=0), np.arange(loading.shape[1])])
    along = spark.sparkContext.broadcast(scale[:, None] * loading)
    shift = mean @ along.value
    schema = f"col_id {values.schema['col_id'].dataType.simpleString()}, pca array<double>"
    return sparse.mapInArrow(lambda batches: _scores(batches, along.value, shift), schema), found, loading


def _krylov(covariance, moves, k: int, steps: int, tolerance: float, seed: int):
    """(eigenvectors, eigenvalues) of the k largest, by Rayleigh-Ritz over the blocks that repeated multiplication gives."""
    import numpy as np

    width = min(int(moves.sum()), k + 10)
    block = np.random.default_rng(seed).standard_normal((len(moves), width)) * moves[:, None]
    basis, image = np.zeros((len(moves), 0)), np.zeros((len(moves), 0))
    for _ in range(steps):
        size = np.linalg.norm(block, axis=0)
        for _ in range(2):  # twice is enough for orthogonal blocks
            block = block - basis @ (basis.T @ block)
        left, length, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, length > 1e-10 * max(1e-300, size.max())]
        if block.shape[1]:
            basis, image = np.hstack([basis, block]), np.hstack([image, covariance(block)])
        inner = basis.T @ image
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        off = np.linalg.norm(image @ vector - basis @ vector * value, axis=0).max(initial=0.0)
        if not block.shape[1] or basis.shape[1] >= moves.sum() or off <= tolerance * max(1e-300, value[0]):
            break
        block = image[:, -block.shape[1] :]
    return basis @ vector, value


#: Entries times directions that are multiplied at once.
AT_ONCE = 1 << 22


def _slices(batch, width: int):
    """(first, past, rows, values, entries of each cell) of stretches of a batch with a bounded number of entries."""
    import numpy as np

    lists = batch.column("i")
    lengths = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    ends, at, v = np.cumsum(lengths), lists.flatten().to_numpy(), batch.column("v").flatten().to_numpy()
    first = 0
    while first < len(lengths):
        before = ends[first] - lengths[first]
        past = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE // max(1, width), "right")))
        yield first, past, at[before : ends[past - 1]], v[before : ends[past - 1]], lengths[first:past]
        first = past


def _along(at, v, lengths, block):
    """The sparse cells times block, one line a cell."""
    import numpy as np

    out = np.zeros((len(lengths), block.shape[1]))
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.add.reduceat(block[at] * v[:, None], (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def _gram(batches, block):
    """One number for each row and column of block: the cells of a task times block, back onto the rows."""
    import numpy as np
    import pyarrow as pa

    m, width = block.shape
    total, seen = np.zeros((m, width)), np.zeros(m, bool)
    for batch in batches:
        for _, _, at, v, lengths in _slices(batch, width):
            y = np.repeat(_along(at, v, lengths, block), lengths, axis=0) * v[:, None]
            for j in range(width):
                total[:, j] += np.bincount(at, y[:, j], m)
            seen[at] = True
    rows = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"i": pa.array(rows, pa.int32()), "w": pa.array(list(total[rows]), pa.list_(pa.float64()))})


def _scores(batches, block, shift):
    import pyarrow as pa

    for batch in batches:
        for first, past, at, v, lengths in _slices(batch, block.shape[1]):
            pca = pa.array(list(_along(at, v, lengths, block) - shift), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("col_id").slice(first, past - first), pca], ["col_id", "pca"])
