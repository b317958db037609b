"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each document has a vector of STATS, transformed so that ordinary texts of any length lie close together. For each language, and for each language and
source, the mean and covariance of the SHARE of documents that lie closest together are estimated. A document is rejected if its squared Mahalanobis
distance from the model of its language and source is above CUTOFF.

The estimate takes concentration steps over all documents, not over a sample: from medians and median deviations (a deterministic start), distances are
taken, the nearest SHARE of the documents give the next mean and covariance, and so on until no group changes. A step is one
aggregation: sums of values and products by group and distance bin, from which a window takes the bins up to the wanted share. Values
are whole UNITs, so sums are exact and results do not depend on the order of rows. Bins are 1/16 of a doubling of the distance wide; the subset ends with
the bin that reaches SHARE, a half, so that estimates hold while less than half of a group is low quality. Covariances get FLOOR squared on their
diagonal, since statistics may be the same in most documents.

Few documents say little, so models are drawn together by weight, without a size at which the rule changes: a language's covariance is the mean of its own, weighted by its
documents, and the unit matrix, weighted PRIOR; mean and covariance of a language and source are the means of their own, weighted by their documents, and
their language's, weighted PRIOR. Every document is tested, whatever the size of its group: those of a small group against a wide model.

Defined results: null and empty texts have the statistics of ordinary text without words and are tested like others; a null language or source is a group of its own; each row is tested,
repeated ones and ones with a null doc_id too; other columns are ignored (`verdicts`) or returned as they are (`kept`); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import IS_WORD, buffer, discard, per_doc, place_of, run_hashes, runs, sliced, small_side, text_of, unused, words, written

STATS = ["symbols", "capitals", "stutter", "word_length", "word_spread", "repeats"]
D = len(STATS)
UNIT = 1 / 256
SHARE = 0.5
#: Documents that the prior counts as.
PRIOR = 50
FLOOR = 0.25
CUTOFF = 140.0
#: A group's steps end when its log-determinant falls by no more than this.
SETTLED = 0.005
_MODEL = "grp string, centre array<double>, cov array<double>, inverse array<double>, logdet double, gain double"
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~IS_WORD
_SYMBOL[list(b".,;:'\"?()-")] = False
_LOWER, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_LOWER[97:123], _UPPER[65:91] = True, True


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents x D) whole UNITs."""
    n = len(offsets) - 1
    begin, end, doc = words(raw, offsets)
    size = np.log((end - begin).astype(float))
    count = per_doc(doc, None, n)
    h = run_hashes(raw, begin, end)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    place = np.repeat(np.arange(n), np.diff(offsets))

    def number(mask: np.ndarray) -> np.ndarray:
        return per_doc(place[mask], None, n)

    upper, lower = number(_UPPER[raw]), number(_LOWER[raw])
    some = np.maximum(count, 1)
    mean = per_doc(doc, size, n) / some
    spread = np.sqrt(np.maximum(per_doc(doc, size**2, n) / some - mean**2, 0))
    # share of the bytes in lines that stand in the document before
    a, b, of = runs(raw != 10, offsets)
    with np.errstate(over="ignore"):
        key = run_hashes(raw, a, b) ^ ((of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(a), bool)
    again[first] = False
    repeated = per_doc(of[again], (b - a)[again], n) / np.maximum(np.diff(offsets), 1)
    # few words say little: shares are drawn to those of ordinary text by a few words' weight
    values = [
        4 * np.log1p(number(_SYMBOL[raw]) / (count + 10) / 0.1),
        4 * np.log1p(upper / (upper + lower + 30) / 0.1),
        4 * np.log1p(per_doc(doc[same], None, n) / (count + 10) / 0.1),
        4 * (mean * count + 1.6 * 10) / (count + 10),
        2 * np.log((spread * count + 0.6 * 10) / (count + 10)),
        4 * repeated,
    ]
    return np.rint(np.stack(values, 1) / UNIT).astype(np.int64)


def _signed(docs: DataFrame, column: str = "_stats") -> DataFrame:
    """docs with a column of statistics."""
    at = place_of("text", docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            value = statistics(*buffer(batch.column(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, D), pa.int32()), pa.array(value.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, column])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def _key(*columns: str) -> Column:
    """One string for the values; null differs from any string."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))


def _inverse(cov: np.ndarray) -> list[float]:
    """Upper triangle, off-diagonal terms doubled."""
    inverse = np.linalg.inv(cov)
    return [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]


def _square(triangle: list[float]) -> np.ndarray:
    cov = np.zeros((D, D))
    for (i, j), x in zip(_PAIRS, triangle, strict=True):
        cov[i, j] = cov[j, i] = x
    return cov


def _models(rows: DataFrame) -> DataFrame:
    """(grp, n, sums, products, logdet) to rows of _MODEL, in units of 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for grp, n, sums, products, before in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                # whole numbers until here: exact differences
                cov = _square([(p * n - sums[i] * sums[j]) / (n * n) * UNIT * UNIT for (i, j), p in zip(_PAIRS, products, strict=True)])
                cov[np.diag_indices(D)] += FLOOR * FLOOR
                logdet = float(np.linalg.slogdet(cov)[1])
                out.append((grp, [x * UNIT / n for x in sums], [float(cov[i, j]) for i, j in _PAIRS], _inverse(cov), logdet, before - logdet))
            types = (pa.string(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["grp", "centre", "cov", "inverse", "logdet", "gain"])

    return rows.mapInArrow(work, _MODEL)


def combined(n: int, centre: np.ndarray, cov: np.ndarray, n_language: int, centre_language: np.ndarray, cov_language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a language and source, drawn to those of the language."""
    wide = (n_language * cov_language + PRIOR * np.eye(D)) / (n_language + PRIOR)
    return (n * centre + PRIOR * centre_language) / (n + PRIOR), (n * cov + PRIOR * wide) / (n + PRIOR)


def _combine(rows: DataFrame) -> DataFrame:
    """Rows (cell, n, centre, cov, n, centre, cov), the latter of the language, to (cell, centre, inverse)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cell, n, centre, cov, n_language, centre_language, cov_language in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                mean, cov = combined(n, np.array(centre), _square(cov), n_language, np.array(centre_language), _square(cov_language))
                out.append((cell, mean.tolist(), _inverse(cov)))
            types = (pa.string(), *[pa.list_(pa.float64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["cell", "centre", "inverse"])

    return rows.mapInArrow(work, "cell string, centre array<double>, inverse array<double>")


def distance(stats: str = "stats", centre: str = "centre", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, of six places; inverse holds the upper triangle with doubled off-diagonal terms."""
    x = [F.col(stats)[i] * F.lit(UNIT) - F.col(centre)[i] for i in range(D)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + F.col(inverse)[k] * x[i] * x[j]
    return F.round(total, 6)


def _medians(values: DataFrame) -> DataFrame:
    """(grp, k, m) of rows (grp, k, x): exact lower medians, from counts of each value."""
    counts = values.groupBy("grp", "k", "x").agg(F.count("*").alias("c"))
    group = Window.partitionBy("grp", "k")
    upto = F.sum("c").over(group.orderBy("x"))
    return counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(group)).where("2 * upto >= n").groupBy("grp", "k").agg(F.min("x").alias("m"))


def fit(vectors: DataFrame, share: float = SHARE) -> DataFrame:
    """(grp, centre, cov) of rows (grp, stats): a written table."""
    values = vectors.select("grp", F.posexplode("stats").alias("k", "x"))
    middle = written(_medians(values), "medians")
    size = middle.count()
    off = values.join(small_side(middle, size), ["grp", "k"]).select("grp", "k", F.abs(F.col("x") - F.col("m")).alias("x"))
    spread = written(_medians(off).withColumnRenamed("m", "s").join(middle, ["grp", "k"]), "spreads")
    # MAD times 1.4826 estimates a normal deviation
    start = spread.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("a"))
    wide = [F.lit(1.0) / (F.pow(F.col("a")[i]["s"] * UNIT * 1.4826, 2) + FLOOR * FLOOR) for i in range(D)]
    inverse = F.array(*(wide[i] if i == j else F.lit(0.0) for i, j in _PAIRS))
    models = written(start.select("grp", F.array(*(F.col("a")[i]["m"] * UNIT for i in range(D))).alias("centre"), inverse.alias("cov"), inverse.alias("inverse"), F.lit(1e9).alias("logdet"), F.lit(1e9).alias("gain")), "models")
    number = models.count()
    made = [middle, spread, models]
    x = [F.col("stats")[i].cast("long") for i in range(D)]
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = models.limit(0)
    while True:
        # a group whose determinant no longer falls keeps its model: every step then lowers one, so steps end
        done = done.unionByName(models.where(F.col("gain") <= SETTLED))
        active = models.where(F.col("gain") > SETTLED)
        if active.isEmpty():
            out = written(done.select("grp", "centre", "cov"), "settled")
            discard(*made)
            return out
        near = vectors.join(small_side(active, number), "grp").withColumn("bin", F.floor(F.log2(F.greatest(distance(), F.lit(2.0**-10))) * 16).cast("int"))
        sums = near.groupBy("grp", "bin").agg(F.count("*").alias("n"), F.max("logdet").alias("logdet"), *(F.sum(x[i]).alias(f"s{i}") for i in range(D)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS))
        subset = sums.withColumn("_all", F.sum("n").over(group)).withColumn("_before", before).where(F.col("_before") < F.ceil(F.lit(share) * F.col("_all")))
        total = subset.groupBy("grp").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"s{i}") for i in range(D))).alias("sums"), F.array(*(F.sum(f"p{i}_{j}") for i, j in _PAIRS)).alias("products"), F.max("logdet").alias("logdet"))
        models = written(_models(total), "models")
        made.append(models)


def _fitted(docs: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Statistics of all documents (doc_id, language, cell, stats), and a model for each cell."""
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key("lang").alias("language"), _key("lang", "source").alias("cell"), text_of().alias("text"))
    vectors = written(_signed(wide, "stats").drop("text"), "statistics")
    # each document counts in two groups
    of_cell, of_language = F.concat(F.lit("cell "), "cell"), F.concat(F.lit("language "), "language")
    models = fit(vectors.select(F.explode(F.array(of_cell, of_language)).alias("grp"), "stats"), share)
    sizes = vectors.groupBy("language", "cell").agg(F.count("*").alias("n")).withColumn("n_language", F.sum("n").over(Window.partitionBy("language")))
    above = models.select(F.col("grp").alias("above"), F.col("centre").alias("centre_language"), F.col("cov").alias("cov_language"))
    rows = sizes.join(models, F.col("grp") == of_cell).join(above, F.col("above") == of_language).select("cell", "n", "centre", "cov", "n_language", "centre_language", "cov_language")
    fitted = written(_combine(rows), "fitted")
    discard(models)
    return vectors, fitted


def verdicts(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF) -> DataFrame:
    """Rows (doc_id, d2, rejected), one for each row."""
    vectors, fitted = _fitted(docs, share)
    judged = vectors.join(small_side(fitted, fitted.count()), "cell").withColumn("d2", distance())
    return judged.select("doc_id", "d2", (F.col("d2") > cutoff).alias("rejected"))


def kept(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are not rejected, with all their columns. Statistics are computed again rather than texts shuffled."""
    vectors, fitted = _fitted(docs, share)
    discard(vectors)
    stats, cell, centre, inverse = (unused(n, docs.columns) for n in ("_stats", "_cell", "_centre", "_inverse"))
    models = fitted.select(F.col("cell").alias(cell), F.col("centre").alias(centre), F.col("inverse").alias(inverse))
    judged = _signed(docs, stats).join(small_side(models, models.count()), _key("lang", "source") == F.col(cell))
    return judged.where(distance(stats, centre, inverse) <= cutoff).select(*(F.col(f"`{c}`") for c in docs.columns))
