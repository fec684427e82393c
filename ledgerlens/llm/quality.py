"""Quality by regularised quadratic discriminant analysis of document statistics.

Every document is reduced to a dozen statistics (shares of character kinds,
lengths, repetition), each on a log scale. For each class the labelled
documents give a mean and a covariance, shrunk towards the pooled covariance
and its diagonal; a score is the logistic of the difference of the two log
densities, from Mahalanobis distances by cached Cholesky factors, and of the
class shares.

All labelled documents outside the held-out fold are used: their sums and
cross products are added up in Spark, so one row reaches the driver whatever
the input. The statistics are computed in one pass over the texts and stored
(about a hundred bytes a document); fitting and scoring read that table.

Behaviour on awkward input: null is the empty text, whose statistics are
those of no characters, words or lines; rows that repeat are scored each; long
texts are read whole; labels that are null or name no document teach nothing,
nor do those of an id with both labels; with fewer than two labelled documents of a class every score is the smoothed
share of good ones; an empty table gives an empty result; only the id and text
columns (and of the labels the id and label columns) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import buffers, distinct_words, kept_rows, slices
from ledgerlens.llm.tables import settled, stored

#: Share of the pooled covariance in each class's, and of its diagonal in the result.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.3, 0.1
#: Added to a share before its logarithm.
SMALL = 0.005

STATISTICS = ("words", "word_length", "longest", "upper", "digits", "symbols", "marks", "bars", "distinct",
              "most_common", "repeats", "line_words", "distinct_lines")

_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("A"):ord("Z") + 1] = 1
_KINDS[ord("0"):ord("9") + 1] = 2
for _c in "#$%&*+<=>@[\\]^_`{}~/":
    _KINDS[ord(_c)] = 3
for _c in "!?;:'\"()-":
    _KINDS[ord(_c)] = 4
_KINDS[ord("|")] = 5


def _distinct(coded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most common one) in each range."""
    count = len(offsets) - 1
    of = np.repeat(np.arange(count), np.diff(offsets))
    pairs, times = np.unique(of.astype(np.int64) << 32 | coded, return_counts=True)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, pairs >> 32, times)
    return np.bincount(pairs >> 32, minlength=count), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text, already on their log scales."""
    texts = pc.fill_null(texts, "")
    offsets, data = buffers(texts)
    size = np.maximum(np.diff(offsets), 1)
    kinds = _KINDS[data]

    def share(kind: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kinds == kind)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    words, index, of_text = distinct_words(texts)
    n = np.diff(of_text)
    some = np.maximum(n, 1)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    total = np.concatenate([[0], np.cumsum(lengths)])
    longest = np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        longest[full] = np.maximum.reduceat(lengths, of_text[:-1][full])
    distinct, common = _distinct(index, of_text)
    same = np.zeros(len(index), bool)
    same[1:] = index[1:] == index[:-1]
    same[of_text[:-1][full]] = False
    repeats = np.concatenate([[0], np.cumsum(same)])
    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    line_at -= line_at[0] if len(line_at) else 0
    line_kinds, _ = _distinct(lines.flatten().dictionary_encode().indices.to_numpy(), line_at)
    line_count = np.maximum(np.diff(line_at), 1)

    def log(x: np.ndarray) -> np.ndarray:
        return np.log(x + SMALL)

    return np.column_stack([
        np.log1p(n), np.log1p((total[of_text[1:]] - total[of_text[:-1]]) / some), np.log1p(longest), log(share(1)),
        log(share(2)), log(share(3)), log(share(4)), log(share(5)), log(distinct / some), log(common / some),
        log((repeats[of_text[1:]] - repeats[of_text[:-1]]) / some), np.log1p(n / line_count), log(line_kinds / line_count)])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats array<double>`` of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "stats"])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, stats array<double>")


@dataclass
class Model:
    """Log density of a class: ``log_share - log_root - |factor @ (x - mean)|^2 / 2``; classes 0 and 1."""
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors of the covariances
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -500, 500)))

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        return density[1] - density[0]


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", learn=None, id_col: str = "doc_id") -> Model:
    """Class means and shrunk covariances over every labelled document for which ``learn`` holds."""
    p = len(STATISTICS)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if learn is not None:
        known = known.where(learn(F.col("id")))
    rows = stats.hint("merge").join(settled(known), stats["doc_id"] == known["id"])
    x = [F.col("stats")[i] for i in range(p)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i + 1)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    n = np.array([found[k]["n"] if k in found else 0 for k in (0, 1)], float)
    share = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Model(np.zeros((2, p)), np.zeros((2, p, p)), share)
    means, covs = np.zeros((2, p)), np.zeros((2, p, p))
    for k in (0, 1):
        means[k] = [found[k][f"s{i}"] / n[k] for i in range(p)]
        for i in range(p):
            for j in range(i + 1):
                covs[k, i, j] = covs[k, j, i] = found[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    pooled = (covs * n[:, None, None]).sum(axis=0) / n.sum()
    factors, constants = np.zeros((2, p, p)), np.zeros(2)
    for k in (0, 1):
        cov = (1 - SHRINK_POOLED) * covs[k] + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + 1e-6 * np.eye(p)
        root = np.linalg.cholesky(cov)
        factors[k] = np.linalg.inv(root)
        constants[k] = share[k] - np.log(np.diag(root)).sum()
    return Model(means, factors, constants)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) from the stored statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("stats")
            rows = lists.flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows))], ["doc_id", "score"])
    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")


def fit_score(docs: DataFrame, labels: DataFrame, learn=None, label_col: str = "quality", id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document, the model fitted on the labelled ones."""
    stats = stored(with_statistics(docs, id_col, text_col), "quality-stats")
    return score(stats, fit(stats, labels, label_col, learn, id_col))


def drop_poor(docs: DataFrame, model: Model, good_from: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score less than ``good_from``."""
    return kept_rows(docs, text_col, lambda texts: model.scores(statistics(texts)) >= good_from)
