"""Toxicity from subword-bag embeddings and a linear softmax.

A word is the average of the embeddings of its character n-grams (hashed into
a fixed table), a window of a few words the average of its words, and a linear
softmax reads the window. A misspelt or inflected word shares n-grams with the
words seen in training, and so their vectors. A document is as toxic as its
worst window, so one insult in a long text is not averaged away. Embeddings
and softmax are trained together in numpy on a bounded sample of labelled
documents; the gradient of each document goes through its worst window.

Only the text enters a score. The trained table reaches the tasks as one
number per n-gram bucket (half a megabyte, whatever the input).

Behaviour on awkward input: a null or empty text, or one without words, has
one empty window, whose average is zero; rows that repeat are scored each; long
texts are scored whole; labels that are null or name no document teach nothing,
nor do those of an id with both labels; of several rows with one id the smallest
text teaches; without labelled documents of both classes every score is the smoothed share
of toxic labels; an empty table gives an empty result; only the id and
text columns (and of the labels the id and label columns) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import buffers, distinct_words, gather, kept_rows, release_memory, slices
from ledgerlens.llm.tables import settled

#: Toxic and other labelled documents taken for training, at most, and the longest text taken, in characters.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_CHARS = 1500, 2500, 20_000
#: Character n-grams, hash buckets, embedding width, words in a window.
GRAMS, BUCKETS, WIDTH, WINDOW = (3, 4, 5, 6), 1 << 17, 8, 2
#: Bytes of distinct words whose n-grams are held at a time.
WORD_BYTES = 128 << 10
#: Passes over whole documents, then over worst windows; documents a step; step sizes.
WHOLE_EPOCHS, EPOCHS, BATCH, RATE, RATE_SCALE = 4, 8, 128, 0.5, 0.3
EDGE = " .,;:!?\"'()[]{}<>*#$%&|/\\-_~`"


@dataclass
class Model:
    """``table``: contribution of each n-gram to the toxic log-odds of a word; the log-odds of a
    document are ``scale`` * worst window + ``shift``."""
    table: np.ndarray
    scale: float
    shift: float


def gram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the hashed n-grams of each word, marked at both ends."""
    parts = [_gram_buckets(part) for part in _pieces(words)]
    counts = [np.diff(ends) for _, ends in parts]
    return (np.concatenate([found for found, _ in parts] or [np.zeros(0, np.int32)]),
            np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))]))


def _pieces(words: pa.Array) -> Iterator[pa.Array]:
    """The words in runs of ``WORD_BYTES``, so that the arrays of their n-grams stay small; a longer word is one run."""
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WORD_BYTES, side="right")))
        yield words.slice(begin, end - begin)
        begin = end


def word_values(table: np.ndarray, words: pa.Array) -> np.ndarray:
    """The mean of each word's n-grams in ``table``."""
    return np.concatenate([_means(table[grams], ends) for grams, ends in map(_gram_buckets, _pieces(words))] or [np.zeros(0)])


def _gram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    marked = pc.binary_join_element_wise("<", pc.utf8_trim(words, characters=EDGE), ">", "")
    offsets, data = buffers(marked)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(offsets))
    room = (offsets[1:][owner] - np.arange(len(data))).astype(np.int32)  # bytes from here to the word's end
    found, owners = [], []
    hashes = np.full(len(data), 2166136261, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[:max(len(data) - n + 1, 0)] = data[n - 1:]
        hashes = (hashes ^ shifted) * np.uint64(1099511628211)
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            found.append(((hashes[at] >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[at])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def _means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each range; 0 for an empty one."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def worst_windows(scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document (a range of word scores): (mean of the worst window, its first word, its words)."""
    counts = np.diff(offsets)
    sizes = np.minimum(counts, WINDOW)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(scores))
    at = at[at + sizes[doc] <= offsets[1:][doc]]
    value = (sums[at + sizes[doc[at]]] - sums[at]) / sizes[doc[at]]
    worst, first = np.zeros(len(counts)), offsets[:-1].copy()
    if len(at):
        order = np.lexsort((at, -value, doc[at]))
        lead = order[np.concatenate([[True], np.diff(doc[at[order]]) > 0])]
        worst[doc[at[lead]]], first[doc[at[lead]]] = value[lead], at[lead]
    return worst, first, sizes


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return distinct_words(pc.utf8_lower(pc.fill_null(texts, "")))


def train(texts, labels: list[int], prior: float, seed: int = 7) -> Model:
    """Fit embeddings and softmax together; ``texts``: a list or Arrow strings; ``prior``: share of toxic documents."""
    labels = np.asarray(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(np.log(prior / (1 - prior))))
    words, index, offsets = _words(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()))
    grams, ends = gram_buckets(words)
    size = np.maximum(np.diff(ends), 1)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.01, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 1, (2, WIDTH)), np.zeros(2)
    seen = np.full(BUCKETS, 1e-6)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for epoch in range(WHOLE_EPOCHS + EPOCHS):
        whole = epoch < WHOLE_EPOCHS
        rate = RATE * (1 - (epoch if whole else epoch - WHOLE_EPOCHS) / (WHOLE_EPOCHS if whole else EPOCHS))
        for docs in np.array_split(rng.permutation(len(labels)), -(-len(labels) // BATCH)):
            direction = out[1] - out[0]
            places, own = gather(offsets[docs], offsets[docs + 1])
            used, local = np.unique(index[places], return_inverse=True)
            flat, flat_ends = gather(ends[used], ends[used + 1])
            scores = _means((embed @ direction)[grams[flat]], flat_ends)[local]
            if whole:  # every word of the document, so that what recurs in toxic documents shows
                top, first, length = _means(scores, own), own[:-1], np.diff(own)
            else:
                top, first, length = worst_windows(scores, own)
            wrong = weight[docs] * (1 / (1 + np.exp(-(top + bias[1] - bias[0]))) - labels[docs])
            # Back through the average to its words, from them to their n-grams.
            at, _ = gather(first, first + length)
            share = np.bincount(local[at], np.repeat(wrong / np.maximum(length, 1), length), len(used)) / size[used]
            if not whole:
                kept = share != 0
                flat, flat_ends = gather(ends[used[kept]], ends[used[kept] + 1])
                share = share[kept]
            push = np.bincount(grams[flat], np.repeat(share, np.diff(flat_ends)), BUCKETS)
            touched = np.flatnonzero(push)
            push = push[touched]
            pull = push @ embed[touched]
            slope = push[:, None] * direction
            seen[touched] += (slope ** 2).mean(axis=1)
            embed[touched] -= RATE_SCALE * rate * slope / np.sqrt(seen[touched])[:, None]
            out -= 0.05 * rate / len(docs) * np.array([[-1.0], [1.0]]) * pull
            bias -= 0.2 * rate / len(docs) * wrong.sum() * np.array([-0.5, 0.5])
    line = embed @ (out[1] - out[0])
    top, _, _ = worst_windows(_means(line[grams], ends)[index], offsets)
    return Model(line.astype(np.float32), *_calibrate(top, labels, prior))


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of the label on the worst window, rows weighted to the given prior."""
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        h = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum()])
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn=None, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Train on a sample of the labelled documents for which ``learn`` (a condition on ``id``) holds.

    The sample is the first ``SAMPLE_TOXIC`` and ``SAMPLE_OTHER`` labels of each class by a hash of
    the id, without texts of over ``SAMPLE_CHARS`` characters."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if learn is not None:
        known = known.where(learn(F.col("id")))
    picked = settled(known)
    counts = picked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
    order = F.xxhash64("id")
    sample = picked.where("label = 1").orderBy(order, "id").limit(SAMPLE_TOXIC).unionAll(
        picked.where("label = 0").orderBy(order, "id").limit(SAMPLE_OTHER))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # At most SAMPLE_TOXIC + SAMPLE_OTHER rows are broadcast, and as many texts come back.
    rows = (texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).toArrow()
            .sort_by([("id", "ascending")]))
    prior = (counts["k"] + 1) / (counts["n"] + 2)
    model = train(rows.column("text"), rows.column("label").to_pylist(), prior)
    del rows
    release_memory()
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Score (0 to 1) of each text."""
    words, index, offsets = _words(texts)
    top = np.zeros(len(texts))
    if len(words):
        top, _, _ = worst_windows(word_values(model.table, words)[index], offsets)
    return 1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(shared.value, batch.column("text")))],
                                             ["doc_id", "score"])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, score double")


def drop_toxic(docs: DataFrame, model: Model, toxic_from: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``toxic_from`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda texts: scores(shared.value, texts) < toxic_from)
