"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, word ends marked, and itself; a text is the mean vector of all
subwords of all its words. Embeddings and softmax are trained jointly, in numpy, on a bounded sample of labelled
texts. An unseen misspelling shares most n-grams, and so most of its vector, with the word it hides.

Scoring needs no more than one number per subword: the softmax is linear in the mean, so each embedding is projected
once. Tasks then score distinct words and average over each whole text; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import Rolling, long_id, training_rows

#: Defaults: labelled texts taken per class, hash buckets, vector length, n-gram lengths, passes, first step size. The last two were chosen by cross-validation over folds 1 to 4 (greater steps were unstable on one of them).
PER_CLASS, BUCKETS, DIM, NGRAMS, EPOCHS, RATE = 1200, 1 << 15, 8, (3, 4, 5), 30, 1000.0


class Subwords:
    """Hash buckets of the subwords of many words."""

    def __init__(self, buckets: int, ngrams: tuple[int, ...]):
        self.buckets, self.ngrams, self.rolling = np.uint64(buckets), ngrams, Rolling(9)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, word by word, and where each word's begin; the last bound is their number."""
        text = "".join(f"<{w.lower()}>" for w in words)
        lengths = np.fromiter((len(w.lower()) + 2 for w in words), dtype=np.int64, count=len(words))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sums = self.rolling.sums((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        owner, found = [np.arange(len(words))], [self.rolling.stretches(sums, starts, ends)]
        of = np.repeat(np.arange(len(words)), lengths)
        room = ends[of] - np.arange(len(codes))
        for n in self.ngrams:
            at = np.flatnonzero((room >= n) & (lengths[of] > n))
            owner.append(of[at])
            found.append(self.rolling.stretches(sums, at, at + n))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(found)[order] % self.buckets).astype(np.int32), np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))


def distinct_words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of an Arrow string column, the number of each word in order, and where each text begins."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    bounds = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64)))
    filled = np.asarray(pc.not_equal(flat, ""))
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    bounds = np.append(0, np.cumsum(filled))[bounds]
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows; empty stretches give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=values.dtype)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


class Model:
    """A number per bucket and a bias: the logit of a text is their mean over its subwords, plus the bias."""

    def __init__(self, numbers: np.ndarray, bias: float, ngrams: tuple[int, ...]):
        self.numbers, self.bias, self.ngrams = numbers, bias, ngrams

    def scores(self, texts) -> np.ndarray:
        words, index, bounds = distinct_words(texts)
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for i in range(0, len(words), 200_000):
            buckets, at = Subwords(len(self.numbers), self.ngrams)(words[i : i + 200_000])
            total[i : i + 200_000], count[i : i + 200_000] = _sums(self.numbers[buckets].astype(float), at), np.diff(at)
        x = _sums(total[index], bounds) / np.maximum(_sums(count[index], bounds), 1)
        return 1 / (1 + np.exp(-np.clip(x + self.bias, -500, 500)))


def _bags(texts, buckets: int, ngrams: tuple[int, ...]):
    """Sparse rows of subword shares: where each text's row begins, buckets, shares."""
    words, index, bounds = distinct_words(texts)
    grams, at = Subwords(buckets, ngrams)(words)
    size = np.diff(at)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = size[index]
    k = np.repeat(at[index] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
    cell, times = np.unique(np.repeat(text, n) * buckets + grams[k], return_counts=True)
    rows = cell // buckets
    total = np.bincount(rows, times, minlength=len(bounds) - 1)
    return np.searchsorted(rows, np.arange(len(bounds))), cell % buckets, (times / total[rows]).astype(np.float32)


def fit(texts, labels: np.ndarray, weights: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, ngrams: tuple[int, ...] = NGRAMS, epochs: int = EPOCHS, rate: float = RATE, batch: int = 128) -> Model:
    """Train embeddings and softmax together on the weighted log loss: small batches, a falling rate, momentum."""
    at, cols, shares = (np.concatenate(x) if k else x for k, x in enumerate(_bags_in_parts(texts, buckets, ngrams)))
    random = np.random.default_rng(7)
    table, out = random.normal(0, 0.05, (buckets, dim)).astype(np.float32), random.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([max(weights @ (labels == c), 1e-3) for c in (0, 1)], dtype=np.float32) / max(weights.sum(), 1e-3)) if len(labels) else np.zeros(2, dtype=np.float32)
    w = (weights / max(weights.mean(), 1e-9)).astype(np.float32) if len(labels) else weights
    target = np.eye(2, dtype=np.float32)[labels]
    moving, total, done = np.zeros_like(table), epochs * -(-len(labels) // batch), 0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            n = at[rows + 1] - at[rows]
            k = np.repeat(at[rows] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
            x = np.zeros((len(rows), buckets), dtype=np.float32)
            x[np.repeat(np.arange(len(rows)), n), cols[k]] = shares[k]
            mean = x @ table
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) * w[rows, None] / len(rows)
            now = rate * (1 - done / total)
            moving = 0.9 * moving - now * (x.T @ (d @ out.T))
            out = out - now / 500 * (mean.T @ d)
            bias = bias - now / 2000 * d.sum(axis=0)
            table += moving
            done += 1
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), ngrams)


def _bags_in_parts(texts, buckets: int, ngrams: tuple[int, ...], part: int = 200):
    """_bags of all texts, a few at a time, so that memory follows the longest texts and not their number."""
    at, cols, shares = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
    for i in range(0, len(texts), part):
        a, c, s = _bags(texts.slice(i, part), buckets, ngrams)
        at.append(a[1:] + at[-1][-1])
        cols.append(c.astype(np.int32))
        shares.append(s)
    return np.concatenate(at), cols, shares


def _score_batches(model: Model):
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")))], ["doc_id", "score"])

    return task


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most `per_class` labelled rows of each class, the ones with the least hashed ids; None without labels."""
    texts, values, weights = training_rows(docs, labels, label, per_class)
    return fit(texts, values, weights) if len(values) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `threshold`) of every row's whole text.

    A null or empty text has no subwords: its score is the model's bias. Without a model (no labels) every score is 0.
    Null and repeated doc_ids are scored like any other; other columns are ignored.
    """
    rows = docs.select(long_id(docs), "text")
    scored = rows.select("doc_id", F.lit(0.0).alias("score")) if model is None else rows.mapInArrow(_score_batches(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
