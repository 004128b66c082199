"""Quality scores from Naive Bayes support vectors (NB-SVM).

Features are n-gram indicators: is it in the text or not. The n-grams are words, pairs of neighbouring words, and word ends
(the last three bytes); a word like the one before it counts as the n-gram "again", so that runs of any word look alike.
Indicators are scaled by the log-count ratios of the two classes, texts to unit length, and a linear hinge-loss model is fitted
by dual coordinate descent on a bounded sample of labelled texts. The part of the sample that the descent did not see
turns margins into probabilities.

Tasks hash n-grams, look weights up and sum each text's distinct features; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import Rolling, Words, long_id, mix, steps, text_bytes, training_rows

#: Defaults: labelled texts taken per class, hashed features, passes of the descent, its bound C, and the NB share.
PER_CLASS, FEATURES, PASSES, C, SHARE = 3000, 1 << 18, 12, 1.0, 0.75


class Ngrams:
    """Distinct n-gram indicators of texts as sparse rows: where each row begins, and hashed features."""

    def __init__(self, features: int):
        self.features, self.rolling = np.uint64(features), Rolling(5)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = text_bytes(texts)
        at, found = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for i, j in steps(bounds):
            words = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            text = np.repeat(np.arange(j - i), np.diff(words.first))
            sums = self.rolling.sums(self.rolling.letters[words.data])
            whole = self.rolling.stretches(sums, words.start, words.end)
            tail = mix(self.rolling.stretches(sums, np.maximum(words.start, words.end - 3), words.end) + np.uint64(3))
            pair = mix(whole[:-1] * np.uint64(0x9FB21C651E98DF25) + whole[1:])
            pair[whole[1:] == whole[:-1]] = 1
            inside = text[1:] == text[:-1]
            grams = np.concatenate([whole, tail, pair[inside]]) % self.features
            cell = np.unique(np.concatenate([text, text, text[1:][inside]]).astype(np.uint64) * self.features + grams)
            found.append((cell % self.features).astype(np.int32))
            at.append(at[-1][-1] + np.searchsorted(cell, np.arange(1, j - i + 1, dtype=np.uint64) * self.features))
        return np.concatenate(at), np.concatenate(found)


class Model:
    def __init__(self, weights: np.ndarray, ratios: np.ndarray, slope: float, offset: float):
        self.weights, self.squares, self.slope, self.offset = (weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), slope, offset

    def margins(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        length = np.sqrt(np.bincount(text, self.squares[grams], minlength=len(at) - 1))
        return np.bincount(text, self.weights[grams], minlength=len(at) - 1) / np.maximum(length, 1e-9)

    def scores(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(at, grams) + self.offset, -500, 500)))


def log_count_ratios(at: np.ndarray, grams: np.ndarray, labels: np.ndarray, weights: np.ndarray, features: int) -> np.ndarray:
    label, weight = np.repeat(labels, np.diff(at)), np.repeat(weights, np.diff(at))
    p, q = (1 + np.bincount(grams, weight * (label == c), minlength=features) / max(weights[labels == c].mean() if (labels == c).any() else 1, 1e-9) for c in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(at: np.ndarray, grams: np.ndarray, labels: np.ndarray, ratios: np.ndarray, cost: np.ndarray, passes: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: one dual variable per text, kept between 0 and its cost."""
    w, alpha, random = np.zeros(len(ratios)), np.zeros(len(labels)), np.random.default_rng(3)
    sign = np.where(labels == 1, 1.0, -1.0)
    for _ in range(passes):
        for i in random.permutation(len(labels)).tolist():
            at_i = grams[at[i] : at[i + 1]]
            x = ratios[at_i]
            length = np.sqrt(x @ x)
            if not length:
                continue
            x = x / length
            old = alpha[i]
            alpha[i] = min(max(old - (sign[i] * (w[at_i] @ x) - 1), 0.0), cost[i])
            if alpha[i] != old:
                w[at_i] += (alpha[i] - old) * sign[i] * x
    return w


def fit(texts, labels: np.ndarray, weights: np.ndarray, features: int = FEATURES, passes: int = PASSES, c: float = C, share: float = SHARE) -> Model:
    at, grams = Ngrams(features)(texts)
    last = np.arange(len(labels)) % 5 == 4  # for the probabilities
    rows = np.flatnonzero(~last)
    n = np.diff(at)[rows]
    k = np.repeat(at[rows] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
    sub = np.append(0, np.cumsum(n)), grams[k], labels[rows]
    ratios = log_count_ratios(*sub, weights[rows], features)
    w = descend(*sub, ratios, c * weights[rows] / max(weights[rows].mean(), 1e-9), passes)
    w = share * w + (1 - share) * np.abs(w).mean() * np.sign(w)
    model = Model(w, ratios, 1.0, 0.0)
    margin, target = model.margins(at, grams)[last], labels[last]
    a, b = 1.0, 0.0
    if len(set(target.tolist())) == 2:
        for _ in range(50):  # Newton steps of a two-parameter logistic regression
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g = weights[last] * (p - target)
            h = weights[last] * p * (1 - p) + 1e-9
            m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
            step = np.linalg.solve(m, [g @ margin + 1e-3 * a, g.sum()])
            a, b = a - step[0], b - step[1]
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


def _parts(batches, rows: int = 500):
    """Smaller batches: the features of one are all that a task holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _score_batches(model: Model, features: int):
    def task(batches):
        import pyarrow as pa

        ngrams = Ngrams(features)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(*ngrams(part.column("text"))))], ["doc_id", "score"])

    return task


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most `per_class` labelled rows of each class, the ones with the least hashed ids; None without labels."""
    texts, values, weights = training_rows(docs, labels, label, per_class)
    return fit(texts, values, weights) if len(values) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `threshold`) of every row's whole text.

    A null or blank text has no features: its score comes from the offset alone. Without a model (no labels) every score is 1,
    so that a filter keeps everything. Null and repeated doc_ids are scored like any other; other columns are ignored.
    """
    rows = docs.select(long_id(docs), "text")
    scored = rows.select("doc_id", F.lit(1.0).alias("score")) if model is None else rows.mapInArrow(_score_batches(model, FEATURES), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, with all their columns. Without a model all stay."""
    if model is None:
        return docs
    columns = docs.columns

    def task(batches):
        import pyarrow as pa

        ngrams = Ngrams(FEATURES)
        for part in _parts(batches):
            good = model.scores(*ngrams(part.column(columns.index("text")))) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(task, docs.schema)
