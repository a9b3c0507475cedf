"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import share, small

#: Hash buckets of the n-grams, and their lengths in bytes.
BUCKETS, SIZES = 1 << 19, (3, 4, 5)
#: Rows of each class that the linear weights are fitted on at most; counts use all rows.
SAMPLE_ROWS = 1500
#: Added to each count, and the standard errors by which a ratio must differ from even odds.
SMOOTH, DOUBT = 1.0, 3.0
#: Logistic regression: steps, their size, the weight that all features start with and the pull back to it.
STEPS, RATE, START, RIDGE = 80, 0.02, 0.3, 1e-3
#: Bytes of one text whose n-grams are hashed at once.
BLOCK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of the text that overlap so that every n-gram lies in one."""
    for at in range(0, max(len(data) - 2, 1), BLOCK):
        yield data[at : at + BLOCK + max(SIZES) - 1]


def buckets(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, with repeats. A-Z count as lower case, white space as a space."""
    data = _FOLD[np.frombuffer(text or b"", dtype=np.uint8)]
    data = np.concatenate([[32], data, [32]]).astype(np.uint64)
    for part in _blocks(data):
        code = part
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            code = (code[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            if n in SIZES:
                mixed = (code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
                yield (mixed >> np.uint64(45)).astype(np.int64)


class Features:
    """Distinct buckets of a text, with one table reused for all texts."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, dtype=bool)

    def of(self, text: bytes | None) -> np.ndarray:
        """Bucket numbers in order."""
        for part in buckets(text):
            self.seen[part] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def class_counts(rows: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and in how many of them each bucket occurs, over all ``rows``."""

    def work(batches):
        features = Features()
        total = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                total[label, features.of(text.as_py())] += 1
                total[label, BUCKETS] += 1
        for label in (0, 1):
            cells = np.flatnonzero(total[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells + label * (BUCKETS + 1)), pa.array(total[label, cells])], names=["cell", "n"]
            )

    sums = (
        rows.select(F.col(text_col).cast("binary"), F.col(label_col).cast("int"))
        .mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(2 * (BUCKETS + 1))
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    out = out.reshape(2, -1)
    return out[:, -1], out[:, :-1]


class Model:
    """Weights of the buckets and the intercept of a logistic score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        """0 to 1: the logistic of the weights of the text's distinct buckets."""
        weights = self.weights
        found = [part[weights[part] != 0] for part in buckets(text)]
        z = self.bias + (weights[np.unique(np.concatenate(found))].sum() if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(rows: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Log-count ratios of the buckets, less ``DOUBT`` standard errors; 0 for those that are less sure."""
    chance = (seen + SMOOTH) / (rows[:, None] + 2 * SMOOTH)
    ratio = np.log(chance[1] / chance[0])
    error = np.sqrt((1 / (seen + SMOOTH)).sum(0))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DOUBT * error, 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the documents that ``labels`` (id, label 0 or 1) names.

    Counts are taken over all of them. The weights of the scaled features are fitted by
    logistic regression on at most ``sample_rows`` whole documents of each class, the
    first by a hash of the id. An id with several labels is toxic if one of them says so;
    null ids and other labels are passed over. Without rows of both classes the score is the share of
    toxic rows, a half if there are none.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    labels = labels.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    rows = docs.select(id_col, text_col).join(small(labels, 32), id_col)
    size, seen = class_counts(rows, text_col, label_col)
    if not size.all():
        share = 0.5 if not size.any() else size[1] / size.sum()
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    scale = ratios(size, seen)
    drawn = []
    for label in (0, 1):
        order = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity"))
        part = labels.where(F.col(label_col) == label).orderBy(order, id_col).limit(sample_rows)
        drawn.append(part)
    sample = docs.select(id_col, text_col).join(F.broadcast(drawn[0].unionByName(drawn[1])), id_col)
    table = sample.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), F.col(label_col).cast("int").alias("y"))
    return _regress(table.orderBy(id_col).limit(4 * sample_rows).toArrow(), scale, size)


def _regress(table: pa.Table, scale: np.ndarray, size: np.ndarray) -> Model:
    """Logistic regression of the labels on the scaled buckets, by Adam from the ratios themselves."""
    features = Features()
    found = [f[scale[f] != 0] for f in (features.of(t.as_py()) for t in table.column("text"))]
    y = np.array(table.column("y").to_pylist(), dtype=np.float64)
    used, cells = np.unique(np.concatenate(found), return_inverse=True) if found else (np.empty(0, int), np.empty(0, int))
    starts = np.cumsum([0, *map(len, found)])
    x = scale[used][cells].astype(np.float32)
    row = np.repeat(np.arange(len(found)), np.diff(starts))
    weight, bias = np.full(len(used), START), 0.0
    mean_w, var_w, mean_b, var_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, x * weight[cells], len(found)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance
        grad = np.bincount(cells, x * error[row], len(used)) + RIDGE * (weight - START)
        grad_b = error.sum()
        mean_w, var_w = 0.9 * mean_w + 0.1 * grad, 0.999 * var_w + 0.001 * grad**2
        mean_b, var_b = 0.9 * mean_b + 0.1 * grad_b, 0.999 * var_b + 0.001 * grad_b**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        weight = weight - RATE * (mean_w / fix) / (np.sqrt(var_w / fix2) + 1e-9)
        bias -= 4 * RATE * (mean_b / fix) / (np.sqrt(var_b / fix2) + 1e-9)
    # Buckets that the sample doesn't have keep the weight that all start with.
    weights = scale * START
    weights[used] = scale[used] * weight
    return Model(weights, float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the score of its whole text (null counts as empty), 0 to 1."""
    shared = share(docs.sparkSession, model)

    def work(batches):
        for batch in batches:
            scores = [shared.value.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary")).mapInArrow(
        work, "id long, score double"
    )
