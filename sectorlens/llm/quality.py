"""Quality by ordinal regression: one weight per hashed word, ordered thresholds between the grades.

The cumulative-link model says P(grade >= k) = sigmoid(score - threshold_k) with the same score for
all k: a sum of weights of a text's distinct hashed words and word beginnings, and of a few shares (signs, digits,
capitals) and the length. Expected grade and the probability of the highest grade follow.

Words are hashed into `BUCKETS` buckets. The model is fitted on at most `SAMPLE` labelled documents
(those with the smallest hash of their id among the ones not held out, whole texts), a stated bound;
every document is scored.

A null or empty text has no words and is scored by the thresholds and shares alone. Labels that are
null aren't used; several labels of a document count as the lowest grade. Without labels the
probabilities are null and every document is kept. Repeated rows are scored each. Columns other than
doc_id and text (and the two labels) aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.language import held_out
from sectorlens.llm.words import _LOWER, _SPACE, mix, span_hashes

BUCKETS = 1 << 18
SAMPLE = 8192
GRADES = 3
STEM = 6  # bytes of a longer word that count as a word of their own
LEAST_TEXTS = 8  # texts of the sample that a bucket must occur in
STEPS, RATE, DECAY = 300, 0.05, 1e-4
SHARES = 4
_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 sign
_KIND[_SPACE] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_VALUE = _LOWER.copy()
_VALUE[48:58] = 48  # numbers differ by length only


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text, where they begin (n + 1 places), and each text's shares."""
    n, texts = len(data), len(bounds) - 1
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(begin)
    ends = np.r_[starts[1:], n]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    text = np.searchsorted(bounds, starts, "right") - 1
    long = ends - starts > STEM
    marked = _VALUE[data]
    hashes = np.r_[span_hashes(marked, starts, ends), mix(span_hashes(marked, starts[long], starts[long] + STEM))]
    code = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    own = np.unique(np.r_[text, text[long]] * BUCKETS + code)
    length = np.maximum(np.diff(bounds), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][bounds]) / length

    shares = np.stack(
        [share(kind == 3), share(kind == 2), share((data >= 65) & (data <= 90)), np.log1p(np.bincount(text, minlength=texts))], 1
    )
    return own % BUCKETS, np.searchsorted(own, np.arange(texts + 1) * BUCKETS), shares


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per bucket
    mean: np.ndarray
    scale: np.ndarray
    share_weights: np.ndarray
    thresholds: np.ndarray  # ascending, one below each grade but the lowest

    def tails(self, buckets: np.ndarray, places: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and k from 1."""
        total = np.r_[0, np.cumsum(self.weights[buckets])]
        score = total[places[1:]] - total[places[:-1]] + (shares - self.mean) / self.scale @ self.share_weights
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_model(buckets: list[np.ndarray], shares: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood with weight decay, by full gradient steps with adaptive sizes."""
    lengths = np.array([len(b) for b in buckets])
    flat = np.concatenate(buckets).astype(np.int64)
    often = np.bincount(flat, minlength=BUCKETS) >= LEAST_TEXTS
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(buckets)), lengths)[often[flat]]
    flat = column[flat[often[flat]]]
    size = int(often.sum())
    mean, scale = shares.mean(axis=0), shares.std(axis=0) + 1e-6
    dense = (shares - mean) / scale
    # Parameters: word weights, share weights, first threshold, logs of the gaps to the next ones.
    x = np.zeros(size + SHARES + n_grades - 1)
    x[-(n_grades - 1)] = -1.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        words, own, cuts = x[:size], x[size : size + SHARES], x[size + SHARES :]
        thresholds = cuts[0] + np.r_[0, np.cumsum(np.exp(cuts[1:]))]
        score = np.bincount(row, words[flat], len(buckets)) + dense @ own
        above = np.c_[np.ones(len(score)), _sigmoid(score[:, None] - thresholds), np.zeros(len(score))]
        slope = above * (1 - above)
        each = np.arange(len(score))
        likely = np.maximum(above[each, grades] - above[each, grades + 1], 1e-9)
        by_score = -(slope[each, grades] - slope[each, grades + 1]) / likely / len(score)
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, slope[each, grades] / likely / len(score))
        np.add.at(by_cut, grades + 1, -slope[each, grades + 1] / likely / len(score))
        by_cut = by_cut[1:-1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.r_[
            np.bincount(flat, by_score[row], size) + DECAY * words, dense.T @ by_score + DECAY * own, tail[0], tail[1:] * np.exp(cuts[1:])
        ]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        x = x - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[often] = x[:size]
    cuts = x[size + SHARES :]
    return Model(weights, mean, scale, x[size : size + SHARES], cuts[0] + np.r_[0, np.cumsum(np.exp(cuts[1:]))])


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rated = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, n_grades: int = GRADES) -> Model | None:
    """Fit on at most `sample` graded documents; None without any."""
    chosen = grades.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def rows(batches):
        for batch, data, bounds in text_slices(batches):
            buckets, places, shares = features(data, bounds)
            ends = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("grade"),
                    pa.ListArray.from_arrays(ends, pa.array(buckets.astype(np.int32))),
                    pa.array(list(shares), pa.list_(pa.float64())),
                ],
                ["doc_id", "grade", "buckets", "shares"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rated.mapInArrow(rows, f"doc_id {kind}, grade int, buckets array<int>, shares array<double>")
    table = found.dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if not len(table):
        return None
    return fit_model(
        [np.asarray(b) for b in table["buckets"]], np.stack(table["shares"].to_list()), table["grade"].to_numpy(np.int64), n_grades
    )


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, p_good, keep)``; kept if the highest grade is at least this probable."""

    def rows(batches):
        for batch, data, bounds in text_slices(batches):
            if model is None:
                expected = top = pa.nulls(batch.num_rows, pa.float64())
                keep = pa.array([True] * batch.num_rows)
            else:
                tails = model.tails(*features(data, bounds))
                expected, top, keep = pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), expected, top, keep], ["doc_id", "expected_grade", "p_good", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, expected_grade double, p_good double, keep boolean")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out, and grade all documents."""
    graded_docs = score(docs, fit(docs, graded(labels)))
    return graded_docs.withColumn("held_out", held_out())
