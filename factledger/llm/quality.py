"""Quality classifier: regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics (log counts and
logits of shares), written once for all documents. Class means and covariances
are sums of moments, added up in the tasks, so all labelled rows are used and
only one small matrix per class reaches the driver. Covariances are shrunk
towards the diagonal of the pooled one; their Cholesky factors are worked out
once and sent with the tasks, which score by the difference of the two
Mahalanobis log-densities.

Statistics are cut off at ``CUT`` pooled deviations from the mean, so that one
odd value cannot decide alone. Null and empty texts are vectors of zeros of
counts and are scored like any other. A label row for an unknown document is
ignored; repeated labels and documents count as often as they appear. If only
one class has labels the score is that class; without labels it is 0.5. Only
the text is an input of the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import drained, pin, prepare, text_or_empty

SHRINKAGE = 0.1
CUT = 5.0
THRESHOLD = 0.3
#: Words of one stretch: the statistics of the worst stretch show junk inside good text.
STRETCH = 64
#: Bytes of one compressed block.
BLOCK = 1 << 16

_TRAIL = re.compile(rb"[^\w\s\x80-\xff]{2,}$")
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ENDS = b".!?;:,"

NAMES = (
    "words word_length distinct repeated top_word upper symbols digits marks trailing short "
    "lines line_length same_lines packed worst_upper worst_symbols worst_repeat worst_distinct worst_trailing"
).split()


def _share(part: float, whole: float) -> float:
    """Logit of a share, steady at 0 and 1."""
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole else 0.0


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one text."""
    data = text.encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return np.zeros(len(NAMES))
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, n - 1)
    upper = size - len(data.translate(None, _UPPER))
    symbols = size - len(data.translate(None, _SYMBOLS))
    trailing = np.fromiter((_TRAIL.search(w) is not None for w in words), bool, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    packed = sum(len(zlib.compress(data[k : k + BLOCK], 1)) for k in range(0, size, BLOCK))
    worst = np.full(5, -np.inf)
    starts = [*range(0, n - STRETCH + 1, STRETCH)]
    if n % STRETCH:
        starts.append(max(0, n - STRETCH))  # the last words, with some of the stretch before
    for k in starts:
        part = words[k : k + STRETCH]
        joined = b"".join(part)
        worst = np.maximum(
            worst,
            [
                _share(len(joined) - len(joined.translate(None, _UPPER)), len(joined)),
                _share(len(joined) - len(joined.translate(None, _SYMBOLS)), len(joined)),
                _share(float(again[k : k + STRETCH - 1].sum()), len(part)),
                _share(len(part) - len(set(part)), len(part)),
                _share(float(trailing[k : k + STRETCH].sum()), len(part)),
            ],
        )
    return np.array(
        [
            np.log1p(n),
            np.log(lengths.mean()),
            np.log(len(counts)) / np.log(n + 1),
            _share(float(again.sum()), n),
            _share(max(counts.values()), n),
            _share(upper, size),
            _share(symbols, size),
            _share(size - len(data.translate(None, _DIGITS)), size),
            _share(size - len(data.translate(None, _ENDS)), size),
            _share(float(trailing.sum()), n),
            _share(float((lengths <= 3).sum()), n),
            np.log1p(len(lines)),
            np.log(size / len(lines)),
            _share(len(lines) - len(set(lines)), len(lines)),
            np.log(packed / size),
            *worst,
        ]
    )


def vectors(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<double>)`` of every row, written once."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.stack([statistics(t.as_py()) for t in batch.column(1)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows))], ["doc_id", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, work)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return pin(rows.mapInArrow(run, "doc_id long, x array<double>"), "quality-vectors")


def _moments(labelled: DataFrame, center: np.ndarray, scale: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class, of standardised cut values."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            z = np.clip((x - center) / scale, -CUT, CUT)
            y = np.asarray(batch.column(1))
            for label in np.unique(y):
                own = z[y == label]
                add = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                sums[int(label)] = sums.get(int(label), 0) + add
        for label, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array([label] * len(total), pa.int32()),
                    "k": pa.array(range(len(total)), pa.int32()),
                    "v": pa.array(total),
                }
            )

    parts = labelled.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, k int, v double")
    out: dict[int, np.ndarray] = {}
    for row in parts.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():  # 2 x (1 + d + d * d) numbers
        out.setdefault(row["label"], np.zeros(1 + d + d * d))[row["k"]] = row["v"]
    return {label: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for label, v in out.items()}


@dataclass
class Model:
    """What a task needs to score: per class the mean, the Cholesky factor, its log determinant."""

    center: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        z = np.clip((x - self.center) / self.scale, -CUT, CUT)
        value = {}
        for label, (prior, mean, factor, log_det) in self.classes.items():
            u = np.linalg.solve(factor, (z - mean).T)
            value[label] = np.log(prior) - log_det - 0.5 * (u * u).sum(axis=0)
        return 1.0 / (1.0 + np.exp(np.clip(value[0] - value[1], -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """The model of ``(x, label)`` rows, label 0 or 1; other labels are ignored."""
    d = len(NAMES)
    labelled = labelled.filter("label IN (0, 1) AND x IS NOT NULL")
    x = [F.col("x")[k] for k in range(d)]
    row = labelled.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    center = np.array([v or 0.0 for v in row[:d]])
    scale = np.array([v if v and v > 1e-9 else 1.0 for v in row[d:]])
    sums = _moments(labelled, center, scale)
    total = sum(n for n, _, _ in sums.values())
    means = {label: s / n for label, (n, s, _) in sums.items()}
    scatter = {label: q - n * np.outer(means[label], means[label]) for label, (n, _, q) in sums.items()}
    pooled = np.diag(np.diag(sum(scatter.values(), np.zeros((d, d))) / max(total, 1)) + 1e-3)
    classes = {}
    for label, (n, _, _) in sums.items():
        # few rows tell little of a covariance: d more rows count for the pooled one
        weight = shrinkage + (1 - shrinkage) * d / (d + n)
        factor = np.linalg.cholesky((1 - weight) * scatter[label] / n + weight * pooled)
        classes[label] = (n / total, means[label], factor, float(np.log(np.diag(factor)).sum()))
    return Model(center, scale, classes)


def scores(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` of every vector."""
    d = len(NAMES)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, d))
        predicted = (score >= threshold).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array(predicted)], ["doc_id", "score", "predicted"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, work)

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` of every document; ``labels`` is ``(doc_id, label)``."""
    found = vectors(docs)
    model = fit(found.join(labels.select(F.col("doc_id").cast("long"), "label"), "doc_id"))
    return scores(found, model, threshold)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels to learn from: the rows that are not held out."""
    return labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))


def held_out():
    """Is crc32 of the id, as text, divisible by 5?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; rows without an id stay.

    Rows that repeat an id go only if all their texts are rejected.
    """
    judged = classify(docs, labels, threshold)
    best = judged.groupBy("doc_id").agg(F.max("predicted").alias("best"))
    bad = pin(best.filter("best = 0 AND doc_id IS NOT NULL").select("doc_id"), "quality-rejected")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
