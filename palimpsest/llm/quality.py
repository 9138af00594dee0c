"""Quality scores by regularised quadratic discriminant analysis.

Whole texts are reduced to a few transformed statistics, near to normally distributed. Each class has a mean and a
covariance that is shrunk towards the pooled covariance and its diagonal; the Cholesky factors are computed once, and a
document's score is the logistic of the difference of the log-densities (half Mahalanobis distances, log-determinants,
class priors), tempered to the labels by one slope and one offset. Shrinkage is chosen on a part of the training fold.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; without labels
of both classes the score is the share of label 1 (0.5 without any label); repeated rows are scored each; repeated labels
of a document count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_fold, materialize, rows_of, tune

#: Labelled rows that the classifier is fitted on, at most.
LABELLED = 20_000

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence marks, 6 other ASCII marks, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 7 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:?'\"-" else 6 if _c.isprintable() else 0
_ONE_HOT = np.eye(8)[_CLASS]


def _odds(share: float, n: int) -> float:
    """A share's logit, drawn in by half a count on either side."""
    k = share * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: bytes) -> list[float]:
    n = len(text)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w, nl = len(words), len(lines)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    letters = kinds[1] + kinds[2] + kinds[7]
    marked = sum(x[-1:] in b"!#$%&*@^~|" for x in words)
    return [
        np.log1p(n),
        np.log1p(w),
        _odds(kinds[2] / max(letters, 1), int(letters)),
        _odds(kinds[3] / max(n, 1), n),
        _odds(kinds[5] / max(n, 1), n),
        _odds(kinds[6] / max(n, 1), n),
        _odds(kinds[7] / max(n, 1), n),
        _odds(kinds[4] / max(n, 1), n),
        float(lengths.mean()) if w else 0.0,
        float(np.log1p(lengths.std())) if w else 0.0,
        _odds(len(counts) / max(w, 1), w),
        _odds((counts.most_common(1)[0][1] if w else 0) / max(w, 1), w),
        _odds(len(set(lines)) / max(nl, 1), nl),
        float(np.log1p(w / max(nl, 1))),
        _odds(marked / max(w, 1), w),
    ]


def solved(factor: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The rows of z divided by a lower triangular factor: their squares add up to Mahalanobis distances."""
    out = np.empty_like(z, float)
    for i in range(len(factor)):
        out[:, i] = (z[:, i] - out[:, :i] @ factor[i, :i]) / factor[i, i]
    return out


class Discriminant:
    """Two Gaussians with shrunken covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: tuple[float, float] = (0.2, 0.1)) -> None:
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        d = z.shape[1]
        pooled = sum((len(c) * np.cov(c.T, bias=True) if len(c) > 1 else np.zeros((d, d))) for c in (z[y == 0], z[y == 1])) / len(z)
        to_pooled, to_diagonal = shrink
        self.means, self.factors, self.logs = [], [], []
        for k in (0, 1):
            c = z[y == k]
            own = np.cov(c.T, bias=True) if len(c) > d else pooled
            s = (1 - to_pooled) * own + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.eye(d) * max(np.trace(s) / d, 1e-3)
            factor = np.linalg.cholesky(s + 1e-6 * np.eye(d))
            self.means.append(c.mean(0))
            self.factors.append(factor)
            self.logs.append(np.log(max(len(c), 1) / len(z)) - np.log(np.diag(factor)).sum())
        self.slope, self.offset = 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, drawn in where it is extreme."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        a, b = (self.logs[k] - 0.5 * (solved(self.factors[k], z - self.means[k]) ** 2).sum(1) for k in (0, 1))
        return np.arcsinh(b - a)

    def temper(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset by Newton steps on the logistic loss."""
        m = np.column_stack([self.margin(x), np.ones(len(x))])
        v = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(m @ v, -30, 30)))
            h = (m * (p * (1 - p) + 1e-6)[:, None]).T @ m + 1e-2 * np.eye(2)
            v = v - np.linalg.solve(h, m.T @ (p - y) + 1e-2 * (v - np.array([1.0, 0.0])))
        if v[0] > 0:
            self.slope, self.offset = float(v[0]), float(v[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """A fitted discriminant, or a constant score where one class is missing."""
    if len(y) < 8 or min((y == 0).sum(), (y == 1).sum()) < 3:
        return float(y.mean()) if len(y) else 0.5
    part = np.arange(len(y)) % 4 == 0
    best: tuple[float, tuple[float, float]] | None = None
    for shrink in ((0.05, 0.02), (0.2, 0.1), (0.5, 0.2), (0.8, 0.4), (1.0, 0.6)):
        if min((y[~part] == 0).sum(), (y[~part] == 1).sum()) < 2:
            break
        m = Discriminant(x[~part], y[~part], shrink)
        m.temper(x[~part], y[~part])
        p = np.clip(m.scores(x[part]), 1e-4, 1 - 1e-4)
        loss = -float(np.mean(np.where(y[part] == 1, np.log(p), np.log(1 - p))))
        if best is None or loss < best[0]:
            best = (loss, shrink)
    model = Discriminant(x, y, best[1] if best else (0.5, 0.2))
    model.temper(x, y)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of the fold with remainder 2 are never read."""
    tune(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    stats = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, "doc_id long, stats array<double>"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~is_fold("doc_id", 4, 2))
    order = F.xxhash64("doc_id")
    known = known.orderBy(order, "doc_id", "y").limit(labelled)  # bounded, so that the driver can hold their statistics
    rows = known.join(stats, "doc_id").orderBy(order, "doc_id", "y").limit(2 * labelled).collect()
    model = fit(np.array([r.stats for r in rows]), np.array([r.y for r in rows]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("stats").flatten().to_numpy().reshape(b.num_rows, -1)
                p = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    out = stats.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
