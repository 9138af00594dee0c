"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of the training fold, whatever their label, are the unlabelled
rows. A linear classifier over the presence of words, and of stems with which one longer word begins, or several, is trained in numpy on
the class-prior-corrected risk prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)) with the logistic loss, so that its
outputs are probabilities; weights and bias are what minimises this risk. The class prior is the share of positives among the labels. Its features are those that occur in far more
positives than unlabelled documents (a likelihood-ratio test over the sample's whole vocabulary). Copies and near copies
in the sample count once: rows that share the smallest hash of their word triples are one.

The sample is bounded by two documented parameters; every document is scored on its whole text.

Defined results: null and empty texts get the score of a text without any known feature; without positives the score is
the prior (0 without labels); a null identifier is scored like any other and never learnt from; repeated rows are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, is_fold, materialize, rows_of, tune

#: Positives and unlabelled documents in the training sample, about; features of the classifier, at most.
POSITIVES, UNLABELLED, FEATURES = 6000, 9000, 2000
#: Characters of a stem, at least and at most; it is shorter than the word that it begins.
SHORTEST, LONGEST = 4, 8
#: Words whose features a worker remembers.
REMEMBERED = 300_000

#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest separates words.
_TOKENS = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TOKENS).split()


def cluster_key(words: list[bytes]) -> int:
    """The smallest hash of the word triples: equal for copies and mostly for near copies."""
    import xxhash

    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - 2)
    return min(h(b" ".join(words[i : i + 3])) for i in range(n)) >> 1


def stems(word: str) -> list[str]:
    """The stems of a word, each marked by a star, which no word holds."""
    return [word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]


def features(words: list[bytes]) -> set[str]:
    """The words, the stems of longer words, and with a second star the stems of two longer words or more."""
    plain = {w.decode("utf-8", "replace") for w in words}
    counts = Counter(s for w in plain for s in stems(w))
    return plain.union(counts, [s + "*" for s, n in counts.items() if n > 1])


def risk(p: np.ndarray, u: np.ndarray, v: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_pos(+) and R_unl(-) - prior * R_pos(-) of weights v with the logistic loss; rows end in a one for the bias."""
    zp, zu = p @ v, u @ v
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def train(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 800, rate: float = 0.1, spread: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over the whole sample. Weights have a normal prior of this spread."""
    d, decay = x.shape[1], prior / (spread**2 * max(int(positive.sum()), 1))
    v, m1, m2 = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    v[-1] = np.log(prior / (1 - prior))
    xs = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    p, u = np.ascontiguousarray(xs[positive]), np.ascontiguousarray(xs[~positive])
    for t in range(1, steps + 1):
        w = v.astype(np.float32)
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        plus = -prior * ((1 - sp) @ p) / len(p)  # of prior * R_pos(+)
        lift = su @ u / len(u) - prior * (sp @ p) / len(p)  # of R_unl(-) - prior * R_pos(-)
        grad = plus + lift if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0 else -lift
        grad = grad.astype(np.float64)
        grad[:-1] += decay * v[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        v -= rate * (1 - 0.9 * t / steps) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return v[:-1], float(v[-1])


class Model:
    """Weights of words and stems, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.bias, self.weights = bias, weights
        self.stems: dict[bytes, list[bytes]] = {}  # by their first bytes
        for raw in {n.rstrip("*").encode() for n in weights if n.endswith("*")}:
            self.stems.setdefault(raw[:SHORTEST], []).append(raw)
        self.known: dict[bytes, tuple[str, ...]] = {}

    def _of(self, word: bytes) -> tuple[str, ...]:
        """The features of a word, stems with one star."""
        name = word.decode("utf-8", "replace")
        found = [name] if name in self.weights else []
        found += [s.decode() + "*" for s in self.stems.get(word[:SHORTEST], ()) if len(word) > len(s) and word.startswith(s)]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = tuple(found)
        return self.known[word]

    def held(self, text: bytes) -> list[str]:
        """The features of a text that have a weight, sorted."""
        found: list[str] = []
        for w in set(tokens(text)):
            got = self.known.get(w)
            found += self._of(w) if got is None else got
        if not found:
            return found
        counts = Counter(found)
        return sorted(n for n in [*counts, *(s + "*" for s, k in counts.items() if k > 1)] if n in self.weights)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[n] for n in self.held(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES) -> Model:
    """docs: doc_id, text; labels: doc_id, y. Both without the held-out fold."""
    counts = {r.y: r["count"] for r in labels.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    bias = float(np.log((prior + 1e-4) / (1 - prior + 1e-4)))
    if not 0 < prior < 1:
        return Model({}, bias)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = lambda wanted, n: int((1 << 30) * min(1.0, wanted / max(n, 1)))
    confirmed = materialize(labels.where((F.col("y") == 1) & (rank < share(positives, counts[1]))).select(F.col("doc_id").alias("_id")).distinct())
    # About `positives` identifiers: a proven bound for the broadcast. Only rows of the sample reach Python.
    marked = docs.join(F.broadcast(confirmed), docs["doc_id"] == confirmed["_id"], "left")
    sets = (rank < share(unlabelled, docs.count())).cast("int") + F.when(F.col("_id").isNotNull(), 2).otherwise(0)
    chosen = marked.select("doc_id", "text", sets.alias("sets")).where("sets > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            lists = [tokens(t) for t in texts]
            keys = [cluster_key(ws) for ws in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sets"), pa.array(keys, pa.int64()), pa.array([sorted(features(ws)) for ws in lists], pa.list_(pa.string()))], names=["doc_id", "sets", "key", "words"])

    found = materialize(chosen.mapInArrow(read, "doc_id long, sets int, key long, words array<string>"))
    rows = found.select((F.col("sets") == 1).alias("other"), F.explode(F.filter(F.array(F.when(F.col("sets").bitwiseAND(1) > 0, F.lit(False)), F.when(F.col("sets").bitwiseAND(2) > 0, F.lit(True))), lambda s: s.isNotNull())).alias("pos"), "key", "doc_id", "words")
    rows = materialize(rows.groupBy("pos", "key").agg(F.min_by("words", F.struct("doc_id", "words")).alias("words"), F.min("other").alias("other")))
    size = {r.pos: r["count"] for r in rows.groupBy("pos").count().collect()}
    np_, nu = size.get(True, 0), size.get(False, 0)
    if not np_ or not nu:
        return Model({}, bias)
    # Features of positives against those of rows not known to be positive.
    no = rows.where("other").count()
    seen = rows.where("pos or other").select("pos", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("pos").cast("int")).alias("a"), F.sum((~F.col("pos")).cast("int")).alias("b"))
    a, b, rate = F.col("a"), F.col("b") + 0.5, (F.col("a") + F.col("b") + 0.5) / (np_ + no + 1)
    g = 2 * (a * F.log(a / (np_ * rate)) + b * F.log(b / ((no + 1) * rate)))
    tested = materialize(seen.where("a >= 3").withColumn("g", g))
    least = 2 * np.log(max(tested.count(), 20))
    picked = tested.where((F.col("a") / np_ > 3 * b / (no + 1)) & (F.col("g") > least))
    chosen_names = [r.word for r in picked.orderBy(F.desc("g"), F.char_length("word"), "word").limit(most).collect()]
    if not chosen_names:
        return Model({}, bias)
    at = {w: k for k, w in enumerate(chosen_names)}
    sparse = rows.select("pos", F.array_intersect("words", F.array(*map(F.lit, chosen_names))).alias("words")).collect()  # at most the sample's rows, each with a few features
    x = np.zeros((len(sparse), len(chosen_names)), np.float32)
    for k, r in enumerate(sparse):
        x[k, [at[w] for w in r.words]] = 1
    # Of features that the sample can't tell apart, the one that sorts first stands for all.
    distinct = sorted(np.unique(x, axis=1, return_index=True)[1].tolist())
    weights, bias = train(x[:, distinct], np.array([r.pos for r in sparse]), prior)
    return Model({chosen_names[k]: float(v) for k, v in zip(distinct, weights, strict=True)}, bias)


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    training = F.col("doc_id").isNotNull() & ~is_fold("doc_id", 4, 2)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(training)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(training & F.col("y").isin(0, 1))
    return learn(base, known)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of the fold with remainder 2 are never read."""
    tune(docs.sparkSession)
    model = _learned(docs, labels, id_col, text_col, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probabilities(texts))], names=["doc_id", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    tune(docs.sparkSession)
    model = _learned(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.probabilities(binary_values(batch.column(at))) < threshold))

    return docs.mapInArrow(clean, docs.schema)
