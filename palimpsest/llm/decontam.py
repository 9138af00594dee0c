"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

The items (few and short against the corpus) become an inverted index whose terms are pairs of neighbouring words; BM25
weights are divided by each item's score against itself, so that a passage scores 1 for an item that it holds in full. Every
passage of every document is a query: passages are windows of twice the stride, and the stride is no shorter than the
longest item, so that an item never straddles all windows. Items of like length (up to STRIDE words, twice that, four times
that, ...) have an index and a stride of their own, so that one very long item leaves the passages of the others as they are.
A passage whose terms' upper bounds can't reach the threshold is skipped; the others run block-max WAND, which returns every
item at or above the threshold. What it returns is verified on five-word shingles of the item's question and its answer (its
last sentence).

Document frequencies, the number of items and their mean length are counted over all items by Spark. The items are then
searched in shards of about SHARD_BYTES of text, one after another: the driver and each task hold the index of one shard,
and as the statistics are those of all items, the size of a shard changes no result. Documents are never shuffled.

Defined results: null and empty texts are clean; items without a word never match; items of fewer than five words are one
shingle; repeated items and rows match each; a null item identifier is kept as null; empty tables give an empty
result; other columns are ignored, or carried along by drop_contaminated().
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, materialize, rows_of, tune

#: Fixed values of BM25, the retrieval threshold (share of an item's own score) and the overlap at which an item counts as held.
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.8
SHINGLE, STRIDE = 5, 64
#: Postings per block of the index; bytes of item text per index.
BLOCK, SHARD_BYTES = 32, 16 << 20

_TOKENS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?:\n])\s+")


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TOKENS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words before its last sentence, and those of its last sentence; one sentence is all question."""
    parts = [p for p in _SENTENCE.split(text.strip()) if tokens(p)]
    if len(parts) < 2:
        return tokens(text), []
    return tokens(" ".join(parts[:-1])), tokens(parts[-1])


def shingles(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def overlap(part: list[bytes], passage: list[bytes], held: set[bytes]) -> float:
    """Share of the shingles of `part` in a passage; 1 for an empty part. A part of less than a shingle must occur as it is."""
    if not part:
        return 1.0
    if len(part) < SHINGLE:
        return float((b" " + b" ".join(part) + b" ") in (b" " + b" ".join(passage) + b" "))
    own = shingles(part)
    return len(own & held) / len(own)


@dataclass
class Index:
    """Postings of word pairs: item numbers in rising order, their weights, and the greatest weight of each block."""

    ids: list[int | None] = field(default_factory=list)
    times: list[int] = field(default_factory=list)  # how often each item occurs
    parts: list[tuple[list[bytes], list[bytes]]] = field(default_factory=list)
    words: dict[bytes, int] = field(default_factory=dict)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted pair numbers
    bound: np.ndarray = field(default_factory=lambda: np.zeros(0))  # greatest weight of each term
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    stride: int = STRIDE


def pairs_of(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    return [(words[i], words[i + 1]) for i in range(len(words) - 1)] or [(w, b"") for w in words]


@dataclass
class Statistics:
    """What BM25 needs to know of all items: their number, mean number of pairs, and the items that hold each pair."""

    n: int
    mean: float
    df: dict[tuple[bytes, bytes], int]


def statistics(items: list[tuple[int | None, str | None, int]]) -> Statistics:
    docs = [(Counter(pairs_of(ws)), k) for _, t, k in items if (ws := tokens(t or ""))]
    n = sum(k for _, k in docs)
    df: Counter = Counter()
    for d, k in docs:
        for t in d:
            df[t] += k
    return Statistics(n, sum(d.total() * k for d, k in docs) / max(n, 1), df)


def build(items: list[tuple[int | None, str | None, int]], known: Statistics | None = None) -> Index:
    """An index of (identifier, text, times) with the statistics given, or those of these items alone."""
    known = known or statistics(items)
    ix = Index()
    docs: list[Counter] = []
    for i, text, times in items:
        q, a = question_and_answer(text or "")
        if q or a:
            ix.ids.append(i)
            ix.times.append(times)
            ix.parts.append((q, a))
            docs.append(Counter(pairs_of(q + a)))
    if not docs:
        return ix
    for d in docs:
        for pair in d:
            for w in pair:
                ix.words.setdefault(w, len(ix.words))
    n, mean = known.n, known.mean
    idf = {t: np.log(1 + (n - known.df[t] + 0.5) / (known.df[t] + 0.5)) for d in docs for t in d}
    found: dict[int, list[tuple[int, float]]] = defaultdict(list)
    width = len(ix.words)
    for k, d in enumerate(docs):
        norm = K1 * (1 - B + B * d.total() / mean)
        weights = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in d.items()}
        total = sum(weights.values())
        for (a, b), w in weights.items():
            found[ix.words[a] * width + ix.words[b]].append((k, w / total))
    ix.terms = np.array(sorted(found), np.int64)
    for t in ix.terms.tolist():
        numbers, weights = (np.array(x) for x in zip(*found[t], strict=True))
        ix.postings.append((numbers, weights, np.maximum.reduceat(weights, np.arange(0, len(weights), BLOCK))))
    ix.bound = np.array([float(p[1].max()) for p in ix.postings])
    ix.stride = max(STRIDE, max(len(q) + len(a) for q, a in ix.parts))
    return ix


def block_max_wand(ix: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item number, score) of all items whose weights over these terms (positions in ix.terms) add up to the threshold."""
    end = len(ix.ids)
    cursors = [[t, 0] for t in terms]
    at = lambda c: int(ix.postings[c[0]][0][c[1]]) if c[1] < len(ix.postings[c[0]][0]) else end
    seek = lambda c, goal: c.__setitem__(1, c[1] + int(np.searchsorted(ix.postings[c[0]][0][c[1] :], goal)))
    out = []
    while True:
        cursors = sorted((c for c in cursors if at(c) < end), key=at)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += ix.bound[c[0]]
            if total >= threshold - 1e-12:
                pivot = k
                break
        if pivot < 0:
            return out
        goal = at(cursors[pivot])
        while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == goal:
            pivot += 1
        block_total, skip = 0.0, end
        for c in cursors[: pivot + 1]:
            numbers, _, best = ix.postings[c[0]]
            k = (c[1] + int(np.searchsorted(numbers[c[1] :], goal))) // BLOCK
            if k < len(best):
                block_total += float(best[k])
                skip = min(skip, int(numbers[min((k + 1) * BLOCK, len(numbers)) - 1]) + 1)
        if block_total >= threshold - 1e-12:
            score = 0.0
            for c in cursors[: pivot + 1]:
                seek(c, goal)
                if at(c) == goal:
                    score += float(ix.postings[c[0]][1][c[1]])
                    c[1] += 1
            if score >= threshold - 1e-12:
                out.append((goal, score))
        else:  # no item before the first of these blocks ends can reach the threshold, nor before the next list's item
            following = at(cursors[pivot + 1]) if pivot + 1 < len(cursors) else end
            nxt = max(goal + 1, min(skip, following))
            for c in cursors[: pivot + 1]:
                seek(c, nxt)


def length_class(words: int) -> int:
    """0 up to STRIDE words, 1 up to twice as many, and so on."""
    return max(0, -(-words // STRIDE) - 1).bit_length()


def shard_of(items: list[tuple[int | None, str | None, int]], known: Statistics | None = None) -> list[Index]:
    """An index for the items of each class of length."""
    known = known or statistics(items)
    classes: dict[int, list] = defaultdict(list)
    for item in items:
        classes[length_class(len(tokens(item[1] or "")))].append(item)
    return [ix for _, some in sorted(classes.items()) if len((ix := build(some, known)).terms)]


def matches(shard: list[Index], text: str, threshold: float = THRESHOLD, least: float = OVERLAP) -> list[tuple[int | None, int, float, float, float]]:
    """(identifier, times, score, question overlap, answer overlap) of the items that a text holds, each by its best passage."""
    words = tokens(text) if shard else []
    return [(ix.ids[m[0]], ix.times[m[0]], *m[1:]) for ix in shard for m in _search(ix, words, threshold, least)]


def _search(ix: Index, words: list[bytes], threshold: float, least: float) -> list[tuple[int, float, float, float]]:
    get, n = ix.words.get, len(words)
    if not n:
        return []
    width = len(ix.words)
    numbers = np.fromiter((get(w, -1) for w in words), np.int64, n)
    single = ix.words.get(b"")  # items of one word are pairs with an empty one
    known = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    pair, place = numbers[known] * width + numbers[known + 1], known
    if single is not None:
        alone = np.flatnonzero(numbers >= 0)
        pair, place = np.concatenate([pair, numbers[alone] * width + single]), np.concatenate([place, alone])
    slot = np.minimum(np.searchsorted(ix.terms, pair), len(ix.terms) - 1)
    hit = ix.terms[slot] == pair
    if not hit.any():
        return []
    slot, place = slot[hit], place[hit]
    order = np.argsort(place, kind="stable")
    slot, place = slot[order], place[order]
    s = ix.stride
    weight = np.concatenate([[0.0], np.cumsum(ix.bound[slot])])
    starts = np.arange(0, max(1, n - s), s)
    lo, hi = np.searchsorted(place, starts), np.searchsorted(place, starts + 2 * s)
    best: dict[int, tuple[int, float, float, float]] = {}
    for k in np.flatnonzero(weight[hi] - weight[lo] >= threshold - 1e-9):
        terms = np.unique(slot[lo[k] : hi[k]]).tolist()
        found = block_max_wand(ix, terms, threshold)
        if not found:
            continue
        passage = words[starts[k] : starts[k] + 2 * s]
        held = shingles(passage)
        for item, score in found:
            q, a = ix.parts[item]
            oq, oa = overlap(q, passage, held), overlap(a, passage, held)
            whole = overlap(q + a, passage, held)
            if (min(oq, oa) >= least or whole >= least) and (item not in best or score > best[item][1]):
                best[item] = (item, score, oq, oa)
    return sorted(best.values())


def indexes(items: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Iterator[list[Index]]:
    """The shards of the items, one after another; one empty shard for no items."""
    rows = materialize(items.groupBy(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).agg(F.count(F.lit(1)).alias("times")).where("t is not null"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "t"):
            found = []
            for at, times, raw in zip(batch.column("shard").to_pylist(), batch.column("times").to_pylist(), texts, strict=True):
                ws = tokens(raw.decode("utf-8", "replace"))
                d = Counter(pairs_of(ws)) if ws else Counter()
                found.append((at, times if ws else 0, d.total() * times, len(raw), [(a + b" " + b) for a, b in d]))
            c = list(zip(*found, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["shard", "times", "pairs", "size", "held"])

    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    counts = materialize(placed.select("shard", "times", "t").mapInArrow(counted, "shard long, times long, pairs long, size long, held array<binary>"))
    n, pairs = counts.agg(F.sum("times"), F.sum("pairs")).first()
    held = counts.select("shard", "times", F.explode("held").alias("pair"))
    df = held.groupBy("pair").agg(F.sum("times").alias("df"))
    frequencies = materialize(held.select("shard", "pair").distinct().join(df, "pair").select("shard", "pair", "df"))
    for k in range(shards):  # about shard_bytes of text, and no more pairs than it has words, reach the driver at once
        known = {tuple(bytes(r.pair).split(b" ")): r.df for r in frequencies.where(F.col("shard") == k).select("pair", "df").collect()}
        own = sorted(((r.i, r.t, r.times) for r in placed.where(F.col("shard") == k).select("i", "t", "times").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield shard_of(own, Statistics(n or 0, (pairs or 0) / max(n or 0, 1), known))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document and item that it holds."""
    tune(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names, kinds = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    parts: list[DataFrame] = []
    for shard in indexes(items, item_id, item_text, shard_bytes):

        def search(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for batch, texts in rows_of(batches, "text"):
                found = [(i, m[0], *m[2:]) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for m in matches(shard, t.decode("utf-8", "replace")) for _ in range(m[1])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        if parts:  # the shard before is done with, and its index can go
            parts[-1] = materialize(parts[-1])
        parts.append(base.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    tune(docs.sparkSession)
    at = docs.columns.index(text_col)
    for k, shard in enumerate(indexes(items, item_id, item_text, shard_bytes)):

        def clean(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matches(shard, t.decode("utf-8", "replace")) for t in binary_values(batch.column(at))], pa.bool_()))

        if k:  # the shard before is done with, and its index can go
            docs = materialize(docs)
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
