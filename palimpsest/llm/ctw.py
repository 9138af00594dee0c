"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it. Every tree node holds a
Krichevsky-Trofimov estimate from its counts over the whole training fold, and a node's probability is the even mixture of
its own estimate and the product of its children's (the deepest ones are leaves). A text is scored with the posterior
weights: along the path of a position the prediction is w * own + (1 - w) * next deeper, down to the leaf; a context that
was not seen in training predicts 1/2 and keeps its weight. The text is followed by an end symbol (byte zero), and starts
after bytes of zero. Each string's log-probability is exchanged as a 32-bit float, so that scores are exact to seven digits.

How it runs: documents are written once with block numbers (at most BLOCK_BYTES of text each). Each block counts its
distinct words and (depth + 1)-byte strings and sends them, packed by a hash of the word, or of the two latest context bytes, to
the task that adds up that share block by block; a share holds every longer context below its two-byte contexts, so that those
levels of the trees are computed from it alone. The levels above (at most 256 x 255 nodes) are added up and finished on the
driver. Each block then gets back, one after another from the share's table, the counts of its words and the log-probabilities
of its strings, and its documents are scored from these. A task holds one share's distinct strings or one block, never all
blocks of a share; shares and tasks grow in number with the text. No table of the corpus is ever broadcast or held whole; words are keyed by their 64-bit XXH64.

Defined results: null and empty texts are the end symbol alone; without training rows every count is zero and each decision has probability
1/2; null identifiers are never held out and train like others; repeated rows count and are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_fold, materialize, partitions, rows_of, tune

DEPTH = 5
BLOCK_BYTES = 16 << 20
#: Packed bytes of all blocks for each share, about.
SHARE_BYTES = 64 << 20
#: Bytes of text whose words and strings are sorted at once.
CHUNK = 1 << 19
#: Key of the end token; a word is never empty.
END = b""
_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 16) + 0.5))])
_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def _log_half(n: np.ndarray) -> np.ndarray:
    """log of gamma(n + 1/2) / gamma(1/2)."""
    small = n < 1 << 16
    x = np.where(small, 1e5, n) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 0.5 * np.log(np.pi)
    return np.where(small, _TABLE[np.where(small, n, 0).astype(np.int64)], far)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = n < 1 << 16
    x = np.where(small, 1e5, n) + 1.0
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return np.where(small, _FACTORIAL[np.where(small, n, 0).astype(np.int64)], far)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator."""
    return _log_half(n0) + _log_half(n1) - _log_factorial(n0 + n1)


def mixture(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's log-probability from its counts and the sum of its children's, and the posterior weight of its own estimate."""
    own = log_kt(n0, n1)
    whole = np.logaddexp(own, children) - np.log(2)
    return whole, np.exp(own - np.log(2) - whole)


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte strings at every position of every text and at its end, and where each text's begin."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    g = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        g <<= np.uint64(8)
        g |= data[k : len(data) - depth + k]
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * depth, lengths)
    return g[at], starts


class Tree:
    """The levels of the trees from `top` context bytes downwards, for the strings of one share."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2) -> None:
        n = len(keys)
        symbol = (keys & np.uint64(255)).astype(np.int64)
        j = np.arange(8)
        node = ((1 << j)[None, :] | (symbol[:, None] >> (8 - j)[None, :])).ravel()
        self.bit = ((symbol[:, None] >> (7 - j)[None, :]) & 1).ravel()
        weight = np.repeat(counts.astype(np.float64), 8)
        context = (keys >> np.uint64(8)).astype(np.int64)
        ids = (np.repeat(context, 8) << 8) | node
        ids, where = np.unique(ids, return_inverse=True)
        n0 = np.bincount(where, weight * (self.bit == 0), len(ids))
        n1 = np.bincount(where, weight * (self.bit == 1), len(ids))
        logs = log_kt(n0, n1)
        self.levels = [(where, n0, n1, None)]  # deepest first: index from the level below (rows at first), counts, weights
        for d in range(depth - 1, top - 1, -1):
            up = ((ids >> 8) & ((1 << (8 * d)) - 1)) << 8 | (ids & 255)
            ids, where = np.unique(up, return_inverse=True)
            n0, n1 = np.bincount(where, n0, len(ids)), np.bincount(where, n1, len(ids))
            logs, w = mixture(n0, n1, np.bincount(where, logs, len(ids)))
            self.levels.append((where, n0, n1, w))
        self.ids, self.n0, self.n1, self.logs, self.rows = ids, n0, n1, logs, 8 * n

    def sums(self) -> list[tuple[int, int, float, float, float]]:
        """(latest context byte, decision, zeros, ones, sum of log-probabilities) over the top level's nodes."""
        up = ((self.ids >> 8) & 255) << 8 | (self.ids & 255)
        ids, where = np.unique(up, return_inverse=True)
        cols = [np.bincount(where, x, len(ids)) for x in (self.n0, self.n1, self.logs)]
        return [(int(i) >> 8, int(i) & 255, *map(float, c)) for i, *c in zip(ids, *cols, strict=True)]

    def log10(self, upper: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 of each string's last byte given those before it. upper: ones' estimates and weights by (byte, decision), then by decision."""
        p, index = np.full(self.rows, 0.5), np.arange(self.rows)  # of the row's own bit
        for where, n0, n1, w in self.levels:
            index = where[index]
            a, b = n0[index], n1[index]
            own = (np.where(self.bit == 1, b, a) + 0.5) / (a + b + 1)
            p = own if w is None else w[index] * own + (1 - w[index]) * p
        est1, w1, est0, w0 = upper
        byte, node = ((self.ids >> 8) & 255)[index], (self.ids & 255)[index]
        for est, w in ((est1[byte, node], w1[byte, node]), (est0[node], w0[node])):
            p = w * np.where(self.bit == 1, est, 1 - est) + (1 - w) * p
        return np.log10(p).reshape(-1, 8).sum(1)


def upper_levels(rows: list[tuple[int, int, float, float, float]]) -> tuple[np.ndarray, ...]:
    """The tables that Tree.log10() takes, from the sums by latest byte and decision."""
    n0, n1, children = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for byte, node, a, b, s in rows:
        n0[byte, node] += a
        n1[byte, node] += b
        children[byte, node] += s
    logs, w1 = mixture(n0, n1, children)
    a, b = n0.sum(0), n1.sum(0)
    _, w0 = mixture(a, b, logs.sum(0))
    return (n1 + 0.5) / (n0 + n1 + 1), w1, (b + 0.5) / (a + b + 1), w0


class Lookup:
    """Positions of 64-bit keys in an open-addressed table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = self._at(keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1

    def _at(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h.astype(np.int64) + step) & ((1 << self.bits) - 1)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Each key must be in the table."""
        out = self.slots[self._at(wanted, 0)]
        left = np.flatnonzero(self.keys[out] != wanted)
        step = 1
        while len(left):
            out[left] = self.slots[self._at(wanted[left], step)]
            left = left[self.keys[out[left]] != wanted[left]]
            step += 1
        return out


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word and of the end of every text, and where each text's begin."""
    import xxhash

    h = xxhash.xxh64_intdigest
    lists = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in lists])]).astype(np.int64)
    end = h(END)
    found: list[int] = []
    for ws in lists:
        found += map(h, ws)
        found.append(end)
    return np.array(found, np.uint64), starts


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal place together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(counts), len(k)).astype(np.int64)


class Sums:
    """Counts by key, added up as they come: what is held is the sum and as much again."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = self.least = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > max(2 * self.least, 1_000_000):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            k, n = _summed([np.zeros(0, np.uint64), *self.keys], [np.zeros(0, np.int64), *self.counts])
            self.keys, self.counts, self.size, self.least = [k], [n], len(k), len(k)
        return self.keys[0], self.counts[0]


class BlockCounts:
    """Distinct words and strings of a block, with their counts in training documents."""

    def __init__(self, depth: int) -> None:
        self.depth, self.words, self.strings = depth, Sums(), Sums()

    def add(self, texts: list[bytes], training: bool) -> None:
        for sums, keys in ((self.words, hashed_words(texts)[0]), (self.strings, strings(texts, self.depth)[0])):
            k, n = np.unique(keys, return_counts=True)
            sums.add(k, n if training else np.zeros(len(k), np.int64))

    def shares(self, buckets: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        for kind, sums in (("w", self.words), ("g", self.strings)):
            keys, counts = sums.total()
            base = keys if kind == "w" else (keys >> np.uint64(8)) & np.uint64(0xFFFF)
            to = (((base * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[b] : bounds[b + 1]]
                yield kind, int(b), keys[at], counts[at]


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


PACKED = "kind string, bucket int, block long, keys binary, counts binary"


def _packed(rows: list[tuple], names: str = "kind bucket block keys counts") -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=names.split())


Packed = tuple[str, int, int, np.ndarray, bytes]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Packed]:
    """(kind, bucket, block, keys, packed numbers) of each row."""
    for b in batches:
        for kind, bucket, block, keys, numbers in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "block", "keys", "counts")), strict=True):
            yield kind, bucket, block, _unpack_keys(keys), numbers


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each (kind, bucket) over its blocks, from sorted rows."""
    at, sums = None, Sums()

    def done() -> pa.RecordBatch:
        k, n = sums.total()
        return _packed([(*at, -1, _pack_keys(k), _planes(n))])

    for kind, bucket, _, k, n in _unpacked(batches):
        if at is not None and at != (kind, bucket):
            yield done()
            sums = Sums()
        at = (kind, bucket)
        sums.add(k, _unplanes(n, np.int64))
    if at is not None:
        yield done()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block asked for, from sorted rows: a share's table (block -1) comes before its blocks."""
    keys, values = np.zeros(0, np.uint64), np.zeros(0)
    for kind, bucket, block, own, numbers in _unpacked(batches):
        if block < 0:
            keys, values = own, _unplanes(numbers, np.int64 if kind == "w" else np.float32)
        else:
            yield _packed([(kind, bucket, block, _pack_keys(own), _planes(values[np.searchsorted(keys, own)]))])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    tune(spark)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = None, 0
        for batch, texts in rows_of(batches, "text"):
            numbers = []
            for at, t in zip(batch.column("at").to_pylist(), texts, strict=True):
                if block is None or size > block_bytes:
                    block, size = at, 0
                size += len(t)
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array([t.lower() for t in texts], pa.binary())], names=["block", "doc_id", "held_out", "text"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_fold(id_col, 10, 0).alias("held_out"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    blocks = materialize(base.mapInArrow(number, "block long, doc_id long, held_out boolean, text binary"))
    n_blocks, size = blocks.agg(F.count_distinct("block"), F.sum(F.octet_length("text"))).first()
    # No more shares than there are contexts of two bytes.
    buckets, tasks = min(1 << 16, max(partitions(spark), (size or 0) // SHARE_BYTES)), max(partitions(spark), 2 * n_blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, BlockCounts(depth)

        def done() -> Iterator[pa.RecordBatch]:
            for kind, bucket, keys, n in counts.shares(buckets):
                yield _packed([(kind, bucket, now, _pack_keys(keys), _planes(n))])

        for batch, texts in rows_of(batches, "text"):
            numbers = batch.column("block").to_numpy()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for block in dict.fromkeys(numbers.tolist()):
                if now is not None and block != now:
                    yield from done()
                    counts = BlockCounts(depth)
                now = block
                for training in (True, False):
                    for some in _chunks([texts[i] for i in np.flatnonzero((numbers == block) & (held != training))]):
                        counts.add(some, training)
        if now is not None:
            yield from done()

    packed = materialize(blocks.mapInArrow(count, PACKED))
    totals = materialize(packed.repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_totals, PACKED))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, _, keys, numbers in _unpacked(batches):
            n = _unplanes(numbers, np.int64)
            rows = [(-1, -1, float(n.sum()), float((n > 0).sum()), 0.0)] if kind == "w" else Tree(keys, n, depth).sums()
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["byte", "node", "n0", "n1", "logs"])

    found = totals.mapInArrow(sums, "byte int, node int, n0 double, n1 double, logs double").groupBy("byte", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("logs")).collect()
    upper = upper_levels([tuple(r) for r in found if r[0] >= 0])
    total, distinct = next(((r[2], r[3]) for r in found if r[0] < 0), (0.0, 0.0))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, block, keys, numbers in _unpacked(batches):
            n = _unplanes(numbers, np.int64)
            yield _packed([(kind, bucket, block, _pack_keys(keys), _planes(n if kind == "w" else Tree(keys, n, depth).log10(upper).astype(np.float32)))])

    asked = totals.mapInArrow(tables, PACKED).unionByName(packed).repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    answered = asked.mapInArrow(_answers, PACKED)
    none = F.lit(None)
    both = answered.select("block", F.lit(0).alias("turn"), "kind", "keys", "counts", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("binary").alias("text")).unionByName(
        blocks.select("block", F.lit(1).alias("turn"), none.cast("string").alias("kind"), none.cast("binary").alias("keys"), none.cast("binary").alias("counts"), "doc_id", "held_out", "text")
    )
    ordered = both.repartition(tasks, "block").sortWithinPartitions("block", "turn")
    floor = np.log10(total + 0.1 * (distinct + 1))

    # One batch can hold the end of a block and the beginning of the next; rows are therefore handled run by run.
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"block": None, "w": [], "g": []}

        def ready() -> None:
            k, v = (np.concatenate(x) for x in zip(*state["g"], strict=True))
            state["grams"], state["logs"] = Lookup(k), v.astype(np.float64)
            k, v = (np.concatenate(x) for x in zip(*state["w"], strict=True))
            order = np.argsort(k)
            state["keys"], state["counts"] = k[order], v[order]
            state["w"], state["g"] = [], []

        def documents(part: pa.RecordBatch) -> pa.RecordBatch:
            if state["w"]:
                ready()
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for some in _chunks(part.column("text").to_pylist()):
                h, starts = hashed_words(some)
                c = state["counts"][np.searchsorted(state["keys"], h)]
                g, places = strings(some, depth)
                found = (np.diff(starts), np.add.reduceat(c > 0, starts[:-1], dtype=np.int64), np.add.reduceat(np.log10(c + 0.1) - floor, starts[:-1]), np.add.reduceat(state["logs"][state["grams"].find(g)], places[:-1]))
                for column, x in zip(columns, found, strict=True):
                    column.append(x)
            n, known, base, scores = (np.concatenate(c) for c in columns)
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), int(total))), pa.array(base), pa.array(scores)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            block, turn = b.column("block").to_numpy(), b.column("turn").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (turn[1:] != turn[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(block)], strict=True):
                part = b.slice(lo, hi - lo)
                if turn[lo] == 1:
                    yield documents(part)
                    continue
                if state["block"] != block[lo]:
                    state["block"], state["w"], state["g"] = block[lo], [], []
                for kind, keys, answer in zip(*(part.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
                    state[kind].append((_unpack_keys(keys), _unplanes(answer, np.int64 if kind == "w" else np.float32)))

    return ordered.mapInArrow(runs, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
