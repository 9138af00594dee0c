"""Packing documents into training sequences with the sum-of-squares rule.

A document is tokenized, closed with an end id and cut into pieces of at most `capacity` tokens. Only the light rows
(document, piece, length) are packed: random groups of about GROUP pieces each run the sum-of-squares rule over
decreasing lengths, placing a piece where the squared counts of open bins per residual gap become smallest (an open
bin or a new one). Bins that a group leaves with a gap of more than CLOSED tokens are then packed again as whole
items among those of other groups, so that the groups cost next to nothing in sequences. No group grows with the data.

Defined results: null and empty texts give one piece that holds the end id alone; repeated rows are packed each; null
identifiers stay null; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, rows_of, tune

CAPACITY = 4096
END_ID = 1
GROUP = 4096
#: A bin with at most this gap is done after the first pass.
CLOSED = 16
#: Words whose ids a worker remembers.
REMEMBERED = 800_000


def lowered(text: bytes) -> bytes:
    """ASCII letters in lower case where that can't change the ids: not before combining marks, nor in special tokens."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


class WordTokenizer:
    """Ids of a text from the ids of its words, as packed little-endian unsigned 32-bit numbers.

    The vocabulary's normaliser drops white space and its pre-tokenizer never joins what white space separates, so that
    the ids of a text are those of its words one after another; a run of points and commas at a word's end is a
    pre-token of its own after a letter or digit. Each distinct word is thus encoded once per worker.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> None:
        letters = [w for w in words if w.isalpha() or (not w.isascii() and w.decode("utf-8", "replace").isalpha())]
        alone = list(set(words).difference(letters))
        for at in range(0, len(letters), 1024):  # words of letters are one pre-token each, so that many are encoded as one text
            some = letters[at : at + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(some):  # a letter whose lower case is not a letter
                alone += some
                continue
            raw = ids.tobytes()
            self.known.update(zip(some, [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        marked = [w for w in words if w[-1] in b".," and len(w) > 1 and w[-2] in b"0123456789abcdefghijklmnopqrstuvwxyz"]
        plain = words.difference(marked)
        plain.update((b".", b","), [w[:-1] for w in marked])
        self._encode(list(plain - known.keys()))
        marks = {b: known[bytes([b])] for b in b".,"}
        known.update((w, known[w[:-1]] + marks[w[-1]]) for w in marked)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        lists = [lowered(t).split() for t in texts]
        words = set().union(*lists)
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        if new:
            self.learn(new)
        ids = self.known.__getitem__
        return [b"".join(map(ids, ws)) for ws in lists]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document, cut where it is longer than the capacity."""
    tune(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch, texts in rows_of(batches, "text"):
            out: list[tuple] = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                out += [(i, k, s, min(capacity, n - s), ids[4 * s : 4 * (s + capacity)]) for k, s in enumerate(range(0, n, capacity))]
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each item, and each bin's gap. Items are taken from the longest to the shortest."""
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i in order:
        size = int(lengths[i])
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        gaps = np.flatnonzero(count[size:capacity]) + size
        gap = capacity
        if len(gaps) and size < capacity:
            after = gaps - size
            change = 2 * (np.where(after > 0, count[after], 0) - count[gaps]) + np.where(after > 0, 2, 1)
            k = int(change.argmin())
            if change[k] <= fresh:
                gap = int(gaps[k])
        if gap == capacity:
            b = opened
            opened += 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(b)
    left = np.zeros(opened, np.int64)
    for gap, stack in enumerate(stacks):
        left[stack] = gap
    return bins, offsets, left


def pack(table: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to a table whose rows have a length of 1 to the capacity; its other columns are carried along."""
    carried = table.columns
    own = [fresh(n, carried) for n in ("_uid", "sequence_id", "offset")]
    if own[1:] != ["sequence_id", "offset"]:
        raise ValueError("the table has columns sequence_id or offset of its own")
    uid = own[0]
    rows = materialize(table.withColumn(uid, F.monotonically_increasing_id()))
    groups = max(1, -(-rows.count() // GROUP))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, left = sum_of_squares(pdf["_length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"_uid": pdf["_uid"], "_group": pdf["_group"], "_bin": bins, "_offset": offsets, "_gap": left[bins]})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, _ = sum_of_squares(capacity - pdf["_gap"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"_group": pdf["_group"], "_bin": pdf["_bin"], "_again": pdf["_super"] * (1 << 20) + bins, "_base": offsets})

    light = rows.select(F.col(uid).alias("_uid"), F.col(length_col).alias("_length"), F.pmod(F.xxhash64(uid), F.lit(groups)).alias("_group"))
    placed = materialize(light.groupBy("_group").applyInPandas(first, "_uid long, _group long, _bin long, _offset long, _gap long"))
    loose = placed.where(F.col("_gap") > CLOSED).groupBy("_group", "_bin").agg(F.first("_gap").alias("_gap"))
    n = loose.count()
    supers = max(1, -(-n // GROUP))
    again = materialize(loose.withColumn("_super", F.pmod(F.xxhash64("_group", "_bin"), F.lit(supers))).groupBy("_super").applyInPandas(second, "_group long, _bin long, _again long, _base long"))
    first_id = F.col("_group") * (1 << 20) + F.col("_bin")
    moved = placed.join(again, ["_group", "_bin"], "left").select(
        F.col("_uid").alias(uid), F.when(F.col("_again").isNull(), 2 * first_id).otherwise(2 * F.col("_again") + 1).alias("sequence_id"), (F.col("_offset") + F.coalesce("_base", F.lit(0))).alias("offset")
    )
    return rows.join(moved, uid).select(*carried, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and the ids of its pieces in order, from packed rows and pieces()."""
    whole = packed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most `capacity` pieces
    return whole.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
