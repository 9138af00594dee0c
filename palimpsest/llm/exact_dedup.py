"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equals next to one another, and
each row is compared in full with its neighbour. Sorting by whole texts would compare the equals of a hot group byte by
byte, and make the splitters as long as the texts; the sort key is therefore a prefix of the normalised bytes, their SHA-256, the
code points of the original (most first) and the identifier (smallest first): equals are adjacent, a group's first row
is the one that stays, and splitters over this key cut even a group that holds a third of all rows into several
partitions. Runs that meet at a partition border are joined afterwards from two rows per partition.

Defined results: null text counts as empty; empty texts are equal to one another; a null identifier sorts after all
others; of repeated rows (same identifier and text) one is kept; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, binary_values, fresh, materialize, packed_binary, partitions, tune

PREFIX = 24
KEY = PREFIX + 32 + 8 + 1 + 8
#: Sampled keys per partition, from which the splitters are taken.
SAMPLED = 60


def sort_key(normalised: bytes, code_points: int, identifier: int | None) -> bytes:
    tail = (2**64 - 1 if identifier is None else identifier + 2**63).to_bytes(8, "big")
    return b"".join((normalised[:PREFIX].ljust(PREFIX, b"\0"), sha256(normalised).digest(), (2**63 - code_points).to_bytes(8, "big"), b"\1" if identifier is None else b"\0", tail))


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _keyed(batches: Iterator[pa.RecordBatch], splitters: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), binary_values(batch.column(1))
        norms = [t.translate(None, WHITE) for t in texts]
        keys = [sort_key(n, code_points(t), i) for n, t, i in zip(norms, texts, ids, strict=True)]
        if splitters is None:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])
        else:
            places = pa.array([bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(keys, pa.binary()), pa.array(norms, pa.binary())], names=["place", "key", "norm"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, the same rows out with their run's first identifier and length; only the open run is held."""
    held: list[np.ndarray] = []  # keys of the open run
    last = None
    place, run, first_text = -1, 0, None

    def emit(keys: np.ndarray, starts: np.ndarray, first_run: int, closing: bytes | None) -> pa.RecordBatch:
        """keys of whole runs; closing: the text of the partition's last run, at its end."""
        n = len(keys)
        sizes = np.diff(np.append(starts, n))
        owner = np.repeat(np.arange(len(starts)), sizes)
        null = keys[:, -9] == 1
        ids = (keys[:, -8:].copy().view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.int64)
        keep = starts[owner]
        at = np.arange(n)
        kept = at == keep
        number = owner + first_run
        edge = np.where(number == 0, 0, np.where((closing is not None) & (owner == len(starts) - 1), 1, -1)).astype(np.int32)
        texts: list[bytes | None] = [None] * n
        tails: list[bytes | None] = [None] * n
        if first_run == 0:
            texts[0] = first_text
        if closing is not None:
            tails[int(starts[-1])] = closing
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(ids[keep], mask=null[keep]), pa.array(sizes[owner].astype(np.int64)), pa.array(kept), packed_binary(keys[:, PREFIX : PREFIX + 32]), pa.array(np.full(n, place, np.int32)), pa.array(edge), pa.array(texts, pa.binary()), pa.array(tails, pa.binary())],
            names=["doc_id", "keep_id", "group_size", "kept", "digest", "place", "edge", "head_text", "tail_text"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, KEY)
        same = np.empty(len(keys), bool)
        same[1:] = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        head = norm[0].as_py()
        same[0] = last is not None and head == last
        if last is None:
            place, first_text = batch.column("place")[0].as_py(), head
        last = norm[len(norm) - 1].as_py()
        starts = np.flatnonzero(~same)
        if not len(starts):
            held.append(keys)
            continue
        done = np.concatenate([*held, keys[: starts[-1]]]) if held else keys[: starts[-1]]
        before = sum(map(len, held))
        bounds = np.concatenate([np.zeros(int(before > 0), np.int64), starts[:-1] + before])
        if len(done):
            yield emit(done, bounds, run, None)
            run += len(bounds)
        held = [keys[starts[-1] :]]
    if held:
        yield emit(np.concatenate(held), np.array([0]), run, last)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = base.count()
    wanted = SAMPLED * n
    sample = base if total <= wanted else base.sample(min(1.0, 1.2 * wanted / total), seed=7)
    keys = sorted(r[0] for r in sample.mapInArrow(lambda it: _keyed(it, None), "key binary").collect())  # at most about 72 x n short keys
    splitters = [bytes(keys[len(keys) * i // n]) for i in range(1, n)] if keys else []
    placed = base.mapInArrow(lambda it: _keyed(it, splitters), "place int, key binary, norm binary")
    ordered = placed.repartitionById(n, F.col("place")).sortWithinPartitions("key")
    rows = materialize(ordered.mapInArrow(_runs, "doc_id long, keep_id long, group_size long, kept boolean, digest binary, place int, edge int, head_text binary, tail_text binary"))
    fixes = _border_runs(rows)
    out = rows.select("doc_id", "keep_id", "group_size", "kept", "digest", "place", "edge")
    if fixes:
        table = spark.createDataFrame(fixes, "place int, edge int, real_keep long, real_size long, leads boolean")
        out = out.join(F.broadcast(table), ["place", "edge"], "left")  # at most two rows per partition
        fixed = F.col("real_size").isNotNull()
        out = out.withColumns({"keep_id": F.when(fixed, F.col("real_keep")).otherwise(F.col("keep_id")), "group_size": F.coalesce("real_size", "group_size"), "kept": F.col("kept") & F.coalesce("leads", F.lit(True))})
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _border_runs(rows: DataFrame) -> list[tuple]:
    """(place, edge, keep_id, size, leads) of runs that go on over a partition border. The driver holds two short rows per partition."""
    edges = rows.where("kept and edge >= 0").select("place", "edge", "keep_id", "group_size", "digest").collect()
    at: dict[int, dict[int, tuple]] = {}
    for r in edges:
        at.setdefault(r.place, {})[r.edge] = (r.keep_id, r.group_size, bytes(r.digest))
    places = sorted(at)
    meets = [(p, q) for p, q in zip(places, places[1:], strict=False) if at[p][max(at[p])][2] == at[q][0][2]]
    if not meets:
        return []
    pairs = rows.sparkSession.createDataFrame(meets, "p int, q int")
    tails = rows.where("tail_text is not null").select(F.col("place").alias("p"), "tail_text")
    heads = rows.where("head_text is not null").select(F.col("place").alias("q"), "head_text")
    joined = {(r.p, r.q) for r in pairs.join(tails, "p").join(heads, "q").where("tail_text = head_text").select("p", "q").collect()}
    fixes, i = [], 0
    while i < len(places):
        chain = [(places[i], max(at[places[i]]))]
        while i + 1 < len(places) and (places[i], places[i + 1]) in joined:
            chain.append((places[i + 1], 0))
            i += 1
            if len(at[places[i]]) > 1:  # this partition's last run is another one
                break
        else:
            i += 1
        if len(chain) > 1:
            size = sum(at[p][e][1] for p, e in chain)
            fixes += [(p, e, at[chain[0][0]][chain[0][1]][0], size, k == 0) for k, (p, e) in enumerate(chain)]
    return fixes


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    columns = docs.columns
    kept_id, kept_sha, digest, row = (fresh(n, columns) for n in ("_kept_id", "_kept_sha", "_digest", "_row"))
    decided = materialize(exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_sha)))
    repeated = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    if not repeated:
        return docs.join(decided, docs[id_col].eqNullSafe(decided[kept_id]), "left_semi")
    # Some identifiers occur more than once: compare the texts too, and keep one of the rows that agree in both.
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", ""), 256)))
    found = marked.join(decided, marked[id_col].eqNullSafe(decided[kept_id]) & (marked[digest] == decided[kept_sha]), "left_semi")
    best = found.groupBy(id_col, digest).agg(F.max_by(F.struct(*columns), F.char_length(text)).alias(row))
    return best.select(*(F.col(row)[c].alias(c) for c in columns))
