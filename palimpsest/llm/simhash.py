"""Near-duplicates by SimHash fingerprints and the general pigeonhole principle.

Fingerprints: 64 bits over the XXH64 hashes of 4-word shingles. Two link at `distance` differing bits or fewer.

Search: correlated bits are grouped into m parts, and each part i gets a threshold t_i >= -1 with sum t_i = distance - m + 1;
any linked pair then differs in at most t_i bits in some part i (else the differences would add up to distance + 1). m and
the thresholds are chosen by dynamic programming on the number of candidates each part would yield at each threshold,
estimated from pairs formed over all fingerprints. Every fingerprint is stored under its value of each part used and
probes the larger values within the threshold; what meets under a value is verified on all 64 bits.

A value's members are verified in blocks: crowded values are dealt out to pairs of blocks of which one at least is stored
there, so that no task holds a whole crowd (values that are only probed have no links and go), and every task hands on a
spanning forest of the links that it finds, never all pairs. Comparing a crowd of n stored members costs n * n / 2 whatever
the method; the plan is chosen so that crowds are few. Components are
found by contraction (graph.py) over distinct fingerprints; copies never multiply.

Defined results: null and empty texts have fingerprint zero, which links like any other; a null identifier is
labelled like any row but never names a component that has another one; repeated rows are returned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, materialize, partitions, rows_of, tune
from .graph import contract

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Members of a value that one task verifies against one another; more are dealt out in blocks of this size.
BLOCK = 2048
#: What one probe costs, in verified candidates; candidates are estimated from so many pairs per fingerprint.
PROBE_COST, PAIRS = 20.0, 8


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return h(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    hashes = np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64, n - size + 1)
    bits = np.zeros(64, np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 65536):
        bits += np.unpackbits(raw[at : at + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(raw), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    tune(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fp long")


def bit_parts(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m parts of nearly equal width, correlated bits together. together[i, j]: fingerprints in which both bits are set."""
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(np.outer(mean * (1 - mean), mean * (1 - mean)), 1e-12))
    strength = np.abs((p - np.outer(mean, mean)) / spread)
    np.fill_diagonal(strength, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        rest = sorted(left)
        part = [max(rest, key=lambda i: (strength[i, rest].sum(), -i))]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(sorted(left), key=lambda i: (strength[i, part].sum(), -i))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def probes(width: int, t: int) -> int:
    """Values within t bits of one, itself included."""
    total, c = 0, 1
    for k in range(t + 1):
        total += c
        c = c * (width - k) // (k + 1)
    return total


def allocate(widths: list[int], candidates: np.ndarray, distance: int) -> tuple[float, list[int]]:
    """Thresholds of least cost. candidates[i, t]: expected candidates of a fingerprint in part i at threshold t."""
    m, budget = len(widths), distance - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                extra = 0.0 if t < 0 else PROBE_COST * (probes(widths[i], t) + 1) / 2 + float(candidates[i, t])
                if used + t not in step or cost + extra < step[used + t][0]:
                    step[used + t] = (cost + extra, [*chosen, t])
        best = step
    return best[budget]


def values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(part):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def plan(distinct: DataFrame, n: int, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost, from counts over all fingerprints."""
    spark = distinct.sparkSession

    def bits_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for b in batches:
            raw = b.column("fp").to_numpy().view(np.uint64)
            x = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["cell", "n"])

    cells = distinct.mapInArrow(bits_together, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(4096, np.int64)
    for r in cells:
        together[r.cell] = r.n
    options = {m: bit_parts(together.reshape(64, 64), n, m) for m in range(2, distance + 2)}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for shift in range(1, min(PAIRS, len(fps) - 1) + 1):
                x = fps ^ np.roll(fps, shift)
                for m, parts in options.items():
                    for i, part in enumerate(parts):
                        mask = np.uint64(sum(1 << k for k in part))
                        h = np.bincount(np.minimum(np.bitwise_count(x & mask), distance + 1), minlength=distance + 2)
                        for t in range(distance + 1):
                            counts[m, i, t] = counts.get((m, i, t), 0) + int(h[: t + 1].sum())
            counts[0, 0, 0] = counts.get((0, 0, 0), 0) + len(fps) * min(PAIRS, max(len(fps) - 1, 0))
        rows = [(*k, v) for k, v in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["m", "i", "t", "n"])

    shuffled = distinct.repartition(partitions(spark), F.xxhash64("fp", F.lit(9)))
    got = {(r.m, r.i, r.t): r.n for r in shuffled.mapInArrow(near, "m long, i long, t long, n long").groupBy("m", "i", "t").agg(F.sum("n").alias("n")).collect()}
    pairs = max(got.get((0, 0, 0), 0), 1)
    best = None
    for m, parts in options.items():
        widths = [len(p) for p in parts]
        found = np.array([[max(got.get((m, i, t), 0) / pairs, probes(widths[i], t) / 2.0 ** widths[i]) * n for t in range(distance + 1)] for i in range(m)])
        cost, thresholds = allocate(widths, found, distance)
        if best is None or cost < best[0]:
            best = (cost, parts, thresholds)
    return best[1], best[2]


class Forest:
    """Union-find that remembers which links joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def verified(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each key. keys: sorted group numbers; one of a pair at least must be at home."""
    links: list[np.ndarray] = []
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    small = 48
    forest, out = Forest(), []
    top = int(min(small, sizes.max(initial=1)))
    fits = np.repeat(sizes <= small, sizes)
    for shift in range(1, top):
        ok = (keys[shift:] == keys[:-shift]) & fits[shift:] & (home[shift:] | home[:-shift])
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        links.append(np.stack([fps[at], fps[at + shift]], axis=1))
    if links:
        for a, b in np.unique(np.concatenate(links), axis=0).tolist():
            if a != b and forest.join(a, b):
                out.append((a, b))
    for k in np.flatnonzero(sizes > small):
        f, h = fps[bounds[k] : bounds[k + 1]], home[bounds[k] : bounds[k + 1]]
        order = np.argsort(~h, kind="stable")  # members at home first
        f, homes = f[order], int(h.sum())
        roots = np.array([forest.root(int(x)) for x in f], np.uint64)
        for i in range(homes):
            at = np.flatnonzero((np.bitwise_count(f[i + 1 :] ^ f[i]) <= distance) & (roots[i + 1 :] != roots[i])) + i + 1
            if not len(at):
                continue
            merged = {int(roots[i])}
            for j in at.tolist():
                if forest.join(int(f[i]), int(f[j])):
                    out.append((int(f[i]), int(f[j])))
                merged.add(int(roots[j]))
            roots[np.isin(roots, np.array(sorted(merged), np.uint64))] = forest.root(int(f[i]))
    return out


def links(distinct: DataFrame, parts: list[list[int]], thresholds: list[int], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints whose components are those of all links."""
    used = [(i, p, t) for i, (p, t) in enumerate(zip(parts, thresholds, strict=True)) if t >= 0]
    flips = {i: np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(p)), k)], np.uint64) for i, p, t in used}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column("fp").to_numpy().view(np.uint64)
            for i, part, _ in used:
                masks = flips[i]
                for at in range(0, len(all_fps), max(1, 200_000 // len(masks))):
                    fps = all_fps[at : at + max(1, 200_000 // len(masks))]
                    own = values(fps, part)
                    goal = own[:, None] ^ masks[None, :]
                    keep = goal >= own[:, None]  # of two values that are near, the smaller one probes the larger one
                    row, col = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int32)), pa.array(goal[keep].view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(col == 0)], names=["part", "value", "fp", "home"])

    kind = "part int, value long, fp long, home boolean"
    dealt = distinct.mapInArrow(deal, kind)
    counts = dealt.groupBy("part", "value").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes")).where(F.col("members") > block)
    blocks = lambda c: F.ceil(c / block).cast("int")
    crowded = materialize(counts.select("part", "value", blocks(F.col("homes")).alias("own"), blocks(F.col("members") - F.col("homes")).alias("others")))
    if crowded.isEmpty():
        spread = dealt.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        # A crowded value without a home has no links and goes. Of the others, every pair of blocks of which one at least
        # is at home is a task: a member at home goes to all pairs that hold its block, a probe to all blocks at home.
        met = dealt.join(crowded, ["part", "value"], "left").where("own is null or own > 0")
        among = lambda n: F.pmod(F.xxhash64("fp", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
        own, others = F.col("own"), F.col("others")
        met = met.withColumn("k", F.when(own.isNull(), 0).when(F.col("home"), among(own)).otherwise(own + among(others)))
        met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(own.isNull(), 0).when(F.col("home"), own + others - 1).otherwise(own - 1))))
        spread = met.select("part", "value", "fp", "home", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"))
    n = partitions(distinct.sparkSession)
    ordered = spread.repartition(n, "part", "value", "x", "y").sortWithinPartitions("part", "value", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(c).to_numpy() for c in ("part", "value", "x", "y")]
            new = np.zeros(table.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            found = verified(np.cumsum(new), table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), distance)
            pair = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 400_000:  # up to the last change of key
                table = pa.Table.from_batches(held).combine_chunks()
                last = [table.column(c)[size - 1].as_py() for c in ("part", "value", "x", "y")]
                same = np.ones(size, bool)
                for c, v in zip(("part", "value", "x", "y"), last, strict=True):
                    same &= table.column(c).to_numpy() == v
                cut = size - int(same.sum())
                if cut:
                    yield run(table.slice(0, cut))
                    rest = table.slice(cut)
                    held, size = rest.to_batches(), rest.num_rows
        if size:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return ordered.mapInArrow(check, "a long, b long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """doc_id, fp, root (one fingerprint of the component), component_id of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = distinct.count()
    out = rows.select("doc_id", "fp")
    if n > 1:
        parts, thresholds = plan(distinct.select("fp"), n, distance)
        roots = contract(links(distinct.select("fp"), parts, thresholds, distance))
    else:
        roots = None
    label = distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    if roots is not None:
        found = materialize(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
        least = materialize(found.groupBy("root").agg(F.min("first").alias("component_id")))
        label = materialize(found.join(least, "root").select("fp", "root", "component_id"))
    return out.join(label, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest identifier reachable) of every row."""
    return _labelled(docs, id_col, text_col, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all its columns: of the rows whose identifier names it, that with the smallest
    fingerprint and text. Rows without an identifier stay.

    A row that shares its identifier with others is decided by identifier and fingerprint.
    """
    found = materialize(_labelled(docs, id_col, text_col, distance).where("doc_id is not null"))
    gone_id, repeated_id = fresh("_gone", docs.columns), fresh("_repeated", docs.columns)
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)))
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(repeated_id)))
    if repeated.isEmpty():
        return docs.join(gone, docs[id_col] == gone[gone_id], "left_anti")
    columns, key = docs.columns, docs[id_col].cast("long")
    mark, row = fresh("_fp", columns), fresh("_row", columns)
    single = docs.join(repeated.unionAll(gone), key == F.col(repeated_id), "left_anti")
    shared = docs.join(repeated, key == F.col(repeated_id), "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, text_col):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*columns, mark])

    marked = shared.mapInArrow(each, StructType([*docs.schema.fields, StructField(mark, LongType())]))
    root = fresh("_root", columns)
    named = found.where("component_id = doc_id").select(F.col("doc_id").alias("_named"), F.col("fp").alias("_named_fp"), F.col("root").alias(root)).distinct()
    kept = marked.join(named, (marked[id_col].cast("long") == named["_named"]) & (marked[mark] == named["_named_fp"]))
    best = kept.groupBy(root).agg(F.min_by(F.struct(*(marked[c] for c in columns)), F.struct(marked[mark], marked[text_col])).alias(row))
    return single.unionByName(best.select(*(F.col(row)[c].alias(c) for c in columns)))
