"""The corpus operators against brute force, exact round trips and held-out labels, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import ctw, decontam, exact_dedup, language_id, packing, quality, simhash, toxicity, url_filter, warc
from palimpsest.llm import queries as Q
from palimpsest.llm.graph import contract

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 12_000
ODD = [None, "", " \n\t", "a", "...", "123 456", LONG, "é", "x" * 5000, "a\0b"]


def docs_of(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, None, None) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, expected = Q.queries()[name](spark, sf_dir), con.sql(Q.oracle_sql()[name])
    normal = lambda rows, cols: sorted(str([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(expected.fetchall(), expected.columns)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{k}" for k in range(1, 11)]


# -- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("seed", range(3))
def test_exact_dedup(spark, seed):
    rng = random.Random(seed)
    texts = [*ODD, *(rng.choice(["a b", "ab", " ab ", "a\tb", "c", "c ", "dé"]) for _ in range(300))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs_of(spark, texts).repartition(5)).collect()}
    assert got == brute_exact(rows)


def test_exact_dedup_hot_group_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
        rows = exact_dedup.exact_dedup(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    texts = {i: "the same text" if i % 3 else f"t{i % 50}" for i in range(3000)}
    want = brute_exact(texts.items())
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == want
    assert {r.doc_id for r in rows if r.kept} == {k for k, _ in want.values()}


def test_exact_dedup_repeated_rows(spark):
    docs = docs_of(spark, ["x", "x", "y", "x y", "x  y", None, None], [1, 1, 1, 2, 3, None, None])
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 4
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("1", "x"), ("1", "y"), ("3", "x  y")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.keep_first(docs.limit(0)).count() == 0


# -- SimHash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_table(spark, sf_dir, table):
    fps = {i: brute_fingerprint(r.text) for i, r in table.items()}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in Q.queries()["op2_simhash"](spark, sf_dir).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_odd_texts(spark):
    texts = [*ODD, "A b c d E", "a B c d e", "one two", "One\ttwo"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{brute_fingerprint(t):016x}" for t in texts]
    assert got[1].component_id == 0 and got[11].component_id == 10 and got[13].component_id == 12
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0
    assert simhash.near_duplicates(docs_of(spark, ["a"])).count() == 1
    twice = docs_of(spark, ["a b c", "a b c", "q"], [5, 5, None])
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(twice).collect()) == ["5", "5", "None"]
    assert simhash.keep_representatives(docs_of(spark, ["a b", "A b", "c"])).count() == 2


@pytest.mark.parametrize("block", [2048, 40])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:  # near ones, in chains
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
            fps.add(f)
    hub = rng.getrandbits(64)  # a crowd
    fps |= {hub ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    at = {x: i for i, x in enumerate(fps)}
    plans = [simhash.plan(df, len(fps))]
    for m in (2, 3, 4, 5):
        parts = simhash.bit_parts(np.eye(64), 1, m)
        plans.append((parts, simhash.allocate([len(p) for p in parts], np.ones((m, 5)), 4)[1]))
    for parts, thresholds in plans:
        assert sum(thresholds) == 4 - len(parts) + 1 and sorted(b for p in parts for b in p) == list(range(64))
        if sum(simhash.probes(len(p), t) for p, t in zip(parts, thresholds, strict=True)) > 3000:
            continue
        edges = simhash.links(df, parts, thresholds, block=block).collect()
        pairs = [(at[e.a % (1 << 64)], at[e.b % (1 << 64)]) for e in edges]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
        linked = {frozenset(p) for p in pairs}
        assert components(range(len(fps)), lambda a, b: frozenset((a, b)) in linked) == want


def test_contraction(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    roots = {r.node: r.root for r in contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for n, r in roots.items():
        groups[r].add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), [200, 201]]
    assert contract(spark.createDataFrame([(1, 1)], "a long, b long")) is None


# -- decontamination


def brute_scores(ix, terms):
    score = Counter()
    for t in terms:
        for i, w in zip(*ix.postings[t][:2], strict=True):
            score[int(i)] += float(w)
    return score


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    ix = decontam.build([(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))), 1) for i in range(200)])
    for _ in range(40):
        terms = sorted(rng.sample(range(len(ix.terms)), rng.randrange(1, 60)))
        for threshold in (0.05, 0.2, 0.5, 0.9):
            want = {i: s for i, s in brute_scores(ix, terms).items() if s >= threshold - 1e-12}
            got = dict(decontam.block_max_wand(ix, terms, threshold))
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)


def test_contamination(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today. It was not amused at all by this."
    other = "Single question without any further sentence at all"
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "word"), (None, "seven unusual words stand here in line")], "item_id long, text string")
    changed = item.replace("by this", "by that")
    texts = [item, f"{LONG} {item} {LONG}", changed, item.upper(), " ".join(reversed(item.split())), other[:20], f"x {other} y", None, "", "a word", "seven unusual words stand here in line", "the fox. the dog."]
    got = sorted((r.doc_id, str(r.item_id)) for r in decontam.contamination(docs_of(spark, texts), items).collect())
    assert got == [(0, "1"), (1, "1"), (2, "1"), (3, "1"), (6, "2"), (9, "5"), (10, "None")]
    docs = docs_of(spark, texts)
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 7, 8, 11]
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).count() == 0 and decontam.drop_contaminated(docs, items.limit(0)).count() == len(texts)


def test_contamination_table(spark, sf_dir, table):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    spaced = lambda t: " " + b" ".join(decontam.tokens(t)).decode() + " "
    held = {i: spaced(r.text) for i, r in table.items()}
    want = {(i, k) for i, t in held.items() for k, x in items.items() if spaced(x) in t}
    got = {(r.doc_id, r.item_id) for r in Q.queries()["op3_decontamination"](spark, sf_dir).collect()}
    assert want and want <= got
    for i, k in got - want:  # near copies hold four fifths of the shingles
        a, b = decontam.shingles(decontam.tokens(items[k])), decontam.shingles(decontam.tokens(table[i].text))
        assert len(a & b) / len(a) >= 0.6


# -- context-tree weighting


class SlowTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for c, x in self.positions(t):
                for node, bit in self.decisions(x):
                    for d in range(depth + 1):
                        s = c[depth - d :]
                        self.n[s, node][bit] += 1
                        if d < depth:
                            self.kids[s, node].add(c[depth - d - 1 :])
        self.memo = {}

    def positions(self, t):
        data = bytes(self.depth) + t + b"\0"
        return [(data[i : i + self.depth], data[i + self.depth]) for i in range(len(t) + 1)]

    @staticmethod
    def decisions(x):
        return [((1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1) for j in range(8)]

    def kt(self, s, node):
        a, b = self.n.get((s, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, s, node):
        if (s, node) not in self.memo:
            own = self.kt(s, node)
            if len(s) == self.depth:
                self.memo[s, node] = own
            else:
                kids = sum(self.weighted(k, node) for k in self.kids.get((s, node), ()))
                self.memo[s, node] = np.logaddexp(own, kids) - math.log(2)
        return self.memo[s, node]

    def bit(self, c, node, bit):
        """The weighted probability with one more decision, over the one without: no posterior weights."""
        value = 0.0
        for d in range(self.depth, -1, -1):
            s = c[self.depth - d :]
            a, b = self.n.get((s, node), (0, 0))
            a, b = a + (bit == 0), b + (bit == 1)
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            others = sum(self.weighted(k, node) for k in self.kids.get((s, node), ()) if k != c[self.depth - d - 1 :]) if d < self.depth else 0.0
            value = own if d == self.depth else np.logaddexp(own, others + value) - math.log(2)
        return math.exp(value - self.weighted(b"", node))

    def log10(self, t):
        return sum(math.log10(self.bit(c, node, b)) for c, x in self.positions(t) for node, b in self.decisions(x))


def test_lm_scores(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "cat", "Sat", "on", "a", "mat."], k=rng.randrange(0, 30))) for _ in range(60)] + ODD[:5] + ["é à", "the zebra"]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    split = [t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") for t in lower]
    split = [[w for w in ws if w] + [""] for ws in split]
    counts = Counter(w for ws, h in zip(split, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    slow = SlowTree([t.encode() for t, h in zip(lower, held, strict=True) if not h], 3)
    rows = {r.doc_id: r for r in ctw.score(docs_of(spark, texts).repartition(3), depth=3, block_bytes=200).collect()}
    assert len(rows) == len(texts)
    for i, ws in enumerate(split):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, slow.log10(lower[i].encode()), rel_tol=1e-6), i
    assert ctw.score(docs_of(spark, texts).limit(0)).count() == 0


def test_lm_predictions_are_distributions():
    keys, counts = np.unique(ctw.strings([b"abracadabra", b"abba"], 3)[0], return_counts=True)
    for context in (b"abr", b"zzz", b"\0\0\0", b"zab"):
        asked = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        k = np.unique(np.concatenate([keys, asked]))
        n = np.zeros(len(k), np.int64)
        n[np.searchsorted(k, keys)] = counts
        tree = ctw.Tree(k, n, 3)
        assert math.isclose((10 ** tree.log10(ctw.upper_levels(tree.sums()))[np.searchsorted(k, asked)]).sum(), 1.0)


def test_lm_beats_the_base_on_held_out_text(spark):
    rows = ctw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# -- URL rules


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x", "http://example.org/en/123?q#f", "http://example.org/en/2", "http://xexample.org/es/", "http://org", "http://org/", "http://a.com/de/", "http://com/fr/é", "ftp://a.com#/de/", "http://a.com?x=/de/", "x://y.org://z.com/de/", "http://h.org/\n/x", "http://" + "a." * 50 + "com/de/" + "p" * 3000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(4, urls[4]), (None, urls[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "verdict": F.lit(2)})
    rules = spark.createDataFrame(Q.URL_RULES, "verdict string, host string, path string")
    got = url_filter.judge(pages, rules).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(str((i, *brute_verdict(u))) for i, u in rows)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


# -- packing


def check_packing(rows, n_docs, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_table(spark, sf_dir, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    ids = {i: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in table.items()}
    rows = Q.queries()["op8_best_fit_packing"](spark, sf_dir).collect()
    want = {(i, k): (s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes())) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, len(table)) <= math.ceil(sum(map(len, ids.values())) / 4096) + 1


def test_packing_odd_texts(spark):
    texts = [*ODD, "<|endoftext|> It's", "Ⱥ İ ẞ 12ab,.", "a", "a"]
    ids = [*range(len(texts) - 2), 3, None]
    rows = packing.pack_documents(docs_of(spark, texts, ids), Q.tokenizer_path()).collect()
    check_packing(rows, len(texts))
    assert {r.doc_id: r.length for r in rows if r.doc_id in (0, 1, 2)} == {0: 1, 1: 1, 2: 1} and sum(r.piece == 0 for r in rows) == len(texts)
    assert packing.pack_documents(docs_of(spark, texts).limit(0), Q.tokenizer_path()).count() == 0
    cut = packing.pieces(docs_of(spark, ["a b", "c"]), Q.tokenizer_path())
    whole = packing.sequences(packing.pack(cut.drop("ids")), cut).collect()
    assert len(whole) == 1 and len(whole[0].ids) == 4 * 5


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 200)
    bins, offsets, gaps = packing.sum_of_squares(lengths, 100)
    for b in range(len(gaps)):
        at = np.flatnonzero(bins == b)
        order = at[np.argsort(offsets[at])]
        assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).tolist() and lengths[at].sum() + gaps[b] == 100
    counts = Counter()  # replay: no placement had a smaller sum of squares
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        size, b = int(lengths[i]), int(bins[i])

        def after(gap, size=size):
            c = Counter(counts)
            if gap is not None:
                c[gap] -= 1
            c[(100 if gap is None else gap) - size] += 1
            c[0] = 0
            return sum(v * v for v in c.values())

        options = [after(g) for g in [None, *(g for g, v in counts.items() if v > 0 and g >= size)]]
        gap = 100 - fill[b] if b in fill else None
        assert after(gap) == min(options)
        if gap is not None:
            counts[gap] -= 1
        fill[b] = fill.get(b, 0) + size
        if fill[b] < 100:
            counts[100 - fill[b]] += 1


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "<p>a</p>\n\n", "same", "same", "WARC/1.1\r\n\r\n", "é\0x" * 1000, LONG, "same", "\n"]
    rows = [(9 - i, f"http://x/{i}\r\n y" if i else None, h) for i, h in enumerate(html)] + [(None, None, "same"), (1, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    path = str(tmp_path / "warc")
    warc.write_warc(pages.repartition(3), path)
    got = warc.read_warc(spark, path).collect()
    text = {i: h or "" for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        payload = text[r.page_id].encode()
        first = min(i for i, h in text.items() if h.encode() == payload and i is not None)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.digest(payload))
        if r.page_id == first:
            assert r.record_type == "response" and bytes(r.payload) == payload and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.payload is None and r.refers_to == first
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_files_begin_with_a_dictionary(spark, sf_dir, tmp_path):
    path = tmp_path / "warc"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").coalesce(1), str(path))
    raw = next(path.glob("part-*")).read_bytes()
    assert raw[:4] == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 1000
    assert len(raw) < sum(len(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()) / 2


@pytest.mark.parametrize(("most", "rows"), [(1, 64), (2_000, 64), (1 << 30, 5)])
def test_warc_archives_are_closed(spark, tmp_path, most, rows):
    import zstandard

    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i % 50 * 100)) for i in range(60)], "page_id long, url string, html string").withColumn("at", F.lit("2020-02-03 04:05:06").cast("timestamp"))
    path = tmp_path / "warc"
    warc.write_warc(pages.coalesce(2), str(path), date_col="at", archive_bytes=most, archive_rows=rows)
    files = sorted(path.glob("part-*"))
    assert len(files) >= (60 if most == 1 else 3 if rows == 64 else 20)
    ids = []
    for f in files:
        raw = f.read_bytes()
        assert raw[:4] == warc.DICTIONARY_MAGIC and len(raw) < 100_000
        found = [fields for fields, _ in warc.parse(warc.open_archive(raw))]
        assert found[0]["warc-type"] == "warcinfo" and len(found) > 1 and "warcinfo" not in [x["warc-type"] for x in found[1:]]
        assert {x["warc-date"] for x in found[1:]} == {"2020-02-03T04:05:06Z"}
        ids += [x["warc-record-id"] for x in found]
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + int.from_bytes(raw[4:8], "little")])
        assert zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True).read(9) == b"WARC/1.1\r"
    assert len(set(ids)) == len(ids) == 60 + len(files)
    texts = {r.page_id: r.html for r in pages.collect()}
    got = warc.read_warc(spark, str(path)).collect()
    assert sorted(r.page_id for r in got) == sorted(texts)
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")


# -- classifiers


def accuracy(rows, labels, column):
    pairs = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in pairs) / len(pairs), pairs


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def test_quality_held_out(labelled):
    docs, labels, known = labelled
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, known, "quality")[0] > 0.97


def test_toxicity_held_out(labelled):
    docs, labels, known = labelled
    rows = toxicity.toxicity_scores(docs, labels).collect()
    share, pairs = accuracy(rows, known, "toxic")
    assert len(rows) == 10_000 and share > 0.95
    flagged = [b for a, b in pairs if a]
    assert sum(flagged) / len(flagged) > 0.95 and sum(flagged) > 0.9 * sum(b for _, b in pairs)


def test_language_held_out(labelled):
    docs, _, _ = labelled
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 10_000 and sum(held) / len(held) > 0.99


def test_gradients_by_differences():
    net = language_id.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = language_id.matrix([b"abc", b"d", b"he lo"])
    y = np.array([0, 2, 1])
    _, grads = net.gradients(x, live, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = net.p[name][at]
            losses = []
            for step in (1e-4, -1e-4):
                net.p[name][at] = old + step
                losses.append(net.gradients(x, live, y)[0])
            net.p[name][at] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 2e-4, name


def test_positive_unlabelled_risk_recovers_the_prior():
    rng = np.random.default_rng(3)
    n, prior = 4000, 0.2
    toxic = rng.random(n) < prior
    x = np.column_stack([(toxic & (rng.random(n) < 0.8)), rng.random(n) < 0.5]).astype(np.float32)
    positives = np.column_stack([rng.random(600) < 0.8, rng.random(600) < 0.5]).astype(np.float32)
    w, b = toxicity.train(np.concatenate([positives, x]), np.r_[np.ones(600, bool), np.zeros(n, bool)], prior)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert p[x[:, 0] == 1].min() > 0.8 and p[x[:, 0] == 0].max() < 0.15 and abs(p.mean() - prior) < 0.01


def test_classifiers_on_odd_rows(spark):
    docs = docs_of(spark, [*ODD, "twice", "twice"], [*range(len(ODD)), 50, None]).withColumns({"score": F.lit(1), "y": F.lit(2)})
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for rows in (quality.quality_scores(docs, some).collect(), toxicity.toxicity_scores(docs, some).collect()):
            assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
            assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in [*range(len(ODD)), 50]}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0 and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 4, 5)) and found[3].lang_pred == "en"
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and language_id.identify(docs.limit(0)).count() == 0
