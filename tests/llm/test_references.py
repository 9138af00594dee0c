"""The learned operators against slow reference versions, and operators on odd or crowded input."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, exact_dedup, language_id, packing, quality, simhash, toxicity, url_filter, warc
from palimpsest.llm import queries as Q

from .test_operators import ODD, components, docs_of

# -- language: the network by plain loops


def slow_distribution(net, text, core, margin):
    """Position by position, from the definition of a gated recurrent unit."""
    h, p = net.h, {k: v.astype(np.float64) for k, v in net.p.items()}
    logistic = lambda x: 1 / (1 + math.exp(-x))
    text = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    total = np.zeros(len(p["c"]))
    for at in range(0, len(text), core):
        low, high = max(0, at - margin), min(len(text), at + core + margin)
        window, states = text[low:high], []
        for k in (0, 1):
            s, found = np.zeros(h), {}
            for t in range(len(window)) if k == 0 else reversed(range(len(window))):
                g, a = p[f"x{k}"][:, window[t]], p[f"u{k}"] @ s
                r = np.array([logistic(g[j] + a[j]) for j in range(h)])
                z = np.array([logistic(g[h + j] + a[h + j]) for j in range(h)])
                c = np.array([math.tanh(g[2 * h + j] + r[j] * a[2 * h + j]) for j in range(h)])
                s = (1 - z) * c + z * s
                found[t] = s
            states.append(found)
        for t in range(len(window)):
            if at <= low + t < at + core:  # each position is labelled once
                q = np.exp(p["v0"] @ states[0][t] + p["v1"] @ states[1][t] + p["c"][:, 0])
                total += q / q.sum()
    return total / max(1, len(text))


def test_network_labels_every_position_of_whole_texts():
    net = language_id.Network(3, hidden=5, seed=2)
    texts = [b"", b"a", b"Two words, 12 + 3!", "é über ñ".encode() * 7, b"x" * 50, bytes(range(256))]
    got = language_id.pooled(net, texts, core=16, margin=5, rows=3)
    assert not got[0].any()
    for t, q in zip(texts[1:], got[1:], strict=True):
        assert np.allclose(q, slow_distribution(net, t, 16, 5), atol=1e-5) and abs(q.sum() - 1) < 1e-5
    assert np.allclose(got, np.concatenate([language_id.pooled(net, [t], core=16, margin=5) for t in texts]), atol=1e-6)
    a, b = language_id.pooled(net, [b"ab cd", b"cd ab"], core=16, margin=5)
    assert not np.allclose(a, b)  # states cross word borders


def test_texts_without_a_letter(spark):
    docs = docs_of(spark, ["²", "½ ①", "42 + 1 = 43", None, "ａ", "ein Wort", "x" * 300_000])
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [rows[i].lang_pred for i in range(7)] == ["und"] * 4 + ["en"] * 3 and {rows[i].score for i in range(4)} == {0.0}


# -- toxicity: the risk by direct sums


def test_risk_by_direct_sums():
    rng = np.random.default_rng(0)
    p, u, v, prior = rng.random((30, 4)), rng.random((70, 4)), rng.normal(size=4), 0.3
    loss = lambda z, y: math.log1p(math.exp(-y * z))
    positive = sum(loss(x @ v, 1) for x in p) / 30
    negative = sum(loss(x @ v, -1) for x in u) / 70 - prior * sum(loss(x @ v, -1) for x in p) / 30
    assert np.allclose(toxicity.risk(p, u, v, prior), (prior * positive, negative))


def test_training_lowers_the_risk():
    rng = np.random.default_rng(1)
    toxic = rng.random(3000) < 0.2
    x = np.column_stack([toxic & (rng.random(3000) < 0.7), rng.random(3000) < 0.4]).astype(np.float32)
    p = np.column_stack([rng.random(500) < 0.7, rng.random(500) < 0.4]).astype(np.float32)
    w, b = toxicity.train(np.concatenate([p, x]), np.r_[np.ones(500, bool), np.zeros(3000, bool)], 0.2, spread=10.0)
    ones = lambda m: np.column_stack([m, np.ones(len(m))])
    whole = lambda v: (lambda r: r[0] + max(0.0, r[1]))(toxicity.risk(ones(p), ones(x), v, 0.2))
    best = whole(np.r_[w, b])
    assert all(whole(np.r_[w, b] + rng.normal(0, 0.3, 3)) > best - 2e-3 for _ in range(40))


def test_stems_and_words():
    assert toxicity.stems("abcdef") == ["abcd*", "abcde*"] and toxicity.stems("abcd") == []
    assert toxicity.features([b"abcde", b"abcdx", b"q"]) == {"abcde", "abcdx", "q", "abcd*", "abcd**"}
    model = toxicity.Model({"q": 1.0, "abcd*": 2.0, "abcd**": 4.0, "éééé*": 8.0}, -3.0)
    for text, z in ((b"", -3), (b"Q q", -2), (b"abcd", -3), (b"abcde abcde", -1), (b"abcde abcdx", 3), ("ééééa".encode(), 5)):
        assert math.isclose(model.probabilities([text])[0], 1 / (1 + math.exp(-z)))
        held = model.held(text)
        assert set(held) == toxicity.features(toxicity.tokens(text)) & model.weights.keys()


# -- quality: densities by explicit inverses


def test_margin_by_explicit_inverses():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)), rng.integers(0, 2, 200)
    x[y == 1] += 0.7
    m = quality.Discriminant(x, y)
    z = np.clip((x - m.centre) / m.scale, -12, 12)
    logs = []
    for k in (0, 1):
        s = m.factors[k] @ m.factors[k].T
        d = z - m.means[k]
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    assert np.allclose(np.sinh(m.margin(x)), logs[1] - logs[0])


# -- decontamination


def test_shards_change_nothing(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = items.unionByName(items.limit(5))  # repeated items match each
    rows = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 12), r.question_overlap, r.answer_overlap) for r in df.collect())
    whole = rows(decontam.contamination(docs, items))
    some = rows(decontam.contamination(docs, items, shard_bytes=max(1, items.agg(F.sum(F.octet_length("text"))).first()[0] // 5)))
    assert whole and whole == some
    left = [sorted(r.doc_id for r in decontam.drop_contaminated(docs, items, shard_bytes=b).collect()) for b in (1 << 24, 4000)]
    assert left[0] == left[1] == sorted({r.doc_id for r in docs.collect()} - {r[0] for r in whole})


def test_near_copies_are_found(spark):
    """Items with words replaced, in long texts: every one whose whole overlap is 0.8 or more, and none far below."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items, texts, overlaps = [], [], []
    for i in range(60):
        ws = rng.choices(words, k=rng.choice([20, 60, 150, 500]))
        items.append((i, " ".join(ws)))
        copy = list(ws)
        for at in rng.sample(range(len(ws)), rng.randrange(0, max(2, len(ws) // 25))):
            copy[at] = "changed"
        a, b = decontam.shingles(decontam.tokens(" ".join(ws))), decontam.shingles(decontam.tokens(" ".join(copy)))
        overlaps.append(len(a & b) / len(a))
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(0, 3000)), *copy, *rng.choices(words, k=200)]))
    items.append((99, " ".join(rng.choices(words, k=20_000))))  # one very long item
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i, o in enumerate(overlaps) if o >= 0.8} <= got and all(i == k and overlaps[i] >= 0.7 for i, k in got)
    assert sum(o >= 0.8 for o in overlaps) > 30


# -- SimHash: crowds


@pytest.mark.parametrize("stored", [0, 1, 700])
def test_crowds_of_probes(spark, stored):
    """Many members probe one value of which few or none are stored there: part 0 is crowded, part 1 holds the rest of the bits."""
    rng = random.Random(stored)
    parts, thresholds = [list(range(8)), list(range(8, 64))], [3, 0]
    fps = {rng.getrandbits(56) << 8 | 0b0001 for _ in range(1500)} | {rng.getrandbits(56) << 8 | 0b0010 for _ in range(stored)}
    fps |= {f ^ 0b0011 for f in sorted(fps)[:30]} | {f ^ (1 << 40) for f in sorted(fps)[:30]}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    at = {x: i for i, x in enumerate(fps)}
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    edges = simhash.links(df, parts, thresholds, block=64).collect()
    linked = {frozenset((at[e.a % (1 << 64)], at[e.b % (1 << 64)])) for e in edges}
    assert components(range(len(fps)), lambda a, b: frozenset((a, b)) in linked) == want


def test_a_crowd_of_copies(spark):
    """Two thirds of 30,000 rows are copies of one text; other columns have the names that operators use."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the one text that many rows hold").otherwise(F.concat_ws(" ", *[F.xxhash64("id", F.lit(k)) for k in range(6)])).alias("text"))
    docs = docs.withColumns({n: F.lit(n) for n in ("fp", "root", "_row", "_fp", "component_id", "first")})
    rows = simhash.near_duplicates(docs).groupBy("component_id").count().orderBy(F.desc("count")).limit(2).collect()
    assert (rows[0].component_id, rows[0]["count"]) == (1, 20_000) and rows[1]["count"] < 5
    assert simhash.keep_representatives(docs).columns == docs.columns


# -- clashing names, nulls and long values elsewhere


def test_clashing_columns(spark):
    texts = [*ODD, "same", "same"]
    ids = [*range(len(ODD)), 3, 3]
    names = ("_uid", "_group", "_digest", "_points", "_row", "place", "key", "norm", "digest", "edge", "start", "length", "piece", "sequence", "bucket", "block", "kind", "stats", "y", "held_out")
    docs = docs_of(spark, texts, ids)
    odd = docs.withColumns({n: F.lit(7) for n in names})
    rows = lambda df, *cols: sorted(str([r[c] for c in cols]) for r in df.collect())
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_dedup(odd), *cols) == rows(exact_dedup.exact_dedup(docs), *cols)
    assert rows(exact_dedup.keep_first(odd), "doc_id", "text", "_digest") == rows(exact_dedup.keep_first(docs).withColumn("_digest", F.lit(7)), "doc_id", "text", "_digest")
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(packing.pack_documents(odd, Q.tokenizer_path()), *cols) == rows(packing.pack_documents(docs, Q.tokenizer_path()), *cols)
    packed = packing.pack(spark.createDataFrame([(5, 10), (6, 20)], "_uid long, length long"))
    assert {(r["_uid"], r.length) for r in packed.collect()} == {(5, 10), (6, 20)}
    cols = ("doc_id", "score", "base_score", "n_tokens")
    from palimpsest.llm import ctw

    assert rows(ctw.score(odd, depth=2), *cols) == rows(ctw.score(docs, depth=2), *cols)
    items = spark.createDataFrame([(1, "same", 3)], "item_id long, text string, times long")
    assert rows(decontam.contamination(odd, items), "doc_id", "item_id") == ["[3, 1]", "[3, 1]"]


def test_odd_url_rules(spark):
    rules = spark.createDataFrame([("block", "h.org", None), ("allow", None, None), (None, "x.org", "/"), ("block", None, "/p")], "verdict string, host string, path string")
    urls = ["http://a.h.org/x", "http://h.org", "http://x.org/", "http://q.com/p", "http://" + ".".join("a" * 60_000) + ".h.org/" + "é/" * 50_000, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({n: F.lit(1) for n in ("_row", "_short", "_digest", "_rule")})
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("h.org", "block"), 1: ("h.org", "block"), 2: ("x.org/", "allow"), 3: (None, "allow"), 4: ("h.org", "block"), 5: (None, "allow")}


def test_archives_are_removed_by_no_reader(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path)
    assert [warc.read_warc(spark, path).count() for _ in range(2)] == [2, 2]
