"""The pipeline's stages against the operators' own decisions and a brute-force version."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as P
from palimpsest.llm import decontam, toxicity

from .test_operators import brute_exact, brute_fingerprint, check_packing, components


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or tables[-1].columns == columns
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:5]]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(rows[1]) == {i for i in rows[0] if not scores[i]}
    assert set(rows[2]) == {keep for keep, _ in brute_exact(rows[1].items()).values()}
    fps = {i: brute_fingerprint(t) for i, t in rows[2].items()}
    assert set(rows[3]) == set(components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4).values())
    shard = next(decontam.indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"))
    assert set(rows[4]) == {i for i, t in rows[3].items() if not decontam.matches(shard, t or "")}
    packed = tables[5].collect()
    check_packing(packed, len(rows[4]))
    assert {r.doc_id for r in packed} == set(rows[4])
    pieces = lambda found: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    whole = P.run(spark, sf_dir).collect()
    check_packing(whole, len(rows[4]))
    assert pieces(whole) == pieces(packed)  # the numbers of sequences may differ from run to run


def test_stages_on_empty_and_odd_tables(spark, sf_dir):
    """Each stage's rows, by hand: nulls, empty texts, repeated rows, two texts under one identifier, clashing names."""
    rows = [(None, None), (1, ""), (1, ""), (2, "a b"), (3, "A  b"), (4, "a\tb "), (5, "x y"), (5, "z"), (6, "z")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(n) for n in ("_digest", "_row", "_fp", "_gone", "fp", "root", "count", "_kept_id")})
    kept = {
        "toxicity": rows,
        "exact_dedup": [(1, ""), (3, "A  b"), (4, "a\tb "), (5, "x y"), (5, "z")],  # null is empty; "ab" in two spellings; z of 5 and 6
        "simhash_near_dedup": [(None, None), (2, "a b"), (5, "x y"), (5, "z"), (1, "")],  # rows without an identifier stay
        "decontamination": rows,
    }
    for name, stage in P.STAGES[:4]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        found = sorted(((r.doc_id, r.text) for r in after.collect()), key=str)
        assert found == sorted(kept[name], key=str), name
        assert {r["_digest"] for r in after.collect()} == {"_digest"}
    assert P.pack(spark, docs.limit(0), sf_dir).count() == 0
    assert P.pack(spark, docs, sf_dir).count() == len(rows)
