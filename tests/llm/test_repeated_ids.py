"""Near-dedup of tables in which one identifier has several rows."""

from __future__ import annotations

from palimpsest.llm import simhash

from .test_operators import brute_fingerprint, docs_of

X, Y, Z = "the first text of all", "another text about rivers", "words that nothing else has"


def kept(spark, rows):
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    found = simhash.keep_representatives(docs)
    assert found.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)


def test_a_row_is_kept_by_its_own_component(spark):
    near_y = Y.upper()
    assert brute_fingerprint(near_y) == brute_fingerprint(Y)
    assert kept(spark, [(5, X), (5, Y), (3, near_y), (8, X)]) == sorted([(3, near_y), (5, X)], key=str)


def test_repeated_rows_leave_one_for_each_component(spark):
    rows = [(5, X), (5, X), (5, X.upper()), (5, Z), (7, Y), (7, Y), (9, Y), (None, X), (None, X)]
    assert kept(spark, rows) == sorted([(5, X.upper()), (5, Z), (7, Y), (None, X), (None, X)], key=str)


def test_without_repeated_ids(spark):
    assert kept(spark, [(1, X), (2, X), (4, Y), (None, Z)]) == sorted([(1, X), (4, Y), (None, Z)], key=str)
