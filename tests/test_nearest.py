"""The metric index against all products, and how much of it stays closed."""

import tracemalloc

import numpy as np
import pandas as pd

from spoor.operators import corpus, nearest

SCHEMA = "doc_id long, embedding array<float>"


def cloud(n, clusters, spread, d=12, seed=2):
    g = np.random.default_rng(seed)
    c = g.normal(size=(clusters, d)) * 3
    return (c[g.integers(clusters, size=n)] + g.normal(size=(n, d)) * spread).astype(np.float32)


def tables(spark, x):
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)
    return docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), docs


def plain(x):
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    return {i: (int(s[i].argmax()), float(s[i].max())) for i in range(0, len(x), 20)}


def test_exact_on_clusters_and_on_noise(spark):
    for x in (cloud(1500, 10, 0.2), cloud(600, 1, 1.0)):
        got = nearest.indexed_nearest(*tables(spark, x), centres=12, rings=3, block=40).collect()
        want = plain(x)
        assert {r.query_id: r.doc_id for r in got} == {q: d for q, (d, _) in want.items()}
        assert all(abs(r.score - want[r.query_id][1]) < 1e-6 for r in got)


def test_most_cells_stay_closed_on_clusters(spark):
    x = cloud(1500, 10, 0.2)
    queries, docs = tables(spark, x)
    centres = nearest.fitted_centres(docs, 12)
    placed, cells = nearest.indexed(docs, centres, 3, 40)
    known = cells.toPandas()
    asked = queries.toPandas().assign(score=[plain(x)[q][1] for q in range(0, len(x), 20)])
    (open_,) = nearest._visits(centres, known, False)(iter([asked]))
    pairs = open_.merge(known, on="cell")["docs"].sum()
    assert known["docs"].sum() == len(x) and known["docs"].max() < 90
    assert pairs < 0.25 * len(asked) * len(x)


def test_ties_repeats_and_empty(spark):
    queries, docs = tables(spark, np.ones((45, 3), np.float32))
    assert {r.query_id: r.doc_id for r in nearest.indexed_nearest(queries, docs).collect()} == {0: 1, 20: 0, 40: 0}
    one = docs.filter("doc_id = 0")
    assert nearest.indexed_nearest(queries.filter("query_id = 0"), one).count() == 0
    assert nearest.indexed_nearest(queries, docs.filter("false")).count() == 0


def test_small_cells_bound_visits_copies_and_batches(spark):
    """Cells of two vectors: as many visits as cells would otherwise travel, all of a batch in one frame."""
    x = cloud(2000, 1, 1.0)
    _, docs = tables(spark, x)
    centres = nearest.fitted_centres(docs, 4)
    known = nearest.indexed(docs, centres, 3, 2)[1].toPandas()
    assert len(known) <= nearest.CELLS + 4 * 3 and known["docs"].sum() == len(x)
    asked = docs.withColumnRenamed("doc_id", "query_id").toPandas().assign(score=float("-inf"))
    sizes = [len(v) for v in nearest._visits(centres, known, False)(iter([asked]))]
    assert max(sizes) <= nearest.VISITS and sum(sizes) == len(x) * (len(known) - 1)


def test_small_blocks_do_not_copy_a_table_for_each(spark):
    x = cloud(700, 3, 0.5)
    docs = tables(spark, x)[1]
    queries = docs.filter("doc_id % 10 <> 0").withColumnRenamed("doc_id", "query_id")
    docs = docs.filter("doc_id % 10 = 0")
    q, d = corpus._dealt(queries, docs, 2)
    assert q.count() == 630 * corpus.BLOCKS and d.count() == 70 * corpus.BLOCKS
    s = x.astype(float) @ x[::10].astype(float).T
    got = {r.query_id: (r.doc_id, r.score) for r in corpus.nearest(queries, docs, 2).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: 10 * int(s[i].argmax()) for i in range(700) if i % 10}
    assert all(abs(v[1] - s[k].max()) < 1e-6 for k, v in got.items())


def test_products_are_taken_in_bounded_steps():
    v = [np.ones(2, np.float32)] * 1024
    q = pd.DataFrame({"query_id": range(1024), "query": v})
    d = pd.DataFrame({"doc_id": range(8192), "document": v * 8})
    tracemalloc.start()
    got = corpus._best(q, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1024 and (got["doc_id"] == 0).all() and peak < 16 << 20  # all products: 64 MB
