"""Exact nearest documents by inner product over a metric index (D-04, J-10).

Documents are dealt once: each to the nearest of a bounded number of centres, and
there to a ring of distances and a block of bounded size, a cell. All that a
query needs to know of a cell is its centre and its outer radius: no document in
it can score more than `q . centre + |q| * radius`. A query first goes to its most
promising cell, whose best score then closes all cells that cannot reach it; it
goes to those that stay open, and the best of both visits is the exact answer.
Documents are not copied but for blocks of queries; queries travel once per open
cell.

How many cells close depends on the vectors: on separate clusters nearly all, on
vectors spread evenly over a sphere of many dimensions next to none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Documents of a cell and queries of a block, about.
BLOCK = 8192
#: Centres, the documents they are fitted on, and rings of a centre.
CENTRES = 64
SAMPLE = 4096
RINGS = 4
#: Blocks that smaller ones are cut into, over all rings, at most; a query travels once per open cell.
CELLS = 256
#: Visits of a batch, and inner products that a task holds at once.
VISITS = 1 << 14
PRODUCTS = 1 << 19
_SLACK = 1e-9


def fitted_centres(docs: DataFrame, centres: int = CENTRES, sample: int = SAMPLE, turns: int = 8) -> np.ndarray:
    """Centres of k-means over at most `sample` documents, those with the least hash of their id."""
    rows = docs.select("embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows], float)
    c = x[: min(centres, len(x))].copy()
    for _ in range(turns):
        at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return c


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy()).astype(float)
                far = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
                at = far.argmin(1)
                yield b.assign(centre=at, distance=np.sqrt(((x - centres[at]) ** 2).sum(1)))

    return run


def indexed(docs: DataFrame, centres: np.ndarray, rings: int = RINGS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with their cell, and the cells (cell, centre, radius, docs)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.select("doc_id", "embedding").mapInPandas(_assigned(centres), f"doc_id {kind}, embedding array<double>, centre int, distance double")
    told = stage(told)
    reach = told.groupBy("centre").agg(F.max("distance").alias("reach"))
    ring = F.when(F.col("reach") > 0, F.least(F.floor(F.col("distance") / F.col("reach") * rings), F.lit(rings - 1))).otherwise(0).cast("int")
    told = told.join(F.broadcast(reach), "centre").withColumn("ring", ring)  # a row per centre
    block = max(block, min(BLOCK, -(-told.count() // CELLS)))  # counted from the checkpoint
    size = told.groupBy("centre", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    cut = told.join(F.broadcast(size), ["centre", "ring"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    placed = stage(cut.withColumn("cell", F.concat_ws(".", "centre", "ring", "part")).select("doc_id", "embedding", "centre", "distance", "cell"))
    cells = placed.groupBy("cell", "centre").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("docs"))
    return placed, cells


def _visits(centres: np.ndarray, cells: pd.DataFrame, first: bool):
    """Rows (query_id, embedding, cell): the most promising cell, or all others that the bound leaves open."""
    names, at, radius = cells["cell"].to_numpy(), cells["centre"].to_numpy(), cells["radius"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, VISITS if first else VISITS // len(names))
            for a in range(0, len(b), step):
                part = b.iloc[a : a + step]
                q = np.stack(part["embedding"].to_numpy()).astype(float)
                near = q @ centres.T
                bound = near[:, at] + np.sqrt((q * q).sum(1))[:, None] * radius[None]
                best = near[:, at].argmax(1)
                if first:
                    i, j = np.arange(len(part)), best
                else:
                    open_ = bound + _SLACK >= part["score"].fillna(-np.inf).to_numpy()[:, None]
                    open_[np.arange(len(part)), best] = False
                    i, j = np.nonzero(open_)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[i], "embedding": part["embedding"].to_numpy()[i], "cell": names[j]})

    return run


def _best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    """The best document of one cell for each of a block of queries, never the query itself."""
    if q.empty or d.empty:
        return pd.DataFrame({"query_id": q["query_id"][:0], "doc_id": d["doc_id"][:0], "score": np.zeros(0)})
    d = d.sort_values("doc_id")
    m, ids, out = np.stack(d["embedding"].to_numpy()).astype(float).T, d["doc_id"].to_numpy(), []
    step = max(1, PRODUCTS // len(d))
    for a in range(0, len(q), step):
        own = q["query_id"].to_numpy()[a : a + step]
        s = np.stack(q["embedding"].to_numpy()[a : a + step]).astype(float) @ m
        s[own[:, None] == ids[None]] = -np.inf
        i = s.argmax(1)
        out.append(pd.DataFrame({"query_id": own, "doc_id": ids[i], "score": s[np.arange(len(s)), i]}))
    got = pd.concat(out)
    return got[np.isfinite(got["score"])]


def _met(visits: DataFrame, placed: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """The best document of each visit: a cell, however small, meets its visitors in blocks of BLOCK and is copied for no fewer."""
    parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    q = visits.join(parts, "cell").withColumn("k", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    d = placed.join(parts.withColumnRenamed("cell", "at"), F.col("cell") == F.col("at")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    q, d = q.select("cell", "k", "query_id", "embedding"), d.select("cell", "k", "doc_id", "embedding")
    return q.groupBy("cell", "k").cogroup(d.groupBy("cell", "k")).applyInPandas(_best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def indexed_nearest(queries: DataFrame, docs: DataFrame, centres: int = CENTRES, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score: the other document with the largest inner product; of equal ones the smaller id.

    queries: query_id, embedding; docs: doc_id, embedding. A query without any
    other document has no row; vectors are of one length and have no nulls.
    """
    kinds = (queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = fitted_centres(docs, centres)
    if not len(found):
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    placed, cells = indexed(docs.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")), found, rings, block)
    known = cells.toPandas()  # a row per `block` documents, and per ring
    shape = f"query_id {kinds[0]}, embedding array<double>, cell string"
    first = stage(_met(asked.mapInPandas(_visits(found, known, True), shape), placed, kinds))
    scored = asked.join(first.select(F.col("query_id").alias("q"), "score"), F.col("query_id") == F.col("q"), "left").drop("q")
    rest = _met(scored.mapInPandas(_visits(found, known, False), shape), placed, kinds)
    b = F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b")
    return first.union(rest).groupBy("query_id").agg(b).select("query_id", F.col("b.doc_id").alias("doc_id"), (-F.col("b.s")).alias("score"))
