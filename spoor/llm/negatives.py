"""Hard negatives by threshold joins: pruned inverted lists, partial scores, thresholds lowered until windows fill.

Scores are inner products of integer vectors. A window asks for the `k` highest
scores of an anchor between two bounds. Rounds of joins find all scores at or
above a threshold that starts high in the window; windows that hold `k` are
done, the others go on with a lower one, at last with their lower bound.

A join meets blocks of rows with blocks of anchors, each pair of blocks in a
task of its own. In it, the dimensions of every row are indexed up to where the
norm of the rest, times the largest norm an anchor has there, falls under the
lowest threshold: what is left out cannot reach it alone. Rows lie in the order
of that cut, so the list of a dimension is a run of rows. Scores are accumulated
over the lists a few dimensions at a time; a pair whose partial score and norms
of what remains fall under the anchor's threshold is dropped, and whoever is
left has its whole score.

Defined results: rows with a null id, label, vector, or with a null or
non-finite component take no part; a shorter vector counts as padded with
zeros, an empty one scores 0; rows with the anchor's own id are none of its
others, of repeated rows each counts for other anchors, and anchors repeated in
full are one; ties go to the smaller id; an empty table gives an empty result;
other columns are not read. Scores over a long end in an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import written

#: Rows and anchors in a block.
ROWS = 8192
ANCHORS = 1 << 15
#: Dimensions whose lists are gone through before pairs are dropped again.
STEP = 8
#: Where thresholds of the rounds lie: for positives as shares of the anchor's squared norm, for negatives as depths into the window.
POSITIVE = (0.5, 0.25, 0.125, None)
NEGATIVE = (0.125, 0.5, 1.0)
_LOW = -(1 << 62)
_PAIRS = 1 << 19  # anchor and row pairs scored at once


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, x (components times `scale`, rounded down) of the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    picked = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    picked = picked.filter("id is not null and label is not null and x is not null").filter(F.forall("x", fine))
    return picked.withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles, short ones padded with zeros."""
    flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    off = off - off[0]
    out, n = np.zeros((len(lists), width)), np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat
    return out


def _rests(x: np.ndarray) -> np.ndarray:
    """Norm of each row from each dimension on; a column more than dimensions."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


class Index:
    """Inverted lists of a block of rows for anchors with these largest norms of the rest, and this lowest threshold.

    Rows and anchors come with their dimensions in one order.
    """

    def __init__(self, x: np.ndarray, anchor_rests: np.ndarray, least: float):
        rest = _rests(x)
        # what a row has from here on may still reach the threshold alone; true up to the cut, then never again
        cut = np.minimum((rest * anchor_rests * (1 + 1e-9) + 1e-6 >= least).sum(axis=1), x.shape[1])
        self.rows = np.argsort(-cut, kind="stable")  # lists are runs from the first row on
        self.x, self.rest, self.cut = x[self.rows], rest[self.rows], cut[self.rows]

    def listed(self, dim: int) -> int:
        """Length of the list of a dimension."""
        return int(np.searchsorted(-self.cut, -dim, side="left"))

    def reach(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of all pairs with a score of `least` of the anchor or more."""
        step = max(1, _PAIRS // max(1, len(self.x)))
        for a in range(0, len(q), step):
            i, j, s = self._reach(q[a : a + step], least[a : a + step])
            yield i + a, self.rows[j], s

    def _reach(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, rests = q.shape[1], _rests(q)
        pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # the lists of the first dimensions meet every anchor; a row stops where its lists end
        stops = [min(k, d) for k in range(0, 2 * STEP + 1, STEP)]
        score = np.zeros((len(q), self.listed(0)))
        ended = []
        for k, z in zip(stops, stops[1:]):
            m = self.listed(k)
            score[:, :m] += q[:, k:z] @ self.x[:m, k:z].T
            ended.append((self.listed(z) if z < stops[-1] else 0, m, z))
        for lo, hi, z in ended:  # pairs that can still reach go on, with dimensions without lists too
            i, j = np.nonzero(score[:, lo:hi] + rests[:, z, None] * self.rest[None, lo:hi, z] * (1 + 1e-9) + 1e-6 >= least[:, None])
            s = score[i, j + lo]
            j, k = j + lo, z
            while k < d and len(i):
                s = s + np.einsum("ij,ij->i", q[i, k : k + STEP], self.x[j, k : k + STEP])
                k = min(k + STEP, d)
                keep = s + rests[i, k] * self.rest[j, k] * (1 + 1e-9) + 1e-6 >= least[i]
                i, j, s = i[keep], j[keep], s[keep]
            keep = s >= least[i]
            pairs = tuple(np.concatenate([x, y[keep]]) for x, y in zip(pairs, (i, j, s)))
        return pairs


def _exact(q: np.ndarray, x: np.ndarray) -> None:
    """Doubles hold the scores exactly up to 2**53."""
    if len(q) and len(x) and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] >= 2.0**53:
        raise OverflowError("scores of these vectors are beyond exact sums; lower the scale")


def _first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each key, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    start = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
    return order[place < k]


def _joined(k: int, same: bool):
    """(window, id, score) of the first k of each window inside a pair of blocks, which come sorted by their key."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        anchor = pc.is_valid(t.column("window"))
        q, x = t.filter(anchor), t.filter(pc.invert(anchor))
        if not (q.num_rows and x.num_rows):
            return pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("window", "other", "score")]))
        one = lambda tab, c: tab.column(c).combine_chunks()
        width = int(max(pc.max(pc.list_value_length(t.column("x"))).as_py() or 0, 1))
        qm, xm = _matrix(one(q, "x"), width), _matrix(one(x, "x"), width)
        _exact(qm, xm)
        ids, labels = one(x, "id").to_numpy(), one(x, "label").to_numpy()
        own, label, window = one(q, "id").to_numpy(), one(q, "label").to_numpy(), one(q, "window").to_numpy()
        low, high = one(q, "low").to_numpy(), one(q, "high").to_numpy()
        # windows of one anchor share its scores: the anchor goes through once, with its lowest threshold
        _, first, of = np.unique(np.stack([own, one(q, "uid").to_numpy()]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        least = np.full(len(first), np.inf)
        np.minimum.at(least, of, low.astype(float))
        by_anchor = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by_anchor], np.arange(len(first) + 1))
        # dimensions that carry most come first, so that what is left out of the lists is long
        dims = np.argsort(-(xm * xm).sum(axis=0), kind="stable")
        qs = qm[first][:, dims]
        index = Index(xm[:, dims], _rests(qs).max(axis=0), float(least.min()))
        found = []
        for i, j, s in index.reach(qs, least):
            keep = (labels[j] == label[first[i]]) if same else (labels[j] != label[first[i]])
            keep &= ids[j] != own[first[i]]
            i, j, s = i[keep], j[keep], s[keep]
            # one row per window of the anchor
            n = starts[i + 1] - starts[i]
            p = np.repeat(np.arange(len(i)), n)
            w = by_anchor[np.repeat(starts[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            inside = (s[p] >= low[w]) & (s[p] <= high[w])
            p, w = p[inside], w[inside]
            best = _first(w, s[p], ids[j[p]], k)
            found.append((w[best], ids[j[p[best]]], s[p[best]]))
        w, i, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(window[w], pa.int64()), pa.array(i.astype(np.int64)), pa.array(s.astype(np.int64))], names=["window", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if held and keys[s] != key:
                    yield solve(held)
                    held = []
                key = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(held)

    return run


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def _join(rows: DataFrame, row_blocks: int, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """window, other, score: the first k of each window (window, uid, id, label, x, low, high), counted over all rows."""
    anchor_blocks = _blocks(windows.select("uid").distinct().count(), ANCHORS)
    key = F.col("b") * row_blocks + F.col("a")
    left = windows.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(anchor_blocks))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    left = left.select(key.alias("key"), "window", "uid", "id", "label", "low", "high", "x")
    right = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    none = F.lit(None).cast("long")
    right = right.select(key.alias("key"), none.alias("window"), none.alias("uid"), "id", "label", none.alias("low"), none.alias("high"), "x")
    met = left.union(right).repartition("key").sortWithinPartitions("key")
    found = met.mapInArrow(_joined(k, same), "window long, other long, score long")
    first = W.partitionBy("window").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _filled(rows: DataFrame, row_blocks: int, windows: DataFrame, k: int, same: bool, lows: tuple) -> DataFrame:
    """window, other, score, rank of every window (with columns floor and high), whose thresholds are lowered round by round."""
    out, open_ = [], windows
    for turn, low in enumerate(lows):
        last = turn == len(lows) - 1
        asked = open_.withColumn("low", F.col("floor") if last else F.greatest("floor", low))
        found = stage(_join(rows, row_blocks, asked, k, same))
        if last:
            out.append(found)
            break
        held = found.groupBy("window").agg(F.count(F.lit(1)).alias("held"))
        state = asked.join(held.withColumnRenamed("window", "w"), F.col("window") == F.col("w"), "left")
        full = (F.coalesce("held", F.lit(0)) >= k) | (F.col("low") <= F.col("floor"))
        open_ = stage(state.filter(~full).select(*windows.columns))
        rest = open_.select(F.col("window").alias("w"))
        out.append(found.join(rest, F.col("window") == F.col("w"), "left_anti"))
        if open_.isEmpty():
            break
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def mined(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides. For each anchor and each of its
    first `positives` others of the same label: the first `negatives` rows of
    another label whose score is between `low` and `high` percent of the positive's.
    """
    own = vectors(rows, id_col, vector_col, label, scale).withColumn("h", F.xxhash64("id", F.monotonically_increasing_id()))
    all_rows = written(own)
    row_blocks = _blocks(all_rows.count(), ROWS)
    dealt = all_rows.withColumn("a", F.pmod("h", F.lit(row_blocks)))
    anchors = all_rows.filter(F.col("id") % every == 0).withColumn("uid", F.xxhash64("id", "label", "x")).dropDuplicates(["uid"])
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    anchors = written(anchors.withColumn("norm", norm))
    asked = anchors.select(F.col("uid").alias("window"), "uid", "id", "label", "x", "norm", F.lit(_LOW).cast("long").alias("floor"), F.lit(-_LOW).cast("long").alias("high"))
    shares = tuple(None if s is None else F.ceil(F.col("norm") * s) for s in POSITIVE)
    near = stage(_filled(dealt, row_blocks, asked, positives, True, shares))
    pairs = near.select(F.col("window").alias("of"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("p"))
    bounded = anchors.join(pairs, F.col("uid") == F.col("of")).drop("of", "norm", "h")
    # whole numbers s with low * positive <= 100 * s <= high * positive
    bounded = bounded.withColumn("floor", F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)"))
    bounded = bounded.withColumn("high", F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")).filter("floor <= high")
    asked = written(bounded.withColumn("window", F.xxhash64("uid", "p")))
    depths = tuple(F.col("high") - F.floor((F.col("high") - F.col("floor")) * d) for d in NEGATIVE)
    found = _filled(dealt, row_blocks, asked.select("window", "uid", "id", "label", "x", "floor", "high"), negatives, False, depths)
    named = asked.select(F.col("window").alias("w"), F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    out = found.join(named, F.col("window") == F.col("w"))
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 3
"""
