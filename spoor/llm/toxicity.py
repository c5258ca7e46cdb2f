"""Toxicity by two Kneser-Ney models of letters, one of toxic and one of ordinary texts.

Each class has interpolated Kneser-Ney probabilities of a byte after three bytes
from its own counts. Both back off to one shared distribution, built from the
number of distinct left neighbours over both classes, so an expression that is
rare in either class says little, while new forms of a known expression share
its beginning. A text's score is the difference of the two log-likelihoods per
byte, put on a 0 to 1 scale by a logistic curve fitted on labelled rows that the
counts beneath it have not seen.

The curve comes from at most CURVE_ROWS of every CALIBRATION-th labelled training
row, by hash of id, the smallest hashes first, and from counts of all others. The
model itself counts all labelled training rows, those of the curve too. All
probabilities are worked out in joins of the counts; what is broadcast are two
tables of log-ratios of fixed size (2**GRAM_BITS and 2**LEFT_BITS floats, 12 MB).

Defined results: null and empty texts have no letters and get the curve's value
at 0; repeated rows count as often as they occur; labels of null or beyond 0 and
1 are not learnt; without both classes every score is 0.5; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import WORDS, encoded, mix, steps

GRAM_BITS = 21
LEFT_BITS = 20
DISCOUNT = 0.75
CALIBRATION = 5
CURVE_ROWS = 50_000
_BLOCK = 14
_PAD = b"    "


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every four bytes in a row of the texts, as numbers, and each text's first position.

    A-Z is lower-cased; runs of other bytes than letters and digits are one blank.
    """
    raw = b"".join(_PAD + t.lower() for t in texts)
    b = np.frombuffer(raw, np.uint8)
    blank = WORDS[b]
    keep = ~blank | np.concatenate([[True], ~blank[:-1]])
    starts = np.cumsum([0, *[len(t) + len(_PAD) for t in texts]])
    keep[starts[:-1]] = True
    off = np.concatenate([[0], np.cumsum(keep)])[starts]
    b = np.where(blank, 32, b)[keep].astype(np.uint32)
    b = np.concatenate([np.full(3, 32, np.uint32), b])
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], off


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, toxic, plain: a task's counts, added up before the exchange."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        g = np.concatenate([x[0] for x in held])
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return g[first], np.add.reduceat(np.concatenate([x[1] for x in held])[order], first, axis=0)

    def out(g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["gram", "toxic", "plain"])

    for batch in batches:
        label, texts = batch.column(0).to_numpy(), _unpacked(batch.column(1))
        for a, z in steps(texts):
            gram, off = _grams(texts[a:z])
            toxic = np.repeat(label[a:z] == 1, np.diff(off))
            for on, column in ((toxic, 0), (~toxic, 1)):
                g, c = np.unique(gram[on], return_counts=True)
                n = np.zeros((len(g), 2), np.int64)
                n[:, column] = c
                held.append((g, n))
            if len(held) >= 32:
                held = [added()]
                if len(held[0][0]) > 1 << 20:
                    yield out(*held[0])
                    held = []
    if held:
        yield out(*added())


def log_ratios(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of grams seen, and (left, ratio) of three bytes before a gram not seen, from (toxic, packed) rows."""
    grams = rows.select("toxic", "packed").mapInArrow(_count, "gram long, toxic long, plain long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    grams = stage(grams).withColumns({"left": F.shiftright("gram", 8), "tri": F.col("gram").bitwiseAND(F.lit(0xFFFFFF)), "bi": F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)), "own": F.col("gram").bitwiseAND(F.lit(0xFF))})
    some = lambda c, n: F.sum((F.col(c) > 0).cast("long")).alias(n)
    lefts = grams.groupBy("left").agg(F.sum("toxic").alias("nt"), F.sum("plain").alias("np"), some("toxic", "tt"), some("plain", "tp"))
    tri = grams.groupBy("tri", "bi", "own").agg(F.count(F.lit(1)).alias("d3"))
    bi = tri.groupBy("bi").agg(F.sum("d3").alias("d2"), F.count(F.lit(1)).alias("t2"))
    one = tri.groupBy("own").agg(F.sum("d3").alias("d1"))  # 256 rows at most
    whole = one.agg(F.sum("d1").alias("d0"))
    d = F.lit(DISCOUNT)
    shared = (F.greatest(F.col("d3") - d, F.lit(0.0)) + d * F.col("t2") * F.col("d1") / F.col("d0")) / F.col("d2")
    tri = tri.join(bi, "bi").join(F.broadcast(one), "own").crossJoin(F.broadcast(whole)).select("tri", shared.alias("shared"))

    def weight(n: str, t: str) -> Column:
        return F.when(F.col(n) > 0, d * F.col(t) / F.col(n)).otherwise(1.0)

    def chance(c: str, n: str, t: str) -> Column:
        seen = F.when(F.col(n) > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(n)).otherwise(0.0)
        return seen + weight(n, t) * F.col("shared")

    known = grams.join(lefts, "left").join(tri, "tri").select("gram", F.log(chance("toxic", "nt", "tt") / chance("plain", "np", "tp")).alias("ratio"))
    return known, lefts.select("left", F.log(weight("nt", "tt") / weight("np", "tp")).alias("ratio"))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def _place(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _BLOCK), pa.array(at & ((1 << _BLOCK) - 1)), batch.column(1)], names=["block", "place", "ratio"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block as one dense array; where two keys meet, their mean."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, place, ratio = (batch.column(i).to_numpy() for i in range(3))
        for b in np.unique(block).tolist():
            on = block == b
            sums = held.setdefault(b, np.zeros((2, 1 << _BLOCK)))
            np.add.at(sums[0], place[on], ratio[on])
            np.add.at(sums[1], place[on], 1)
    for b, (total, n) in held.items():
        dense = np.where(n > 0, total / np.maximum(n, 1), np.nan).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([dense.tobytes()], pa.binary())], names=["block", "dense"])


def dense(ratios: DataFrame, bits: int) -> np.ndarray:
    """A (key, ratio) table in 2**bits hashed places; NaN where nothing is."""
    placed = ratios.mapInArrow(_place(bits), "block long, place long, ratio double").repartition("block")
    out = np.full(1 << bits, np.nan, np.float32)
    for r in placed.mapInArrow(_pack, "block long, dense binary").collect():
        out[r.block << _BLOCK : (r.block + 1) << _BLOCK] = np.frombuffer(r.dense, np.float32)
    return out


class Model:
    """Log-ratio tables, and the curve (a, b): score = 1 / (1 + exp(-(a + b * ratio)))."""

    def __init__(self, known: np.ndarray, lefts: np.ndarray):
        self.known, self.lefts, self.curve = known, np.nan_to_num(lefts), (0.0, 0.0)

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood difference per byte of each text."""
        out = []
        for a, z in steps(texts):
            gram, off = _grams(texts[a:z])
            r = self.known[_places(gram, GRAM_BITS)]
            new = np.flatnonzero(np.isnan(r))
            r[new] = self.lefts[_places(gram[new] >> 8, LEFT_BITS)]
            sums = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
            out.append((sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * self.ratios(texts)).clip(-50, 50)))


def fitted_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with a weak pull to zero."""
    if not len(x) or y.min() == y.max():
        return (0.0, 0.0)
    m, s = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones(len(x)), (x - m) / s], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ w).clip(-50, 50)))
        g = z.T @ (y - p) - 1e-2 * w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), g)
    return float(w[0] - w[1] * m / s), float(w[1] / s)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = zstandard.ZstdCompressor(level=1)
        small = pa.array([z.compress(t) for t in encoded(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), small], names=["doc_id", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    return [zstandard.decompress(x) for x in column.to_pylist()]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, packed, toxic: the texts that have a label of 0 or 1, compressed for the exchange and written once.

    Labels grow with the corpus, so both sides are dealt by doc_id at every size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pack_texts, f"doc_id {kind}, packed binary")
    known = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return stage(texts.join(known.hint("merge"), "doc_id"))


def _counted(rows: DataFrame) -> Model:
    known, lefts = log_ratios(rows)
    return Model(dense(known, GRAM_BITS), dense(lefts, LEFT_BITS))


def train(rows: DataFrame) -> Model:
    """A model of the rows that `labelled` gives: the curve by rows kept apart, the counts by all."""
    order = F.xxhash64(F.lit("curve"), "doc_id")
    held = F.pmod(order, F.lit(CALIBRATION)) == 0
    part_model = _counted(rows.filter(~held))
    sent = rows.sparkSession.sparkContext.broadcast(part_model)

    def ratio(batches):
        for batch in batches:
            x = sent.value.ratios(_unpacked(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x)], names=["o", "y", "x"])

    part = rows.filter(held).select(order.alias("o"), F.col("toxic").alias("y"), "packed").mapInArrow(ratio, "o long, y int, x double")
    got = part.orderBy("o", "y", "x").limit(CURVE_ROWS).collect()
    sent.unpersist()
    model = _counted(rows)
    model.curve = fitted_curve(np.array([r.x for r in got]), np.array([r.y for r in got], float))
    return model


def scored(docs: DataFrame, model: Model, keep: dict[str, Column]) -> DataFrame:
    """The columns of `keep`, then the score of `text`."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    sent, n = docs.sparkSession.sparkContext.broadcast(model), len(keep)

    def run(batches):
        for batch in batches:
            got = pa.array(sent.value.scores(encoded(batch.column(n))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], got], names=[*batch.schema.names[:n], "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")
