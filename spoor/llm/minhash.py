"""Near-duplicates by bottom-k sketches: inverted lists of retained values, union-sketch estimates, exact Jaccard.

One hash function gives every shingle a number; a text's sketch is the SKETCH
smallest numbers of its set. The union of two sketches, cut to its smallest
SKETCH numbers, is a sketch of the union of the sets, and the share of it that
both hold estimates their similarity. A near pair shares at least SHARED of it
(at 0.8 all but one in 10**10 pairs do; sets that fit into a sketch always do),
so two sketches that are each cut to all but SHARED - 1 of their numbers, rarest
first, still have one in common: only these postings make inverted lists, and
frequent shingles make none unless they are most of a text.

Lists are not expanded into pairs. First each member of a list meets the list's
head; pairs whose estimate is high enough are confirmed on the full
sets, and their links joined to components. Only lists that then still hold
members of different components are gone through in full, in blocks of bounded
size: every pair of different components is settled on the full sets in the task
where it meets, and leaves at most the links of a forest.

Defined results: null, empty and blank texts have an empty set, are linked with
nothing and are their own component; repeated rows and equal texts are one node
from the start; rows without doc_id belong to their text's component but never
name it, and are kept only where nothing names it (`kept` is true then for one
and all such rows); an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .common import components, encoded, steps, written
from .simhash import shingle_sets

#: Numbers that a sketch retains.
SKETCH = 64
#: Numbers of a union sketch that a near pair has in common, at least; for a similarity of 0.8.
SHARED = 28
#: Members and bytes of text that one side of a meeting holds, about.
BLOCK = 1024
BYTES = 4 << 20


def shared_least(similarity: float) -> int:
    """The part of a union sketch that near pairs share but for about one in 10**10: seven deviations under the mean."""
    return max(1, int(SKETCH * similarity - 7.25 * (SKETCH * similarity * (1 - similarity)) ** 0.5))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, z in steps(texts, 1 << 19):
                flat, ends = shingle_sets(texts[a:z], width)
                size = np.diff(ends)
                kept = np.minimum(size, SKETCH)
                off = np.concatenate([[0], np.cumsum(kept)])
                # sets come sorted, so the smallest are in front
                at = np.repeat(ends[:-1] - off[:-1], kept) + np.arange(off[-1])
                listed = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat[at].view(np.int64) ^ np.int64(-(1 << 63))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(size), listed, batch.column(1).slice(a, z - a)], names=["t", "n", "sketch", "text"])

    return run


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key() -> Column:
    return F.xxhash64(F.xxhash64(_text()), F.md5(_text()))


def _postings(nodes: DataFrame, similarity: float) -> DataFrame:
    """v, t, n, bytes, common: the rarest numbers of each sketch, as many as a near pair cannot miss, without those of one text.

    `common` is how many texts have a number of the sketch, on average.
    """
    least = F.least(F.lit(shared_least(similarity)), F.ceil(F.col("m") * similarity - 1e-9))
    # read twice from the written table, where sketches are packed; as a checkpoint these rows are larger than the texts
    rows = nodes.select("t", "n", "bytes", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    often = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = rows.join(often, "v").withColumn("prefix", (F.col("m") - least + 1).cast("int"))
    own = W.partitionBy("t")
    # numbers of no other text come first in the order and make no list
    single = F.col("m") - F.count(F.lit(1)).over(own)
    ranked = met.withColumn("r", F.row_number().over(own.orderBy("df", "v")) + single)
    return ranked.filter("r <= prefix").select("v", "t", "n", "bytes", ((F.sum("df").over(own) + single) / F.col("m")).alias("common"))


def _near(sketch_a: str, sketch_b: str, similarity: float) -> Column:
    """Whether the union sketch leaves it open that two sets are near."""
    union = F.slice(F.array_sort(F.array_union(sketch_a, sketch_b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(sketch_a, sketch_b), union))
    return both >= F.least(F.lit(shared_least(similarity)), F.ceil(F.size(union) * similarity - 1e-9))


def settled(flat: np.ndarray, ends: np.ndarray, side: np.ndarray, lab: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join sets i of side 1 with sets j of side 2 (3: both) at that similarity, as a forest over `lab`."""
    size = np.diff(ends)
    kinds, place = np.unique(flat, return_inverse=True)
    flag = np.zeros(len(kinds), bool)
    _, lab = np.unique(lab, return_inverse=True)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    right = right[np.argsort(size[right], kind="stable")]
    ranked = size[right]
    u, v = [], []
    for i in left.tolist():
        if not size[i]:
            continue
        a = np.searchsorted(ranked, size[i] * similarity - 1e-6, side="left")
        z = np.searchsorted(ranked, size[i] / similarity + 1e-6, side="right")
        j = right[a:z]
        j = j[lab[j] != lab[i]]
        if not len(j):
            continue
        own = place[ends[i] : ends[i + 1]]
        flag[own] = True
        for at in np.array_split(j, -(-int(size[j].sum()) // (1 << 22)) or 1):
            n = size[at]
            first = np.cumsum(n) - n
            spots = np.repeat(ends[at] - first, n) + np.arange(int(n.sum()))
            both = np.add.reduceat(flag[place[spots]].astype(np.int64), first)
            # hundredths, so that the bound is met exactly
            near = at[100 * both >= round(100 * similarity) * (size[i] + n - both)]
            _, once = np.unique(lab[near], return_index=True)
            for x in near[once].tolist():
                if lab[x] != lab[i]:
                    u.append(i)
                    v.append(x)
                    lab[lab == max(lab[x], lab[i])] = min(lab[x], lab[i])
        flag[own] = False
    return np.array(u, np.int64), np.array(v, np.int64)


def _meetings(width: int, similarity: float):
    """Links of each meeting (k, side, lab, t, text), which come sorted by k: one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            sides, labs, ts, texts = zip(*rows)
            t = np.array(ts, np.int64)
            u, v = settled(*shingle_sets(list(texts), width), np.array(sides), np.array(labs, np.int64), similarity)
            return pa.RecordBatch.from_arrays([pa.array(t[u]), pa.array(t[v])], names=["u", "v"])

        for batch in batches:
            for k, *row, text in zip(*[batch.column(c).to_pylist() for c in range(4)], encoded(batch.column(4))):
                if k != key:
                    if len(rows) > 1:
                        yield links()
                    key, rows = k, []
                rows.append((*row, text))
        if len(rows) > 1:
            yield links()

    return run


def _met(rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links of meetings (k, side, lab, t), with the texts of t."""
    seated = rows.join(nodes.select("t", "text"), "t").select("k", "side", "lab", "t", "text")
    return seated.repartition("k").sortWithinPartitions("k").mapInArrow(_meetings(width, similarity), "u long, v long")


def _parts() -> Column:
    """Blocks that a group of rows with `bytes` is cut into."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BYTES)).cast("int")


def _stars(post: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between one member of each list, the one most like all others, and the rest.

    An original has what all its copies have, an edited copy does not, so the head
    of a list is the member whose numbers are the most common.
    """
    heads = post.groupBy("v").agg(F.max(F.struct("common", "t")).alias("b")).select("v", F.col("b.t").alias("head"))
    pairs = post.join(heads, "v").filter("t <> head").select("t", "head").distinct()
    one = pairs.join(nodes.select("t", "bytes", F.col("sketch").alias("x")), "t")
    two = one.join(nodes.select(F.col("t").alias("head"), F.col("sketch").alias("y")), "head")
    close = stage(two.filter(_near("x", "y", similarity)).select("t", "head", "bytes"))
    parts = close.groupBy("head").agg(_parts().alias("parts"))
    key = lambda p: F.xxhash64("head", p)
    leads = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    leads = leads.select(key("p").alias("k"), F.lit(1).alias("side"), F.col("head").alias("lab"), F.col("head").alias("t"))
    rest = close.join(parts, "head").withColumn("p", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    rest = rest.select(key("p").alias("k"), F.lit(2).alias("side"), F.col("t").alias("lab"), "t")
    return _met(leads.union(rest), nodes, width, similarity)


def _remainder(post: DataFrame, nodes: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between members of lists that still hold different components.

    Lists of the same members are gone through once. A member meets its own class
    of set sizes and the next; sizes of a near pair are no further apart. A class
    over BLOCK members or BYTES bytes is cut into blocks, and every two blocks
    meet in a task of their own.
    """
    labelled = post.join(found, F.col("t") == F.col("node"), "left").select("v", "t", "n", "bytes", F.coalesce("root", "t").alias("lab"))
    labelled = stage(labelled)
    lists = labelled.groupBy("v").agg(
        F.sum(F.xxhash64("t").cast("decimal(38,0)")).alias("same"), F.count(F.lit(1)).alias("c"), F.min("lab").alias("lo"), F.max("lab").alias("hi")
    )
    once = lists.filter("lo <> hi").groupBy("same", "c").agg(F.min("v").alias("v")).select("v")
    # steps of a little over the greatest ratio of sizes
    step = -log(similarity - 1e-6)
    size_class = F.floor(F.log("n") / step).cast("int")
    open_ = labelled.join(once, "v").withColumn("s", size_class)
    both = open_.select("v", "t", "lab", "bytes", F.explode(F.array(F.struct("s", F.lit(3).alias("side")), F.struct((F.col("s") + 1).alias("s"), F.lit(1).alias("side")))).alias("e"))
    both = stage(both.select("v", "t", "lab", "bytes", "e.*"))
    rooms = both.groupBy("v", "s").agg(
        _parts().alias("parts"),
        F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.max("side").alias("most"),
    ).filter("lo <> hi and most = 3").select("v", "s", "parts")
    dealt = both.join(rooms, ["v", "s"]).withColumn("own", F.pmod(F.xxhash64("t", F.lit(7)), F.col("parts")).cast("int"))
    # with one block it meets itself; with more each meets every other, and so its own rows too
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("v", "s", "own", "side", "lab", "t", F.explode(others).alias("other"))
    k = F.xxhash64("v", "s", F.least("own", "other"), F.greatest("own", "other"))
    return _met(dealt.select(k.alias("k"), "side", "lab", "t"), nodes, width, similarity)


def near_duplicates(docs: DataFrame, width: int = 4, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (whether it is that document)."""
    keyed = docs.select("doc_id", _text().alias("text"), _key().alias("t"))
    texts = keyed.groupBy("t").agg(F.first("text").alias("text"))
    nodes = written(texts.mapInArrow(_sketches(width), "t long, n long, sketch array<long>, text string").withColumn("bytes", F.octet_length("text").cast("long")))
    post = stage(_postings(nodes.filter("n > 0"), similarity))
    first = stage(_stars(post, nodes, width, similarity))
    more = _remainder(post, nodes, components(first), width, similarity)
    found = components(first.union(more))
    named = nodes.select("t", "n").join(found, F.col("t") == F.col("node"), "left").select("t", "n", F.coalesce("root", "t").alias("root"), (F.col("n") > 0).alias("some"))
    ids = stage(keyed.select("doc_id", "t"))
    best = ids.groupBy("t").agg(F.min("doc_id").alias("least")).join(named, "t")
    roots = best.groupBy("root").agg(F.min("least").alias("named"))
    each = best.join(roots, "root").select("t", "n", "some", "named")
    out = ids.join(each, "t").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("named")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY ALL
), worded AS (
  SELECT least AS t, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts
), sets AS (
  SELECT t, text, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded
), flat AS (
  SELECT t, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.t AS u, b.t AS v FROM flat a JOIN flat b ON a.g = b.g AND a.t <> b.t
  GROUP BY a.t, b.t, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(d, r) AS (
  SELECT t, t FROM sets UNION SELECT reach.d, links.v FROM reach JOIN links ON reach.r = links.u
), named AS (
  SELECT d, min(r) AS root FROM reach GROUP BY d
)
SELECT doc_id, len(s) AS n_shingles,
  CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS component_id,
  doc_id = CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS kept
FROM documents JOIN sets ON coalesce(documents.text, '') = sets.text JOIN named ON d = t
"""
