"""Contamination and retrieval over text corpora (D-01 .. D-08, J-09, J-10)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS
from .spread import group_percentiles


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{WS}+"), lambda w: w != "")


def ngrams(w: Column, n: int) -> Column:
    """D-01: distinct n-grams of a column of words; shorter lists have none.

    `w` must be a column and not an expression: the lambda would split the text anew for every n-gram.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.expr("cast(array() as array<string>)"))


def prompt_text(text: Column) -> Column:
    """The part of a prompt before its first code fence."""
    return F.substring_index(text, "```", 1)


def gram_rows(df: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    return df.select(key, words(text).alias("words")).select(key, F.explode(ngrams(F.col("words"), n)).alias("ngram"))


def gram_summary(df: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """D-01: key, n_distinct, least: the number of a text's distinct n-grams and the least of them; texts without any have no row.

    Both are taken where the text is, so no n-gram becomes a row. The lists are
    exploded out of an array of one, else each use would make them anew.
    """
    lists = df.select(key, F.explode(F.array(words(text))).alias("words"))
    lists = lists.select(key, F.explode(F.array(ngrams(F.col("words"), n))).alias("ngrams"))
    each = lists.select(key, F.size("ngrams").cast("long").alias("n_distinct"), F.array_min("ngrams").alias("least")).filter("n_distinct > 0")
    return each.groupBy(key).agg(F.sum("n_distinct").alias("n_distinct"), F.min("least").alias("least"))


HASH = ["gram_a", "gram_b"]


def _hash(words: Column) -> list[Column]:
    """128 bits of a run of word hashes, as two differently seeded 64-bit hashes."""
    return [F.xxhash64(words).alias(HASH[0]), F.xxhash64(F.lit(1), words).alias(HASH[1])]


def _runs(df: DataFrame, keep: Sequence[Column | str], text: Column) -> DataFrame:
    """Words and their hashes as columns of their own, since a lambda would split and hash the text anew for every n-gram."""
    w = df.select(*keep, words(text).alias("words"))
    return w.select("*", F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))


def _starts(n: int) -> Column:
    """Places where a run of n words starts; shorter lists have none."""
    size = F.size("hashes")
    return F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))


def item_grams(items: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """Distinct n-grams of items with their hash."""
    at = _runs(items, [key], text).select(key, "words", "hashes", F.explode(_starts(n)).alias("i"))
    return at.select(key, F.array_join(F.slice("words", F.col("i"), n), " ").alias("ngram"), *_hash(F.slice("hashes", F.col("i"), n))).distinct()


def corpus_hits(docs: DataFrame, mine: DataFrame, n: int, keep: Sequence[Column] = ()) -> DataFrame:
    """Distinct hashes of items that the corpus holds, with the columns of `keep`.

    Of the corpus only 16 bytes per n-gram leave the scan. The item side is far
    smaller: where Spark measures that it fits it is broadcast and nothing of the
    corpus is exchanged but hits; else hashes meet in a shuffle.
    """
    theirs = _runs(docs, keep, F.col("text"))
    names = [c for c in theirs.columns if c not in ("words", "hashes")]
    theirs = theirs.select(*names, "hashes", F.explode(_starts(n)).alias("i")).select(*names, *_hash(F.slice("hashes", F.col("i"), n)))
    return theirs.join(mine.select(*HASH).distinct(), HASH, "left_semi").distinct()


def shared_grams(items: DataFrame, docs: DataFrame, n: int, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """D-02/J-09: (item, n-gram) rows whose n-gram is in the corpus; n-grams are compared by 128 bits of hash.

    Words are hashed once each and n-grams from the hashes of their words, so the
    corpus' n-grams are never built as strings.
    """
    mine = item_grams(items, item_key, prompt_text(F.col(text)), n)
    return mine.join(corpus_hits(docs, mine, n), HASH, "left_semi").select(item_key, "ngram")


def contaminated_items(items: DataFrame, docs: DataFrame, n: int, item_key: str = "item_id") -> DataFrame:
    hit = shared_grams(items, docs, n, item_key).groupBy(item_key).agg(F.count(F.lit(1)).alias("shared"))
    return items.select(item_key).join(hit, item_key, "left").select(item_key, F.coalesce("shared", F.lit(0)).alias("shared"))


def overlap_percentage(items: DataFrame, docs: DataFrame, n: int, item_key: str = "item_id") -> DataFrame:
    """D-02: percent of items that share any n-gram."""
    flags = contaminated_items(items, docs, n, item_key)
    return flags.agg((F.avg((F.col("shared") > 0).cast("double")) * 100).alias("overlap_percent"), F.count(F.lit(1)).alias("items"))


def shard_hits(items: DataFrame, docs: DataFrame, shard: str, n: int, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """D-03: distinct (shard, item) rows whose n-grams meet, all shards in one scan; a null shard is one of its own."""
    mine = item_grams(items, item_key, prompt_text(F.col(text)), n)
    hits = corpus_hits(docs, mine, n, [F.col(shard).alias("shard")])
    return hits.join(mine, HASH).select("shard", item_key).distinct()


def sharded_overlap(hits: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """D-03: distinct items over all shards' hit lists (shard, item) as a percentage."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    found = hits.select(item_key).distinct().agg(F.count(F.lit(1)).alias("found"))
    return found.crossJoin(total).withColumn("overlap_percent", F.col("found") / F.col("total") * 100)  # one row each


BLOCK = 8192  # vectors of either side that a task holds at once
BLOCKS = 16  # blocks of a side that smaller blocks may be cut into
PRODUCTS = 1 << 19  # inner products that a task holds at once


def _best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    """Of one block of queries and one of documents: the best document of each query."""
    if q.empty or d.empty:
        return pd.DataFrame({"query_id": q["query_id"][:0], "doc_id": d["doc_id"][:0], "score": np.zeros(0)})
    d = d.sort_values("doc_id")
    m = np.stack(d["document"].to_numpy()).astype(np.float64).T
    ids, at, top = d["doc_id"].to_numpy(), [], []
    step = max(1, PRODUCTS // len(d))
    for a in range(0, len(q), step):
        s = np.stack(q["query"].to_numpy()[a : a + step]).astype(np.float64) @ m
        i = s.argmax(axis=1)
        at.append(i)
        top.append(s[np.arange(len(s)), i])
    return pd.DataFrame({"query_id": q["query_id"], "doc_id": ids[np.concatenate(at)], "score": np.concatenate(top)})


def _dealt(queries: DataFrame, docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the blocks (qb, db) that meet: a row once for each block of the other side."""
    n = F.count(F.lit(1))
    parts = F.least(F.ceil(n / F.lit(block)), F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(BLOCKS)))
    blocks = lambda df, name: df.agg(F.greatest(parts, F.lit(1)).cast("int").alias(name))
    sizes = F.broadcast(blocks(queries, "nq").crossJoin(blocks(docs, "nd")))  # one row
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.crossJoin(sizes).select("query_id", F.col("embedding").alias("query"), own("query_id", "nq").alias("qb"), every("nd").alias("db"))
    # the other side's columns are new ones, since both may come from one table
    d = docs.crossJoin(sizes).select("doc_id", F.col("embedding").alias("document"), own("doc_id", "nd").alias("db"), every("nq").alias("qb"))
    return q, d


def nearest(queries: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """J-10/D-04: best document per query by inner product; equal scores take the smaller id.

    queries: query_id, embedding; docs: doc_id, embedding, both of any size. Both
    sides are dealt into blocks of about `block` vectors by hash of id, BLOCKS of
    them at most while BLOCK vectors fit, so that a small `block` does not copy a
    large table over and over; every query block meets every document block once,
    in a task of its own, in matrix products that leave one row per query. A
    grouped minimum joins the blocks. Nothing passes through the driver.
    """
    q, d = _dealt(queries, docs, block)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    met = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(_best, f"query_id {kind(queries, 'query_id')}, doc_id {kind(docs, 'doc_id')}, score double")
    b = F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b")
    return met.groupBy("query_id").agg(b).select("query_id", F.col("b.doc_id").alias("doc_id"), (-F.col("b.s")).alias("score"))


def top_percent(matches: DataFrame, percent: float) -> DataFrame:
    """D-05: scores above the (100 - percent) percentile."""
    cut = group_percentiles(matches, [], "score", {"cut": (100.0 - percent) / 100.0})
    return matches.crossJoin(F.broadcast(cut)).filter("score > cut").drop("cut")  # one row


def best_query(matches: DataFrame, threshold: float) -> DataFrame:
    """D-06: best query per document among scores above the threshold."""
    b = F.min(F.struct((-F.col("score")).alias("s"), "query_id")).alias("b")
    return matches.filter(F.col("score") > threshold).groupBy("doc_id").agg(b).select(
        "doc_id", F.col("b.query_id").alias("query_id"), (-F.col("b.s")).alias("score")
    )


def hard_subset(retrieved: DataFrame, tasks: DataFrame, min_libs: int = 2, min_chars: int = 426, max_rate: float = 50.0) -> DataFrame:
    """D-07: ids that pass all four filters. tasks: task_id, libs array, solution, solve_rate."""
    keep = (F.size("libs") > min_libs) & (F.length("solution") > min_chars) & (F.col("solve_rate") < max_rate)
    return tasks.filter(keep).select("task_id").intersect(retrieved.select("task_id"))


def subset_ranking(perf: DataFrame, subset: DataFrame, modes: Sequence[str]) -> DataFrame:
    """D-08: models by mean pass rate on the subset, the average of their modes first."""
    rows = perf.join(subset.select("task_id").distinct(), "task_id", "left_semi")
    rate = lambda m: F.avg(F.when(F.col("mode") == m, F.col("is_correct").cast("double")))
    g = rows.groupBy("model").agg(*[rate(m).alias(m) for m in modes])
    both = sum((F.col(m) for m in modes[1:]), F.col(modes[0])) / len(modes)
    return g.withColumn("average", both).orderBy(F.col("average").desc_nulls_last(), "model")
