"""Queries for contamination and retrieval (D-01 .. D-08, J-09, J-10)."""

from pyspark.sql import functions as F

from ..operators import corpus as co
from ..operators import nearest as ne
from . import fixtures as fx
from .q_metrics import scored_runs
from .registry import CTES, query, shared

N = 10
_WORDS = r"list_filter(string_split_regex({t}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


def _grams(key, text, table, n=N):
    after = ", ".join(f"lead(w, {j}) OVER d" for j in range(1, n))
    return f"""SELECT DISTINCT {key}, ngram FROM (SELECT {key}, concat_ws(' ', w, {after}) AS ngram, lead(w, {n - 1}) OVER d AS last_word
      FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, {_WORDS.format(t=text)} AS ws FROM {table}))
      WINDOW d AS (PARTITION BY {key} ORDER BY i)) WHERE last_word IS NOT NULL"""


CTES["doc_grams"] = _grams("doc_id", "text", "documents")
CTES["item_grams"] = _grams("item_id", "split_part(text, '```', 1)", "benchmark")
CTES["item_hits"] = "SELECT b.item_id, count(g.ngram) AS shared FROM benchmark b LEFT JOIN (SELECT * FROM item_grams WHERE ngram IN (SELECT ngram FROM doc_grams)) g ON g.item_id = b.item_id GROUP BY b.item_id"


def docs(spark, sf):
    return fx.table(spark, sf, "documents")


def items(spark, sf):
    return fx.table(spark, sf, "benchmark")


@query("D01_ngrams", "SELECT doc_id, count(*) AS n_distinct, min(ngram) AS least FROM doc_grams GROUP BY doc_id")
def d01(spark, sf):
    return co.gram_summary(docs(spark, sf), "doc_id", F.col("text"), N)


@query("D02_overlap", "SELECT avg(CASE WHEN shared > 0 THEN 1.0 ELSE 0.0 END) * 100 AS overlap_percent, count(*) AS items FROM item_hits", "overlap_percent")
def d02(spark, sf):
    return co.overlap_percentage(items(spark, sf), docs(spark, sf), N)


@query("D02_contaminated_items", "SELECT item_id, shared FROM item_hits")
def d02b(spark, sf):
    return co.contaminated_items(items(spark, sf), docs(spark, sf), N)


@query("J09_shared_grams", "SELECT item_id, ngram FROM item_grams WHERE ngram IN (SELECT ngram FROM doc_grams)")
def j09(spark, sf):
    return co.shared_grams(items(spark, sf), docs(spark, sf), N)


@query(
    "D03_sharded_overlap",
    "SELECT found, total, found * 100.0 / total AS overlap_percent FROM (SELECT count(*) FILTER (shared > 0) AS found, count(*) AS total FROM item_hits)",
    "overlap_percent",
)
def d03(spark, sf):
    """Hit lists per shard (here the language, null included) from one scan, then their union."""
    return co.sharded_overlap(co.shard_hits(items(spark, sf), docs(spark, sf), "lang", N), items(spark, sf))


# Every tenth vector is a document, the others are queries.
CTES["match_rows"] = """SELECT query_id, arg_max(doc_id, (round(score, 9), -doc_id)) AS doc_id, max(score) AS score FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 10 <> 0 AND d.vec_id % 10 = 0) GROUP BY query_id"""


def matches(spark, sf):
    def build():
        e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
        q = e.filter("vec_id % 10 <> 0").withColumnRenamed("vec_id", "query_id")
        return co.nearest(q, e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "doc_id"))

    return shared("matches", spark, sf, build)


@query("D04_nearest", "SELECT query_id, doc_id, score FROM match_rows", "score")
def d04(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 10 <> 0").withColumnRenamed("vec_id", "query_id")
    return co.nearest(q, e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "doc_id"))


@query("J10_nearest_blocked", "SELECT query_id, doc_id, score FROM match_rows", "score")
def j10(spark, sf):
    """The same join with both sides in several blocks."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 10 <> 0").withColumnRenamed("vec_id", "query_id")
    d = e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "doc_id")
    return co.nearest(q, d, block=20)


@query("D05_top_percent", "SELECT query_id, doc_id, score FROM match_rows WHERE round(score, 9) > (SELECT round(quantile_cont(score, 0.9), 9) FROM match_rows)", "score")
def d05(spark, sf):
    return co.top_percent(matches(spark, sf).withColumn("score", F.round("score", 9)), 10.0)


@query("D06_best_query", "SELECT doc_id, arg_max(query_id, (round(score, 9), -query_id)) AS query_id, max(score) AS score FROM match_rows WHERE score > 0.2 GROUP BY doc_id", "score")
def d06(spark, sf):
    return co.best_query(matches(spark, sf).withColumn("score", F.round("score", 9)), 0.2)


# Searches over all rows: every vector with an id that 20 divides asks, all others can be found.
CTES["search_rows"] = """SELECT query_id, arg_max(doc_id, (round(score, 9), -doc_id)) AS doc_id, max(score) AS score FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id) GROUP BY query_id"""


def _searched(spark, sf, **params):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ne.indexed_nearest(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id"), **params)


def searches(spark, sf):
    return shared("searches", spark, sf, lambda: _searched(spark, sf)).withColumn("score", F.round("score", 9))


@query("D04_search_all", "SELECT query_id, doc_id, score FROM search_rows", "score")
def d04b(spark, sf):
    return _searched(spark, sf)


@query("J10_search_cells", "SELECT query_id, doc_id, score FROM search_rows", "score")
def j10b(spark, sf):
    """The same search over more and smaller cells."""
    return _searched(spark, sf, centres=16, rings=3, block=64)


@query("D05_search_percent", "SELECT query_id, doc_id, score FROM search_rows WHERE round(score, 9) > (SELECT round(quantile_cont(score, 0.9), 9) FROM search_rows)", "score")
def d05b(spark, sf):
    return co.top_percent(searches(spark, sf), 10.0)


@query("D06_search_best", "SELECT doc_id, arg_max(query_id, (round(score, 9), -query_id)) AS query_id, max(score) AS score FROM search_rows WHERE score > 0.2 GROUP BY doc_id", "score")
def d06b(spark, sf):
    return co.best_query(searches(spark, sf), 0.2)


CTES["code_tasks"] = "SELECT d.doc_id AS task_id, d.n_chars, CAST(floor(d.doc_id / 10.0) AS BIGINT) % 5 AS n_libs, d.doc_id % 100 AS solve_rate, d.text FROM documents d"


def code_tasks(spark, sf):
    libs = F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= F.floor(F.col("doc_id") / 10) % 5), lambda i: i.cast("string"))
    return docs(spark, sf).select(F.col("doc_id").alias("task_id"), libs.alias("libs"), F.col("text").alias("solution"), (F.col("doc_id") % 100).alias("solve_rate"))


@query(
    "D07_hard_subset",
    "SELECT task_id FROM code_tasks WHERE n_libs > 2 AND length(text) > 426 AND solve_rate < 50 AND task_id IN (SELECT doc_id FROM match_rows WHERE score > 0.2)",
)
def d07(spark, sf):
    got = matches(spark, sf).filter("score > 0.2").select(F.col("doc_id").alias("task_id"))
    return co.hard_subset(got, code_tasks(spark, sf))


@query(
    "D07_search_subset",
    "SELECT task_id FROM code_tasks WHERE n_libs > 2 AND length(text) > 426 AND solve_rate < 50 AND task_id IN (SELECT doc_id FROM search_rows WHERE score > 0.2)",
)
def d07b(spark, sf):
    got = searches(spark, sf).filter("score > 0.2").select(F.col("doc_id").alias("task_id"))
    return co.hard_subset(got, code_tasks(spark, sf))


_R = "avg(CASE WHEN coalesce(reward, 0) > 0 THEN 1.0 ELSE 0.0 END) FILTER"


@query(
    "D08_subset_ranking",
    f"SELECT llm AS model, {_R} (mode < '3') AS first, {_R} (mode >= '3') AS second, ({_R} (mode < '3') + {_R} (mode >= '3')) / 2 AS average FROM runs WHERE task_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) GROUP BY llm",
    "first second average",
)
def d08(spark, sf):
    subset = fx.table(spark, sf, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("task_id"))
    perf = scored_runs(spark, sf).withColumn("mode", F.when(F.col("mode") < "3", "first").otherwise("second"))
    return co.subset_ranking(perf, subset, ["first", "second"])
