"""Queries for scans, layout and normalisation (S). Files are written from the given tables and read back."""

import uuid

from pyspark.sql import functions as F

from ..functions import keys as k
from ..session import work_dir
from ..sources import arrays as ar
from ..sources import layout as la
from ..sources import normalise as no
from ..sources import readers as rd
from . import fixtures as fx
from .inputs import centroids, traces
from .registry import query, shared

SCHEMA = "id string, original_id string, generated_text string, reward double, termination_reason string"


def _dir(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark, sf):
    """Trajectory-shaped text records, one per document."""
    d, n = fx.table(spark, sf, "documents"), F.col("doc_id")
    return d.select(
        F.concat(F.lit("q"), (n % 100).cast("string"), F.lit("_traj_"), F.floor(n / 100).cast("string")).alias("id"),
        F.concat(F.lit("q"), (n % 100).cast("string")).alias("original_id"),
        F.col("text").alias("generated_text"),
        (n % 2).cast("double").alias("reward"),
        F.when(n % 19 == 0, "llm_error").otherwise("agent_stop").alias("termination_reason"),
    )


_ID = "concat('q', CAST(doc_id % 100 AS STRING), '_traj_', CAST(CAST(floor(doc_id / 100.0) AS INT) AS STRING))"
_REC = f"SELECT {_ID} AS id, length(text) AS n, CAST(doc_id % 2 AS DOUBLE) AS reward FROM documents"


def _lines(spark, sf):
    def build():
        path = _dir(spark, "lines")
        good = records(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
        bad = fx.table(spark, sf, "region").select(F.concat(F.lit('{"id": "broken'), F.col("r_regionkey").cast("string")).alias("value"))
        good.unionByName(bad).write.text(path)
        return spark.createDataFrame([(path,)], "path string")

    return shared("lines", spark, sf, build).first()["path"]


def _arrays(spark, sf):
    """Files that each hold one JSON array: lines of a part file between brackets, commas after all but the last."""
    path = _dir(spark, "array")
    rows = records(spark, sf).select(F.to_json(F.struct("*")).alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    ends = rows.groupBy("p").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    lead, tail = F.when(F.col("i") == F.col("first"), "[").otherwise(""), F.when(F.col("i") == F.col("last"), "]").otherwise(",")
    rows.join(F.broadcast(ends), "p").select(F.concat(lead, "value", tail).alias("value")).write.text(path)
    return path


@query("S01_array_scan", _REC, "reward")
def s01(spark, sf):
    return rd.read_array(spark, _arrays(spark, sf), SCHEMA).select("id", F.length("generated_text").alias("n"), "reward")


@query("S02_lines_scan", _REC, "reward")
def s02(spark, sf):
    return rd.read_lines(spark, _lines(spark, sf), SCHEMA).filter("id IS NOT NULL").select("id", F.length("generated_text").alias("n"), "reward")


@query("S03_slim_scan", f"SELECT {_ID} AS id, CAST(doc_id % 2 AS DOUBLE) AS reward FROM documents", "reward")
def s03(spark, sf):
    return rd.read_slim(spark, _lines(spark, sf)).filter("id IS NOT NULL").select("id", "reward")


@query("S04_split_scan", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def s04(spark, sf):
    rows = rd.read_lines(spark, _lines(spark, sf), SCHEMA).filter("id IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("generated_text")).alias("chars"))


@query("S04_large_array", _REC, "reward")
def s04b(spark, sf):
    """The arrays read in byte ranges of 256 KB, so that each is many tasks' work."""
    return ar.read_large_array(spark, _arrays(spark, sf), SCHEMA, 1 << 18).select("id", F.length("generated_text").alias("n"), "reward")


@query("S05_converted", _REC, "reward")
def s05(spark, sf):
    path = _dir(spark, "parquet")
    rd.to_parquet(rd.read_lines(spark, _lines(spark, sf), SCHEMA).filter("id IS NOT NULL"), path)
    return spark.read.schema(SCHEMA).parquet(path).select("id", F.length("generated_text").alias("n"), "reward")


@query("S06_keep_last", "SELECT CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id END AS id, max(event_id) AS event_id FROM events WHERE user_id % 13 <> 0 GROUP BY user_id")
def s06(spark, sf):
    e = fx.table(spark, sf, "events").select(F.when(F.col("user_id") % 13 == 0, None).otherwise(F.col("user_id")).alias("id"), "event_id", F.col("event_id").alias("arrival"))
    return rd.keep_last(e).select("id", "event_id")


@query("S07_discovered_runs", "SELECT concat('release_v', CAST(doc_id % 3 + 4 AS STRING)) AS release, count(*) AS n FROM documents GROUP BY release")
def s07(spark, sf):
    root = _dir(spark, "runs")
    d = fx.table(spark, sf, "documents").select((F.col("doc_id") % 3 + 4).alias("v"), F.col("doc_id").cast("string").alias("id"))
    d.withColumn("run", F.concat(F.lit("model_release_v"), F.col("v").cast("string"))).drop("v").write.partitionBy("run").json(root)
    got = rd.read_runs(spark, f"{root}/run=model_release_v*", "id string")
    return got.groupBy("release").agg(F.count(F.lit(1)).alias("n"))


@query("S08_release", "SELECT page_id, coalesce(regexp_extract(concat(url, '/release_v', CAST(page_id % 7 AS STRING), '/x'), 'release_v\\d+', 0), '') AS release FROM pages".replace("\\\\", "\\"))
def s08(spark, sf):
    p = F.concat(F.col("url"), F.lit("/release_v"), (F.col("page_id") % 7).cast("string"), F.lit("/x"))
    return fx.table(spark, sf, "pages").select("page_id", k.release(p).alias("release"))


@query(
    "S09_model_from_path",
    "SELECT page_id, CASE WHEN page_id % 6 = 5 THEN concat('Model-', CAST(page_id % 9 + 1 AS STRING), 'B-chat') WHEN page_id % 3 = 2 THEN NULL ELSE concat('org', CAST(page_id % 5 AS STRING), '/Model-', CAST(page_id % 9 + 1 AS STRING), 'B-chat') END AS model FROM pages",
)
def s09(spark, sf):
    n = F.col("page_id")
    org, model = F.concat(F.lit("org"), (n % 5).cast("string")), F.concat(F.lit("Model-"), (n % 9 + 1).cast("string"), F.lit("B-chat"))
    path = (
        F.when(n % 3 == 0, F.concat_ws("_", F.lit("out/set_x"), org, model, F.lit("n64")))
        .when(n % 3 == 1, F.concat(F.lit("out/"), F.concat_ws("_", org, model), F.lit("/airline")))
        .when(n % 6 == 5, F.concat(F.lit("out/"), model, F.lit("_x_n64")))
        .otherwise("out/unknown_run")
    )
    return fx.table(spark, sf, "pages").select("page_id", k.model_from_path(path).alias("model"))


@query("S10_json_lists", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def s10(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", 0.5]")).alias("confidence_list"))
    return e.select("event_id", F.get(rd.decoded_list("confidence_list"), F.lit(0)).cast("int").alias("k"))


@query(
    "S11_nested_outputs",
    "SELECT problem_id, string_agg(coalesce(extracted_answer, '-'), '|' ORDER BY traj_idx) AS outputs FROM traces GROUP BY problem_id",
)
def s11(spark, sf):
    t = traces(spark, sf).select("problem_id", "traj_idx", F.coalesce("extracted_answer", F.lit("-")).alias("text"))
    path = _dir(spark, "nested")
    la.nested_outputs(t, "problem_id", "traj_idx", "text").write.parquet(path)
    return spark.read.schema("problem_id long, output array<string>").parquet(path).select("problem_id", F.array_join("output", "|").alias("outputs"))


@query("S12_parameter_table", "SELECT traj_id, 5.0 AS top, centroid FROM trajectories", "top centroid")
def s12(spark, sf):
    path = _dir(spark, "results")
    c = centroids(spark, sf).select("traj_id", "top", "bottom", "cons", "centroid").withColumn("method", F.lit("hep"))
    la.write_results(c.withColumn("top", F.lit(1.5)), path)
    la.write_results(c.withColumn("centroid", F.lit(0.0)), path)
    la.write_results(c, path)  # replaces its own parameter set and leaves top = 1.5 alone
    schema = "traj_id string, centroid double, method string, top double, bottom double, cons int"
    return spark.read.schema(schema).parquet(path).filter("top = 5.0").select("traj_id", "top", "centroid")


@query("S13_fallback", "SELECT traj_id, CASE WHEN traj_idx < 4 THEN 'cache' ELSE 'analysis' END AS origin FROM evals")
def s13(spark, sf):
    e = fx.evals(spark, sf)
    first = e.filter("traj_idx < 4").select("traj_id", F.lit("cache").alias("origin"))
    return la.with_fallback(first, e.select("traj_id", F.lit("analysis").alias("origin")), ["traj_id"])


@query("S14_csv_summary", "SELECT traj_id, count(*) AS n FROM tokens GROUP BY traj_id")
def s14(spark, sf):
    path = _dir(spark, "csv")
    la.write_csv(fx.tokens(spark, sf).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("traj_id string, n long").option("header", True).csv(path)


@query(
    "S15_score_files",
    "SELECT concat('model', CAST(doc_id % 3 AS STRING)) AS model, lang AS question_type, source AS mode, count(*) AS n FROM documents GROUP BY ALL",
)
def s15(spark, sf):
    d = fx.table(spark, sf, "documents")
    path = F.concat(F.lit("results/model"), (F.col("doc_id") % 3).cast("string"), F.lit("_"), "lang", F.lit("_x_"), "source", F.lit(".jsonl"))
    return d.select(*rd.score_file_columns(path)).groupBy("model", "question_type", "mode").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S16_normalised_problems",
    "SELECT CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS STRING) ELSE format('sample_{:05d}', item_id) END AS id, text AS problem, concat('a', CAST(item_id AS STRING), ', b') AS solution FROM benchmark",
)
def s16(spark, sf):
    b, n = fx.table(spark, sf, "benchmark"), F.col("item_id")
    raw = b.select(
        F.when(n % 2 == 0, n).alias("qid"), F.col("text").alias("question"), F.array(F.concat(F.lit("a"), n.cast("string")), F.lit("b")).alias("final"), n.alias("place")
    )
    return no.problems(raw, {"id": "qid", "problem": "question", "solution": "final"}, "place")


@query(
    "S17_coalesced_answers",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS STRING) ELSE event_type END AS answer, CASE WHEN event_id % 3 = 0 THEN 'file' ELSE event_type END AS task FROM events",
)
def s17(spark, sf):
    e = fx.table(spark, sf, "events")
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"answer": "", "extra": {"game": '), "props", F.lit("}}"))).otherwise(
        F.concat(F.lit('{"answer": "'), "event_type", F.lit('"}'))
    )
    e = e.withColumn("j", j)
    src = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("set/"), "event_type"))
    return e.select("event_id", no.first_path("j", ["$.answer", "$.extra.game.k"]).alias("answer"), no.task_of(src, F.lit("file/a.json")).alias("task"))


@query("S18_rules", "SELECT c_custkey, n_name AS rule FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def s18(spark, sf):
    rules = fx.table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule"))
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("rule_id"))
    return no.with_rules(c, rules).select("c_custkey", "rule")


@query("S19_list_columns", "SELECT p_partkey, CAST(2 AS INT) AS n, p_brand AS first FROM part")
def s19(spark, sf):
    p = fx.table(spark, sf, "part")
    a = no.list_column(F.concat(F.lit("['"), "p_brand", F.lit("', 'x']")))
    return p.select("p_partkey", F.size(a).alias("n"), F.get(a, F.lit(0)).alias("first"))


@query("S20_contest_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_orderpriority = '2-HIGH'")
def s20(spark, sf):
    o = fx.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "platform")
    return no.window(o, "o_orderdate", "1995-01-01", "1996-12-31", "2-HIGH").select("o_orderkey")
