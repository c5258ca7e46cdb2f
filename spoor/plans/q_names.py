"""Queries through the extension points: by name and from SQL (U-01 .. U-07), and checked reuse of results (S-13)."""

from pyspark.sql import functions as F

from .. import registry as re
from ..operators import phases as ph
from ..sources import adapters as ad
from ..sources import layout as la
from . import fixtures as fx
from . import q_entropy, q_metrics, q_phases, q_text, q_voting  # noqa: F401 - their oracles are named here
from .inputs import centroids
from .q_entropy import step_table, step_tokens
from .q_sources import _dir, records
from .q_text import gen
from .registry import _SQL, query


def _of(name, label):
    return f"SELECT '{label}' AS name, * FROM ({_SQL[name][0]})"


def _each(rows):
    """One table of several, each with its name."""
    out = None
    for name, df in rows.items():
        df = df.withColumn("name", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


_SCORES = {"entropy_mean": "C01_score_entropy_mean", "entropy_min": "C02_score_entropy_min", "early_high_entropy": "C03_score_early_entropy"}


@query("U01_scores_by_name", " UNION ALL ".join(_of(q, n) for n, q in _SCORES.items()), "score")
def u01(spark, sf):
    return _each({n: re.score(fx.tokens(spark, sf), n) for n in re.SCORES})


@query(
    "U02_selectors_by_name",
    f"""SELECT 'majority_voting' AS name, problem_id, selected_idx FROM ({_SQL["V07_majority"][0]}) UNION ALL
    SELECT 'random' AS name, problem_id, selected_idx FROM ({_SQL["V10_random_pick"][0]})""",
)
def u02(spark, sf):
    picked = {n: fx.evals(spark, sf).transform(re.select, n) for n in ("majority_voting", "random")}
    return _each({n: df.select("problem_id", "selected_idx") for n, df in picked.items()})


@query(
    "U03_adapter_layouts",
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'set_a' WHEN 1 THEN 'set_b' ELSE 'set_c' END AS run_id, concat('q', CAST(doc_id % 100 AS STRING)) AS problem_id,
    CAST(floor(doc_id / 100.0) AS INT) AS traj_idx, length(text) AS n, CAST(doc_id % 2 AS DOUBLE) AS reward FROM documents""",
    "reward",
)
def u03(spark, sf):
    """Three folders in three layouts (lines, Parquet, array) read through one name; a fourth is left out by its name."""
    root = _dir(spark, "adapters")
    r = records(spark, sf)
    third = F.substring_index("id", "_traj_", -1).cast("int") * 100 + F.regexp_extract("original_id", r"\d+", 0).cast("int")
    part = lambda k: r.filter(third % 3 == k)
    part(0).write.json(f"{root}/set_a")
    part(1).write.parquet(f"{root}/set_b")
    rows = part(2).select(F.to_json(F.struct("*")).alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    ends = rows.groupBy("p").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    lead, tail = F.when(F.col("i") == F.col("a"), "[").otherwise(""), F.when(F.col("i") == F.col("b"), "]").otherwise(",")
    rows.join(F.broadcast(ends), "p").select(F.concat(lead, "value", tail)).write.text(f"{root}/set_c")  # a row per input partition
    part(0).write.json(f"{root}/old_a")
    got = ad.read(spark, "trajectories", f"{root}/*", runs="^set_", span=1 << 18)
    return got.select("run_id", "problem_id", "traj_idx", F.length("generated_text").alias("n"), "reward")


_EXTRACTS = {"headed": _SQL["X05_header_answer"][0], "math": "SELECT doc_id, answer FROM cascade"}


@query("U04_extractors_by_name", " UNION ALL ".join(f"SELECT '{n}' AS name, doc_id, answer FROM ({q})" for n, q in _EXTRACTS.items()))
def u04(spark, sf):
    return _each({n: gen(spark, sf).select("doc_id", re.extract(F.col("body"), n).alias("answer")) for n in _EXTRACTS})


@query(
    "U05_post_processors",
    """SELECT 'self-correction' AS name, traj_id, CASE WHEN extracted_answer IS NULL THEN 'error' WHEN is_correct THEN 'correct' WHEN traj_idx >= 8 THEN 'max_rounds' ELSE 'processing' END AS outcome FROM evals
    UNION ALL SELECT 'answer_key', traj_id, key FROM keyed UNION ALL SELECT 'none', traj_id, extracted_answer FROM evals""",
)
def u05(spark, sf):
    e = fx.evals(spark, sf).withColumn("error", F.col("extracted_answer").isNull()).withColumn("round", F.col("traj_idx"))
    routed = re.process(e, "self-correction", max_rounds=8).select("traj_id", F.col("status").alias("outcome"))
    keys = re.process(e, "answer_key").select("traj_id", F.col("key").alias("outcome"))
    return _each({"self-correction": routed, "answer_key": keys, "none": re.process(e, "none").select("traj_id", F.col("extracted_answer").alias("outcome"))})


@query(
    "U06_sql_estimators",
    """SELECT problem_id, n, c, CASE WHEN n - c < 2 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - (n - c) * (n - c - 1.0) / (n * (n - 1.0)) END AS pass_at_2,
    CASE WHEN n < 2 THEN NULL WHEN c < 2 THEN 0.0 ELSE c * (c - 1.0) / (n * (n - 1.0)) END AS pass_hat_2
    FROM (SELECT problem_id, count(*) AS n, count(*) FILTER (is_correct) AS c FROM evals GROUP BY problem_id)""",
    "pass_at_2 pass_hat_2",
)
def u06(spark, sf):
    re.register_sql(spark)
    return spark.sql(
        """SELECT problem_id, n, c, pass_at_k(n, c, 2) AS pass_at_2, pass_hat_k(n, c, 2) AS pass_hat_2
        FROM (SELECT problem_id, count(*) AS n, count_if(is_correct) AS c FROM {evals} GROUP BY problem_id)""",
        evals=fx.evals(spark, sf),
    )


@query("U07_phase_rows", "SELECT traj_id, CAST(start AS BIGINT) AS start, duration FROM found_phases")
def u07(spark, sf):
    re.register_sql(spark)
    t = fx.tokens(spark, sf).select("traj_id", "position", "entropy")
    marked = t.join(ph.thresholds(t), "traj_id")
    return spark.sql("SELECT * FROM phase_rows(3, TABLE(SELECT * FROM {marked}) PARTITION BY traj_id ORDER BY (position))", marked=marked)


@query("U07_step_rows", "SELECT traj_id, step, CAST(start_position AS BIGINT) AS start_position, CAST(end_position AS BIGINT) AS end_position, text FROM step_rows")
def u07b(spark, sf):
    re.register_sql(spark)
    marks = step_table(spark, sf).filter("trigger_position IS NOT NULL").select("traj_id", F.col("end_position").alias("position"), F.lit(True).alias("is_boundary"))
    t = step_tokens(spark, sf).select("traj_id", "position", "token").join(marks, ["traj_id", "position"], "left")
    got = spark.sql("SELECT * FROM step_rows(TABLE(SELECT * FROM {t}) PARTITION BY traj_id ORDER BY (position))", t=t)
    return got.select("traj_id", "step", "start_position", "end_position", "text")


@query("U07_word_ngrams", "SELECT item_id, ngram FROM item_grams")
def u07c(spark, sf):
    re.register_sql(spark)
    b = fx.table(spark, sf, "benchmark").select("item_id", F.substring_index("text", "```", 1).alias("prompt"))
    return spark.sql("SELECT item_id, ngram FROM {b}, LATERAL word_ngrams(prompt, 10)", b=b)


_KEPT = "traj_id string, centroid double, method string, top double, bottom double, cons int"


@query(
    "S13_checked_reuse",
    """SELECT traj_id, centroid, 'hep' AS method, 5.0 AS top, 'cache' AS origin FROM trajectories WHERE centroid IS NOT NULL
    UNION ALL SELECT traj_id, 0.25, 'hep', 1.5, 'analysis' FROM trajectories WHERE centroid IS NOT NULL
    UNION ALL SELECT traj_id, 0.5, 'raw_entropy', 1.5, 'computed' FROM trajectories WHERE centroid IS NOT NULL
    UNION ALL SELECT traj_id, 0.75, 'hep', 7.0, 'computed' FROM trajectories WHERE centroid IS NOT NULL""",
    "centroid top",
)
def s13b(spark, sf):
    """A set in the cache, one that only the analysis has, the same of a method that may not use it, and one found incomplete."""
    path = _dir(spark, "kept")
    c = centroids(spark, sf).filter("centroid IS NOT NULL").select("traj_id", "centroid", F.lit("hep").alias("method"), "top", "bottom", "cons")
    la.write_checked(c.unionByName(c.withColumn("top", F.lit(7.0))), path)
    la.write_results(c.withColumn("top", F.lit(7.0)).filter("traj_id < 'p5'"), path)  # a write that did not come to its manifest
    analysed = c.withColumn("top", F.lit(1.5)).withColumn("centroid", F.lit(0.25)).drop("method")

    def wanted(method, top, value):
        params = {"method": method, "top": top, "bottom": 50.0, "cons": 3}
        return la.reuse(spark, path, _KEPT, params, lambda: c.withColumn("centroid", F.lit(value)), analysed)

    sets = [wanted("hep", 5.0, 0.1), wanted("hep", 1.5, 0.2), wanted("raw_entropy", 1.5, 0.5), wanted("hep", 7.0, 0.75)]
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.unionByName(s)
    return rows.select("traj_id", "centroid", "method", "top", "origin")
