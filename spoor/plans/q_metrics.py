"""Queries for keys, joins and metrics (P, J, M)."""

from pyspark.sql import functions as F

from ..functions import keys as k
from ..operators import entropy as en
from ..operators import joins as jo
from ..operators import metrics as me
from ..operators.agent import long_pass
from . import fixtures as fx
from .inputs import centroids, traces
from .q_confidence import online
from .q_voting import seven
from .registry import CTES, query

CTES["named_ids"] = """SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'logic_' WHEN 1 THEN 'games_' ELSE '' END, CASE WHEN doc_id % 4 = 2 THEN CAST(doc_id AS STRING) ELSE concat(lang, '_', source, '_', CAST(doc_id AS STRING)) END,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '_traj_b' ELSE concat('_traj_', CAST(doc_id % 64 AS STRING)) END) AS id,
  CASE WHEN doc_id % 3 = 0 THEN concat('orig', CAST(doc_id AS STRING)) WHEN doc_id % 4 = 2 THEN CAST(doc_id AS STRING) END AS original_id, text,
  concat('[', replace(lang, '-', '_'), '_issue]', source, '|', CAST(doc_id AS STRING), '[PERSONA:', CASE WHEN doc_id % 2 = 0 THEN 'Easy' ELSE 'Hard' END, ']') AS task_id,
  concat('agents-', source) AS origin FROM documents"""


def named(spark, sf):
    d, n = fx.table(spark, sf, "documents"), F.col("doc_id")
    s = n.cast("string")
    head = F.when(n % 4 == 0, "logic_").when(n % 4 == 1, "games_").otherwise("")
    body = F.when(n % 4 == 2, s).otherwise(F.concat("lang", F.lit("_"), "source", F.lit("_"), s))
    tail = F.when(n % 5 == 0, "").when(n % 7 == 0, "_traj_b").otherwise(F.concat(F.lit("_traj_"), (n % 64).cast("string")))
    return d.select(
        "doc_id",
        F.concat(head, body, tail).alias("id"),
        F.when(n % 3 == 0, F.concat(F.lit("orig"), s)).when(n % 4 == 2, s).alias("original_id"),
        "text",
        F.concat(F.lit("["), F.translate("lang", "-", "_"), F.lit("_issue]"), "source", F.lit("|"), s, F.lit("[PERSONA:"), F.when(n % 2 == 0, "Easy").otherwise("Hard"), F.lit("]")).alias("task_id"),
        F.concat(F.lit("agents-"), "source").alias("origin"),
    )


@query("P01_problem_key", "SELECT doc_id, coalesce(original_id, split_part(id, '_traj_', 1)) AS problem_id FROM named_ids")
def p01(spark, sf):
    return named(spark, sf).select("doc_id", k.problem_id(F.col("id"), F.col("original_id")).alias("problem_id"))


@query(
    "P02_trajectory_index",
    "SELECT doc_id, CASE WHEN contains(id, '_traj_') THEN TRY_CAST(regexp_extract(id, '_traj_([^_]*)$', 1) AS INT) ELSE 0 END AS traj_idx FROM named_ids WHERE NOT (contains(id, '_traj_') AND TRY_CAST(regexp_extract(id, '_traj_([^_]*)$', 1) AS INT) IS NULL)",
)
def p02(spark, sf):
    d = named(spark, sf).select("doc_id", k.trajectory_index(F.col("id")).alias("traj_idx"))
    return d.filter("traj_idx IS NOT NULL")


@query(
    "P03_task_type",
    """SELECT doc_id, CASE WHEN starts_with(id, 'logic_') THEN 'logic' WHEN starts_with(id, 'games_') THEN 'games'
    WHEN regexp_matches(coalesce(original_id, ''), '^\\d+$') AND regexp_matches(split_part(id, '_traj_', 1), '^\\d+$') AND contains(id, '_traj_') AND contains(text, 'the') THEN 'headed' ELSE 'math' END AS task_type FROM named_ids""".replace("\\\\", "\\"),
)
def p03(spark, sf):
    t = k.task_type(F.col("id"), [("logic_", "logic"), ("games_", "games")], F.col("original_id"), F.col("text"), "headed", ["the"])
    return named(spark, sf).select("doc_id", t.alias("task_type"))


@query(
    "P04_task_between",
    "SELECT doc_id, CASE WHEN NOT starts_with(id, 'logic_') THEN 'unknown' ELSE regexp_extract(regexp_replace(id, '_traj_.*$', ''), '^logic_(.+)_[^_]*$', 1) END AS task FROM named_ids",
)
def p04(spark, sf):
    return named(spark, sf).select("doc_id", k.task_between(F.col("id"), "logic_").alias("task"))


@query("P05_category", "SELECT doc_id, CASE WHEN contains(id, '_') THEN split_part(id, '_', 2) ELSE 'unknown' END AS category FROM named_ids")
def p05(spark, sf):
    return named(spark, sf).select("doc_id", k.category(F.col("id")).alias("category"))


@query(
    "P06_intent_persona",
    r"SELECT doc_id, regexp_extract(task_id, '^\[([a-zA-Z_]+)\]', 1) AS intent, regexp_extract(task_id, '\[PERSONA:([a-zA-Z_]+)\]', 1) AS persona, CAST(len(string_split(task_id, '|')) AS INT) AS n_issues FROM named_ids",
)
def p06(spark, sf):
    t = F.col("task_id")
    return named(spark, sf).select("doc_id", k.intent(t).alias("intent"), k.persona(t).alias("persona"), k.n_issues(t).alias("n_issues"))


@query("P07_without_errors", "SELECT run_id, reward FROM runs WHERE termination_reason <> 'llm_error'", "reward")
def p07(spark, sf):
    return fx.runs(spark, sf).filter("termination_reason <> 'llm_error'").select("run_id", "reward")


@query("P08_success", "SELECT run_id, coalesce(reward, 0) > 0 AS lenient, coalesce(abs(reward - 1) <= 1e-6, false) AS strict FROM runs")
def p08(spark, sf):
    r = F.col("reward")
    return fx.runs(spark, sf).select("run_id", k.succeeded(r).alias("lenient"), k.succeeded_strictly(r).alias("strict"))


@query("P09_domain", "SELECT doc_id, regexp_replace(origin, '^agents-', '') AS domain FROM named_ids")
def p09(spark, sf):
    return named(spark, sf).select("doc_id", k.domain(F.col("origin"), "agents-").alias("domain"))


@query("P10_first_trajectory", "SELECT traj_id, problem_id FROM evals WHERE traj_idx = 0")
def p10(spark, sf):
    return fx.evals(spark, sf).filter("traj_idx = 0").select("traj_id", "problem_id")


@query("P11_correctness", "SELECT run_id, coalesce(CASE WHEN run_id % 3 = 0 THEN run_id % 2 = 0 END, reward > 0, false) AS is_correct FROM runs")
def p11(spark, sf):
    flag = F.when(F.col("run_id") % 3 == 0, F.col("run_id") % 2 == 0)
    return fx.runs(spark, sf).select("run_id", k.correctness(flag, F.col("reward")).alias("is_correct"))


@query("P12_answers", "SELECT traj_id, extracted_answer FROM evals WHERE extracted_answer IS NOT NULL")
def p12(spark, sf):
    return fx.evals(spark, sf).filter("extracted_answer IS NOT NULL").select("traj_id", "extracted_answer")


@query("P13_mixed_sources", "SELECT count(DISTINCT source) AS n_sources, count(DISTINCT source) > 1 AS is_mixed FROM documents")
def p13(spark, sf):
    n = fx.table(spark, sf, "documents").select("source").distinct().agg(F.count("source").alias("n_sources"))
    return n.withColumn("is_mixed", F.col("n_sources") > 1)


# --- joins --------------------------------------------------------------------------------


@query(
    "J01_merged",
    "SELECT c.traj_id, c.centroid, coalesce(e.is_correct, c.num_heps > 3) AS is_correct FROM trajectories c LEFT JOIN (SELECT * FROM evals WHERE traj_idx < 6) e ON e.traj_id = c.traj_id",
    "centroid",
)
def j01(spark, sf):
    c = centroids(spark, sf).select("traj_id", "centroid", (F.col("num_heps") > 3).alias("is_correct"), F.lit(None).cast("string").alias("extracted_answer"))
    return jo.merged(c, fx.evals(spark, sf).filter("traj_idx < 6")).select("traj_id", "centroid", "is_correct")


@query(
    "J02_lookup",
    "SELECT t.traj_id, t.centroid, s.n_steps, e.avg_entropy FROM trajectories t LEFT JOIN (SELECT traj_id, count(*) AS n_steps FROM step_rows GROUP BY traj_id) s ON s.traj_id = t.traj_id LEFT JOIN (SELECT traj_id, avg(entropy) AS avg_entropy FROM tokens GROUP BY traj_id) e ON e.traj_id = t.traj_id",
    "centroid avg_entropy",
)
def j02(spark, sf):
    from .q_entropy import step_table

    steps = step_table(spark, sf).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_steps"))
    ent = en.statistics(fx.tokens(spark, sf)).select("traj_id", "avg_entropy")
    return jo.lookup(centroids(spark, sf).select("traj_id", "centroid"), steps, ent)


@query("J04_pending", "SELECT traj_id FROM evals WHERE traj_id NOT IN (SELECT traj_id FROM evals WHERE is_correct)")
def j04(spark, sf):
    e = fx.evals(spark, sf)
    return jo.pending(e, e.filter("is_correct")).select("traj_id")


@query(
    "J05_matched_and_skipped",
    """SELECT 'matched' AS kind, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang <> 'en'
    UNION ALL SELECT 'skipped' AS kind, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')""",
)
def j05(spark, sf):
    d = fx.table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id")
    ok, skipped = jo.matched_and_skipped(fx.table(spark, sf, "labels"), d, "doc_id")
    return ok.agg(F.lit("matched").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(
        skipped.agg(F.lit("skipped").alias("kind"), F.count(F.lit(1)).alias("n"))
    )


@query("J06_within", "SELECT run_id FROM runs WHERE task_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j06(spark, sf):
    c = fx.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("task_id"))
    return jo.within(fx.runs(spark, sf), c).select("run_id")


# --- metrics ------------------------------------------------------------------------------

CTES["trial_counts"] = "SELECT problem_id, count(*) AS n, count(*) FILTER (is_correct) AS c FROM evals GROUP BY problem_id"


CTES["pass_rows"] = " UNION ALL ".join(
    f"SELECT {kk} AS k, problem_id, n, CASE WHEN n - c < {kk} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_product(list_transform(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda x: 1.0 - {kk} / CAST(x AS DOUBLE))) END AS p FROM trial_counts"
    for kk in (1, 2, 5, 10)
)


@query(
    "M01_pass_at_k",
    "SELECT k, avg(p) AS pass_at_k, count(*) AS num_problems, avg(n) AS mean_trajectories FROM pass_rows WHERE n > k GROUP BY k",
    "pass_at_k mean_trajectories",
)
def m01(spark, sf):
    return me.pass_at_k_skipping(fx.evals(spark, sf), [1, 2, 5, 10])


@query("M02_available_ks", "SELECT unnest(range(1, (SELECT CAST(max(n) AS BIGINT) FROM trial_counts))) AS k")
def m02(spark, sf):
    return me.available_ks(fx.evals(spark, sf))


CTES["graded_gens"] = "SELECT problem_id, generation, bool_and(outcome > 0) AS is_correct, CASE problem_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM graded GROUP BY problem_id, generation"
CTES["graded_counts"] = "SELECT problem_id, difficulty, count(*) AS n, count(*) FILTER (is_correct) AS c FROM graded_gens GROUP BY problem_id, difficulty"
CTES["graded_pass"] = " UNION ALL ".join(
    f"SELECT {kk} AS k, problem_id, difficulty, n, CASE WHEN n - c < {kk} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_product(list_transform(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda x: 1.0 - {kk} / CAST(x AS DOUBLE))) END AS p FROM graded_counts"
    for kk in (1, 5, 10)
)


def _gens(spark, sf):
    return me.generation_correct(fx.graded(spark, sf))


def _difficulty():
    p = F.col("problem_id") % 3
    return F.when(p == 0, "easy").when(p == 1, "medium").otherwise("hard")


@query("M03_pass_at_k_strict", "SELECT k, avg(p) AS pass_at_k FROM graded_pass GROUP BY k HAVING min(n) >= k", "pass_at_k")
def m03(spark, sf):
    return me.pass_at_k_strict(me.counts(_gens(spark, sf)), [1, 5, 10])


@query("M04_generation_correct", "SELECT problem_id, generation, is_correct FROM graded_gens")
def m04(spark, sf):
    return _gens(spark, sf)


@query(
    "M05_pass_by_difficulty",
    "SELECT k, difficulty, avg(p) AS pass_at_k FROM graded_pass GROUP BY k, difficulty UNION ALL SELECT k, 'all' AS difficulty, avg(p) AS pass_at_k FROM graded_pass GROUP BY k",
    "pass_at_k",
)
def m05(spark, sf):
    per = me.counts(_gens(spark, sf)).withColumn("difficulty", _difficulty())
    return me.pass_at_k_by(per, "difficulty", [1, 5, 10])


@query("M06_pass_per_difficulty_strict", "SELECT difficulty, k, avg(p) AS pass_at_k FROM graded_pass GROUP BY difficulty, k HAVING min(n) >= k", "pass_at_k")
def m06(spark, sf):
    per = me.counts(_gens(spark, sf)).withColumn("difficulty", _difficulty())
    return me.pass_at_k_strict(per, [1, 5, 10], ["difficulty"])


@query("M07_pass_at_1_percent", "SELECT avg(c / CAST(n AS DOUBLE)) * 100 AS pass_at_1 FROM graded_counts", "pass_at_1")
def m07(spark, sf):
    return me.pass_at_1_percent(_gens(spark, sf))


MAX_K = 4


def _comb(c, kk):
    return "(" + " * ".join(f"greatest(CAST({c} AS DOUBLE) - {i}, 0)" for i in range(kk)) + ")"


CTES["task_pass"] = "SELECT task_id, llm, domain, n, c, " + ", ".join(f"CASE WHEN n >= {i} THEN {_comb('c', i)} / {_comb('n', i)} END AS pass_hat_{i}" for i in range(1, MAX_K + 1)) + (
    " FROM (SELECT task_id, llm, domain, count(*) AS n, count(*) FILTER (abs(reward - 1) <= 1e-6) AS c FROM runs GROUP BY task_id, llm, domain)"
)
PH = " ".join(f"pass_hat_{i}" for i in range(1, MAX_K + 1))


@query("M08_task_pass_hat_k", f"SELECT task_id, n, c, {PH.replace(' ', ', ')} FROM task_pass", PH)
def m08(spark, sf):
    return me.task_pass_hat_k(fx.runs(spark, sf), ["task_id"], MAX_K, k.succeeded_strictly(F.col("reward")))


@query(
    "M09_pass_hat_k_long",
    " UNION ALL ".join(f"SELECT {i} AS k, avg(pass_hat_{i}) AS mean_pass FROM task_pass HAVING min(n) >= {i}" for i in range(1, MAX_K + 1)),
    "mean_pass",
)
def m09(spark, sf):
    per = me.task_pass_hat_k(fx.runs(spark, sf), ["task_id"], MAX_K, k.succeeded_strictly(F.col("reward")))
    means = long_pass(per, range(1, MAX_K + 1), []).groupBy("k").agg(F.avg("p").alias("mean_pass"))
    return means.crossJoin(F.broadcast(me.max_trials(per))).filter("k <= max_k").drop("max_k")  # one row


@query(
    "M10_agent_metrics",
    "SELECT r.*, p.* FROM (SELECT avg(reward) AS avg_reward, avg(agent_cost) AS avg_agent_cost FROM runs) r, (SELECT " + ", ".join(f"CASE WHEN min(n) >= {i} THEN avg(pass_hat_{i}) END AS pass_hat_{i}" for i in range(1, MAX_K + 1)) + " FROM task_pass) p",
    "avg_reward avg_agent_cost " + PH,
)
def m10(spark, sf):
    return me.agent_metrics(fx.runs(spark, sf), ["task_id"], MAX_K, k.succeeded_strictly(F.col("reward")))


CTES["results"] = """SELECT d.doc_id AS id, l.quality = 1 AS is_correct, CASE WHEN d.doc_id % 13 <> 0 THEN d.n_chars < 200 END AS error, CASE WHEN d.doc_id % 11 <> 0 THEN d.lang END AS comparison_method, d.source AS extraction_method,
  CASE WHEN l.toxic = 1 THEN 'logic' ELSE 'math' END AS task_type, concat(CASE WHEN l.toxic = 1 THEN 'logic' ELSE 'math' END, '/', d.lang) AS subtask,
  CASE WHEN d.doc_id % 5 = 0 THEN 0.5 WHEN d.doc_id % 5 = 1 THEN NULL ELSE 1.0 END AS comparison_confidence, CASE WHEN d.doc_id % 7 = 0 THEN 0.0 ELSE 0.8 END AS extraction_confidence
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


def results(spark, sf):
    j = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").drop("text"), "doc_id")
    task = F.when(F.col("toxic") == 1, "logic").otherwise("math")
    m5 = F.col("doc_id") % 5
    return j.select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 1).alias("is_correct"),
        F.when(F.col("doc_id") % 13 != 0, F.col("n_chars") < 200).alias("error"),
        F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("comparison_method"),
        F.col("source").alias("extraction_method"),
        task.alias("task_type"),
        F.concat(task, F.lit("/"), "lang").alias("subtask"),
        F.when(m5 == 0, 0.5).when(m5 == 1, None).otherwise(1.0).alias("comparison_confidence"),
        F.when(F.col("doc_id") % 7 == 0, 0.0).otherwise(0.8).alias("extraction_confidence"),
    )


@query(
    "M11_accuracy",
    "SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct AND NOT coalesce(error, false)) AS incorrect, count(*) FILTER (error) AS failed_extraction, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM results",
    "accuracy",
)
def m11(spark, sf):
    return me.accuracy(results(spark, sf))


_DIMS = ["comparison_method", "extraction_method", "task_type", "subtask"]


@query(
    "M12_breakdown",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) AS total, count(*) FILTER (is_correct) AS correct, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM results GROUP BY {d}"
        for d in _DIMS
    ),
    "accuracy",
)
def m12(spark, sf):
    return me.breakdown(results(spark, sf), _DIMS)


@query("M13_low_confidence", "SELECT id FROM results WHERE coalesce(comparison_confidence, 1.0) < 0.8 OR extraction_confidence < 0.8")
def m13(spark, sf):
    return me.low_confidence(results(spark, sf)).select("id")


@query("M14_trajectory_counts", "SELECT count(*) FILTER (n > 1) AS multi_trajectory, count(*) FILTER (n <= 1) AS single_trajectory FROM trial_counts")
def m14(spark, sf):
    return me.trajectory_counts(fx.evals(spark, sf))


_ACC = "count(*) AS total, count(*) FILTER (is_correct) AS correct, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy"


@query("M15_task_accuracy", f"SELECT task_type, {_ACC} FROM results GROUP BY task_type", "accuracy")
def m15(spark, sf):
    return me.accuracy_by(results(spark, sf), "task_type")


CTES["mixed"] = """SELECT o_orderkey AS idx, q AS q_idx, CASE q WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_custkey % 1000 ELSE (o_orderkey + 7) % 1000 END AS question FROM orders, (SELECT CAST(range AS INT) AS q FROM range(3))"""


@query(
    "M16_mixed_pass_rate",
    """SELECT idx, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) = 1.0 AS is_correct FROM
    (SELECT m.idx, coalesce(l.quality = 1, false) AS ok FROM mixed m LEFT JOIN labels l ON l.doc_id = m.question) GROUP BY idx""",
    "pass_rate",
)
def m16(spark, sf):
    o = fx.table(spark, sf, "orders")
    q = F.array(F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000, (F.col("o_orderkey") + 7) % 1000)
    samples = o.select(F.col("o_orderkey").alias("idx"), q.alias("question_list"))
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("question"), (F.col("quality") == 1).alias("is_correct"))
    answers = samples.select("idx", F.posexplode("question_list").alias("q_idx", "question")).join(labels, "question").drop("question")
    return me.mixed_pass_rate(samples, answers)


@query(
    "M17_counterfactual",
    "SELECT extraction_method AS question_type, comparison_method AS mode, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN task_type = 'logic' AND NOT is_correct THEN 1.0 ELSE 0.0 END) AS real_life_rate FROM results GROUP BY extraction_method, comparison_method",
    "accuracy real_life_rate",
)
def m17(spark, sf):
    r = results(spark, sf).withColumns({"question_type": F.col("extraction_method"), "mode": F.col("comparison_method")})
    return me.counterfactual_rates(r.withColumn("is_real_life", (F.col("task_type") == "logic") & ~F.col("is_correct")))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_OK = "coalesce(reward, 0) > 0"


def scored_runs(spark, sf):
    return fx.runs(spark, sf).withColumn("is_correct", k.succeeded(F.col("reward"))).withColumn("model", F.col("llm"))


@query(
    "M18_score_sheet",
    "SELECT llm AS model, mode, "
    + ", ".join(f"count(*) FILTER (domain = '{r}' AND {_OK}) * 100.0 / nullif(count(*) FILTER (domain = '{r}'), 0) AS \"{r}\"" for r in REGIONS)
    + f", count(*) FILTER ({_OK}) * 100.0 / count(*) AS overall FROM runs GROUP BY llm, mode",
    " ".join(["AFRICA", "AMERICA", "ASIA", "EUROPE", "overall"]),
)
def m18(spark, sf):
    s = me.score_sheet(scored_runs(spark, sf).withColumn("question_type", F.col("domain")), REGIONS)
    return s.withColumn("MIDDLE EAST", F.round("MIDDLE EAST", 6))


MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "M19_variant_table",
    f"SELECT llm AS model, max(CASE WHEN v = '1-URGENT' THEN s END) AS urgent, max(CASE WHEN v = '5-LOW' THEN s END) AS low FROM (SELECT llm, mode AS v, coalesce(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) FILTER (task_id % 3 = 0), avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) FILTER (task_id % 3 <> 0)) * 100 AS s FROM runs GROUP BY llm, mode) GROUP BY llm",
    "urgent low",
)
def m19(spark, sf):
    r = scored_runs(spark, sf).withColumn("variant", F.col("mode")).withColumn("calibrated", F.col("task_id") % 3 == 0)
    v = me.variant_table(r, ["1-URGENT", "5-LOW"])
    return v.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("M20_solve_rate", f"SELECT task_id, count(*) AS total, count(*) FILTER ({_OK}) AS correct, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) AS accuracy FROM runs GROUP BY task_id", "accuracy")
def m20(spark, sf):
    return me.accuracy_by(scored_runs(spark, sf), "task_id")


@query(
    "M21_domain_performance",
    "SELECT llm AS model, "
    + ", ".join(f"avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) FILTER (task_id % 3 = {i} OR 3 + task_id % 2 = {i}) AS d{i}" for i in range(5))
    + " FROM runs GROUP BY llm",
    "d0 d1 d2 d3 d4",
)
def m21(spark, sf):
    d = F.array(F.concat(F.lit("d"), (F.col("task_id") % 3).cast("string")), F.concat(F.lit("d"), (3 + F.col("task_id") % 2).cast("string")))
    return me.domain_performance(scored_runs(spark, sf).withColumn("domains", d), [f"d{i}" for i in range(5)])


REPS = 20
_POIS = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in me.POISSON)


@query(
    "M22_bootstrap",
    f"""SELECT model, lower, median, upper, median - lower AS error_low, upper - median AS error_high FROM (SELECT model, quantile_cont(acc, 0.025) AS lower, quantile_cont(acc, 0.5) AS median, quantile_cont(acc, 0.975) AS upper FROM
    (SELECT model, rep, sum(CASE WHEN ok THEN {_POIS} ELSE 0 END) / CAST(sum({_POIS}) AS DOUBLE) AS acc FROM
      (SELECT llm AS model, {_OK} AS ok, rep, CAST(concat('0x', substr(md5(concat(CAST(rep AS STRING), ':', CAST(run_id AS STRING))), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM runs, (SELECT range AS rep FROM range({REPS})))
     GROUP BY model, rep) GROUP BY model)""",
    "lower median upper error_low error_high",
)
def m22(spark, sf):
    return me.bootstrap(scored_runs(spark, sf), "model", "run_id", REPS)


@query(
    "M23_domain_termination",
    "SELECT coalesce(domain, 'all') AS domain, coalesce(termination_reason, 'all') AS termination_reason, count(*) AS n FROM runs GROUP BY CUBE (domain, termination_reason)",
)
def m23(spark, sf):
    return me.domain_termination_counts(fx.runs(spark, sf))


CTES["seven_won"] = """SELECT v.problem_id, v.method, v.answer, s.num_votes, s.confidence FROM (SELECT problem_id, method, answer FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, method ORDER BY round(w, 9) DESC, f) AS r FROM
      (SELECT problem_id, method, extracted_answer AS answer, sum(w) AS w, min(traj_idx) AS f FROM seven_rows GROUP BY problem_id, method, extracted_answer)) WHERE r = 1) v
    JOIN (SELECT problem_id, method, count(*) AS num_votes, avg(conf) AS confidence FROM seven_rows GROUP BY problem_id, method) s ON s.problem_id = v.problem_id AND s.method = v.method"""


@query(
    "M24_voting_accuracy",
    "SELECT method, avg(CASE WHEN answer = concat('a', CAST(problem_id % 5 AS STRING)) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(num_votes) AS mean_votes, avg(confidence) AS mean_confidence FROM seven_won GROUP BY method",
    "accuracy mean_votes mean_confidence",
)
def m24(spark, sf):
    truth = traces(spark, sf).select("problem_id").distinct().withColumn("ground_truth", F.concat(F.lit("a"), (F.col("problem_id") % 5).cast("string")))
    return me.voting_accuracy(seven(spark, sf), truth)


@query(
    "M25_stop_groups",
    """SELECT CASE WHEN phase = 'warmup' AND round(min_window_confidence, 6) >= round(conf_bar, 6) THEN 'warmup_above' WHEN phase = 'warmup' THEN 'warmup_below' WHEN stopped THEN 'early_stopped' ELSE 'completed' END AS trace_group,
    count(*) AS n, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM online GROUP BY trace_group""",
    "accuracy",
)
def m25(spark, sf):
    return me.stop_groups(online(spark, sf), "min_window_confidence")


CTES["usage_rows"] = "SELECT problem_id, CAST(sum(num_tokens) AS BIGINT) AS total_tokens, count(*) AS n_traces, CAST(sum(CASE WHEN traj_idx % 3 = 0 THEN 0 ELSE num_tokens END) / 10.0 AS DOUBLE) AS warmup_time, CAST(max(num_tokens) AS DOUBLE) AS final_time FROM traces GROUP BY problem_id"


def usage(spark, sf):
    n = F.col("num_tokens")
    return traces(spark, sf).groupBy("problem_id").agg(
        F.sum(n).alias("total_tokens"), F.count(F.lit(1)).alias("n_traces"),
        (F.sum(F.when(F.col("traj_idx") % 3 == 0, 0).otherwise(n)) / 10.0).alias("warmup_time"), F.max(n).cast("double").alias("final_time"),
    )


@query(
    "M26_token_usage",
    "SELECT avg(total_tokens) AS mean_tokens, stddev_pop(total_tokens) AS std_tokens, min(total_tokens) AS min_tokens, max(total_tokens) AS max_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens, sum(total_tokens) / CAST(sum(n_traces) AS DOUBLE) AS tokens_per_trace, quantile_cont(CAST(total_tokens AS DOUBLE), 0.5) AS median_tokens FROM usage_rows",
    "mean_tokens std_tokens tokens_per_trace median_tokens",
)
def m26(spark, sf):
    return me.token_usage(usage(spark, sf))


@query(
    "M27_timing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS phase, count(*) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, sum(total_tokens) / sum({c}) AS tokens_per_second, quantile_cont({c}, 0.5) AS median FROM usage_rows WHERE {c} > 0"
        for c in ("warmup_time", "final_time")
    ),
    "mean std min max tokens_per_second median",
)
def m27(spark, sf):
    return me.timing(usage(spark, sf), ["warmup_time", "final_time"])


@query(
    "M28_missing_pairs",
    "SELECT q.question_id, r.run FROM (SELECT range AS question_id FROM range(60)) q, (SELECT CAST(range AS INT) AS run FROM range(30)) r WHERE NOT EXISTS (SELECT 1 FROM traces t WHERE t.problem_id = q.question_id AND t.traj_idx = r.run)",
)
def m28(spark, sf):
    done = traces(spark, sf).select(F.col("problem_id").alias("question_id"), F.col("traj_idx").alias("run"))
    return me.missing_pairs(done, 60, range(30))


@query("M29_question_accuracy", f"SELECT problem_id, {_ACC} FROM traces WHERE problem_id % 4 <> 3 GROUP BY problem_id", "accuracy")
def m29(spark, sf):
    kind = F.when(F.col("problem_id") % 4 == 3, "description").otherwise("number")
    return me.question_accuracy(traces(spark, sf).withColumn("answer_type", kind), ["description"])


@query(
    "M30_reasoning_summary",
    "SELECT avg(num_tokens) AS mean_length, avg(CASE WHEN extracted_answer IS NULL THEN 1.0 ELSE 0.0 END) AS no_answer_rate, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM traces",
    "mean_length no_answer_rate accuracy",
)
def m30(spark, sf):
    return me.reasoning_summary(traces(spark, sf).withColumn("reasoning_length", F.col("num_tokens")))


CTES["expected_n"] = "SELECT n AS expected FROM (SELECT n, count(*) AS f FROM (SELECT problem_id, count(*) AS n FROM traces GROUP BY problem_id) GROUP BY n) ORDER BY f DESC, n LIMIT 1"


@query(
    "M31_truncated",
    "SELECT problem_id, traj_idx FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY traj_idx) AS r FROM traces), expected_n WHERE r <= expected",
)
def m31(spark, sf):
    return me.truncated(traces(spark, sf)).select("problem_id", "traj_idx")


@query("M31_anomalies", "SELECT problem_id, n, expected FROM (SELECT problem_id, count(*) AS n FROM traces GROUP BY problem_id), expected_n WHERE n <> expected")
def m31b(spark, sf):
    return me.count_anomalies(traces(spark, sf))


@query(
    "M32_evaluation_table",
    "SELECT concat('p', CAST(o_orderkey AS STRING), '_traj_', CAST(g AS STRING)) AS traj_id, o_orderkey AS problem_id, CASE g WHEN 0 THEN o_orderkey % 2 > 0 ELSE (o_orderkey % 3 > 0 AND o_orderkey % 5 > 0) END AS is_correct FROM orders, (SELECT range AS g FROM range(2))",
)
def m32(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"))
    base = F.concat(F.lit("p"), F.col("o").cast("string"), F.lit("_traj_"))
    order = o.select(F.col("o").alias("problem_id"), F.array(F.concat(base, F.lit("0")), F.concat(base, F.lit("1"))).alias("traj_ids"))
    res = o.select(F.col("o").alias("problem_id"), F.array(F.array(F.col("o") % 2), F.array(F.col("o") % 3, F.col("o") % 5)).alias("outcomes"))
    return me.evaluation_table(order, res)


@query("M33_failed_tasks", "SELECT l_orderkey AS task_id, l_linenumber AS sample, status, l_linestatus AS details FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'pass' ELSE l_returnflag END AS status FROM lineitem) l WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def m33(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("sample"), F.when(F.col("l_returnflag") == "N", "pass").otherwise(F.col("l_returnflag")).alias("status"), F.col("l_linestatus").alias("details"))
    return me.failed_tasks(e)


@query(
    "M34_stored_check",
    "SELECT problem_id, stored, recomputed, abs(stored - recomputed) < 1e-4 AS agrees FROM (SELECT problem_id, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) + CASE WHEN problem_id % 4 = 0 THEN 0.01 ELSE 0 END AS stored, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS recomputed FROM graded_gens GROUP BY problem_id)",
    "stored recomputed",
)
def m34(spark, sf):
    g = _gens(spark, sf)
    off = F.when(F.col("problem_id") % 4 == 0, 0.01).otherwise(0.0)
    stored = g.groupBy("problem_id").agg(F.avg(F.col("is_correct").cast("double")).alias("a")).select("problem_id", (F.col("a") + off).alias("stored"))
    return me.stored_check(stored, g)


@query(
    "M35_routing",
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN extracted_answer IS NULL THEN 'error' WHEN is_correct THEN 'correct' WHEN traj_idx >= 15 THEN 'max_rounds' ELSE 'processing' END AS status FROM traces) GROUP BY status",
)
def m35(spark, sf):
    t = traces(spark, sf).withColumn("error", F.col("extracted_answer").isNull()).withColumn("round", F.col("traj_idx"))
    return me.routed(t, 15).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
