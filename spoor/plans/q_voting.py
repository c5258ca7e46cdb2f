"""Queries for selection and voting (V-01 .. V-30)."""

from pyspark.sql import functions as F

from ..operators import centroid as ce
from ..operators import voting as vo
from ..session import stage
from . import fixtures as fx
from .inputs import traces, trajectories
from .q_confidence import online
from .registry import CTES, query


@query(
    "V01_best_by_score",
    """SELECT problem_id, traj_idx AS selected_idx, score AS selected_score FROM (SELECT e.problem_id, e.traj_idx, s.score,
    row_number() OVER (PARTITION BY e.problem_id ORDER BY s.score DESC, e.traj_idx) AS r FROM evals e JOIN early_scores s ON s.traj_id = e.traj_id) WHERE r = 1""",
    "selected_score",
)
def v01(spark, sf):
    rows = fx.evals(spark, sf).join(ce.score_early_entropy(fx.tokens(spark, sf)), "traj_id")
    return vo.best_by_score(rows, "score")


CTES["centred"] = """SELECT *, avg(centroid) OVER w AS mean_c, stddev_pop(centroid) OVER w AS std_c, count(*) OVER w AS n_c
  FROM keyed WHERE centroid IS NOT NULL WINDOW w AS (PARTITION BY problem_id)"""
_RULES = {
    "none": "false",
    "threshold": "abs(centroid - mean_c) > 0.1",
    "std": "std_c > 0 AND (centroid < mean_c - std_c OR centroid > mean_c + std_c)",
    "below_mean_threshold": "centroid < mean_c - 0.1",
}


@query(
    "V02_outliers",
    " UNION ALL ".join(f"SELECT '{m}' AS method, problem_id, traj_idx, {r} AS is_outlier FROM centred" for m, r in _RULES.items()),
)
def v02(spark, sf):
    out = None
    for m in _RULES:
        d = vo.outliers(trajectories(spark, sf).filter("centroid IS NOT NULL"), m)
        d = d.select(F.lit(m).alias("method"), "problem_id", "traj_idx", "is_outlier")
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "V03_lowest_centroid",
    f"""SELECT t.problem_id, t.n AS n_trajectories, coalesce(c.n, 0) AS n_valid, CASE WHEN c.n = c.o THEN 0 ELSE coalesce(c.o, 0) END AS n_excluded,
    coalesce(c.idx, t.i0) AS selected_idx, c.cen AS selected_centroid FROM (SELECT problem_id, count(*) AS n, min(traj_idx) AS i0 FROM evals GROUP BY problem_id) t
    LEFT JOIN (SELECT problem_id, count(*) AS n, count(*) FILTER (out) AS o, arg_min(traj_idx, r) AS idx, arg_min(centroid, r) AS cen FROM
      (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY out, centroid, traj_idx) AS r FROM (SELECT *, {_RULES['std']} AS out FROM centred)) GROUP BY problem_id) c
    ON c.problem_id = t.problem_id""",
    "selected_centroid",
)
def v03(spark, sf):
    return vo.lowest_centroid(trajectories(spark, sf), "std")


CTES["thr_picks"] = """SELECT * FROM (SELECT g.threshold, c.*, c.n_c > 1 AND c.mean_c - c.centroid > g.threshold AS cut,
  count(*) FILTER (c.n_c > 1 AND c.mean_c - c.centroid > g.threshold) OVER (PARTITION BY g.threshold, c.problem_id) AS n_cut,
  row_number() OVER (PARTITION BY g.threshold, c.problem_id ORDER BY c.n_c > 1 AND c.mean_c - c.centroid > g.threshold, c.centroid, c.traj_idx) AS r
  FROM centred c CROSS JOIN (SELECT CAST(range AS DOUBLE) / 100 AS threshold FROM range(1, 31)) g) WHERE r = 1"""


@query(
    "V04_threshold_search",
    """SELECT threshold, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (is_correct) AS correct_count, count(*) AS total_samples,
    count(*) FILTER (n_cut > 0 AND n_cut < n_c) AS filtered_problems FROM thr_picks GROUP BY threshold""",
    "threshold accuracy",
)
def v04(spark, sf):
    """From tokens to accuracy: thresholds, phases, centroids, filter search."""
    c = stage(ce.centroid_table(fx.tokens(spark, sf)).select("traj_id", "centroid"))  # one row per trajectory
    return vo.threshold_search(fx.evals(spark, sf).join(c, "traj_id", "left"))


@query("V04_held_out_search")
def v04h(spark, sf):
    return vo.held_out_search(trajectories(spark, sf))


@query(
    "V05_filtered_pick",
    "SELECT problem_id, traj_idx AS selected_idx, centroid AS selected_centroid, is_correct, (n_cut > 0 AND n_cut < n_c) AS used_filter FROM thr_picks WHERE threshold = 0.05",
    "selected_centroid",
)
def v05(spark, sf):
    return vo.threshold_picks(trajectories(spark, sf), [0.05]).drop("threshold")


@query("V06_answer_keys", "SELECT traj_id, key FROM keyed")
def v06(spark, sf):
    return fx.evals(spark, sf).select("traj_id", vo.answer_key(F.col("extracted_answer")).alias("key"))


CTES["tallied"] = "SELECT problem_id, key, count(*) AS votes, min(traj_idx) AS first_idx FROM keyed WHERE extracted_answer IS NOT NULL GROUP BY problem_id, key"


@query(
    "V07_majority",
    """SELECT t.problem_id, t.n AS n_trajectories, coalesce(v.u, 0) AS n_unique_answers, v.key AS winning_key, v.votes AS winning_votes,
    v.votes * 100.0 / t.n AS winning_percentage, coalesce(v.first_idx, t.i0) AS selected_idx
    FROM (SELECT problem_id, count(*) AS n, min(traj_idx) AS i0 FROM keyed GROUP BY problem_id) t LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, first_idx) AS r, count(*) OVER (PARTITION BY problem_id) AS u FROM tallied) v
    ON v.problem_id = t.problem_id AND v.r = 1""",
    "winning_percentage",
)
def v07(spark, sf):
    return vo.majority(fx.evals(spark, sf))


@query(
    "V08_vote_distribution",
    """SELECT problem_id, key, votes, votes * 100.0 / n AS percentage, u AS n_unique, ties > 1 AS had_tie, ties > 1 AND votes = top AS is_tied_answer FROM
    (SELECT *, count(*) FILTER (votes = top) OVER (PARTITION BY problem_id) AS ties FROM
      (SELECT v.*, max(votes) OVER (PARTITION BY v.problem_id) AS top, count(*) OVER (PARTITION BY v.problem_id) AS u, t.n FROM tallied v
       JOIN (SELECT problem_id, count(*) AS n FROM keyed GROUP BY problem_id) t ON t.problem_id = v.problem_id))""",
    "percentage",
)
def v08(spark, sf):
    return vo.vote_distribution(fx.evals(spark, sf))


@query(
    "V09_judged_majority",
    """SELECT problem_id, key AS winning_key, votes AS winning_votes, first_idx AS selected_idx, judged AS judgment_used FROM
    (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY judged DESC, votes DESC, first_idx) AS r FROM
      (SELECT problem_id, key, count(*) AS votes, min(traj_idx) AS first_idx, bool_or(coalesce(is_correct, false)) AS judged FROM keyed GROUP BY problem_id, key)) WHERE r = 1""",
)
def v09(spark, sf):
    e = fx.evals(spark, sf)
    key = vo.answer_key(F.col("extracted_answer"))
    judged = e.withColumn("key", key).groupBy("problem_id", "key").agg(F.max("is_correct").alias("judged"))
    return vo.judged_majority(e, judged)


@query(
    "V10_random_pick",
    "SELECT problem_id, arg_min(traj_idx, md5(concat('42:', traj_id))) AS selected_idx FROM evals GROUP BY problem_id",
)
def v10(spark, sf):
    return vo.random_pick(fx.evals(spark, sf))


@query(
    "V10_random_samples",
    "SELECT problem_id, traj_idx FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY md5(concat('42:', traj_id))) AS r FROM evals) WHERE r <= 3",
)
def v10b(spark, sf):
    return vo.random_pick(fx.evals(spark, sf), samples=3)


@query(
    "V11_centroid_vote",
    """SELECT problem_id, key AS winning_key, votes AS winning_votes, mc AS winning_centroid, mi AS selected_idx FROM
    (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, mc, mi) AS w FROM
      (SELECT problem_id, key, count(*) AS votes, min(centroid) AS mc, arg_min(traj_idx, r) AS mi FROM
        (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY centroid, traj_idx) AS r FROM centred)
       WHERE r <= greatest(1, floor(n_c * 30 / 100.0)) GROUP BY problem_id, key)) WHERE w = 1""",
    "winning_centroid",
)
def v11(spark, sf):
    return vo.centroid_vote(trajectories(spark, sf), 30.0)


@query(
    "V12_vote_without_centroids",
    """SELECT problem_id, key AS winning_key, votes AS winning_votes, CAST(NULL AS DOUBLE) AS winning_centroid, first_idx AS selected_idx FROM
    (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, first_idx) AS r FROM
      (SELECT problem_id, key, count(*) AS votes, min(traj_idx) AS first_idx FROM keyed GROUP BY problem_id, key)) WHERE r = 1""",
    "winning_centroid",
)
def v12(spark, sf):
    return vo.centroid_vote(trajectories(spark, sf).withColumn("centroid", F.lit(None).cast("double")), 30.0)


_W = {
    "linear": "1 - (centroid - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END",
    "inverse": "1 / (centroid + 0.01)",
    "exponential": "exp(-centroid)",
}


def _weights(method):
    return f"""SELECT *, CASE WHEN lo IS NULL THEN 1.0 / n_c WHEN w0 > 0 THEN w0 / pos ELSE w0 END AS weight FROM
    (SELECT *, sum(CASE WHEN w0 > 0 THEN w0 ELSE 0 END) OVER (PARTITION BY problem_id) AS pos FROM
      (SELECT *, CASE WHEN out THEN -1.0 ELSE {_W[method]} END AS w0 FROM
        (SELECT *, min(CASE WHEN NOT out THEN centroid END) OVER (PARTITION BY problem_id) AS lo, max(CASE WHEN NOT out THEN centroid END) OVER (PARTITION BY problem_id) AS hi
         FROM (SELECT *, {_RULES['std']} AS out FROM centred))))"""


@query(
    "V13_vote_weights",
    " UNION ALL ".join(f"SELECT '{m}' AS method, problem_id, traj_idx, weight FROM ({_weights(m)})" for m in _W),
    "weight",
)
def v13(spark, sf):
    out = None
    for m in _W:
        d = vo.vote_weights(vo.outliers(trajectories(spark, sf).filter("centroid IS NOT NULL"), "std"), m)
        d = d.select(F.lit(m).alias("method"), "problem_id", "traj_idx", "weight")
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "V14_weighted_centroid_vote",
    f"""SELECT problem_id, key AS winning_key, w AS winning_weight, mi AS selected_idx FROM
    (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(w, 12) DESC, f) AS r FROM
      (SELECT problem_id, key, sum(weight) AS w, min(traj_idx) AS f, arg_min(traj_idx, centroid) AS mi FROM ({_weights('linear')}) GROUP BY problem_id, key)) WHERE r = 1""",
    "winning_weight",
)
def v14(spark, sf):
    return vo.weighted_centroid_vote(trajectories(spark, sf), outlier_method="std")


def _wvote(src, weight, by="problem_id"):
    return f"""SELECT {by}, answer, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(w, 9) DESC, f) AS r FROM
      (SELECT {by}, extracted_answer AS answer, sum({weight}) AS w, min(traj_idx) AS f FROM {src} GROUP BY {by}, extracted_answer)) WHERE r = 1"""


@query("V15_simple_majority", f"SELECT problem_id, answer, CAST(weight AS BIGINT) AS votes FROM ({_wvote('traces WHERE extracted_answer IS NOT NULL', '1')})")
def v15(spark, sf):
    t = traces(spark, sf).withColumn("one", F.lit(1.0))
    return vo.weighted_majority(t, "one").select("problem_id", "answer", F.col("weight").cast("long").alias("votes"))


@query("V16_weighted_majority", _wvote("traces WHERE extracted_answer IS NOT NULL", "mean_confidence"), "weight")
def v16(spark, sf):
    return vo.weighted_majority(traces(spark, sf), "mean_confidence")


CTES["answered"] = """SELECT *, round(quantile_cont(tail_confidence, 0.9) OVER (PARTITION BY problem_id), 9) AS tail_cut,
  round(quantile_cont(bottom_window_confidence, 0.9) OVER (PARTITION BY problem_id), 9) AS bottom_cut FROM traces WHERE extracted_answer <> ''"""
_SEVEN = [
    ("majority", "1.0", "NULL", "true"),
    ("mean_confidence_weighted", "mean_confidence", "mean_confidence", "true"),
    ("tail_confidence_weighted", "tail_confidence", "tail_confidence", "true"),
    ("bottom_window_weighted", "bottom_window_confidence", "bottom_window_confidence", "true"),
    ("min_window_weighted", "min_window_confidence", "min_window_confidence", "true"),
    ("top10_tail_filtered", "tail_confidence", "tail_confidence", "round(tail_confidence, 9) >= tail_cut"),
    ("top10_bottom_window_filtered", "bottom_window_confidence", "bottom_window_confidence", "round(bottom_window_confidence, 9) >= bottom_cut"),
]
CTES["seven_rows"] = " UNION ALL ".join(
    f"SELECT '{m}' AS method, problem_id, traj_idx, extracted_answer, CAST({w} AS DOUBLE) AS w, CAST({c} AS DOUBLE) AS conf FROM answered WHERE {k}"
    for m, w, c, k in _SEVEN
)


def seven(spark, sf):
    t = traces(spark, sf)
    cols = ["mean_confidence", "tail_confidence", "bottom_window_confidence", "min_window_confidence"]
    return vo.seven_votes(t.withColumns({c: F.round(c, 9) for c in cols}))


@query(
    "V17_seven_votes",
    f"""SELECT v.problem_id, v.method, v.answer, s.num_votes, s.confidence FROM ({_wvote('seven_rows', 'w', 'problem_id, method')}) v
    JOIN (SELECT problem_id, method, count(*) AS num_votes, avg(conf) AS confidence FROM seven_rows GROUP BY problem_id, method) s
    ON s.problem_id = v.problem_id AND s.method = v.method""",
    "confidence",
)
def v17(spark, sf):
    return seven(spark, sf)


CTES["online_voters"] = "SELECT * FROM online WHERE extracted_answer <> '' AND CASE WHEN phase = 'warmup' THEN round(min_window_confidence, 6) >= round(conf_bar, 6) ELSE NOT stopped END"


@query("V18_online_vote", _wvote("online_voters", "round(min_window_confidence, 6)"), "weight")
def v18(spark, sf):
    return vo.online_vote(online(spark, sf), "min_window_confidence")


CTES["trace_ranks"] = "SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(tail_confidence, 9) DESC, traj_idx) AS r FROM traces"


@query(
    "V19_confidence_report",
    """SELECT problem_id, avg(tail_confidence) AS mean_conf, stddev_pop(tail_confidence) AS std_conf, min(tail_confidence) AS min_conf, max(tail_confidence) AS max_conf,
    count(*) FILTER (is_correct) AS n_correct, count(*) AS n_total, arg_min(traj_idx, r) AS selected_idx, arg_min(is_correct, r) AS selected_correct,
    count(*) FILTER (r <= 5 AND is_correct) AS top_n_correct, string_agg(CAST(traj_idx AS STRING), ',' ORDER BY r) FILTER (r <= 5) AS top_n FROM trace_ranks GROUP BY problem_id""",
    "mean_conf std_conf min_conf max_conf",
)
def v19(spark, sf):
    return vo.confidence_report(traces(spark, sf).withColumn("tail_confidence", F.round("tail_confidence", 9)), "tail_confidence")


NS = [1, 4, 8, 16]


def _of_n(n):
    return f"""SELECT {n} AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS pass_at_1, count(*) FILTER (ok) AS correct, count(*) AS total FROM
    (SELECT problem_id, arg_min(is_correct, r) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(mean_confidence, 9) DESC, traj_idx) AS r
     FROM traces WHERE traj_idx < {n}) GROUP BY problem_id)"""


def _mean9(spark, sf):
    return traces(spark, sf).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("V20_best_of_n", " UNION ALL ".join(_of_n(n) for n in NS), "pass_at_1")
def v20(spark, sf):
    t = _mean9(spark, sf)
    return vo.best_of_n(t, "mean_confidence", NS, labelled=t)


@query(
    "V21_best_answered",
    """SELECT problem_id, traj_idx AS selected_idx, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, traj_idx) AS r FROM
    (SELECT *, CASE WHEN extracted_answer IS NULL THEN -1e9 ELSE round(mean_confidence, 9) END AS c FROM traces WHERE traj_idx < 8)) WHERE r = 1""",
    "confidence",
)
def v21(spark, sf):
    return vo.best_answered(_mean9(spark, sf), "mean_confidence", 8)


@query(
    "V22_borda",
    """SELECT t.problem_id, coalesce(b.f, t.i0) AS selected_idx, coalesce(b.s, 0) AS borda_votes FROM (SELECT problem_id, min(traj_idx) AS i0 FROM traces WHERE traj_idx < 16 GROUP BY problem_id) t
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(s, 9) DESC, f) AS w FROM (SELECT problem_id, extracted_answer, sum(sqrt(n - r)) AS s, min(traj_idx) AS f FROM
      (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(mean_confidence, 9) DESC, traj_idx) - 1 AS r, count(*) OVER (PARTITION BY problem_id) AS n FROM traces WHERE traj_idx < 16)
      WHERE extracted_answer IS NOT NULL GROUP BY problem_id, extracted_answer)) b ON b.problem_id = t.problem_id AND b.w = 1""",
    "borda_votes",
)
def v22(spark, sf):
    return vo.borda(_mean9(spark, sf), "mean_confidence", 16)


CTES["judge_texts"] = """SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'no choice' ELSE concat('Response ', CAST(conv_id % 7 AS STRING), ' or rather Response ', CAST(conv_id % 12 AS STRING)) END AS judge_text
  FROM (SELECT DISTINCT conv_id FROM conversations)"""


@query(
    "V23_judge_choice",
    r"SELECT conv_id, CASE WHEN coalesce(TRY_CAST(regexp_extract_all(judge_text, 'Response (\d+)', 1)[-1] AS INT), 0) < 8 THEN coalesce(TRY_CAST(regexp_extract_all(judge_text, 'Response (\d+)', 1)[-1] AS INT), 0) ELSE 0 END AS pick FROM judge_texts",
)
def v23(spark, sf):
    c = fx.table(spark, sf, "conversations").select("conv_id").distinct()
    text = F.when(F.col("conv_id") % 4 == 0, "no choice").otherwise(
        F.concat(F.lit("Response "), (F.col("conv_id") % 7).cast("string"), F.lit(" or rather Response "), (F.col("conv_id") % 12).cast("string"))
    )
    return c.select("conv_id", vo.last_response_index(text, F.lit(8)).alias("pick"))


@query(
    "V24_answerable_pick",
    """SELECT t.problem_id, CASE WHEN bool_or(traj_idx = p.pick AND extracted_answer IS NOT NULL) THEN any_value(p.pick)
    ELSE coalesce(min(CASE WHEN extracted_answer IS NOT NULL THEN traj_idx END), any_value(p.pick)) END AS selected_idx
    FROM traces t JOIN (SELECT DISTINCT problem_id, CAST(problem_id % 9 AS INT) AS pick FROM traces) p ON p.problem_id = t.problem_id GROUP BY t.problem_id""",
)
def v24(spark, sf):
    t = traces(spark, sf)
    picks = t.select("problem_id", (F.col("problem_id") % 9).cast("int").alias("pick")).distinct()
    return vo.answerable_pick(picks, t)


@query(
    "V25_random_expectation",
    "SELECT avg(a) AS random_pass_at_1, count(*) AS problems FROM (SELECT problem_id, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS a FROM evals GROUP BY problem_id)",
    "random_pass_at_1",
)
def v25(spark, sf):
    return vo.random_expectation(fx.evals(spark, sf))


@query(
    "V26_oracle_expectation",
    "SELECT avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS oracle_pass_at_1, count(*) FILTER (a) AS correct, count(*) AS problems FROM (SELECT problem_id, bool_or(is_correct) AS a FROM evals GROUP BY problem_id)",
    "oracle_pass_at_1",
)
def v26(spark, sf):
    return vo.oracle_expectation(fx.evals(spark, sf))


@query(
    "V27_first_answered",
    """SELECT problem_id, min(CASE WHEN extracted_answer IS NOT NULL THEN traj_idx END) AS selected_idx,
    arg_min(extracted_answer, CASE WHEN extracted_answer IS NOT NULL THEN traj_idx END) AS answer,
    coalesce(arg_min(is_correct, CASE WHEN extracted_answer IS NOT NULL THEN traj_idx END), false) AS is_correct FROM traces WHERE traj_idx < 4 GROUP BY problem_id""",
)
def v27(spark, sf):
    return vo.first_answered(traces(spark, sf), 4)


@query(
    "V28_any_of_n",
    "SELECT avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS problems FROM (SELECT problem_id, bool_or(is_correct) AS a FROM traces WHERE traj_idx < 8 GROUP BY problem_id)",
    "accuracy",
)
def v28(spark, sf):
    return vo.any_of_n(traces(spark, sf), 8)


@query(
    "V29_parameter_grid",
    f"""SELECT g.select_percent, g.num_std, avg(CASE WHEN e.is_correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM
    (SELECT * FROM (VALUES (10.0), (30.0), (50.0)) a(select_percent), (VALUES (1.0), (2.0)) b(num_std)) g
    JOIN (SELECT s.num_std, s.select_percent, problem_id, arg_min(traj_idx, row(-v, mc, mi)) AS mi FROM (SELECT num_std, select_percent, problem_id, key, count(*) AS v, min(centroid) AS mc, arg_min(traj_idx, r) AS mi, arg_min(traj_idx, r) AS traj_idx FROM
      (SELECT *, row_number() OVER (PARTITION BY num_std, select_percent, problem_id ORDER BY centroid, traj_idx) AS r, count(*) OVER (PARTITION BY num_std, select_percent, problem_id) AS n FROM
        (SELECT c.*, b.num_std, a.select_percent FROM centred c, (VALUES (10.0), (30.0), (50.0)) a(select_percent), (VALUES (1.0), (2.0)) b(num_std)
         WHERE NOT (std_c > 0 AND (centroid < mean_c - num_std * std_c OR centroid > mean_c + num_std * std_c))))
      WHERE r <= greatest(1, floor(n * select_percent / 100.0)) GROUP BY num_std, select_percent, problem_id, key) s GROUP BY ALL) p ON p.num_std = g.num_std AND p.select_percent = g.select_percent
    JOIN evals e ON e.problem_id = p.problem_id AND e.traj_idx = p.mi GROUP BY g.select_percent, g.num_std""",
    "select_percent num_std accuracy",
)
def v29(spark, sf):
    """A selector over a parameter grid: outlier width x voting share, all combinations in one plan."""
    from ..operators.spread import ranked, with_group

    grid = vo.parameter_grid(spark, select_percent=[10.0, 30.0, 50.0], num_std=[1.0, 2.0])
    rows = trajectories(spark, sf).filter("centroid IS NOT NULL").withColumn("key", vo.answer_key(F.col("extracted_answer")))
    rows = with_group(rows, ["problem_id"], m=F.avg("centroid"), s=F.stddev_pop("centroid")).crossJoin(F.broadcast(grid))
    far = (F.col("s") > 0) & (F.abs(F.col("centroid") - F.col("m")) > F.col("num_std") * F.col("s"))
    key = ["select_percent", "num_std", "problem_id"]
    rows = ranked(rows.filter(~far), key, "centroid", [F.col("traj_idx")], "r", total="n")
    rows = rows.filter(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("n") * F.col("select_percent") / 100)))
    per = rows.groupBy(*key, "key").agg(F.count(F.lit(1)).alias("v"), F.min(F.struct("centroid", "traj_idx", "is_correct")).alias("b"))
    win = per.groupBy(*key).agg(F.min(F.struct((-F.col("v")).alias("v"), "b")).alias("w"))
    return win.groupBy("select_percent", "num_std").agg(F.avg(F.col("w.b.is_correct").cast("double")).alias("accuracy"))


@query(
    "V30_confident_output",
    """SELECT problem_id, traj_idx AS selected_idx, concat('answer ', coalesce(extracted_answer, '-')) AS output FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(mean_confidence, 9) DESC, traj_idx) AS r
    FROM traces WHERE traj_idx < 8) WHERE r = 1""",
)
def v30(spark, sf):
    t = _mean9(spark, sf).withColumn("output", F.concat(F.lit("answer "), F.coalesce("extracted_answer", F.lit("-"))))
    return vo.most_confident_output(t, "mean_confidence", 8, "output")
