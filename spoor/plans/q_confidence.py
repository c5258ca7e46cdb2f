"""Queries for trace confidence (C-04 .. C-14)."""

from pyspark.sql import functions as F

from ..functions import probs
from ..operators import confidence as cf
from ..operators import entropy as en
from . import fixtures as fx
from .inputs import WINDOW, confs, half_even, traces
from .registry import CTES, query

POS = ["traj_num", "position"]


@query("C04_token_confidence", "SELECT traj_id, position, conf FROM confs", "conf")
def c04(spark, sf):
    return cf.token_confidence(fx.candidates(spark, sf), POS).withColumnRenamed("traj_num", "traj_id")


@query("C05_confidence_from_probs", f"SELECT traj_num, position, {half_even('-avg(ln(p + 1e-30))')} AS conf FROM cand_probs GROUP BY traj_num, position", "conf")
def c05(spark, sf):
    sets = en.position_probs(fx.candidates(spark, sf), POS, 4)
    return sets.select(*POS, probs.confidence_from_probs(F.col("top_k_probs")).alias("conf"))


@query("C06_mean_confidence", "SELECT traj_id, avg(conf) AS mean_confidence FROM confs GROUP BY traj_id", "mean_confidence")
def c06(spark, sf):
    return cf.mean_confidence(confs(spark, sf))


@query("C07_tail_confidence", f"SELECT traj_id, avg(conf) AS tail_confidence FROM confs WHERE i >= n - {WINDOW} GROUP BY traj_id", "tail_confidence")
def c07(spark, sf):
    return cf.tail_confidence(cf.sized(confs(spark, sf)), WINDOW)


@query("C08_window_means", "SELECT traj_id, i, m AS window_mean FROM windows", "window_mean")
def c08(spark, sf):
    return cf.window_means(confs(spark, sf), WINDOW).select("traj_id", "i", "window_mean")


@query(
    "C08_min_conf",
    f"""SELECT c.traj_id, coalesce(any_value(w.l), avg(conf)) AS min_conf FROM confs c LEFT JOIN
    (SELECT traj_id, min({half_even('m')}) AS l FROM windows GROUP BY traj_id) w ON w.traj_id = c.traj_id GROUP BY c.traj_id""",
    "min_conf",
)
def c08b(spark, sf):
    return cf.least_grouped(confs(spark, sf), WINDOW)


@query("C09_bottom_windows", "SELECT traj_id, bottom_window_confidence FROM conf_rows", "bottom_window_confidence")
def c09(spark, sf):
    return cf.bottom_windows(confs(spark, sf), WINDOW)


@query("C10_min_window", "SELECT traj_id, min_window_confidence FROM conf_rows", "min_window_confidence")
def c10(spark, sf):
    return cf.min_window(confs(spark, sf), WINDOW)


_FOUR = "mean_confidence tail_confidence bottom_window_confidence min_window_confidence"


@query("C11_all_confidences", "SELECT * FROM conf_rows", _FOUR)
def c11(spark, sf):
    return cf.all_confidences(confs(spark, sf), WINDOW, WINDOW)


@query(
    "C12_top_confidence",
    """SELECT t.problem_id, traj_idx, tail_confidence FROM traces t JOIN (SELECT problem_id, quantile_cont(tail_confidence, 0.9) AS cut FROM traces GROUP BY problem_id) c
    ON c.problem_id = t.problem_id WHERE round(tail_confidence, 9) >= round(cut, 9)""",
    "tail_confidence",
)
def c12(spark, sf):
    t = traces(spark, sf).withColumn("tail_confidence", F.round("tail_confidence", 9))
    return cf.top_confidence(t, "tail_confidence").select("problem_id", "traj_idx", "tail_confidence")


WARMUP, ETA = 8, 90.0
CTES["online"] = f"""SELECT t.*, b.conf_bar, CASE WHEN traj_idx < {WARMUP} THEN 'warmup' ELSE 'final' END AS phase,
  traj_idx >= {WARMUP} AND round(min_window_confidence, 6) < round(b.conf_bar, 6) AS stopped FROM traces t JOIN
  (SELECT problem_id, quantile_cont(round(min_window_confidence, 6), 0.1) AS conf_bar FROM traces WHERE traj_idx < {WARMUP} GROUP BY problem_id) b ON b.problem_id = t.problem_id"""


def online(spark, sf):
    t = traces(spark, sf).withColumn("min_window_confidence", F.round("min_window_confidence", 6))
    return cf.online_stops(t, WARMUP, ETA, "min_window_confidence").withColumn("conf_bar", F.round("conf_bar", 6)).withColumn(
        "stopped", (F.col("phase") == "final") & (F.col("min_window_confidence") < F.col("conf_bar"))
    )


@query("C13_online_stops", "SELECT problem_id, traj_idx, conf_bar, phase, stopped FROM online", "conf_bar")
def c13(spark, sf):
    return online(spark, sf).select("problem_id", "traj_idx", "conf_bar", "phase", "stopped")


@query(
    "C14_self_certainty",
    "SELECT traj_num, sum(mask * (-logprob_sum / 50.0 - ln(50))) / sum(mask) AS self_certainty FROM (SELECT traj_num, position, sum(logprob) AS logprob_sum, CASE WHEN position >= 1 THEN 1 ELSE 0 END AS mask FROM candidates GROUP BY traj_num, position) GROUP BY traj_num HAVING sum(mask) > 0",
    "self_certainty",
)
def c14(spark, sf):
    rows = fx.candidates(spark, sf).groupBy(*POS).agg(F.sum("logprob").alias("logprob_sum"))
    rows = rows.withColumn("mask", F.when(F.col("position") >= 1, 1).otherwise(0))
    return cf.self_certainty(rows, ["traj_num"], 50).filter("self_certainty IS NOT NULL")
