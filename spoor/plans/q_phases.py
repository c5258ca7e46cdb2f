"""Queries for high-entropy phases and centroids (H-01 .. H-20, C-01 .. C-03, S-12 shape)."""

from pyspark.sql import functions as F

from ..operators import centroid as ce
from ..operators import phases as ph
from . import fixtures as fx
from .inputs import SWEEP, centroid_sql, centroids
from .registry import CTES, query, shared


@query(
    "H01_thresholds",
    "SELECT traj_id, quantile_cont(entropy, 0.95) AS high, quantile_cont(entropy, 0.5) AS low FROM tokens WHERE entropy IS NOT NULL GROUP BY traj_id",
    "high low",
)
def h01(spark, sf):
    return ph.thresholds(fx.tokens(spark, sf))


@query("H02_phases", "SELECT traj_id, start, duration FROM found_phases")
def h02(spark, sf):
    return ph.phases(fx.tokens(spark, sf)).select("traj_id", "start", "duration")


@query("H02_phases_crossing_cuts", "SELECT traj_id, start, duration FROM wide_phases")
def h02b(spark, sf):
    """Top 30 / bottom 80: the high cut lies below the low one and the ordered scan takes over."""
    return ph.phases(fx.tokens(spark, sf), [(30.0, 80.0, 2)]).select("traj_id", "start", "duration")


for _id, _m in (("H03", "moment"), ("H04", "weighted_average"), ("H05", "weighted_average_center")):

    @query(f"{_id}_centroid_{_m}", f"SELECT traj_id, {_m} AS centroid FROM centroid_rows", "centroid")
    def _centroid(spark, sf, m=_m):
        t = fx.tokens(spark, sf)
        return ce.phase_summary(ph.phases(t), ce.lengths(t)).select("traj_id", F.col(m).alias("centroid"))


@query(
    "H06_raw_centroid",
    """SELECT traj_id, sum(entropy * position) FILTER (entropy >= 0) / sum(entropy) FILTER (entropy >= 0) / count(*) AS centroid, count(*) AS trajectory_length,
    sum(entropy) FILTER (entropy >= 0) AS total_entropy, avg(entropy) FILTER (entropy >= 0) AS mean_entropy, quantile_cont(entropy, 0.5) FILTER (entropy >= 0) AS median_entropy,
    stddev_pop(entropy) FILTER (entropy >= 0) AS std_entropy, min(entropy) FILTER (entropy >= 0) AS min_entropy, max(entropy) FILTER (entropy >= 0) AS max_entropy,
    count(*) FILTER (entropy >= 0) AS num_valid_tokens FROM tokens GROUP BY traj_id HAVING sum(entropy) FILTER (entropy >= 0) > 0""",
    "centroid total_entropy mean_entropy median_entropy std_entropy min_entropy max_entropy",
)
def h06(spark, sf):
    return ce.raw_centroid(fx.tokens(spark, sf))


@query(
    "H07_phase_statistics",
    """SELECT traj_id, num_heps, total_hep_weight, avg_hep_duration, first_hep_position, last_hep_position, hep_duration_variance, hep_duration_std,
    hep_position_variance, hep_position_std, hep_spread FROM centroid_rows""",
    "avg_hep_duration hep_duration_variance hep_duration_std hep_position_variance hep_position_std hep_spread",
)
def h07(spark, sf):
    t = fx.tokens(spark, sf)
    s = ce.phase_summary(ph.phases(t), ce.lengths(t))
    return s.drop("trajectory_length", "moment", "weighted_average", "weighted_average_center")


def analysed(spark, sf):
    return ce.analysed(centroids(spark, sf), fx.evals(spark, sf))


CTES["analysed"] = "SELECT * FROM trajectories WHERE centroid IS NOT NULL"


@query("H08_analysis", "SELECT traj_id, problem_id, centroid, num_heps, is_correct FROM analysed", "centroid")
def h08(spark, sf):
    return analysed(spark, sf).select("traj_id", "problem_id", "centroid", "num_heps", "is_correct")


@query(
    "H09_summary_counts",
    """SELECT count(*) FILTER (is_correct) AS n_correct_trajectories, count(*) FILTER (NOT is_correct) AS n_incorrect_trajectories,
    count(DISTINCT problem_id) AS n_problems, count(DISTINCT CASE WHEN is_correct THEN problem_id END) AS n_problems_with_correct,
    count(DISTINCT CASE WHEN NOT is_correct THEN problem_id END) AS n_problems_with_incorrect FROM analysed""",
)
def h09(spark, sf):
    return ce.summary_counts(analysed(spark, sf))


CTES["swept_rows"] = centroid_sql("swept_phases")


@query("H10_sweep", "SELECT traj_id, top, bottom, cons, weighted_average_center AS centroid, num_heps FROM swept_rows", "top bottom centroid")
def h10(spark, sf):
    """27 parameter sets: one scan, one pass per (bottom, cons), the tops share it."""
    c = ce.centroid_table(fx.tokens(spark, sf), SWEEP)
    return c.filter("centroid IS NOT NULL").select("traj_id", "top", "bottom", "cons", "centroid", "num_heps")


@query(
    "H11_method_table",
    """SELECT traj_id, 'hep' AS method, centroid, num_heps FROM trajectories UNION ALL
    SELECT traj_id, 'raw_entropy' AS method, sum(CASE WHEN entropy > 0 THEN entropy * position END) / sum(CASE WHEN entropy > 0 THEN entropy END) / count(*) AS centroid, 0 AS num_heps
    FROM tokens GROUP BY traj_id""",
    "centroid",
)
def h11(spark, sf):
    cols = ["traj_id", "centroid", "num_heps"]
    hep = centroids(spark, sf).select(*cols).withColumn("method", F.lit("hep"))
    raw = ce.centroid_table(fx.tokens(spark, sf), method="raw_entropy").select(*cols).withColumn("method", F.lit("raw_entropy"))
    return hep.unionByName(raw)


CTES["running_len"] = """SELECT t.traj_id, t.position, CAST(CASE WHEN t.entropy IS NULL THEN 0 ELSE s.len END AS BIGINT) AS duration FROM
  (SELECT *, count(entropy) OVER (PARTITION BY traj_id ORDER BY position) AS n_idx FROM tokens) t
  LEFT JOIN scan_rows s ON s.traj_id = t.traj_id AND s.n = t.n_idx"""


def _running(spark, sf):
    return shared("running_durations", spark, sf, lambda: ph.running_durations(fx.tokens(spark, sf)))


@query("H12_running_durations", "SELECT traj_id, position, duration FROM running_len")
def h12(spark, sf):
    return ph.running_durations(fx.tokens(spark, sf))


CTES["curves"] = """SELECT traj_id, t, a + (b - a) * (x - floor(x)) AS value FROM (SELECT traj_id, t, t * (n - 1) / 200.0 AS x, position, a, b FROM
  (SELECT traj_id, position, duration AS a, coalesce(lead(duration) OVER (PARTITION BY traj_id ORDER BY position), duration) AS b, count(*) OVER (PARTITION BY traj_id) AS n FROM running_len),
  (SELECT CAST(range AS INT) AS t FROM range(201))) WHERE position = CAST(floor(x) AS INT)"""
CTES["mean_curve"] = "SELECT is_correct, t, avg(value) AS mean_duration FROM curves c JOIN evals e ON e.traj_id = c.traj_id GROUP BY is_correct, t"


def _curves(spark, sf):
    return ce.resampled_curves(_running(spark, sf), ce.lengths(fx.tokens(spark, sf)))


@query("H13_resampled_curves", "SELECT traj_id, t, value FROM curves", "value")
def h13(spark, sf):
    return _curves(spark, sf)


@query("H14_mean_curves", "SELECT is_correct, t, mean_duration FROM mean_curve", "mean_duration")
def h14(spark, sf):
    return ce.mean_curves(_curves(spark, sf), fx.evals(spark, sf))


@query(
    "H15_smoothed_difference",
    """SELECT x.t, sum(k.w * d.diff) / (SELECT sum(exp(-0.5 * (r / 5.0) * (r / 5.0))) FROM (SELECT range AS r FROM range(-15, 16))) AS smooth
    FROM (SELECT CAST(range AS INT) AS t FROM range(201)) x CROSS JOIN (SELECT range AS r, exp(-0.5 * (range / 5.0) * (range / 5.0)) AS w FROM range(-15, 16)) k
    JOIN (SELECT t, max(CASE WHEN is_correct THEN mean_duration END) - max(CASE WHEN NOT is_correct THEN mean_duration END) AS diff FROM mean_curve GROUP BY t) d
      ON d.t = greatest(0, least(200, x.t + k.r)) GROUP BY x.t""",
    "smooth",
)
def h15(spark, sf):
    mean = ce.mean_curves(_curves(spark, sf), fx.evals(spark, sf))
    return ce.smoothed(ce.correct_minus_incorrect(mean), "t", "difference", 201)


def _measures(names):
    return " UNION ALL ".join(
        f"""SELECT is_correct, '{n}' AS measure, count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM analysed GROUP BY is_correct"""
        for n, c in ((n, n) for n in names)
    )


_A = ["centroid", "num_heps", "total_hep_weight"]
_B = ["hep_duration_variance", "hep_position_variance", "hep_spread"]
_D = "mean std min max q25 median q75"


@query("H16_group_comparison", _measures(_A), _D)
def h16(spark, sf):
    return ce.compare_groups(analysed(spark, sf), _A)


@query("H17_variance_comparison", _measures(_B), _D)
def h17(spark, sf):
    return ce.compare_groups(analysed(spark, sf), _B)


@query(
    "H18_group_differences",
    f"""SELECT measure, max(CASE WHEN is_correct THEN mean END) - max(CASE WHEN NOT is_correct THEN mean END) AS mean_difference,
    max(CASE WHEN is_correct THEN median END) - max(CASE WHEN NOT is_correct THEN median END) AS median_difference FROM ({_measures(_A)}) GROUP BY measure""",
    "mean_difference median_difference",
)
def h18(spark, sf):
    return ce.group_differences(ce.compare_groups(analysed(spark, sf), _A))


@query(
    "H19_problem_categories",
    """SELECT problem_id, cat1, cat2, cat3, cat1 AND cat2 AND cat3 AS cat_all FROM (
    SELECT problem_id, avg(centroid) FILTER (NOT is_correct) < avg(centroid) FILTER (is_correct) AS cat1,
      2 * count(*) FILTER (r <= 3 AND NOT is_correct) > least(3, count(*)) AS cat2, bool_or(r = 1 AND NOT is_correct) AS cat3
    FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY centroid, is_correct DESC, traj_idx) AS r FROM analysed) GROUP BY problem_id
    HAVING bool_or(is_correct) AND bool_or(NOT is_correct))""",
)
def h19(spark, sf):
    return ce.problem_categories(analysed(spark, sf))


@query(
    "H20_histogram",
    "SELECT is_correct, CAST(least(floor(centroid * 19), 18) AS INT) AS bin, count(*) AS n FROM analysed WHERE centroid BETWEEN 0 AND 1 GROUP BY is_correct, bin",
)
def h20(spark, sf):
    return ce.centroid_histogram(analysed(spark, sf))


@query("C01_score_entropy_mean", "SELECT traj_id, coalesce(-avg(entropy), 0) AS score FROM tokens GROUP BY traj_id", "score")
def c01(spark, sf):
    return ce.score_entropy_mean(fx.tokens(spark, sf))


@query("C02_score_entropy_min", "SELECT traj_id, coalesce(-min(entropy), 0) AS score FROM tokens GROUP BY traj_id", "score")
def c02(spark, sf):
    return ce.score_entropy_min(fx.tokens(spark, sf))


CTES["early_scores"] = """SELECT t.traj_id, CASE WHEN sum(entropy) FILTER (entropy >= cut) <> 0 THEN
  1 - sum(entropy * position) FILTER (entropy >= cut) / sum(entropy) FILTER (entropy >= cut) / count(*) ELSE 0 END AS score
  FROM tokens t LEFT JOIN (SELECT traj_id, quantile_cont(entropy, 0.7) AS cut FROM tokens GROUP BY traj_id) c ON c.traj_id = t.traj_id GROUP BY t.traj_id"""


@query("C03_score_early_entropy", "SELECT traj_id, score FROM early_scores", "score")
def c03(spark, sf):
    return ce.score_early_entropy(fx.tokens(spark, sf))
