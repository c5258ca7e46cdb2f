"""Queries for agent runs (A-01 .. A-27, J-03, J-07, J-08)."""

from pyspark.sql import functions as F

from ..functions import keys as k
from ..operators import agent as ag
from ..operators import metrics as me
from . import fixtures as fx
from .q_metrics import MAX_K
from .registry import CTES, query

KS = range(1, MAX_K + 1)

# Tasks: one per customer, actions spelled by digits of the key; issue and persona from it too.
CTES["agent_tasks"] = """SELECT c_custkey AS task_id, c_custkey % 4 AS n_agent, c_custkey % 3 AS n_user, c_custkey % 5 AS n_env, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END AS n_nl,
  (c_custkey % 4 + c_custkey % 3 = 1 AND c_custkey % 2 = 0) AS transfer FROM customer"""
CTES["task_info"] = "SELECT task_id, n_agent AS num_agent_actions, n_user AS num_user_actions, CASE WHEN transfer THEN -1 ELSE n_agent + n_user END AS num_actions, n_env AS num_env_assertions, coalesce(n_nl, 0) AS num_nl_assertions FROM agent_tasks"


def tasks(spark, sf):
    c = F.col("c_custkey")
    name = F.when(c % 2 == 0, "Transfer_to_human").otherwise("update")

    def acts(n, who):
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= n), lambda i: F.struct(F.lit(who).alias("requestor"), name.alias("name"))
        )

    strings = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= n), lambda i: i.cast("string"))
    return fx.table(spark, sf, "customer").select(
        c.alias("task_id"),
        F.concat(acts(c % 4, "assistant"), acts(c % 3, "user")).alias("actions"),
        strings(c % 5).alias("env_assertions"),
        F.when(c % 7 == 0, None).otherwise(F.array(F.lit("x"))).alias("nl_assertions"),
    )


_INFO = ["num_agent_actions", "num_user_actions", "num_actions", "num_env_assertions", "num_nl_assertions"]


@query("A02_task_counts", "SELECT task_id, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in _INFO) + " FROM task_info")
def a02(spark, sf):
    return ag.task_counts(tasks(spark, sf))


@query(
    "A01_flat_runs",
    "SELECT r.run_id, r.task_id, r.trial, r.reward, r.agent_cost, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in _INFO) + " FROM runs r JOIN task_info t ON t.task_id = r.task_id",
    "reward agent_cost",
)
def a01(spark, sf):
    return ag.flat_runs(fx.runs(spark, sf), tasks(spark, sf)).select("run_id", "task_id", "trial", "reward", "agent_cost", *_INFO)


@query("J03_runs_with_tasks", "SELECT r.run_id, t.num_env_assertions > 2 AS many FROM runs r JOIN task_info t ON t.task_id = r.task_id")
def j03(spark, sf):
    j = ag.flat_runs(fx.runs(spark, sf), tasks(spark, sf))
    return j.select("run_id", (F.col("num_env_assertions") > 2).alias("many"))


# Golden actions are the odd lines of an order, tool calls all even ones.
CTES["golden"] = "SELECT l_orderkey AS run_id, concat(CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_extendedprice AS STRING)) AS action_id, concat(l_returnflag, l_linestatus) AS name, CAST(l_quantity AS INT) % 3 AS q, CAST(l_suppkey AS INT) % 2 AS s, l_partkey % 4 AS mode FROM lineitem WHERE l_linenumber % 2 = 1"
CTES["calls"] = "SELECT l_orderkey AS run_id, concat(l_returnflag, l_linestatus) AS name, CAST(l_quantity AS INT) % 3 AS q, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey AS INT) % 2 END AS s FROM lineitem WHERE l_linenumber % 2 = 0"
CTES["matched_actions"] = """SELECT DISTINCT g.run_id, g.action_id, EXISTS (SELECT 1 FROM calls c WHERE c.run_id = g.run_id AND c.name = g.name AND
  CASE g.mode WHEN 0 THEN true WHEN 1 THEN c.q = g.q WHEN 2 THEN c.q = g.q AND c.s IS NOT NULL AND c.s = g.s ELSE c.q = g.q AND (c.s IS NULL OR c.s = g.s) END) AS action_match FROM golden g"""


def golden(spark, sf):
    s = lambda c: F.col(c).cast("string")
    li = fx.table(spark, sf, "lineitem").filter("l_linenumber % 2 = 1")
    mode = F.col("l_partkey") % 4
    args = F.create_map(F.lit("q"), (F.col("l_quantity").cast("int") % 3).cast("string"), F.lit("s"), (F.col("l_suppkey").cast("int") % 2).cast("string"))
    sets = F.when(mode == 0, F.expr("cast(array() as array<string>)")).when(mode == 1, F.array(F.lit("q"))).when(mode == 2, F.array(F.lit("s"), F.lit("q")))
    rows = li.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("-", s("l_linenumber"), s("l_partkey"), s("l_suppkey"), F.col("l_extendedprice").cast("string")).alias("action_id"),
        F.concat("l_returnflag", "l_linestatus").alias("name"),
        args.alias("arguments"),
        sets.alias("compare_args"),
    )
    return rows.dropDuplicates(["run_id", "action_id"])


def calls(spark, sf):
    li = fx.table(spark, sf, "lineitem").filter("l_linenumber % 2 = 0")
    q, s = (F.col("l_quantity").cast("int") % 3).cast("string"), (F.col("l_suppkey").cast("int") % 2).cast("string")
    args = F.when(F.col("l_partkey") % 5 == 0, F.create_map(F.lit("q"), q)).otherwise(F.create_map(F.lit("q"), q, F.lit("s"), s))
    return li.select(F.col("l_orderkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("name"), args.alias("arguments"))


@query("J07_action_matches", "SELECT run_id, count(*) AS n_actions, count(*) FILTER (action_match) AS n_matched FROM matched_actions GROUP BY run_id")
def j07(spark, sf):
    m = ag.action_matches(golden(spark, sf), calls(spark, sf))
    return m.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_actions"), F.count_if("action_match").alias("n_matched"))


@query(
    "A04_argument_match",
    "SELECT action_match, count(*) AS n FROM (SELECT DISTINCT m.run_id, m.action_id, m.action_match FROM matched_actions m) GROUP BY action_match",
)
def a04(spark, sf):
    m = ag.action_matches(golden(spark, sf), calls(spark, sf))
    return m.groupBy("action_match").agg(F.count(F.lit(1)).alias("n"))


CTES["action_scores"] = "SELECT o_orderkey AS run_id, coalesce(CAST(min(CAST(action_match AS INT)) AS DOUBLE), 1.0) AS action_reward FROM orders LEFT JOIN matched_actions m ON m.run_id = o_orderkey GROUP BY o_orderkey"


@query("A03_action_rewards", "SELECT run_id, action_reward FROM action_scores", "action_reward")
def a03(spark, sf):
    runs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    return ag.action_rewards(runs, ag.action_matches(golden(spark, sf), calls(spark, sf)))


CTES["info_strings"] = "SELECT DISTINCT conv_id AS run_id, w AS info FROM conversations, (SELECT unnest(['The', 'model', 'and', 'zebra', '1']) AS w) WHERE (conv_id + length(w)) % 2 = 0"
CTES["info_met"] = "SELECT i.run_id, i.info, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = i.run_id AND c.role = 'assistant' AND contains(replace(lower(c.text), ',', ''), lower(i.info))) AS met FROM info_strings i"


def infos(spark, sf):
    c = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    w = F.explode(F.array(*[F.lit(x) for x in ("The", "model", "and", "zebra", "1")]))
    return c.withColumn("info", w).filter((F.col("run_id") + F.length("info")) % 2 == 0)


def messages(spark, sf):
    return fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), "role", F.col("text").alias("content"))


@query("J08_communicated", "SELECT run_id, info, met FROM info_met")
def j08(spark, sf):
    return ag.communicated(infos(spark, sf), messages(spark, sf))


@query("A05_communication_rewards", "SELECT run_id, CAST(min(CAST(met AS INT)) AS DOUBLE) AS communicate_reward FROM info_met GROUP BY run_id", "communicate_reward")
def a05(spark, sf):
    checks = ag.communicated(infos(spark, sf), messages(spark, sf))
    return ag.communication_rewards(infos(spark, sf).select("run_id").distinct(), checks)


_PREM = "termination_reason <> 'agent_stop'"


@query(
    "A06_combined_reward",
    f"SELECT run_id, CASE WHEN {_PREM} THEN 0.0 WHEN run_id % 4 = 0 THEN 1.0 WHEN run_id % 4 = 1 THEN 0.5 WHEN run_id % 4 = 2 THEN 0.5 * coalesce(reward, 1) ELSE 0.5 END AS combined FROM runs",
    "combined",
)
def a06(spark, sf):
    r = fx.runs(spark, sf)
    m = F.col("run_id") % 4
    basis = F.when(m == 1, F.array(F.lit("ACTION"))).when(m == 2, F.array(F.lit("ACTION"), F.lit("COMMUNICATE"))).when(m == 3, F.array(F.lit("ACTION"), F.lit("ACTION")))
    parts = F.create_map(F.lit("ACTION"), F.lit(0.5), F.lit("COMMUNICATE"), F.col("reward"))
    early = F.col("termination_reason") != "agent_stop"
    return r.select("run_id", ag.combined_reward(parts, basis, early, m != 0).alias("combined"))


CTES["rewarded"] = """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS reward, o_orderkey % 3 = 0 AS no_breakdown,
  o_orderkey % 2 = 0 AS has_comm, a.n_write, a.n_ok FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag = 'A' ELSE l_returnflag = 'R' END) AS n_write,
  count(*) FILTER (l_discount > 0.05 AND CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag = 'A' ELSE l_returnflag = 'R' END) AS n_ok FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey = o_orderkey"""
CTES["reward_rows"] = """SELECT run_id, coalesce(reward = 1, false) AS success, CASE WHEN has_comm THEN CASE WHEN no_breakdown THEN false ELSE coalesce(reward = 1, false) END END AS communication,
  CAST(NULL AS BOOLEAN) AS environment, CASE WHEN no_breakdown THEN false ELSE run_id % 5 <> 0 END AS database, CAST(coalesce(n_ok, 0) AS INT) AS num_correct_write_action, CAST(coalesce(n_write, 0) AS INT) AS num_write_action FROM rewarded"""


def rewarded(spark, sf):
    """Runs with a reward breakdown and their action checks as one array per run (lines of one order)."""
    li = fx.table(spark, sf, "lineitem")
    check = F.struct(
        F.when(F.col("l_linenumber") % 2 == 1, "assistant").otherwise("user").alias("requestor"),
        F.col("l_returnflag").alias("name"),
        (F.col("l_discount") > 0.05).alias("action_match"),
    )
    checks = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(check).alias("action_checks"))
    o = fx.table(spark, sf, "orders").join(checks, "o_orderkey", "left")
    key = F.col("o_orderkey")
    reward = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    basis = F.when(key % 2 == 0, F.array(F.lit("DB"), F.lit("COMMUNICATE"))).otherwise(F.array(F.lit("DB")))
    parts = F.create_map(F.lit("COMMUNICATE"), reward, F.lit("DB"), F.when(key % 5 == 0, 0.0).otherwise(1.0))
    return o.select(key.alias("run_id"), reward.alias("reward"), basis.alias("reward_basis"), F.when(key % 3 == 0, None).otherwise(parts).alias("reward_breakdown"), "action_checks")


@query("A07_reward_analysis", "SELECT * FROM reward_rows")
def a07(spark, sf):
    return ag.reward_analysis(rewarded(spark, sf), ["A"], ["R"])


@query(
    "A08_reward_actions",
    "SELECT requestor, action_name, action_match, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'assistant' ELSE 'user' END AS requestor, l_returnflag AS action_name, l_discount > 0.05 AS action_match FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 <> 0) GROUP BY ALL",
)
def a08(spark, sf):
    rows = ag.reward_actions(rewarded(spark, sf))
    return rows.groupBy("requestor", "action_name", "action_match").agg(F.count(F.lit(1)).alias("n"))


CTES["run_actions"] = "SELECT a.*, r.llm, r.mode, r.domain FROM actions a JOIN runs r ON r.run_id = a.run_id"
_COLS = [("BUILDING", "1-URGENT"), ("MACHINERY", "5-LOW")]


@query(
    "A09_action_success",
    "SELECT action_name, avg(CASE WHEN action_match THEN 1.0 ELSE 0.0 END) FILTER (llm = 'BUILDING' AND mode = '1-URGENT') AS building_urgent, avg(CASE WHEN action_match THEN 1.0 ELSE 0.0 END) FILTER (llm = 'MACHINERY' AND mode = '5-LOW') AS machinery_low, count(*) / CAST((SELECT count(*) FROM run_actions) AS DOUBLE) AS frequency FROM run_actions GROUP BY action_name",
    "building_urgent machinery_low frequency",
)
def a09(spark, sf):
    rows = fx.actions(spark, sf).join(fx.runs(spark, sf).select("run_id", "llm", "mode"), "run_id")
    out = ag.action_success(rows, _COLS)
    return out.withColumnsRenamed({"BUILDING|1-URGENT": "building_urgent", "MACHINERY|5-LOW": "machinery_low"})


# Per-task pass^k by (llm, mode), null where a task has fewer than k trials; modes fold into two.
CTES["mode_pass"] = (
    "SELECT *, 'i' || CAST(task_id % 3 AS STRING) AS intent, CASE WHEN task_id % 2 = 0 THEN 'Easy' ELSE 'Hard' END AS persona, t_actions AS num_actions, CASE WHEN t_actions = 0 THEN -1 ELSE task_id % 4 END AS num_issues FROM (SELECT p.*, (task_id % 4 + task_id % 3) AS t_actions, "
    + ", ".join(f"CASE WHEN n >= {kk} THEN ({' * '.join(f'greatest(c - {i}.0, 0)' for i in range(kk))}) / ({' * '.join(f'(n - {i}.0)' for i in range(kk))}) END AS pass_hat_{kk}" for kk in (1, 2))
    + " FROM (SELECT llm, domain, CASE WHEN mode < '3' THEN 'default' ELSE 'no-user' END AS mode, task_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (abs(reward - 1) <= 1e-6) AS DOUBLE) AS c FROM runs GROUP BY ALL) p)"
)
K2 = [1, 2]


def mode_pass(spark, sf):
    r = fx.runs(spark, sf).withColumn("mode", F.when(F.col("mode") < "3", "default").otherwise("no-user"))
    per = me.task_pass_hat_k(r, ["llm", "domain", "mode", "task_id"], 2, k.succeeded_strictly(F.col("reward")))
    t = F.col("task_id")
    size = (t % 4 + t % 3)
    return per.withColumns(
        {
            "intent": F.concat(F.lit("i"), (t % 3).cast("string")),
            "persona": F.when(t % 2 == 0, "Easy").otherwise("Hard"),
            "num_actions": size,
            "num_issues": F.when(size == 0, -1).otherwise(t % 4),
        }
    )


def _by(cols, std="stddev_samp"):
    c = ", ".join(cols)
    return " UNION ALL ".join(
        f"SELECT {c}, {kk} AS k, avg(pass_hat_{kk}) AS mean, {std}(pass_hat_{kk}) AS std, count(*) AS n_tasks FROM mode_pass GROUP BY {c}" for kk in K2
    )


for _id, _cols in {
    "A10_pass_by_intent": ["llm", "intent"],
    "A11_pass_by_persona": ["llm", "persona"],
    "A12_pass_by_persona_mode": ["persona", "mode"],
    "A17_pass_by_domain": ["llm", "domain"],
    "A25_pass_by_mode": ["llm", "mode"],
}.items():

    @query(_id, _by(_cols), "mean std")
    def _pass(spark, sf, cols=_cols):
        return ag.pass_by(mode_pass(spark, sf), cols, K2)


@query("A24_pass_one_by_mode", "SELECT llm, mode, 1 AS k, avg(pass_hat_1) AS mean, stddev_samp(pass_hat_1) AS std, count(*) AS n_tasks FROM mode_pass GROUP BY llm, mode", "mean std")
def a24(spark, sf):
    return ag.pass_by(mode_pass(spark, sf), ["llm", "mode"], [1])


@query(
    "A13_mode_difference",
    " UNION ALL ".join(f"SELECT llm, {kk} AS k, avg(pass_hat_{kk}) FILTER (mode = 'no-user') - avg(pass_hat_{kk}) FILTER (mode = 'default') AS difference FROM mode_pass GROUP BY llm" for kk in K2),
    "difference",
)
def a13(spark, sf):
    return ag.mode_difference(mode_pass(spark, sf), "no-user", "default", K2)


def _sized(size, kk):
    return f"""SELECT g.llm, g.mode, s.{size}, s.task_share, coalesce(m.p, 0) AS pass_k FROM (SELECT DISTINCT llm, mode FROM mode_pass) g
    JOIN (SELECT llm, {size}, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY llm) AS task_share FROM mode_pass WHERE mode = 'default' GROUP BY llm, {size}) s ON s.llm = g.llm
    LEFT JOIN (SELECT llm, mode, {size}, avg(pass_hat_{kk}) AS p FROM mode_pass GROUP BY llm, mode, {size}) m ON m.llm = g.llm AND m.mode = g.mode AND m.{size} = s.{size}"""


@query("A14_pass_by_actions", _sized("num_actions", 2), "task_share pass_k")
def a14(spark, sf):
    return ag.pass_by_size(mode_pass(spark, sf), "num_actions", 2, "default")


@query("A15_pass_by_issues", _sized("num_issues", 2), "task_share pass_k")
def a15(spark, sf):
    return ag.pass_by_size(mode_pass(spark, sf), "num_issues", 2, "default")


@query(
    "A26_curves_one_mode",
    f"SELECT 'actions' AS curve, llm, num_actions AS size, task_share, pass_k FROM ({_sized('num_actions', 1)}) WHERE mode = 'default' UNION ALL SELECT 'issues' AS curve, llm, num_issues AS size, task_share, pass_k FROM ({_sized('num_issues', 1)}) WHERE mode = 'default'",
    "task_share pass_k",
)
def a26(spark, sf):
    out = None
    for curve, size in (("actions", "num_actions"), ("issues", "num_issues")):
        d = ag.pass_by_size(mode_pass(spark, sf), size, 1, "default").filter("mode = 'default'")
        d = d.select(F.lit(curve).alias("curve"), "llm", F.col(size).alias("size"), "task_share", "pass_k")
        out = d if out is None else out.unionByName(d)
    return out


@query("A16_mean_over_k", f"SELECT llm, mode, avg(mean) AS mean_pass, stddev_pop(mean) AS std_pass FROM ({_by(['llm', 'mode'])}) GROUP BY llm, mode", "mean_pass std_pass")
def a16(spark, sf):
    return ag.mean_over_k(mode_pass(spark, sf), K2)


_LEN = "CASE WHEN num_actions BETWEEN 1 AND 3 THEN '1-3' WHEN num_actions BETWEEN 4 AND 6 THEN '4-6' ELSE '7+' END"


@query(
    "A18_failure_shares",
    f"SELECT {_LEN} AS length_class, count(*) AS n, avg(CASE WHEN database THEN 0.0 ELSE 1.0 END) AS db_failures, avg(CASE WHEN NOT communication THEN 1.0 WHEN communication THEN 0.0 END) AS communication_failures, avg(num_correct_write_action) AS mean_correct_writes FROM (SELECT w.*, run_id % 9 AS num_actions FROM reward_rows w) WHERE num_actions >= 1 GROUP BY length_class",
    "db_failures communication_failures mean_correct_writes",
)
def a18(spark, sf):
    rows = ag.reward_analysis(rewarded(spark, sf), ["A"], ["R"]).withColumn("num_actions", F.col("run_id") % 9)
    return ag.failure_shares(rows)


CTES["reward_keys"] = "SELECT w.*, r.llm, r.domain, r.mode FROM reward_rows w JOIN runs r ON r.run_id = w.run_id"
_FAILED = "coalesce(count(*) FILTER (NOT {0}) / CAST(nullif(count({0}), 0) AS DOUBLE), 0) AS {1}"
_CHECKS = ", ".join(["count(*) AS n, count(database) AS db_checks, count(communication) AS communication_checks", _FAILED.format("database", "db_failures"), _FAILED.format("communication", "communication_failures")])


def reward_keys(spark, sf):
    keys = fx.runs(spark, sf).select("run_id", "llm", "domain", "mode")
    return ag.reward_analysis(rewarded(spark, sf), ["A"], ["R"]).join(keys, "run_id")


@query(
    "A18_check_failures",
    f"SELECT llm, domain, {_CHECKS} FROM reward_keys WHERE mode = '1-URGENT' AND NOT starts_with(domain, 'ASIA') GROUP BY llm, domain UNION ALL SELECT 'all' AS llm, domain, {_CHECKS} FROM reward_keys WHERE mode = '1-URGENT' AND NOT starts_with(domain, 'ASIA') GROUP BY domain",
    "db_failures communication_failures",
)
def a18c(spark, sf):
    """Per model and domain, then over all models."""
    rows = reward_keys(spark, sf)
    whole = ag.check_failures(rows, ["domain"], "1-URGENT", "ASIA").withColumn("llm", F.lit("all"))
    return ag.check_failures(rows, ["llm", "domain"], "1-URGENT", "ASIA").unionByName(whole)


@query(
    "A18_write_proportions",
    f"""SELECT llm, length_class, CAST(least(len(list_filter([{", ".join(f"CAST({e!r} AS DOUBLE)" for e in ag.EDGES)}], lambda e: e <= share)), 10) - 1 AS INT) AS bin, count(*) AS n
    FROM (SELECT llm, num_correct_write_action / CAST(num_write_action AS DOUBLE) AS share, CASE WHEN num_write_action <= 3 THEN 'short' WHEN num_write_action <= 6 THEN 'medium' ELSE 'long' END AS length_class
    FROM reward_keys WHERE mode = '1-URGENT' AND domain = 'ASIA' AND num_write_action > 0 AND NOT success) GROUP BY ALL""",
)
def a18d(spark, sf):
    return ag.write_proportions(reward_keys(spark, sf), "1-URGENT", "ASIA", failed_only=True)


@query("A18_write_histogram", "SELECT num_write_action, num_correct_write_action, count(*) AS n FROM reward_rows GROUP BY num_write_action, num_correct_write_action")
def a18b(spark, sf):
    return ag.write_histogram(ag.reward_analysis(rewarded(spark, sf), ["A"], ["R"]))


@query("A19_costs", "SELECT llm, avg(agent_cost) AS mean_cost, round(sum(agent_cost), 4) AS total_cost FROM runs GROUP BY llm", "mean_cost total_cost")
def a19(spark, sf):
    return ag.costs(fx.runs(spark, sf)).withColumn("total_cost", F.round("total_cost", 4))


@query("A20_tagged_union", "SELECT llm, experiment, count(*) AS n FROM (SELECT llm, 'one' AS experiment FROM runs WHERE mode < '3' UNION ALL SELECT llm, 'two' AS experiment FROM runs WHERE mode >= '3') GROUP BY llm, experiment")
def a20(spark, sf):
    r = fx.runs(spark, sf)
    u = ag.tagged_union([({"experiment": "one"}, r.filter("mode < '3'")), ({"experiment": "two"}, r.filter("mode >= '3'"))])
    return u.groupBy("llm", "experiment").agg(F.count(F.lit(1)).alias("n"))


_PK = ", ".join(f"avg(pass_hat_{i}) * 100 AS pass_{i}" for i in KS)
CTES["board"] = f"SELECT p.*, c.cost FROM (SELECT llm, domain, {_PK} FROM task_pass GROUP BY llm, domain) p JOIN (SELECT llm, domain, avg(agent_cost) AS cost FROM runs GROUP BY llm, domain) c ON c.llm = p.llm AND c.domain = p.domain"
_PKD = " ".join(f"pass_{i}" for i in KS) + " cost"


@query("A21_leaderboard", "SELECT * FROM board", _PKD)
def a21(spark, sf):
    return ag.leaderboard(fx.runs(spark, sf), list(KS))


@query(
    "A22_submission_check",
    "SELECT llm, domain, 'pass_1' AS metric, pass_1 + 1 AS submitted, pass_1 AS computed FROM board WHERE domain = 'ASIA' UNION ALL SELECT llm, domain, 'cost' AS metric, CAST(NULL AS DOUBLE) AS submitted, cost AS computed FROM board WHERE domain = 'EUROPE'",
    "submitted computed",
)
def a22(spark, sf):
    board = ag.leaderboard(fx.runs(spark, sf), list(KS))
    sub = board.withColumn("pass_1", F.when(F.col("domain") == "ASIA", F.col("pass_1") + 1).otherwise(F.col("pass_1")))
    sub = sub.withColumn("cost", F.when(F.col("domain") != "EUROPE", F.col("cost")))
    return ag.submission_check(sub, board, ["pass_1", "pass_2", "cost"], tolerance=1e-9)


@query("A23_trajectory_set_check", "SELECT max(f) = 1 AS domains_unique, (SELECT count(DISTINCT llm) FROM runs) = 1 AS one_model FROM (SELECT domain, count(DISTINCT mode) AS f FROM runs GROUP BY domain)")
def a23(spark, sf):
    return ag.trajectory_set_check(fx.runs(spark, sf).withColumns({"file": F.col("mode"), "user_llm": F.lit("u")}))


@query(
    "A27_recomputed_rewards",
    f"""SELECT r.run_id, CASE WHEN {_PREM} THEN 0.0 WHEN r.run_id % 4 = 0 THEN 1.0 ELSE a.action_reward * CASE WHEN r.run_id % 4 = 2 THEN coalesce(c.cr, 1.0) ELSE 1.0 END END AS reward
    FROM runs r JOIN action_scores a ON a.run_id = r.run_id LEFT JOIN (SELECT run_id, CAST(min(CAST(met AS INT)) AS DOUBLE) AS cr FROM info_met GROUP BY run_id) c ON c.run_id = r.run_id""",
    "reward",
)
def a27(spark, sf):
    m = F.col("run_id") % 4
    basis = F.when(m == 2, F.array(F.lit("ACTION"), F.lit("COMMUNICATE"))).when(m != 0, F.array(F.lit("ACTION")))
    runs = fx.runs(spark, sf).select("run_id", "termination_reason", basis.alias("basis"), F.lit(1.0).alias("env_reward"))
    out = ag.recomputed_rewards(runs, golden(spark, sf), calls(spark, sf), infos(spark, sf), messages(spark, sf))
    return out.select("run_id", "reward")
