"""Agent runs: flattening, rewards and reports (A-01 .. A-27, J-03, J-07, J-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import succeeded_strictly
from .metrics import task_pass_hat_k

# --- flattening ---------------------------------------------------------------------------


def task_counts(tasks: DataFrame) -> DataFrame:
    """A-02: per task, counts from its arrays (actions with requestor and name, assertions)."""
    by = lambda r: F.coalesce(F.size(F.filter("actions", lambda a: a["requestor"] == r)), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    one = (F.size("actions") == 1) & F.lower(F.get("actions", F.lit(0))["name"]).contains("transfer")
    agent = F.when(F.col("actions").isNull(), 0).otherwise(by("assistant"))
    user = F.when(F.col("actions").isNull(), 0).otherwise(by("user"))
    return tasks.select(
        "task_id",
        agent.alias("num_agent_actions"),
        user.alias("num_user_actions"),
        F.when(F.coalesce(one, F.lit(False)), -1).otherwise(agent + user).alias("num_actions"),
        size("env_assertions").alias("num_env_assertions"),
        size("nl_assertions").alias("num_nl_assertions"),
    )


def flat_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """A-01/J-03: one row per run with its task's counts; -1 actions for transfer-only tasks."""
    return runs.join(task_counts(tasks), "task_id")


def unpacked(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results records (info, tasks[], simulations[]) to run rows and task rows."""
    runs = results.select("info", F.explode("simulations").alias("s")).select(
        F.col("s.id").alias("simulation_id"),
        F.col("s.task_id").alias("task_id"),
        F.col("s.trial").alias("trial"),
        F.col("s.reward_info.reward").alias("reward"),
        F.col("s.agent_cost").alias("agent_cost"),
        F.col("s.termination_reason").alias("termination_reason"),
        F.size("s.messages").alias("num_messages"),
        F.col("info.environment_info.domain_name").alias("domain"),
        F.col("info.agent_info.llm").alias("llm"),
        F.col("info.num_trials").alias("num_trials"),
    )
    tasks = results.select(F.explode("tasks").alias("t")).select(
        F.col("t.id").alias("task_id"), "t.evaluation_criteria.*"
    )
    return runs, tasks.dropDuplicates(["task_id"])


# --- checks and rewards -------------------------------------------------------------------


def _restricted(args: Column, keys: Column) -> Column:
    """Sorted entries of a map on the given keys: equal maps give equal arrays."""
    return F.array_sort(F.map_entries(F.map_filter(args, lambda k, v: F.array_contains(keys, k))))


_TOLD = ["told_a", "told_b"]


def _told(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """128 bits of hash of a tool's name, the keys that count and the arguments cut to them; a row with a null among these equals none.

    A hash leaves nulls out, so each value comes with whether it is null.
    """
    values = F.transform(_restricted(F.col("arguments"), F.col("keys")), lambda e: F.struct(e["key"], e["value"].isNull(), e["value"]))
    some = rows.withColumn("values", values).filter("name IS NOT NULL AND keys IS NOT NULL AND values IS NOT NULL")
    parts = [F.col(c) for c in ("name", "own", "keys", "values")]
    return some.select(*keep, F.xxhash64(*parts).alias(_TOLD[0]), F.xxhash64(F.lit(1), *parts).alias(_TOLD[1]))


def action_matches(golden: DataFrame, calls: DataFrame) -> DataFrame:
    """J-07/A-04: whether a golden action has an equal tool call in its run.

    golden: run_id, action_id, name, arguments, compare_args (null: the call's
    own keys); calls: run_id, name, arguments. Which arguments count varies by
    row, so both sides are cut to each key set in use (few per tool) and then
    joined on equality. Pairs of calls and actions are never formed. The sets go
    to the rows and not the rows to their tool's name, of which there are few; what
    is compared travels as 128 bits of hash.
    """
    empty = F.expr("cast(array() as array<string>)")
    own = F.array_sort(F.map_keys("arguments"))
    g = golden.withColumn("named", F.array_sort("compare_args"))
    named_sets = g.filter("named IS NOT NULL").select("name", F.col("named").alias("keys")).distinct()
    own_sets = calls.select("name", own.alias("keys")).distinct()

    c_named = calls.join(F.broadcast(named_sets), "name").withColumn("own", F.lit(False))
    c_own = calls.withColumn("keys", own).withColumn("own", F.lit(True))
    have = _told(c_named.select("run_id", "name", "own", "keys", "arguments").unionByName(c_own.select("run_id", "name", "own", "keys", "arguments")), ["run_id"])

    g_named = g.filter("named IS NOT NULL").withColumn("keys", F.coalesce("named", empty)).withColumn("own", F.lit(False))
    # for the call's own keys: an empty call matches, others need all its keys in the action
    g_own = g.filter("named IS NULL").join(F.broadcast(own_sets), "name").withColumn("own", F.lit(True))
    cols = ["run_id", "action_id", "name", "own", "keys", "arguments"]
    want = _told(g_named.select(*cols).unionByName(g_own.select(*cols)), ["run_id", "action_id"])
    key = ["run_id", *_TOLD]
    hit = want.join(have, key, "left_semi").select("run_id", "action_id").distinct().withColumn("hit", F.lit(True))
    return golden.join(hit, ["run_id", "action_id"], "left").withColumn("action_match", F.coalesce("hit", F.lit(False))).drop("hit")


def action_rewards(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """A-03: 1 when every golden action matched; runs without actions get 1."""
    r = matches.groupBy("run_id").agg(F.min("action_match").alias("ok"))
    return runs.join(r, "run_id", "left").select("run_id", F.coalesce("ok", F.lit(True)).cast("double").alias("action_reward"))


def communicated(infos: DataFrame, messages: DataFrame) -> DataFrame:
    """J-08: whether each info string is inside an assistant message of its run (lower case, commas removed)."""
    said = messages.filter("role = 'assistant' AND content IS NOT NULL").select(
        "run_id", F.translate(F.lower("content"), ",", "").alias("said")
    )
    # the info list of a run is short; it travels as one array per run, not per pair
    wanted = infos.groupBy("run_id").agg(F.collect_set("info").alias("wanted"))
    hit = said.join(wanted, "run_id").select(
        "run_id", F.explode(F.filter("wanted", lambda i: F.contains(F.col("said"), F.lower(i)))).alias("info")
    )
    hit = hit.distinct().withColumn("met", F.lit(True))
    return infos.join(hit, ["run_id", "info"], "left").withColumn("met", F.coalesce("met", F.lit(False)))


def communication_rewards(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """A-05."""
    r = checks.groupBy("run_id").agg(F.min("met").alias("ok"))
    return runs.join(r, "run_id", "left").select("run_id", F.coalesce("ok", F.lit(True)).cast("double").alias("communicate_reward"))


def combined_reward(breakdown: Column, basis: Column, premature: Column, has_criteria: Column) -> Column:
    """A-06: product over the types in the basis; premature end 0; no criteria 1."""
    values = F.transform(F.array_distinct(basis), lambda b: F.coalesce(F.try_element_at(breakdown, b), F.lit(1.0)))
    product = F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
    return F.when(premature, 0.0).when(~has_criteria, 1.0).otherwise(product)


def recomputed_rewards(runs: DataFrame, golden: DataFrame, calls: DataFrame, infos: DataFrame, messages: DataFrame) -> DataFrame:
    """A-27: rewards of stored runs from their tables. runs: run_id, env_reward, basis, termination_reason."""
    a = action_rewards(runs, action_matches(golden, calls))
    c = communication_rewards(runs, communicated(infos, messages))
    parts = F.create_map(
        F.lit("ACTION"), F.col("action_reward"), F.lit("COMMUNICATE"), F.col("communicate_reward"), F.lit("ENV"), F.col("env_reward")
    )
    early = ~F.col("termination_reason").isin("agent_stop", "user_stop")
    return (
        runs.join(a, "run_id")
        .join(c, "run_id")
        .withColumn("reward", combined_reward(parts, F.col("basis"), early, F.col("basis").isNotNull()))
    )


def reward_analysis(runs: DataFrame, agent_writes: Sequence[str], user_writes: Sequence[str]) -> DataFrame:
    """A-07: runs(run_id, reward, reward_basis, reward_breakdown map, action_checks array)."""

    def part(kind: str) -> Column:
        in_basis = F.array_contains("reward_basis", kind)
        ok = succeeded_strictly(F.try_element_at("reward_breakdown", F.lit(kind)))
        return F.when(in_basis, F.when(F.col("reward_breakdown").isNull(), False).otherwise(ok))

    writes = F.filter(
        "action_checks",
        lambda a: F.when(a["requestor"] == "assistant", a["name"].isin(list(agent_writes))).otherwise(a["name"].isin(list(user_writes))),
    )
    n = lambda c: F.when(F.col("action_checks").isNull(), 0).otherwise(F.size(c))
    return runs.select(
        "run_id",
        succeeded_strictly(F.col("reward")).alias("success"),
        part("COMMUNICATE").alias("communication"),
        part("ENV_ASSERTION").alias("environment"),
        part("DB").alias("database"),
        n(F.filter(writes, lambda a: a["action_match"])).alias("num_correct_write_action"),
        n(writes).alias("num_write_action"),
    )


def reward_actions(runs: DataFrame) -> DataFrame:
    """A-08: action rows with the match flag."""
    rows = runs.filter("reward_breakdown IS NOT NULL").select("run_id", F.explode("action_checks").alias("a"))
    return rows.select("run_id", "a.requestor", F.col("a.name").alias("action_name"), "a.action_match")


# --- reports ------------------------------------------------------------------------------


def action_success(actions: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A-09: success rate per action and (model, mode) column, and the action's share of all actions."""
    rate = lambda l, m: F.avg(F.when((F.col("llm") == l) & (F.col("mode") == m), F.col("action_match").cast("double")))
    g = actions.groupBy("action_name").agg(F.count(F.lit(1)).alias("n"), *[rate(l, m).alias(f"{l}|{m}") for l, m in columns])
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("n") / F.col("total")).drop("n", "total")  # one row


def pass_by(tasks: DataFrame, by: Sequence[str], ks: Sequence[int], std=F.stddev_samp) -> DataFrame:
    """A-10..A-12, A-17, A-24, A-25: mean and deviation of pass^k by any columns, k in long form."""
    rows = long_pass(tasks, ks, by)
    return rows.groupBy(*by, "k").agg(F.avg("p").alias("mean"), std("p").alias("std"), F.count(F.lit(1)).alias("n_tasks"))


def long_pass(tasks: DataFrame, ks: Sequence[int], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"pass_hat_{k}").alias("p")) for k in ks])
    return tasks.select(*keep, F.inline(pairs))


def mode_difference(tasks: DataFrame, mode_a: str, mode_b: str, ks: Sequence[int]) -> DataFrame:
    """A-13: mean pass^k of mode_a minus mode_b per model."""
    m = pass_by(tasks, ["llm", "mode"], ks)
    v = lambda x: F.max(F.when(F.col("mode") == x, F.col("mean")))
    return m.groupBy("llm", "k").agg((v(mode_a) - v(mode_b)).alias("difference"))


def pass_by_size(tasks: DataFrame, size: str, k: int, default_mode: str, keys: Sequence[str] = ("llm", "mode")) -> DataFrame:
    """A-14/A-15/A-26: mean pass^k and task share (percent, of the default mode) per size, gaps filled with 0."""
    keys = list(keys)
    means = tasks.groupBy(*keys, size).agg(F.avg(f"pass_hat_{k}").alias("pass_k"))
    base = tasks.filter(F.col("mode") == default_mode)
    n = base.groupBy("llm", size).agg(F.count(F.lit(1)).alias("n"))
    share = n.join(n.groupBy("llm").agg(F.sum("n").alias("total")), "llm").select(
        "llm", size, (F.col("n") / F.col("total") * 100).alias("task_share")
    )
    grid = tasks.select(*keys).distinct().join(share, "llm")
    return grid.join(means, [*keys, size], "left").withColumn("pass_k", F.coalesce("pass_k", F.lit(0.0)))


def mean_over_k(tasks: DataFrame, ks: Sequence[int]) -> DataFrame:
    """A-16: mean and population deviation over k of pass^k per model and mode."""
    m = pass_by(tasks, ["llm", "mode"], ks)
    return m.groupBy("llm", "mode").agg(F.avg("mean").alias("mean_pass"), F.stddev_pop("mean").alias("std_pass"))


def failure_shares(rows: DataFrame) -> DataFrame:
    """A-18: shares of failed checks and mean write actions by task length 1-3, 4-6, 7+."""
    n = F.col("num_actions")
    size = F.when(n.between(1, 3), "1-3").when(n.between(4, 6), "4-6").when(n >= 7, "7+")
    fail = lambda c: F.avg((~F.col(c)).cast("double"))
    return rows.filter("num_actions >= 1").groupBy(size.alias("length_class")).agg(
        F.count(F.lit(1)).alias("n"),
        fail("database").alias("db_failures"),
        fail("communication").alias("communication_failures"),
        F.avg("num_correct_write_action").alias("mean_correct_writes"),
    )


def check_failures(rows: DataFrame, keys: Sequence[str] = ("llm", "domain"), mode: str = "default", leave_out: str = "telecom") -> DataFrame:
    """A-18: share of failed database and communication checks among those made, 0 where none was made.

    Runs of one mode; domains that begin with `leave_out` are kept apart. A check
    that is null was not made.
    """
    some = rows.filter((F.col("mode") == mode) & ~F.col("domain").startswith(leave_out))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(~F.col(c)), F.count(c)), F.lit(0.0))
    return some.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("database").alias("db_checks"), F.count("communication").alias("communication_checks"),
        share("database").alias("db_failures"), share("communication").alias("communication_failures"),
    )


EDGES = [i * 0.1 for i in range(11)]


def write_proportions(rows: DataFrame, mode: str = "default", domain: str = "telecom", failed_only: bool = False) -> DataFrame:
    """A-18: how many runs have which share of their write actions right, in tenths, per model and length class.

    The class goes by the number of write actions; a run without any has none. The
    last tenth holds 1. `failed_only` leaves out runs that succeeded.
    """
    n = F.col("num_write_action")
    size = F.when(n.between(1, 3), "short").when(n.between(4, 6), "medium").when(n >= 7, "long")
    some = rows.filter((F.col("mode") == mode) & (F.col("domain") == domain) & (n >= 1))
    if failed_only:
        some = some.filter(~F.col("success"))
    share = F.col("num_correct_write_action") / n
    below = F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: e <= F.col("share")))
    some = some.select("llm", size.alias("length_class"), share.alias("share")).withColumn("bin", F.least(below, F.lit(len(EDGES) - 1)) - 1)
    return some.groupBy("llm", "length_class", "bin").agg(F.count(F.lit(1)).alias("n"))


def write_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("num_write_action", "num_correct_write_action").agg(F.count(F.lit(1)).alias("n"))


def costs(runs: DataFrame) -> DataFrame:
    """A-19."""
    return runs.groupBy("llm").agg(F.avg("agent_cost").alias("mean_cost"), F.sum("agent_cost").alias("total_cost"))


def tagged_union(parts: Sequence[tuple[dict[str, str], DataFrame]]) -> DataFrame:
    """A-20: runs of several directories, tagged with their parameters."""
    out = None
    for tags, df in parts:
        df = df.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def leaderboard(runs: DataFrame, ks: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """A-21: pass^k x 100 and mean cost per model and domain."""
    per = task_pass_hat_k(runs, ["llm", "domain", "task_id"], max(ks), succeeded_strictly(F.col("reward")))
    p = per.groupBy("llm", "domain").agg(*[(F.avg(f"pass_hat_{k}") * 100).alias(f"pass_{k}") for k in ks])
    return p.join(runs.groupBy("llm", "domain").agg(F.avg("agent_cost").alias("cost")), ["llm", "domain"])


def submission_check(submitted: DataFrame, computed: DataFrame, columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """A-22: submitted values that differ from the recomputed ones (null-safe)."""
    keys = ["llm", "domain"]
    s = submitted.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns])

    def differs(c: str) -> Column:
        a, b = F.col(f"s_{c}"), F.col(c)
        return ~F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())

    rows = computed.join(s, keys, "left")
    parts = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"s_{c}").alias("submitted"), F.col(c).alias("computed"), differs(c).alias("bad")) for c in columns])
    return rows.select(*keys, F.inline(parts)).filter("bad").drop("bad")


def trajectory_set_check(files: DataFrame) -> DataFrame:
    """A-23: a domain in one file only, one agent and user everywhere. files: file, domain, llm, user_llm."""
    per = files.select("file", "domain", "llm", "user_llm").distinct()
    d = per.groupBy("domain").agg(F.count_distinct("file").alias("f"))
    d = d.agg(F.max("f").alias("f"))
    m = per.select("llm", "user_llm").distinct().agg(F.count(F.lit(1)).alias("m"))
    return d.crossJoin(m).select((F.col("f") == 1).alias("domains_unique"), (F.col("m") == 1).alias("one_model"))  # one row each


