"""Streaming jobs run over the given tables as sources, available data once (T-01 .. T-08)."""

from pyspark.sql import functions as F

from ..streaming import jobs, state, tables
from . import fixtures as fx
from .inputs import WINDOW, confs
from .q_sources import _dir
from .registry import CTES, query, shared


#: Files of a stream in turns, and the positions (or turns) that one of them spans.
BATCHES = 3
SPAN = 2


def _as_stream(spark, sf, name, build):
    """The table written once as files, then read as a stream."""

    def write():
        path = _dir(spark, name)
        build().write.parquet(path)
        return spark.createDataFrame([(path,)], "path string")

    path = shared(f"stream_{name}", spark, sf, write).first()["path"]
    return jobs.read_stream(spark, path, spark.read.parquet(path).schema)


def _appended(spark, stream, name):
    out = _dir(spark, name)
    jobs.append_to(stream, out, f"{out}-checkpoint")
    return spark.read.schema(stream.schema).parquet(out)


def _utc_events(spark, sf):
    """Events with their wall-clock times read as UTC instants, which watermarks need."""
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return fx.table(spark, sf, "events").withColumn("ts", utc)


def _events(spark, sf):
    return _as_stream(spark, sf, "events", lambda: _utc_events(spark, sf))


def _in_time(spark, sf):
    """Events whose files arrive in the order of their times, so that a query takes several batches and none is late."""

    def build():
        e = _utc_events(spark, sf)
        span = F.broadcast(e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")))  # one row
        part = (F.col("ts").cast("double") - F.col("a").cast("double")) / F.greatest(F.col("b").cast("double") - F.col("a").cast("double"), F.lit(1.0))
        return e.crossJoin(span).withColumn("turn", F.floor(part * (BATCHES * SPAN))).drop("a", "b")

    return _batches(spark, sf, "events_in_time", build, "turn", "event_id")


@query("T01_append_results", "SELECT event_id, user_id, value FROM events", "value")
def t01(spark, sf):
    return _appended(spark, _events(spark, sf).select("event_id", "user_id", "value"), "t01")


@query("T02_first_wins", "SELECT user_id, 1 AS n FROM events GROUP BY user_id")
def t02(spark, sf):
    """Everything arrives in one batch, so each id is kept once."""
    once = jobs.first_wins(_events(spark, sf).select("user_id", "ts"), "user_id", "ts", "1 day")
    return _appended(spark, once, "t02").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("T02_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def t02b(spark, sf):
    out = _dir(spark, "t02b")
    events = _in_time(spark, sf).select("user_id", "event_id")
    tables.keep(events, out, f"{out}-checkpoint", ["user_id"], "event_id")
    return tables.read(spark, out, events.schema)


@query("T02_first_arrival", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def t02c(spark, sf):
    """First events arrive first, all repeats of an id in later batches; within ten years a repeat is dropped."""

    def build():
        e = _utc_events(spark, sf).select("user_id", "event_id", "ts")
        first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
        return e.join(first, "user_id").select("user_id", "event_id", "ts", F.when(F.struct("ts", "event_id") == F.col("f"), 0).otherwise(F.lit(SPAN)).alias("turn"))

    s = _batches(spark, sf, "repeats", build, "turn", "user_id")
    return _appended(spark, jobs.first_wins(s.select("user_id", "event_id", "ts"), "user_id", "ts", "3650 days"), "t02c").drop("ts")


def _ends(rows, key, *order):
    """Rows with `last`, whether they are the end of their key."""
    top = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("top"))
    return rows.join(top, key).withColumn("last", F.struct(*order) == F.col("top")).drop("top")


def _in_turns(spark, path, rows, order, key):
    """Files that arrive one after another in order of position, a trajectory in one file at a time, so that a query takes several batches."""
    for k in range(BATCHES):
        rows.filter(F.least(F.floor(F.col(order) / SPAN), F.lit(BATCHES - 1)) == k).repartition(4, key).write.mode("append").parquet(path)


def _batches(spark, sf, name, build, order="position", key="traj_id"):
    def write():
        path = _dir(spark, name)
        rows = build()
        _in_turns(spark, path, rows, order, key)
        return spark.createDataFrame([(path,)], "path string")

    path = shared(f"batches_{name}", spark, sf, write).first()["path"]
    return jobs.read_stream(spark, path, spark.read.parquet(path).schema, 4)


def _conf_stream(spark, sf):
    def build():
        name = F.concat(F.lit("t"), F.col("traj_id").cast("string"))
        return confs(spark, sf).select(name.alias("traj_id"), F.col("i").alias("position"), "conf", F.col("traj_id").alias("n"), (F.col("i") == F.col("n") - 1).alias("last"))

    return _batches(spark, sf, "confs", build)


CTES["conf_windows"] = "SELECT concat('t', CAST(traj_id AS STRING)) AS traj_id, traj_id AS n, i, m FROM windows"
LOW = 2.0


@query("T03_early_stop", f"SELECT traj_id, min(i) AS stopped_at, arg_min(m, i) AS window_mean FROM conf_windows WHERE m < {LOW} - 1e-9 GROUP BY traj_id", "window_mean")
def t03(spark, sf):
    s = _conf_stream(spark, sf).withColumn("threshold", F.lit(LOW - 1e-9))
    return _appended(spark, state.early_stop(s.drop("n"), WINDOW), "t03")


@query(
    "T04_static_threshold",
    f"SELECT traj_id, min(i) AS stopped_at, arg_min(m, i) AS window_mean FROM conf_windows WHERE m < {LOW} + (n % 60) / 100.0 - 1e-9 GROUP BY traj_id",
    "window_mean",
)
def t04(spark, sf):
    """The stream joined with a threshold per problem, as the warm-up leaves it."""
    bars = confs(spark, sf).select((F.col("traj_id") % 60).alias("problem_id")).distinct()
    bars = bars.withColumn("threshold", LOW + F.col("problem_id") / 100.0 - 1e-9)
    s = _conf_stream(spark, sf).withColumn("problem_id", F.col("n") % 60).join(F.broadcast(bars), "problem_id").drop("problem_id", "n")  # 60 rows
    return _appended(spark, state.early_stop(s, WINDOW), "t04")


@query(
    "T05_merged_turns",
    """SELECT t.problem_id AS traj_id, t.traj_idx AS turn, CAST(t.position + coalesce(o.before, 0) AS BIGINT) AS position FROM tokens t
    JOIN (SELECT problem_id, traj_idx, sum(count(*)) OVER (PARTITION BY problem_id ORDER BY traj_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tokens GROUP BY problem_id, traj_idx) o
    ON o.problem_id = t.problem_id AND o.traj_idx = t.traj_idx""",
)
def t05(spark, sf):
    turns = lambda: _ends(fx.tokens(spark, sf).select(F.col("problem_id").alias("traj_id"), F.col("traj_idx").alias("turn"), "position"), "traj_id", "turn", "position")
    s = _batches(spark, sf, "turns", turns, "turn")
    return _appended(spark, state.merged_turns(s), "t05").withColumn("turn", F.col("turn").cast("int"))




def _token_stream(spark, sf):
    def build():
        from ..operators.phases import thresholds

        t = fx.tokens(spark, sf)
        ends = t.groupBy("traj_id").agg(F.max("position").alias("end"))
        t = t.join(thresholds(t).join(ends, "traj_id"), "traj_id")
        return t.select("traj_id", "position", "token_id", "entropy", "high", "low", (F.col("position") == F.col("end")).alias("last"))

    return _as_stream(spark, sf, "tokens", build)


@query(
    "T06_live_phases",
    "SELECT traj_id, CAST(start AS BIGINT) AS start, duration FROM found_phases",
)
def t06(spark, sf):
    s = _token_stream(spark, sf).drop("token_id")
    return _appended(spark, jobs.live_phases(s, 3), "t06")


@query(
    "T07_live_degeneration",
    """SELECT traj_id, CAST(min(start) AS BIGINT) AS degenerate_at FROM (SELECT traj_id, g, min(position) AS start, count(*) AS n FROM
    (SELECT traj_id, position, position - row_number() OVER (PARTITION BY traj_id ORDER BY position) AS g FROM tokens WHERE token_id = 0)
    GROUP BY traj_id, g) WHERE n >= 2 GROUP BY traj_id""",
)
def t07(spark, sf):
    return _appended(spark, state.live_degeneration(_token_stream(spark, sf).select("traj_id", "position", "token_id", "last"), 2), "t07")


@query("T08_running_votes", "SELECT problem_id, extracted_answer, count(*) AS votes, count(*) FILTER (is_correct) AS correct FROM evals GROUP BY problem_id, extracted_answer")
def t08(spark, sf):
    s = _as_stream(spark, sf, "evals", lambda: fx.evals(spark, sf))
    out = _dir(spark, "t08")
    votes = jobs.running_votes(s)
    tables.keep(votes, out, f"{out}-checkpoint", ["problem_id", "extracted_answer"], mode="update")
    return tables.read(spark, out, votes.schema)


@query(
    "T08_tumbling_counts",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day_start, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY day_start, event_type",
    "mean_value",
)
def t08b(spark, sf):
    counts = jobs.tumbling_counts(_in_time(spark, sf), "ts", "1 day", "1 hour")
    out = _dir(spark, "t08b")
    tables.keep(counts, out, f"{out}-checkpoint", ["window", "event_type"], mode="update")
    got = tables.read(spark, out, counts.schema)
    return got.select(F.unix_timestamp("window.start").alias("day_start"), "event_type", "n", "mean_value")


@query(
    "T08_closed_windows",
    """SELECT CAST(epoch(day) AS BIGINT) AS day_start, event_type, count(*) AS n, avg(value) AS mean_value FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY day, event_type""",
    "mean_value",
)
def t08c(spark, sf):
    """Only windows that the watermark has passed, each given out once."""
    got = _appended(spark, jobs.tumbling_counts(_in_time(spark, sf), "ts", "1 day", "1 hour"), "t08c")
    return got.select(F.unix_timestamp("window.start").alias("day_start"), "event_type", "n", "mean_value")
