"""Queries for token entropy (E-01 .. E-24)."""

from pyspark.sql import functions as F

from ..functions import probs
from ..functions.tokens import is_math_symbol
from ..operators import entropy as en
from ..operators import semantic as sem
from ..operators import steps as st
from . import fixtures as fx
from .registry import CTES, query, shared

K = 4  # candidates kept per position
POS = ["traj_num", "position"]

CTES["top_cands"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_num, position ORDER BY logprob DESC, cand_idx) AS cand_rank
  FROM candidates) WHERE cand_rank <= {K}"""
CTES["cand_probs"] = """SELECT traj_num, position, token_id, cand_rank,
  exp(logprob) / sum(exp(logprob)) OVER (PARTITION BY traj_num, position) AS p FROM top_cands"""
CTES["bands"] = """SELECT *, CASE WHEN percentile < 1 THEN 'red' WHEN percentile < 3 THEN 'pink' WHEN percentile < 5 THEN 'purple' ELSE 'black' END AS color
  FROM (SELECT t.*, CASE WHEN entropy IS NOT NULL THEN
  (row_number() OVER (PARTITION BY traj_id, entropy IS NULL ORDER BY entropy DESC, position) - 1) / CAST(count(entropy) OVER (PARTITION BY traj_id) AS DOUBLE) * 100 END AS percentile FROM tokens t)"""


@query(
    "E01_token_entropy",
    "SELECT traj_num, position, sum(-p * ln(p)) AS entropy, count(*) AS n_candidates FROM cand_probs GROUP BY traj_num, position",
    "entropy",
)
def e01(spark, sf):
    return en.position_entropy(fx.candidates(spark, sf), POS, K)


@query(
    "E01_token_entropy_arrays",
    "SELECT traj_num, position, sum(-p * ln(p)) AS entropy FROM cand_probs GROUP BY traj_num, position",
    "entropy",
)
def e01a(spark, sf):
    """The per-record form over stored arrays."""
    top = en.top_candidates(fx.candidates(spark, sf), POS, K)
    arr = top.groupBy(*POS).agg(F.collect_list("logprob").alias("lps"))
    return arr.select(*POS, probs.entropy(F.col("lps"), K).alias("entropy"))


@query("E02_top_k_probs", "SELECT traj_num, position, token_id, cand_rank - 1 AS k, p FROM cand_probs", "p")
def e02(spark, sf):
    sets = en.position_probs(fx.candidates(spark, sf), POS, K)
    both = F.arrays_zip("top_k_token_ids", "top_k_probs")
    return sets.select(*POS, F.posexplode(both).alias("k", "x")).select(
        *POS, F.col("x.top_k_token_ids").alias("token_id"), F.col("k").cast("long").alias("k"), F.col("x.top_k_probs").alias("p")
    )


def bands(spark, sf):
    return shared("bands", spark, sf, lambda: en.banded(fx.tokens(spark, sf)))


@query("E03_bands", "SELECT traj_id, position, percentile, color FROM bands", "percentile")
def e03(spark, sf):
    return en.banded(fx.tokens(spark, sf)).select("traj_id", "position", "percentile", "color")


_STATS = """count(*) AS total_tokens, count(entropy) AS valid_tokens, avg(entropy) AS avg_entropy, max(entropy) AS max_entropy,
  min(entropy) AS min_entropy, stddev_pop(entropy) AS std_entropy"""
_SD = "avg_entropy max_entropy min_entropy std_entropy"


@query("E04_trajectory_stats", f"SELECT traj_id, {_STATS} FROM tokens GROUP BY traj_id", _SD)
def e04(spark, sf):
    return en.statistics(fx.tokens(spark, sf))


CTES["global_cut"] = """SELECT entropy AS cut FROM (SELECT entropy, row_number() OVER (ORDER BY entropy DESC) AS r, count(*) OVER () AS n
  FROM tokens WHERE entropy IS NOT NULL) WHERE r = greatest(1, CAST(floor(n * 5 / 100.0) AS BIGINT))"""


@query(
    "E05_corpus_stats",
    f"""SELECT {_STATS}, count(*) FILTER (entropy >= cut) AS high_entropy_count,
    count(*) FILTER (entropy >= cut) / CAST(count(entropy) AS DOUBLE) AS high_entropy_ratio FROM tokens, global_cut WHERE entropy IS NOT NULL""",
    _SD + " high_entropy_ratio",
)
def e05(spark, sf):
    t = fx.tokens(spark, sf).filter("entropy IS NOT NULL")
    hot = en.above_global_cut(t).agg(F.count(F.lit(1)).alias("high_entropy_count"))
    stats = en.statistics(t, [])
    return stats.crossJoin(hot).withColumn("high_entropy_ratio", F.col("high_entropy_count") / F.col("valid_tokens"))


@query("E06_global_high_tokens", "SELECT traj_id, position, token, entropy FROM tokens, global_cut WHERE entropy >= cut", "entropy")
def e06(spark, sf):
    return en.above_global_cut(fx.tokens(spark, sf)).select("traj_id", "position", "token", "entropy")


def _top(src, where):
    return f"SELECT '{src}' AS kind, token, n FROM (SELECT token, count(*) AS n FROM {where} GROUP BY token ORDER BY n DESC, token LIMIT 20)"


@query(
    "E07_top_tokens",
    " UNION ALL ".join(
        [
            _top("all", "tokens WHERE entropy IS NOT NULL"),
            _top("high", "tokens, global_cut WHERE entropy >= cut"),
            _top("banded", "bands WHERE color <> 'black'"),
            "SELECT 'color' AS kind, color AS token, count(*) AS n FROM bands WHERE color <> 'black' GROUP BY color",
        ]
    ),
)
def e07(spark, sf):
    t = fx.tokens(spark, sf).filter("entropy IS NOT NULL")
    hot = bands(spark, sf).filter("color <> 'black'")
    parts = {
        "all": en.top_tokens(t),
        "high": en.top_tokens(en.above_global_cut(t)),
        "banded": en.top_tokens(hot),
        "color": hot.groupBy(F.col("color").alias("token")).agg(F.count(F.lit(1)).alias("n")),
    }
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "token", "n")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "E08_problem_rows",
    """SELECT traj_id, count(*) AS total_tokens, count(entropy) AS valid_tokens, avg(entropy) AS avg_entropy,
    count(*) FILTER (color <> 'black') AS high_entropy_count,
    count(*) FILTER (color <> 'black') / CAST(count(entropy) AS DOUBLE) AS high_entropy_ratio FROM bands GROUP BY traj_id""",
    "avg_entropy high_entropy_ratio",
)
def e08(spark, sf):
    return en.problem_rows(bands(spark, sf))


@query(
    "E09_merged_turns",
    """SELECT run_id, turn, position + CAST(coalesce(o.before, 0) AS BIGINT) AS position, token FROM
    (SELECT problem_id AS run_id, traj_idx AS turn, CAST(position AS BIGINT) AS position, token FROM tokens) t
    JOIN (SELECT problem_id AS run_id, traj_idx AS turn, sum(count(*)) OVER (PARTITION BY problem_id ORDER BY traj_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM tokens GROUP BY problem_id, traj_idx) o USING (run_id, turn)""",
)
def e09(spark, sf):
    t = fx.tokens(spark, sf).select(F.col("problem_id").alias("run_id"), F.col("traj_idx").alias("turn"), "position", "token")
    return en.merge_turns(t)


CTES["merged"] = """SELECT run_id, turn, position + CAST(coalesce(o.before, 0) AS BIGINT) AS position, entropy FROM
    (SELECT problem_id AS run_id, traj_idx AS turn, CAST(position AS BIGINT) AS position, entropy FROM tokens) t
    JOIN (SELECT problem_id AS run_id, traj_idx AS turn, sum(count(*)) OVER (PARTITION BY problem_id ORDER BY traj_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM tokens GROUP BY problem_id, traj_idx) o USING (run_id, turn)"""
CTES["merged_bands"] = """SELECT *, CASE WHEN percentile < 1 THEN 'red' WHEN percentile < 3 THEN 'pink' WHEN percentile < 5 THEN 'purple' ELSE 'black' END AS color
  FROM (SELECT m.*, CASE WHEN entropy IS NOT NULL THEN
  (row_number() OVER (PARTITION BY run_id, entropy IS NULL ORDER BY entropy DESC, position) - 1) / CAST(count(entropy) OVER (PARTITION BY run_id) AS DOUBLE) * 100 END AS percentile FROM merged m)"""


def turns(spark, sf):
    """Tokens of a problem's trajectories as turns of one run, with the bands that each turn had alone."""
    return bands(spark, sf).select(F.col("problem_id").alias("run_id"), F.col("traj_idx").alias("turn"), "position", "entropy", "percentile", "color")


@query("E09_rebanded_runs", "SELECT run_id, turn, position, percentile, color FROM merged_bands", "percentile")
def e09b(spark, sf):
    return en.rebanded(turns(spark, sf))[0].select("run_id", "turn", "position", "percentile", "color")


@query(
    "E09_run_statistics",
    f"""SELECT run_id, {_STATS}, count(DISTINCT turn) AS turns, count(*) FILTER (color <> 'black') AS high_entropy_count, count(*) FILTER (color = 'red') AS red,
    count(*) FILTER (color = 'pink') AS pink, count(*) FILTER (color = 'purple') AS purple,
    count(*) FILTER (color <> 'black') / CAST(count(entropy) AS DOUBLE) AS high_entropy_ratio FROM merged_bands GROUP BY run_id""",
    _SD + " high_entropy_ratio",
)
def e09c(spark, sf):
    return en.rebanded(turns(spark, sf))[1]


@query(
    "E10_provider_tokens",
    """SELECT traj_num, position, 't' AS token, 0 AS token_id, sum(-p * ln(p)) AS entropy, max(CASE WHEN cand_rank = 1 THEN CAST(token_id AS INT) END) AS first_id
    FROM cand_probs GROUP BY traj_num, position""",
    "entropy",
)
def e10(spark, sf):
    """Candidates packed into provider-style records, one per trajectory position, and read back."""
    top = en.top_candidates(fx.candidates(spark, sf), POS, K)
    cand = F.struct("cand_rank", F.col("token_id").cast("int").alias("token_id"), "logprob")
    rec = top.groupBy(*POS).agg(F.array_sort(F.collect_list(cand)).alias("top_logprobs"))
    item = F.struct(F.lit("t").alias("token"), F.lit(None).cast("int").alias("token_id"), "top_logprobs")
    df = rec.select("traj_num", F.col("position").alias("pos"), F.array(item).alias("content"))
    out = en.provider_tokens(df).select("traj_num", "pos", "token", "token_id", "entropy", F.get("top_k_token_ids", F.lit(0)).alias("first_id"))
    return out.withColumnRenamed("pos", "position")


# Semantic entropy over top-K candidates; tokens outside the embedding table stand alone.
THRESHOLD = 0.25


def _sets(spark, sf):
    sets = en.position_probs(fx.candidates(spark, sf), POS, K)
    ent = en.position_entropy(fx.candidates(spark, sf), POS, K).select(*POS, "entropy")
    token = F.concat(F.lit("w"), F.when(F.col("position") % 5 == 0, "1").otherwise("x"))
    return sets.join(ent, POS).withColumnRenamed("traj_num", "traj_id").withColumn("token", token)


def candidate_sets(spark, sf):
    return shared("candidate_sets", spark, sf, lambda: _sets(spark, sf))


def _emb(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")


def semantics(spark, sf):
    return shared("semantics", spark, sf, lambda: sem.semantic_entropy(candidate_sets(spark, sf), _emb(spark, sf), THRESHOLD))


CTES["sem_nodes"] = "SELECT c.*, e.embedding, position % 5 = 0 AS is_math FROM cand_probs c LEFT JOIN embeddings e ON e.vec_id = c.token_id"
CTES["sem_reach"] = f"""WITH RECURSIVE edge AS (SELECT a.traj_num, a.position, a.cand_rank AS i, b.cand_rank AS j FROM sem_nodes a JOIN sem_nodes b
    ON a.traj_num = b.traj_num AND a.position = b.position AND a.cand_rank <> b.cand_rank
    AND (a.token_id = b.token_id OR list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > {THRESHOLD})),
  reach AS (SELECT traj_num, position, cand_rank AS i, cand_rank AS j FROM sem_nodes
    UNION SELECT r.traj_num, r.position, r.i, e.j FROM reach r JOIN edge e ON e.traj_num = r.traj_num AND e.position = r.position AND e.i = r.j)
  SELECT traj_num, position, i, min(j) AS label FROM reach GROUP BY traj_num, position, i"""
CTES["sem_rows"] = """SELECT traj_num AS traj_id, position, any_value(is_math) AS is_math_symbol, max(oe) AS original_entropy,
  CASE WHEN any_value(is_math) THEN max(oe) ELSE sum(-mass * ln(mass)) END AS semantic_entropy,
  CASE WHEN any_value(is_math) THEN max(n) ELSE count(*) END AS num_groups,
  CASE WHEN any_value(is_math) THEN 0.0 ELSE max(oe) - sum(-mass * ln(mass)) END AS entropy_reduction FROM (
  SELECT n.traj_num, n.position, r.label, any_value(n.is_math) AS is_math, sum(n.p) AS mass,
    sum(sum(-n.p * ln(n.p))) OVER (PARTITION BY n.traj_num, n.position) AS oe, sum(count(*)) OVER (PARTITION BY n.traj_num, n.position) AS n
  FROM sem_nodes n JOIN sem_reach r ON r.traj_num = n.traj_num AND r.position = n.position AND r.i = n.cand_rank
  GROUP BY n.traj_num, n.position, r.label) GROUP BY traj_num, position"""


@query(
    "E11_semantic_entropy",
    "SELECT traj_id, position, original_entropy, semantic_entropy, CAST(num_groups AS INT) AS num_groups, is_math_symbol, entropy_reduction FROM sem_rows",
    "original_entropy semantic_entropy entropy_reduction",
)
def e11(spark, sf):
    return sem.semantic_entropy(candidate_sets(spark, sf), _emb(spark, sf), THRESHOLD).drop("token")


@query(
    "E12_math_symbols",
    r"""SELECT token_kind, is_math, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) d,
    LATERAL (SELECT CASE WHEN trim(ch) = '' THEN 'blank' ELSE 'char' END AS token_kind,
      regexp_matches(ch, '[0-9]') OR trim(ch) IN ('+','-','*','/','=','<','>','≤','≥','≠','×','÷','±','∓','^','²','³','√','∛','(',')','[',']','{','}','.',',','%','°','∑','∏','∫','∂','∞','π','e') AS is_math) x
    GROUP BY token_kind, is_math""",
)
def e12(spark, sf):
    """Every character of every text; equal characters are counted before they are told apart."""
    d = fx.table(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.trim("ch") == "", "blank").otherwise("char")
    return d.groupBy(kind.alias("token_kind"), is_math_symbol(F.col("ch")).alias("is_math")).agg(F.sum("n").alias("n"))


@query(
    "E13_semantic_summary",
    """SELECT traj_id, count(*) AS total_positions, count(*) AS valid_positions, count(*) FILTER (is_math_symbol) AS math_symbol_positions,
    count(*) FILTER (NOT is_math_symbol) AS non_math_positions,
    count(*) FILTER (NOT is_math_symbol AND round(entropy_reduction, 9) > 0) AS positions_with_reduction,
    CASE WHEN count(*) FILTER (NOT is_math_symbol) > 0 THEN coalesce(sum(entropy_reduction) FILTER (NOT is_math_symbol AND round(entropy_reduction, 9) > 0), 0) / count(*) FILTER (NOT is_math_symbol) ELSE 0 END AS avg_entropy_reduction,
    CASE WHEN count(*) FILTER (NOT is_math_symbol) > 0 THEN count(*) FILTER (NOT is_math_symbol AND round(entropy_reduction, 9) > 0) / CAST(count(*) FILTER (NOT is_math_symbol) AS DOUBLE) ELSE 0 END AS reduction_rate,
    CAST(coalesce(max(num_groups) FILTER (NOT is_math_symbol), 0) AS INT) AS max_semantic_groups FROM sem_rows GROUP BY traj_id""",
    "avg_entropy_reduction reduction_rate",
)
def e13(spark, sf):
    # the two entropies are computed along different paths; equal values may differ in the last bit
    s = semantics(spark, sf).withColumn("entropy_reduction", F.round("entropy_reduction", 9))
    return sem.semantic_summary(s, ("traj_id",))


# Steps on short trajectories: distance 10, search 20, every seventh event ends a sentence.
DIST, SEARCH = 10, 20


def step_tokens(spark, sf):
    def build():
        b = bands(spark, sf)
        word = F.when(F.col("token_id") % 7 == 0, F.concat("token", F.lit("."))).otherwise(F.col("token"))
        hot = F.when(F.col("percentile") < 25, "red").otherwise("black")
        return b.withColumn("token", word).withColumn("color", hot)

    return shared("step_tokens", spark, sf, build)


CTES["step_tokens"] = """SELECT * REPLACE (CASE WHEN token_id % 7 = 0 THEN concat(token, '.') ELSE token END AS token,
  CASE WHEN percentile < 25 THEN 'red' ELSE 'black' END AS color) FROM bands"""
CTES["step_cands"] = f"""SELECT c.traj_id, c.position, c.token, c.entropy, coalesce((SELECT min(e.position) FROM step_tokens e
  WHERE e.traj_id = c.traj_id AND e.position >= c.position AND e.position < c.position + {SEARCH} AND contains(e.token, '.')), c.position) AS boundary
  FROM step_tokens c WHERE c.entropy IS NOT NULL AND c.color <> 'black'"""
CTES["step_bounds"] = f"""WITH RECURSIVE nxt AS (SELECT c.*, (SELECT min(d.position) FROM step_cands d WHERE d.traj_id = c.traj_id AND d.position >= c.boundary + {DIST}) AS next_at FROM step_cands c),
  walk AS (SELECT n.* FROM nxt n JOIN (SELECT traj_id, min(position) AS p FROM step_cands GROUP BY traj_id) f ON f.traj_id = n.traj_id AND f.p = n.position
    UNION ALL SELECT n.* FROM walk w JOIN nxt n ON n.traj_id = w.traj_id AND n.position = w.next_at)
  SELECT traj_id, boundary, position AS trigger_position, token AS trigger_token, entropy AS trigger_entropy FROM walk"""
CTES["step_no"] = """SELECT t.*, 1 + (SELECT count(*) FROM step_bounds b WHERE b.traj_id = t.traj_id AND b.boundary < t.position) AS step FROM step_tokens t"""
CTES["step_rows"] = """SELECT s.traj_id, s.step, s.start_position, s.end_position, s.text, b.trigger_position, b.trigger_token, b.trigger_entropy FROM
  (SELECT traj_id, step, min(position) AS start_position, max(position) AS end_position, string_agg(token, '' ORDER BY position) AS text FROM step_no GROUP BY traj_id, step) s
  LEFT JOIN step_bounds b ON b.traj_id = s.traj_id AND b.boundary = s.end_position"""
CTES["step_means"] = """SELECT t.traj_id, s.step, coalesce(avg(CASE WHEN t.position < s.end_position THEN t.entropy END), 0) AS mean_entropy
  FROM step_no t JOIN step_rows s ON s.traj_id = t.traj_id AND s.step = t.step GROUP BY t.traj_id, s.step"""


@query(
    "E14_step_boundaries",
    "SELECT traj_id, CAST(boundary AS BIGINT) AS boundary, CAST(trigger_position AS BIGINT) AS trigger_position, trigger_token, trigger_entropy FROM step_bounds",
    "trigger_entropy",
)
def e14(spark, sf):
    return st.boundaries(step_tokens(spark, sf), DIST, SEARCH)


def step_table(spark, sf):
    def build():
        t = step_tokens(spark, sf)
        return st.steps(t, st.boundaries(t, DIST, SEARCH))

    return shared("steps", spark, sf, build)


@query(
    "E15_steps",
    "SELECT traj_id, step, CAST(start_position AS BIGINT) AS start_position, CAST(end_position AS BIGINT) AS end_position, text, CAST(trigger_position AS BIGINT) AS trigger_position, trigger_token, trigger_entropy FROM step_rows",
    "trigger_entropy",
)
def e15(spark, sf):
    s = step_table(spark, sf)
    return s.withColumn("start_position", F.col("start_position").cast("long")).withColumn("end_position", F.col("end_position").cast("long"))


@query(
    "E16_trim_specials",
    """SELECT t.traj_id, t.position, t.tok AS token FROM (SELECT *, CASE WHEN token_id % 3 = 0 THEN '</s>' ELSE token END AS tok FROM tokens) t
    JOIN (SELECT traj_id, max(position) AS p FROM tokens WHERE token_id % 3 <> 0 GROUP BY traj_id) l ON l.traj_id = t.traj_id WHERE t.position <= l.p""",
)
def e16(spark, sf):
    t = fx.tokens(spark, sf).withColumn("token", F.when(F.col("token_id") % 3 == 0, "</s>").otherwise(F.col("token")))
    return en.trim_trailing_specials(t).select("traj_id", "position", "token")


@query("E17_step_entropy", "SELECT traj_id, step, mean_entropy FROM step_means", "mean_entropy")
def e17(spark, sf):
    return st.step_entropy(step_tokens(spark, sf), step_table(spark, sf))


_BY = "avg(mean_entropy) AS mean, stddev_pop(mean_entropy) AS std, count(*) AS n FROM step_means m JOIN evals e ON e.traj_id = m.traj_id"


@query("E18_step_entropy_by_problem", f"SELECT problem_id, is_correct, step, {_BY} GROUP BY problem_id, is_correct, step", "mean std")
def e18(spark, sf):
    per = st.step_entropy(step_tokens(spark, sf), step_table(spark, sf))
    return st.step_entropy_by_correctness(per, fx.evals(spark, sf))


@query(
    "E19_degeneration",
    """SELECT traj_id, min(start) AS degenerate_at FROM (SELECT traj_id, g, min(position) AS start, count(*) AS n FROM
    (SELECT traj_id, position, position - row_number() OVER (PARTITION BY traj_id ORDER BY position) AS g FROM tokens WHERE token_id = 0)
    GROUP BY traj_id, g) WHERE n >= 2 GROUP BY traj_id""",
)
def e19(spark, sf):
    return en.degeneration(fx.tokens(spark, sf), threshold=2)


@query("E22_step_entropy_overall", f"SELECT is_correct, step, {_BY} GROUP BY is_correct, step", "mean std")
def e22(spark, sf):
    per = st.step_entropy(step_tokens(spark, sf), step_table(spark, sf))
    return st.step_entropy_by_correctness(per, fx.evals(spark, sf), by_problem=False)


@query(
    "E23_reduction_grid",
    """SELECT t.traj_id, g.position, greatest(coalesce(s.entropy_reduction, 0), 0) AS reduction
    FROM (SELECT DISTINCT traj_id FROM sem_rows) t CROSS JOIN (SELECT range AS position FROM range(12)) g
    LEFT JOIN sem_rows s ON s.traj_id = t.traj_id AND s.position = g.position""",
    "reduction",
)
def e23(spark, sf):
    return en.reduction_grid(semantics(spark, sf), 12)


@query(
    "E24_grouping_examples",
    """SELECT traj_id, position, round(original_entropy, 9) AS original_entropy, num_groups FROM (SELECT s.traj_id, s.position, s.original_entropy, CAST(s.num_groups AS INT) AS num_groups,
    row_number() OVER (PARTITION BY s.traj_id ORDER BY s.position) AS k FROM sem_rows s
    JOIN (SELECT traj_id, quantile_cont(original_entropy, 0.7) AS cut FROM sem_rows GROUP BY traj_id) c ON c.traj_id = s.traj_id
    WHERE round(s.original_entropy, 9) >= round(c.cut, 9) AND s.num_groups > 1) WHERE k <= 3""",
    "original_entropy",
)
def e24(spark, sf):
    s = semantics(spark, sf).withColumn("original_entropy", F.round("original_entropy", 9))
    return en.grouping_examples(s, top=30.0).select("traj_id", "position", "original_entropy", "num_groups")
