"""Token entropy tables: entropies, bands, statistics, turns, trimming, degeneration (E-01 .. E-24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..functions.probs import band
from .spread import CHUNK, group_percentiles, position_chunk, ranked, running, selected

TOK = ["traj_id"]


def top_candidates(cands: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """The k most likely candidates per position. The limit is applied before the exchange."""
    w = W.partitionBy(*keys).orderBy(F.col("logprob").desc(), F.col("cand_idx"))
    return cands.withColumn("cand_rank", F.row_number().over(w)).filter(F.col("cand_rank") <= k)


def position_entropy(cands: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """E-01 long form: -sum p ln p with p = exp(lp) / sum exp(lp), over the at most k values of a position.

    No difference of large terms is taken: one candidate gives exactly 0, and nothing is negative.
    The sum is taken over the partition and order in which the ranks were given, and
    the aggregation follows in it: one exchange, one sort, no list.
    """
    some = top_candidates(cands, keys, k).select(*keys, F.exp("logprob").alias("__e"))
    p = F.col("__e") / F.sum("__e").over(W.partitionBy(*keys))
    some = some.select(*keys, F.when(F.col("__e") > 0, p).alias("__p"))
    h = F.coalesce(F.sum(-F.col("__p") * F.ln("__p")), F.lit(0.0))
    return some.groupBy(*keys).agg((F.greatest(h, F.lit(0.0)) + F.lit(0.0)).alias("entropy"), F.count(F.lit(1)).alias("n_candidates"))


def position_probs(cands: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """E-02: top-k ids and renormalised probabilities per position; at most k entries each."""
    pairs = F.array_sort(F.collect_list(F.struct("cand_rank", "token_id", F.exp("logprob").alias("p"))))
    total = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["p"])
    return (
        top_candidates(cands, keys, k)
        .groupBy(*keys)
        .agg(pairs.alias("pairs"))
        .select(
            *keys,
            F.transform("pairs", lambda x: x["token_id"]).alias("top_k_token_ids"),
            F.transform("pairs", lambda x: F.when(total > 0, x["p"] / total).otherwise(x["p"])).alias("top_k_probs"),
        )
    )


def banded(tokens: DataFrame, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """E-03: rank percentile in the trajectory (highest entropy first, earlier position wins) and band."""
    keys = list(keys)
    valid = ranked(tokens.filter("entropy IS NOT NULL"), keys, "entropy", [F.col("position")], "rank", True, "n_valid")
    valid = valid.withColumn("percentile", F.col("rank") / F.col("n_valid") * 100)
    nulls = tokens.filter("entropy IS NULL").withColumn("percentile", F.lit(None).cast("double"))
    out = valid.drop("rank", "n_valid").unionByName(nulls)
    return out.withColumn("color", F.coalesce(F.when(F.col("percentile").isNotNull(), band(F.col("percentile"))), F.lit("black")))


def statistics(tokens: DataFrame, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """E-04 / E-05: counts, mean, extremes and population deviation."""
    return tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tokens"),
        F.count("entropy").alias("valid_tokens"),
        F.avg("entropy").alias("avg_entropy"),
        F.max("entropy").alias("max_entropy"),
        F.min("entropy").alias("min_entropy"),
        F.stddev_pop("entropy").alias("std_entropy"),
    )


def kth_largest(tokens: DataFrame, percent: float = 5.0) -> DataFrame:
    """E-06: one row with the entropy at rank max(1, floor(n p / 100)) of the whole descending sort."""
    rank = lambda total: [total - F.greatest(F.lit(1), F.floor(total * F.lit(float(percent)) / 100))]
    return selected(tokens, [], "entropy", rank).select(F.col("__r0").alias("cut"))


def above_global_cut(tokens: DataFrame, percent: float = 5.0) -> DataFrame:
    """Tokens at or above the corpus-wide cut (the cut is one row)."""
    return tokens.crossJoin(F.broadcast(kth_largest(tokens, percent))).filter(F.col("entropy") >= F.col("cut")).drop("cut")


def top_tokens(tokens: DataFrame, n: int = 20) -> DataFrame:
    """E-07: most frequent tokens; equal counts by token."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token").limit(n)


def problem_rows(bands: DataFrame) -> DataFrame:
    """E-08: statistics per trajectory with the share of banded tokens."""
    hot = F.count_if(F.col("color") != "black")
    valid = F.count("entropy")
    return bands.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("total_tokens"),
        valid.alias("valid_tokens"),
        F.avg("entropy").alias("avg_entropy"),
        hot.alias("high_entropy_count"),
        F.when(valid > 0, hot / valid).otherwise(0.0).alias("high_entropy_ratio"),
    )


def merge_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """E-09: continuous positions over the turns of a run; rows need run_id, turn, position."""
    lens = turns.groupBy("run_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    offs = running(lens, ["run_id"], [F.col("turn")], F.floor(F.col("turn") / chunk), sums={"upto": F.col("n")})
    offs = offs.select("run_id", "turn", (F.col("upto") - F.col("n")).alias("offset"))
    return turns.join(offs, ["run_id", "turn"]).withColumn("position", F.col("offset") + F.col("position")).drop("offset")


def rebanded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E-09: the merged run with bands over all its turns, and its statistics.

    Ranks and shares of a turn do not carry over to the run, so tokens are ranked
    anew in the merged positions; a run may span tasks, as in `banded`. Columns of
    an earlier banding of the turns are replaced.
    """
    merged = merge_turns(turns.drop("percentile", "color"))
    bands = banded(merged, ["run_id"])
    hot = F.count_if(F.col("color") != "black")
    shares = bands.groupBy("run_id").agg(F.count_distinct("turn").alias("turns"), hot.alias("high_entropy_count"), *[F.count_if(F.col("color") == c).alias(c) for c in ("red", "pink", "purple")])
    valid = F.col("valid_tokens")
    share = F.when(valid > 0, F.col("high_entropy_count") / valid).otherwise(0.0)
    return bands, statistics(merged, ["run_id"]).join(shares, "run_id").withColumn("high_entropy_ratio", share)


def provider_tokens(df: DataFrame, content: str = "content", k: int = 20) -> DataFrame:
    """E-10: provider log-probability arrays to token rows; missing ids become indexes."""
    from ..functions.probs import entropy, renormalised

    top = F.col("e.top_logprobs")
    has = F.coalesce(F.size(top) > 0, F.lit(False))
    lps = F.transform(top, lambda x: F.coalesce(x["logprob"], F.lit(0.0)))
    rows = df.select("*", F.posexplode(content).alias("position", "e")).drop(content)
    return rows.select(
        *[c for c in rows.columns if c != "e"],
        F.coalesce("e.token", F.lit("")).alias("token"),
        F.coalesce("e.token_id", F.lit(0)).alias("token_id"),
        F.when(has, entropy(lps, k)).alias("entropy"),
        F.when(has, F.transform(top, lambda x, i: F.coalesce(x["token_id"], i))).otherwise(F.expr("cast(array() as array<int>)")).alias("top_k_token_ids"),
        F.when(has, renormalised(lps, 1 << 30)).otherwise(F.expr("cast(array() as array<double>)")).alias("top_k_probs"),
    )


def trim_trailing_specials(tokens: DataFrame) -> DataFrame:
    """E-16: drop special tokens after the last ordinary one."""
    last = tokens.groupBy("traj_id").agg(
        F.max(F.when(~tok.is_trailing_special(F.col("token")), F.col("position"))).alias("last_ok")
    )
    return tokens.join(last, "traj_id").filter("position <= last_ok").drop("last_ok")


def degeneration(tokens: DataFrame, threshold: int = 10, chunk: int = CHUNK) -> DataFrame:
    """E-19: first position of at least `threshold` consecutive zero token ids.

    Each token takes the last non-zero position before it; a run is the zero
    tokens sharing that value, so runs crossing chunks need no special case.
    """
    rows = running(
        tokens.select("traj_id", "position", "token_id"),
        TOK,
        [F.col("position")],
        position_chunk("position", chunk),
        maxes={"prev": F.when(F.col("token_id") != 0, F.col("position"))},
    )
    runs = rows.filter("token_id = 0").groupBy("traj_id", "prev").agg(
        F.min("position").alias("start"), F.count(F.lit(1)).alias("n")
    )
    return runs.filter(F.col("n") >= threshold).groupBy("traj_id").agg(F.min("start").alias("degenerate_at"))


def reduction_grid(semantic: DataFrame, positions: int) -> DataFrame:
    """E-23: positive entropy reductions per sample on a fixed position grid, 0 where absent.

    A sample's rows on the grid come together as one short list, and the grid is
    made from it; its cells are never exchanged.
    """
    p = F.col("position").cast("long")
    on = (p >= 0) & (p < positions) & F.col("traj_id").isNotNull()
    got = F.collect_list(F.when(on, F.struct(p.alias("p"), F.greatest(F.coalesce("entropy_reduction", F.lit(0.0)), F.lit(0.0)).alias("r"))))
    rows = semantic.groupBy("traj_id").agg(got.alias("got")).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(positions - 1)))).withColumn("position", F.col("position").cast("long"))
    here = F.transform(F.filter("got", lambda g: g["p"] == F.col("position")), lambda g: g["r"])
    return rows.select("traj_id", "position", F.explode(F.when(F.size(here) > 0, here).otherwise(F.array(F.lit(0.0)))).alias("reduction"))


def grouping_examples(semantic: DataFrame, top: float = 5.0, n: int = 3) -> DataFrame:
    """E-24: the first n positions per sample at or above the percentile cut that have several groups."""
    cut = group_percentiles(semantic, TOK, "original_entropy", {"cut": (100.0 - top) / 100.0})
    hits = semantic.join(cut, "traj_id").filter("original_entropy >= cut AND num_groups > 1")
    w = W.partitionBy("traj_id").orderBy("position")
    return hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("cut", "k")
