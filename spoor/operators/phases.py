"""High-entropy phases (H-01, H-02, H-10, H-12) over long token tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .spread import CHUNK, group_percentiles, per_chunk, position_chunk, running

Combo = tuple[float, float, int]  # top percent, bottom percent, consecutive lows


def thresholds(tokens: DataFrame, top: float = 5.0, bottom: float = 50.0) -> DataFrame:
    """H-01: high and low cut per trajectory."""
    return group_percentiles(tokens, ["traj_id"], "entropy", {"high": (100.0 - top) / 100.0, "low": bottom / 100.0})


def _cuts(tokens: DataFrame, combos: list[Combo]) -> DataFrame:
    """One row per trajectory and (bottom, cons): the low cut, and an array of the high cuts of its tops."""
    probs = {f"p{p:g}".replace(".", "_"): p / 100.0 for t, b, _ in combos for p in (100.0 - t, b)}
    col = {p: F.col(f"p{p:g}".replace(".", "_")) for t, b, _ in combos for p in (100.0 - t, b)}
    cut = group_percentiles(tokens, ["traj_id"], "entropy", probs)
    groups: dict[tuple[float, int], list[float]] = {}
    for t, b, c in combos:
        groups.setdefault((b, c), []).append(t)
    rows = [
        F.struct(
            F.lit(float(b)).alias("bottom"),
            F.lit(int(c)).alias("cons"),
            col[b].alias("low"),
            F.array(*[F.struct(F.lit(float(t)).alias("top"), col[100.0 - t].alias("high")) for t in tops]).alias("tops"),
        )
        for (b, c), tops in groups.items()
    ]
    return cut.select("traj_id", F.inline(F.array(*rows)))


def phases(tokens: DataFrame, combos: Iterable[Combo] = ((5.0, 50.0, 3),), chunk: int = CHUNK) -> DataFrame:
    """H-02/H-10: rows (traj_id, top, bottom, cons, start, duration, closed, start_n), all parameter sets in one job.

    Where high > low a token is never both, and a phase is a gaps-and-islands
    problem; other cuts (ties, top + bottom > 100) go through an ordered scan.
    """
    combos = list(dict.fromkeys((float(t), float(b), int(c)) for t, b, c in combos))
    toks = tokens.filter(F.col("entropy").isNotNull()).select(
        "traj_id", "position", "entropy", position_chunk("position", chunk).alias("chunk")
    )
    cuts = stage(_cuts(tokens, combos))  # one row per trajectory, read by several branches
    clear = cuts.withColumn("tops", F.filter("tops", lambda t: t["high"] > F.col("low"))).filter(F.size("tops") > 0)
    tied = cuts.withColumn("tops", F.filter("tops", lambda t: t["high"] <= F.col("low"))).filter(F.size("tops") > 0)
    tied = tied.select("traj_id", "bottom", "cons", "low", F.inline("tops"))
    n_tops = max(sum(1 for t, b, c in combos if (b, c) == g) for g in {(b, c) for _, b, c in combos})
    found = _islands(toks, clear, n_tops)
    return found if tied.isEmpty() else found.unionByName(_scanned(toks, tied))


_K = ["traj_id", "bottom", "cons"]


def _labelled(toks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Tokens with n_idx (1-based over non-null tokens), seg (closings before) and is_end."""
    kc = [*_K, "chunk"]
    here = per_chunk(cuts, toks, ["traj_id"], "chunk")
    # `local` is read by both branches below with the same columns, so its exchange is reused
    rows = toks.join(here.drop("tops"), ["traj_id", "chunk"])
    w = W.partitionBy("traj_id", "chunk", "bottom", "cons").orderBy("position")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    local = (
        rows.withColumn("l_idx", F.row_number().over(w))
        .withColumn("l_keep", F.max(F.when(F.col("entropy") > F.col("low"), F.col("l_idx"))).over(upto))
        .withColumn("l_end", (F.col("l_keep").isNotNull() & (F.col("l_idx") - F.col("l_keep") == F.col("cons"))).cast("int"))
        .withColumn("l_seg", F.sum("l_end").over(upto) - F.col("l_end"))
    )
    # One row per chunk: length, last token above the low cut, leading lows, closings.
    part = local.groupBy(*kc).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("l_keep").alias("keep"),
        F.min("l_keep").alias("first_keep"),
        F.sum("l_end").alias("ends"),
    )
    prev = W.partitionBy(*_K).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    part = (
        part.withColumn("n_before", F.coalesce(F.sum("n").over(prev), F.lit(0)))
        .withColumn("keep_before", F.coalesce(F.max(F.col("n_before") + F.col("keep")).over(prev), F.lit(0)))
        .withColumn("carry", F.col("n_before") - F.col("keep_before"))
        .withColumn("lead", F.coalesce(F.col("first_keep") - 1, F.col("n")))
        # a low run that crosses the chunk border closes inside this chunk's leading lows
        .withColumn("late", (F.col("carry") < F.col("cons")) & (F.col("carry") + F.col("lead") >= F.col("cons")))
        .withColumn("late_ends", F.col("ends") + F.col("late").cast("int"))
        .withColumn("seg_before", F.coalesce(F.sum("late_ends").over(prev), F.lit(0)))
        .select(*kc, "n_before", "carry", "late", "seg_before")
        .join(cuts.select(*_K, "tops"), _K)
    )
    late_at = F.col("cons") - F.col("carry")
    return (
        local.join(part, kc)
        .withColumn("n_idx", F.col("n_before") + F.col("l_idx"))
        .withColumn(
            "is_end",
            (F.col("l_end") == 1) | (F.col("late") & F.col("l_keep").isNull() & (F.col("l_idx") == late_at)),
        )
        .withColumn(
            "seg", F.col("seg_before") + F.col("l_seg") + (F.col("late") & (F.col("l_idx") > late_at)).cast("int")
        )
    )


def _islands(toks: DataFrame, cuts: DataFrame, n_tops: int) -> DataFrame:
    rows = _labelled(toks, cuts)
    aggs, each = [], []
    for i in range(n_tops):
        h = F.get("tops", F.lit(i))
        hit = F.col("entropy") >= h["high"]
        aggs += [
            F.max(h["top"]).alias(f"top{i}"),
            F.min(F.when(hit, F.col("position"))).alias(f"start{i}"),
            F.min(F.when(hit, F.col("n_idx"))).alias(f"from{i}"),
        ]
        each.append(F.struct(F.col(f"top{i}").alias("top"), F.col(f"start{i}").alias("start"), F.col(f"from{i}").alias("n")))
    segs = rows.groupBy(*_K, "seg").agg(F.max("n_idx").alias("last_n"), F.max("is_end").alias("closed"), *aggs)
    length = F.col("last_n") - F.col("n") + 1 - F.when(F.col("closed"), F.col("cons")).otherwise(0)
    return (
        segs.select(*_K, "last_n", "closed", F.inline(F.array(*each)))
        .filter(F.col("start").isNotNull())
        .select("traj_id", "top", "bottom", "cons", "start", length.cast("long").alias("duration"), "closed", F.col("n").alias("start_n"))
    )


# --- ordered scan for cuts where a token can be both high and low -------------------------
# Entry states of a chunk: 0 = outside, k + 1 = inside with k lows counted.


def _scan(entropy, high: float, low: float, cons: int, state: int):
    """One chunk from one entry state: exit state, tokens until the carried phase closes, opened spans."""
    inside, lows = state > 0, max(state - 1, 0)
    carried, begin, length = None, None, 0
    spans = []
    for i, e in enumerate(entropy):
        if not inside:
            if e >= high:
                inside, begin, length, lows = True, i, 1, 0
            continue
        length += 1
        lows = lows + 1 if e <= low else 0
        if lows >= cons:
            if begin is None:
                carried = length
            else:
                spans.append((begin, length - cons))
            inside, begin, length, lows = False, None, 0, 0
    return (lows + 1 if inside else 0), carried, spans, begin, length


#: An ordered scan goes through so many parts of whole chunks, more where a part would hold over CHUNK rows on average.
PARTS = 1024


def _by_chunk(rows: DataFrame, key: list[str], parts: int, out: str, step: Callable[[dict, dict[str, np.ndarray]], list[tuple]]) -> DataFrame:
    """key, chunk and what `step(first row, columns in order of position)` gives for each chunk; Python is called per part, not per chunk."""
    at = [*key, "chunk"]
    names = [*at, *[x.split()[0] for x in out.split(", ")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*at, "position"])
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        new = np.zeros(len(pdf), bool)
        for c in at:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        found = []
        for a, z in zip(cuts, cuts[1:]):
            h = {c: v[a] for c, v in columns.items()}
            found += [(*(h[c] for c in at), *x) for x in step(h, {c: v[a:z] for c, v in columns.items()})]
        return pd.DataFrame(found, columns=names)

    parted = rows.withColumn("part", F.pmod(F.xxhash64(*at), F.lit(parts)))
    return parted.groupBy("part").applyInPandas(run, f"traj_id string, top double, bottom double, cons int, chunk long, {out}")


def _scanned(toks: DataFrame, cuts: DataFrame) -> DataFrame:
    key = ["traj_id", "top", "bottom", "cons"]
    rows = toks.join(per_chunk(cuts, toks, ["traj_id"], "chunk"), ["traj_id", "chunk"])
    n_parts = max(PARTS, toks.count() * cuts.select("top", "bottom", "cons").distinct().count() // CHUNK)

    def moves(h: dict, part: dict[str, np.ndarray]) -> list[tuple]:
        e = part["entropy"].tolist()
        return [([_scan(e, h["high"], h["low"], int(h["cons"]), s)[0] for s in range(int(h["cons"]) + 1)],)]

    table = _by_chunk(rows, key, n_parts, "moves array<int>", moves)

    # Entry state per chunk: compose the per-chunk tables, one short row per chunk.
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "moves")))
    entry = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<struct<chunk:bigint,entry:int>>)").alias("o")),
        lambda a, x: F.struct(
            F.get(x["moves"], a["s"]).alias("s"),
            F.concat(a["o"], F.array(F.struct(x["chunk"].alias("chunk"), a["s"].alias("entry")))).alias("o"),
        ),
        lambda a: a["o"],
    )
    entries = table.groupBy(*key).agg(entry.alias("o")).select(*key, F.inline("o"))

    def emit(h: dict, part: dict[str, np.ndarray]) -> list[tuple]:
        pos, e = part["position"].tolist(), part["entropy"].tolist()
        _, carried, spans, begin, length = _scan(e, h["high"], h["low"], int(h["cons"]), int(h["entry"]))
        out = [("whole", pos[b], d, True, b + 1) for b, d in spans]
        closes = carried is not None
        out.append(("in", None, carried if closes else len(pos), closes, None))
        if begin is not None:
            out.append(("open", pos[begin], length, False, begin + 1))
        return out

    kinds = "kind string, start long, n long, closed boolean, l_n long"
    parts = _by_chunk(rows.join(entries, [*key, "chunk"]), key, n_parts, kinds, emit)
    before = W.partitionBy("traj_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = toks.groupBy("traj_id", "chunk").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("traj_id", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("n_before"))
    parts = parts.join(sizes, ["traj_id", "chunk"]).withColumn("start_n", F.col("n_before") + F.col("l_n"))
    whole = parts.filter("kind = 'whole'").select(*key, "start", F.col("n").alias("duration"), "closed", "start_n")
    # A phase open at a chunk's end runs through later chunks until one closes it.
    after = W.partitionBy(*key).orderBy("chunk")
    border = (
        parts.filter("kind <> 'whole'")
        .groupBy(*key, "chunk")
        .agg(
            F.max(F.when(F.col("kind") == "in", F.col("n"))).alias("n_in"),
            F.max("closed").alias("closes"),
            F.max("start").alias("start"),
            F.max("start_n").alias("start_n"),
            F.max(F.when(F.col("kind") == "open", F.col("n"))).alias("n_open"),
        )
        .withColumn("run", F.sum("n_in").over(after.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn(
            "end_run",
            F.first(F.when(F.col("closes"), F.col("run")), True).over(after.rowsBetween(1, W.unboundedFollowing)),
        )
        .withColumn("last_run", F.last("run").over(after.rowsBetween(0, W.unboundedFollowing)))
    )
    tail = F.coalesce(F.col("end_run") - F.col("cons"), F.col("last_run")) - F.col("run")
    crossing = border.filter(F.col("start").isNotNull()).select(
        *key, "start", (F.col("n_open") + tail).alias("duration"), F.col("end_run").isNotNull().alias("closed"), "start_n"
    )
    return whole.unionByName(crossing).withColumn("start", F.col("start").cast("int"))


def running_durations(
    tokens: DataFrame, top: float = 5.0, bottom: float = 50.0, cons: int = 3, chunk: int = CHUNK
) -> DataFrame:
    """H-12: tokens with the length of the phase so far; 0 outside, on null entropy and on a closing token."""
    key, order, c = ["traj_id"], [F.col("position")], position_chunk("position", chunk)
    # tokens a phase covers before its closing one
    span = F.col("duration") + F.when(F.col("closed"), F.col("cons") - 1).otherwise(0)
    starts = stage(phases(tokens, [(top, bottom, cons)], chunk)).select(
        "traj_id", F.col("start").alias("position"), "start_n", span.alias("span"), position_chunk("start", chunk).alias("chunk")
    )
    toks = tokens.select("traj_id", "position", "entropy", c.alias("chunk"))
    rows = toks.join(starts, ["traj_id", "chunk", "position"], "left")
    began = F.when(F.col("span").isNotNull(), F.struct(F.col("start_n").alias("n"), "span"))
    counted = F.col("entropy").isNotNull().cast("long")
    rows = running(rows, key, order, F.col("chunk"), sums={"n_idx": counted}, maxes={"cur": began})
    so_far = F.col("n_idx") - F.col("cur.n") + 1
    inside = F.col("entropy").isNotNull() & (so_far <= F.col("cur.span"))
    return rows.select("traj_id", "position", F.when(inside, so_far).otherwise(F.lit(0)).cast("long").alias("duration"))
