"""Group-wise ranks, running values, percentiles and statistics that survive hot groups.

One trajectory or problem may hold a third of all rows, so nothing here puts a
group of more than CHUNK rows into one task. Such a group is cut into chunks by a
monotone function of its ordering column. Row-level windows run per (group, chunk); only one
summary row per chunk is windowed per group, and its result is joined back on
(group, chunk), the key the row-level window is already partitioned by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 65536  # token positions per chunk; typical trajectories fit in one

_C = "__chunk"


def position_chunk(position: str | Column, width: int = CHUNK) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.floor(p / F.lit(width)).cast("long")


def value_bucket(value: str | Column) -> Column:
    """Monotone bucket of a number, fine near zero and coarse far out.

    Built from square roots and products only, which are exactly rounded, so a
    value lands in the same bucket in every attempt of every task.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return (F.signum(v) * F.ceil(F.sqrt(F.sqrt(F.abs(v))) * F.lit(64.0))).cast("long")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column | Sequence[Column],
    name: str,
    descending_chunk: bool = False,
    total: str | None = None,
    limit: int = CHUNK,
) -> DataFrame:
    """0-based row number per group; `chunk`, one column or several, must be monotone in the first order columns.

    Groups of at most `limit` rows are numbered whole, in one exchange. Only where
    there are larger ones, fewer than one per `limit` rows, are these cut into chunks.
    `total` names a column for the group's size.
    """
    keys = list(keys)
    cols = [chunk] if isinstance(chunk, Column) else list(chunk)
    names = [_C, *[f"{_C}{i}" for i in range(1, len(cols))]]
    base = df.withColumns({n: -c if descending_chunk else c for n, c in zip(names, cols)})
    base = _present(base, [*keys, *names])
    large = large_groups(base, keys, limit)
    if large is None:
        return _whole(base, keys, order, name, total).drop(*names)
    large = F.broadcast(large)
    small = _whole(base.join(large, keys, "left_anti"), keys, order, name, total)
    return small.unionByName(_chunked(base.join(large, keys, "left_semi"), keys, names, order, name, total)).drop(*names)


def _present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows without nulls in these columns: a null key or value has no number."""
    for n in names:
        df = df.filter(F.col(n).isNotNull())
    return df


def large_groups(df: DataFrame, keys: Sequence[str], limit: int = CHUNK) -> DataFrame | None:
    """Keys of the groups of more than `limit` rows; None if there are none."""
    keys = list(keys)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys)
    return None if large.isEmpty() else large


def _whole(df: DataFrame, keys: list[str], order: Sequence[Column], name: str, total: str | None) -> DataFrame:
    w = W.partitionBy(*keys)
    out = df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
    return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out


def _chunked(base: DataFrame, keys: list[str], names: list[str], order: Sequence[Column], name: str, total: str | None) -> DataFrame:
    """Numbered within each chunk, then moved by the sizes of the chunks before, which give `total` for free."""
    local = base.withColumn(name, F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order)) - 1)
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        base.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )
    if total:
        sizes = sizes.withColumn(total, F.sum("__n").over(W.partitionBy(*keys)))
    out = local.join(sizes.drop("__n"), [*keys, *names])
    return out.withColumn(name, (F.col(name) + F.col("__off")).cast("long")).drop("__off")


def _cell(x: str, low: str, high: str) -> Column:
    """Place of a value among CHUNK equal parts of a range; monotone, since every step is correctly rounded."""
    part = F.floor((F.col(x) - F.col(low)) / (F.col(high) - F.col(low)) * F.lit(float(CHUNK))).cast("long")
    return F.when(F.col(high) > F.col(low), part).otherwise(F.lit(0).cast("long"))


def value_chunks(df: DataFrame, keys: Sequence[str], value: str, tie: Column, limit: int = CHUNK) -> tuple[DataFrame, list[str]]:
    """`df` with columns that cut each group into chunks in the order of (value, tie), and their names.

    A value bucket of more than `limit` rows is cut by the range that its values
    really span; a value with more than `limit` rows of its own is taken out of
    its part and cut by the tie column, which is a number.
    """
    keys, names = list(keys), ["__vb", "__cell", "__sub", "__tie"]
    base = df.withColumn("__x", F.col(value).cast("double")).withColumn("__vb", value_bucket(value))
    at = [*keys, "__vb"]
    hot = base.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).filter(F.col("__n") > limit)
    often = base.join(hot.select(*at), at, "left_semi").groupBy(*at, "__x").agg(F.count(F.lit(1)).alias("__m")).filter(F.col("__m") > limit)
    often = often.groupBy(*at).agg(F.sort_array(F.collect_list("__x")).alias("__often"))  # fewer than one per `limit` rows
    known = hot.drop("__n").join(often, at, "left")
    rows = base.join(F.broadcast(known), at, "left")  # fewer than one bucket per `limit` rows
    heavy = F.coalesce(F.array_contains("__often", F.col("__x")), F.lit(False))
    below = F.coalesce(F.size(F.filter("__often", lambda h: h < F.col("__x"))), F.lit(0))
    below = F.when(F.col("__often").isNull(), 0).otherwise(below)
    rows = rows.withColumns(
        {
            "__cell": F.coalesce(_cell("__x", "__lo", "__hi"), F.lit(0)),
            "__sub": (2 * below + heavy.cast("int")).cast("long"),
            "__tie": F.when(heavy, value_bucket(tie)).otherwise(F.lit(0).cast("long")),
        }
    )
    return rows.drop("__x", "__lo", "__hi", "__often"), names


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[Column],
    name: str,
    descending: bool = False,
    total: str | None = None,
    limit: int = CHUNK,
) -> DataFrame:
    """0-based rank by a numeric column with explicit tie order; the first tie column is a number.

    Groups of at most `limit` rows are ranked whole; value chunks are made for larger ones alone.
    """
    keys = list(keys)
    order = [F.col(value).desc() if descending else F.col(value).asc(), *ties]
    rows = _present(df, [*keys, value])
    large = large_groups(rows, keys, limit)
    if large is None:
        return _whole(rows, keys, order, name, total)
    large = F.broadcast(large)
    cut, names = value_chunks(rows.join(large, keys, "left_semi"), keys, value, ties[0], limit)
    down = lambda n: -F.col(n) if descending and n != "__tie" else F.col(n)
    cut = _present(cut.withColumns({n: down(n) for n in names}), names)
    small = _whole(rows.join(large, keys, "left_anti"), keys, order, name, total)
    return small.unionByName(_chunked(cut, keys, names, order, name, total).drop(*names))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima per group in the given order."""
    keys, sums, maxes = list(keys), sums or {}, maxes or {}
    vals = {**sums, **maxes}
    agg = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}}
    base = df.withColumns({_C: chunk, **{f"__v_{n}": e for n, e in vals.items()}})
    upto = W.partitionBy(*keys, _C).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    totals = base.groupBy(*keys, _C).agg(*[f(f"__v_{n}").alias(f"__t_{n}") for n, f in agg.items()])
    totals = totals.select(*keys, _C, *[f(f"__t_{n}").over(before).alias(f"__o_{n}") for n, f in agg.items()])
    out = base.select("*", *[f(f"__v_{n}").over(upto).alias(n) for n, f in agg.items()]).join(totals, [*keys, _C])
    done = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in sums}
    done |= {n: F.greatest(F.col(n), F.col(f"__o_{n}")) for n in maxes}
    return out.withColumns(done).drop(_C, *[f"__{k}_{n}" for n in vals for k in "vo"])


def selected(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]], limit: int = CHUNK) -> DataFrame:
    """Per group `__total` and the values `__r0`, `__r1`, .. at the 0-based ascending ranks that `ranks(total)` names.

    A group of at most `limit` values gathers and sorts them, in one exchange of
    the values alone. Larger ones, fewer than one per `limit` rows, are named to
    all tasks and go through counts of their values.
    """
    keys = list(keys)
    if not keys:
        return _selected_by_counts(df, keys, value, ranks)
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    large = F.broadcast(src.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*keys))
    lists = src.join(large, keys, "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    lists = lists.withColumn("__total", F.size("__xs").cast("long"))
    picks = [F.get("__xs", r.cast("int")).alias(f"__r{i}") for i, r in enumerate(ranks(F.col("__total")))]
    return lists.select(*keys, "__total", *picks).unionByName(_selected_by_counts(src.join(large, keys, "left_semi"), keys, "__x", ranks))


def _selected_by_counts(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """The same for groups of any size.

    Counts per (group, value bucket) combine map-side and find the buckets that
    hold the ranks. The values of these alone are counted, so any number of equal
    ones is one row, and cut into CHUNK parts of the range they really span;
    counts per part find the parts that hold the ranks, and only inside such a
    part are values put in order.
    """
    keys, whole = list(keys), not keys
    src = df.filter(F.col(value).isNotNull())
    if whole:
        src, keys = src.withColumn("__all", F.lit(1)), ["__all"]
    src = src.select(*keys, F.col(value).cast("double").alias("__x")).withColumn("__b", value_bucket("__x"))
    wanted = F.array(*[r.cast("long") for r in ranks(F.col("__total"))])
    inside = F.exists(wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    ahead = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    hist = (
        src.groupBy(*keys, "__b")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(W.partitionBy(*keys)))
    )
    targets = hist.filter(inside).select(*keys, "__b", "__before", "__total", "__min", "__max")
    near = src.join(targets, [*keys, "__b"]).withColumn("__c", _cell("__x", "__min", "__max"))
    part = [*keys, "__b", "__c"]
    vals = near.groupBy(*part, "__x", "__before", "__total").agg(F.count(F.lit(1)).alias("__m"))
    ahead = W.partitionBy(*keys, "__b").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    cells = vals.groupBy(*part, "__before", "__total").agg(F.sum("__m").alias("__n"))
    cells = cells.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(ahead), F.lit(0))).filter(inside).drop("__n")
    upto = W.partitionBy(*part).orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    vals = vals.drop("__before", "__total").join(cells, part).withColumn("__hi", F.col("__before") + F.sum("__m").over(upto))
    held = lambda r: (r >= F.col("__hi") - F.col("__m")) & (r < F.col("__hi"))
    picks = [F.max(F.when(held(r.cast("long")), F.col("__x"))).alias(f"__r{i}") for i, r in enumerate(ranks(F.col("__total")))]
    got = vals.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)
    return got.drop("__all") if whole else got


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per entry of `probs`."""
    at = lambda total, p: (total - 1) * F.lit(float(p))
    got = selected(df, keys, value, lambda total: [f(at(total, p)) for p in probs.values() for f in (F.floor, F.ceil)])
    place = [at(F.col("__total"), p) for p in probs.values()]
    low, high = (lambda i: F.col(f"__r{2 * i}")), (lambda i: F.col(f"__r{2 * i + 1}"))
    return got.select(*keys, *[(low(i) + (high(i) - low(i)) * (a - F.floor(a))).alias(n) for i, (n, a) in enumerate(zip(probs, place))])


def with_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregate and join back: the aggregate combines map-side, the join splits
    under AQE, where a window over the group would hold all of it in one task.
    """
    keys = list(keys)
    cols = [e.alias(n) for n, e in aggs.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*cols)))  # the right side is one row
    return df.join(df.groupBy(*keys).agg(*cols), keys)


def per_chunk(values: DataFrame, rows: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """Copy one-row-per-group values onto each (group, chunk) present in `rows`.

    A large table then joins on the bounded key (group, chunk) and not on the group.
    """
    return rows.select(*keys, chunk).distinct().join(values, list(keys))
