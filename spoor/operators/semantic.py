"""Semantic entropy: candidates merged by embedding similarity (E-11, E-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import is_math_symbol

POS = ["traj_id", "position"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _pairs(sets: DataFrame) -> DataFrame:
    """Index pairs i < j inside one position's candidate list, which top-k bounds at k entries."""
    ids = F.col("top_k_token_ids")
    pairs = F.flatten(
        F.transform(
            ids,
            lambda a, i: F.transform(
                F.filter(F.transform(ids, lambda b, j: F.struct(j.alias("j"), b.alias("b"))), lambda x: x["j"] > i),
                lambda x: F.struct(i.alias("i"), x["j"].alias("j"), F.least(a, x["b"]).alias("a"), F.greatest(a, x["b"]).alias("b")),
            ),
        )
    )
    return sets.select(*POS, F.inline(pairs))


def similar_pairs(sets: DataFrame, embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Token pairs that occur together and have cosine > threshold.

    Distinct pairs are taken first, with map-side combine, so vectors travel once
    per pair of the vocabulary and not once per position.
    """
    norm = embeddings.withColumn("n", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).select("token_id", "embedding", "n")
    left = norm.select(F.col("token_id").alias("a"), F.col("embedding").alias("va"), F.col("n").alias("na"))
    right = norm.select(F.col("token_id").alias("b"), F.col("embedding").alias("vb"), F.col("n").alias("nb"))
    pairs = _pairs(sets).select("a", "b").distinct()
    cos = dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))
    near = pairs.filter("a <> b").join(left, "a").join(right, "b").filter(cos > threshold).select("a", "b")
    return near.unionByName(pairs.filter("a = b"))


def semantic_entropy(sets: DataFrame, embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """E-11. `sets` rows: traj_id, position, token, entropy, top_k_token_ids, top_k_probs.

    Connected components of at most k candidates: folding the edges once and
    merging the two labels of each edge gives the components. Pairs are formed
    once, to find those of the vocabulary that occur together; the similar ones
    come back as one list per token, so a position sends its k candidates and
    not its k(k-1)/2 pairs.
    """
    kind = sets.schema["top_k_token_ids"].dataType.elementType
    ids, none = F.col("top_k_token_ids"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    near = similar_pairs(sets, embeddings, threshold).filter("a <> b")
    lists = near.groupBy("a").agg(F.collect_list("b").alias("near"))  # at most a vocabulary
    each = sets.select(*POS, ids.alias("ids"), F.explode(F.array_distinct(ids)).alias("a")).join(lists, "a")
    each = each.select(*POS, "a", F.array_intersect("near", "ids").alias("bs")).filter(F.size("bs") > 0)
    pairs = F.transform("bs", lambda b: F.struct(F.col("a").cast("long").alias("a"), b.cast("long").alias("b")))
    edges = each.groupBy(*POS).agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("edges"))  # at most k(k-1)/2
    n = F.size("top_k_token_ids")
    rows = sets.join(edges, POS, "left").withColumn("is_math", is_math_symbol(F.col("token")))
    at = lambda lab, x: F.get(lab, (F.array_position(ids, x.cast(kind)) - 1).cast("int"))
    labels = F.aggregate(
        F.coalesce(F.col("edges"), none),
        F.transform(ids, lambda x: F.array_position(ids, x)),  # equal tokens start together
        lambda lab, e: F.transform(lab, lambda x: F.when(x == at(lab, e["b"]), at(lab, e["a"])).otherwise(x)),
    )
    rows = rows.withColumn("labels", labels)
    mass = F.transform(
        F.array_distinct("labels"),
        lambda g: F.aggregate(
            F.zip_with("labels", "top_k_probs", lambda l, p: F.when(l == g, p).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x
        ),
    )
    h = F.aggregate(mass, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    usable = F.col("entropy").isNotNull() & (n > 0)
    out = rows.select(
        *POS,
        "token",
        F.when(usable, F.col("entropy")).alias("original_entropy"),
        F.when(usable, F.when(F.col("is_math"), F.col("entropy")).otherwise(h)).alias("semantic_entropy"),
        F.when(usable, F.when(F.col("is_math"), n).otherwise(F.size(F.array_distinct("labels")))).otherwise(0).alias("num_groups"),
        (usable & F.col("is_math")).alias("is_math_symbol"),
    )
    return out.withColumn("entropy_reduction", F.when(F.col("is_math_symbol"), 0.0).otherwise(F.col("original_entropy") - F.col("semantic_entropy")))


def semantic_summary(semantic: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """E-13: positions, positions with a reduction, mean reduction and most groups."""
    valid = F.col("semantic_entropy").isNotNull()
    plain = valid & ~F.col("is_math_symbol")
    drop = plain & (F.col("entropy_reduction") > 0)
    n_plain = F.count_if(plain)
    g = semantic.groupBy(*keys) if keys else semantic
    return g.agg(
        F.count(F.lit(1)).alias("total_positions"),
        F.count_if(valid).alias("valid_positions"),
        F.count_if(valid & F.col("is_math_symbol")).alias("math_symbol_positions"),
        n_plain.alias("non_math_positions"),
        F.count_if(drop).alias("positions_with_reduction"),
        F.when(n_plain > 0, F.coalesce(F.sum(F.when(drop, F.col("entropy_reduction"))), F.lit(0.0)) / n_plain).otherwise(0.0).alias("avg_entropy_reduction"),
        F.when(n_plain > 0, F.count_if(drop) / n_plain).otherwise(0.0).alias("reduction_rate"),
        F.coalesce(F.max(F.when(plain, F.col("num_groups"))), F.lit(0)).alias("max_semantic_groups"),
    )
