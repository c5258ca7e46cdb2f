"""One JSON array of any size, read in byte ranges (S-04).

Spark's text source deals a file out in byte ranges; with `}` as the end of a
line every range gives whole fragments, none longer than a record. Whether a
fragment starts inside a string is not known, so its structural index holds both
cases: the parity of its quotes, and the change of depth if it starts outside
and if it starts inside. Indexes compose: inside a range by running sums, from
range to range over one row per range. A fragment that ends outside strings at
depth one ends a record. Fragments of a record are put together, also over the
borders of ranges, and parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

_SPLIT = "spark.sql.files.maxPartitionBytes"


def _depth(outside: Column) -> Column:
    """Brackets opened less brackets closed; the closing brace at the fragment's end is counted by the caller."""
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    return opened - (F.length(outside) - F.length(F.translate(outside, "]", "")))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """f, b, i (file, start of the byte range, order inside it), v, and the structural index p, d0, d1."""
    m = "_metadata."
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col(m + "file_path").alias("f"), F.col(m + "file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("v"), F.col(m + "file_size").alias("size")
    )
    # an escape never reaches over the end: what it escapes would be the brace
    parts = F.split(F.regexp_replace("v", r"(?s)\\.", ""), '"')
    side = lambda odd: F.array_join(F.filter(parts, lambda x, k: k % 2 == odd), "")
    flips = (F.size(parts) - 1) % 2
    # the brace closes if the fragment ends outside strings
    return rows.select("*", flips.alias("p"), (_depth(side(0)) - (1 - flips)).alias("d0"), (_depth(side(1)) - flips).alias("d1"))


def records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """file, number, json: the objects of the array in each file of `path`, in their order there.

    `split_bytes` is the size of a byte range, the session's own if not given.
    What follows the last whole object is no record; elements that are not
    objects are not read.
    """
    before = spark.conf.get(_SPLIT)
    if split_bytes:
        spark.conf.set(_SPLIT, str(split_bytes))
    try:
        frag = fragments(spark, path)
        inside = W.partitionBy("f", "b").orderBy("i")
        up_to, ahead = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
        rows = frag.withColumn("q", F.coalesce(F.sum("p").over(ahead), F.lit(0)) % 2)
        rows = rows.withColumn("e0", F.when(F.col("q") == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn("e1", F.when(F.col("q") == 0, F.col("d1")).otherwise(F.col("d0")))
        rows = stage(rows.select("f", "b", "i", "v", "size", "p", "q", "e0", "e1", F.sum("e0").over(up_to).alias("c0"), F.sum("e1").over(up_to).alias("c1")))
    finally:
        spark.conf.set(_SPLIT, before)
    # one row per byte range
    ranges = rows.groupBy("f", "b").agg(
        (F.sum("p") % 2).alias("p"), F.sum("e0").alias("d0"), F.sum("e1").alias("d1"), F.max("i").alias("last"), F.max("size").alias("size"), F.sum(F.octet_length("v") + 1).alias("bytes")
    )
    earlier = W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("s", F.coalesce(F.sum("p").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1"))
    ranges = ranges.withColumn("at", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    # a file that does not end in a brace has one byte less than its fragments with their ends: its last fragment is open
    own = W.partitionBy("f")
    open_ = (F.sum("bytes").over(own) > F.col("size")) & (F.col("b") == F.max("b").over(own))
    ranges = ranges.select("f", "b", "s", "at", F.when(open_, F.col("last")).alias("cut"))
    depth = F.col("at") + F.when(F.col("s") == 0, F.col("c0")).otherwise(F.col("c1"))
    ended = (depth == 1) & ((F.col("s") + F.col("q") + F.col("p")) % 2 == 0)
    ended &= ~F.col("i").eqNullSafe(F.col("cut"))
    told = rows.join(ranges, ["f", "b"]).select("f", "b", "i", "v", ended.cast("int").alias("ended"))
    done = told.groupBy("f", "b").agg(F.sum("ended").alias("n"))
    done = done.select("f", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ago"))
    told = told.withColumn("here", F.coalesce(F.sum("ended").over(ahead), F.lit(0))).join(done, ["f", "b"])
    whole = told.groupBy("f", (F.col("ago") + F.col("here")).alias("number")).agg(F.array_sort(F.collect_list(F.struct("b", "i", "v"))).alias("parts"), F.max("ended").alias("ended"))
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["v"]), "}"), F.lit("}"))
    # what stands between two elements, and the array's own bracket before the first
    return whole.filter("ended = 1").select(F.col("f").alias("file"), "number", F.regexp_replace(text, r"^[\s,]*(\[)?\s*", "").alias("json"))


def read_large_array(spark: SparkSession, path: str, schema: str, split_bytes: int | None = None) -> DataFrame:
    """S-04: the records of huge JSON arrays, read by as many tasks as there are byte ranges; malformed records are dropped."""
    parsed = records(spark, path, split_bytes).select(F.from_json("json", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.filter("r._broken IS NULL").select("r.*").drop("_broken")
