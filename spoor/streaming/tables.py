"""Tables that a stream keeps up to date, written in proportion to what arrives (T-02, T-08).

A table is a folder: `data/v=<batch>/<bucket>` holds the rows of a bucket (a
hash of the key) as one batch left them, and `manifest/v=<batch>` names the
folder of every bucket. A batch reads and rewrites only the buckets that its
rows fall into and then writes its manifest; a bucket it leaves alone keeps its
folder. A batch that is repeated after a failure starts from the manifest before
it, so it gives the same table again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64  # a manifest has a line per bucket; a large table takes more


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that have left a whole manifest, in order."""
    fs, p = _at(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def folders(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Folder of every bucket in a version; at most a line per bucket."""
    rows = spark.read.schema("bucket int, folder string").json(f"{path}/manifest/v={version}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _write_manifest(spark: SparkSession, path: str, version: int, named: dict[int, str]) -> None:
    """Under another name first: a manifest is there as a whole or not at all."""
    fs, draft = _at(spark, f"{path}/manifest/draft-{version}")
    _, final = _at(spark, f"{path}/manifest/v={version}")
    out = fs.create(draft, True)
    out.write(bytearray("".join(json.dumps({"bucket": b, "folder": f}) + "\n" for b, f in sorted(named.items())), "utf-8"))
    out.close()
    fs.delete(final, False)
    fs.rename(draft, final)


def merge(batch: DataFrame, version: int, path: str, keys: Sequence[str], order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put a batch into the table at `path`; the buckets it rewrote are returned.

    Of rows with one key the greatest `order` stays; without an order the batch's
    row replaces the earlier one. Equal orders are settled by a hash of the row. A
    null key is a key of its own. An empty batch writes a manifest only.
    """
    spark, cols = batch.sparkSession, batch.columns
    earlier = [v for v in versions(spark, path) if v < version]
    named = folders(spark, path, earlier[-1]) if earlier else {}

    def keyed(df: DataFrame, new: int) -> DataFrame:
        rank = F.struct(F.col(order) if order else F.lit(new), F.xxhash64(*cols))
        slot = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        return df.select(slot.alias("s"), F.struct(*keys).alias("k"), rank.alias("o"), F.struct(*cols).alias("r"))

    def last(df: DataFrame) -> DataFrame:
        return df.groupBy("s", "k").agg(F.max_by("r", "o").alias("r"), F.max("o").alias("o"))

    mine = last(keyed(batch, 1)).persist()  # read twice: for the buckets it touches and for the merge
    try:
        touched = [r["s"] for r in mine.select("s").distinct().collect()]
        if touched:
            rows = mine
            old = [f"{path}/{named[b]}" for b in touched if b in named]
            if old:
                rows = last(mine.select("s", "k", "o", "r").unionByName(keyed(spark.read.schema(batch.schema).parquet(*old), 0)).repartition("s"))
            bucket = "bucket"
            while bucket in cols:
                bucket += "_"
            out = rows.select(F.col("s").alias(bucket), "r.*")
            (out if old else out.repartition(bucket)).write.mode("overwrite").partitionBy(bucket).parquet(f"{path}/data/v={version}")
            named.update({b: f"data/v={version}/{bucket}={b}" for b in touched})
        _write_manifest(spark, path, version, named)
    finally:
        mine.unpersist()
    return sorted(touched)


def read(spark: SparkSession, path: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The table as its newest batch (or an earlier one) left it."""
    known = versions(spark, path)
    named = folders(spark, path, known[-1] if version is None else version) if known else {}
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in named.values()])


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove bucket folders and manifests that the newest `keep` versions don't need; returns the folders removed."""
    known = versions(spark, path)
    kept = known[-max(keep, 1) :]
    needed = {f for v in kept for f in folders(spark, path, v).values()}
    old = {f for v in known if v not in kept for f in folders(spark, path, v).values()} - needed
    for f in old:
        fs, p = _at(spark, f"{path}/{f}")
        fs.delete(p, True)
    for v in known:
        if v not in kept:
            fs, p = _at(spark, f"{path}/manifest/v={v}")
            fs.delete(p, False)
    return len(old)


def keep(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str | None = None, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Run what is available into the table at `path`.

    Mode `append` with an order keeps the last row per key; mode `update` on an
    aggregation writes only the groups that a batch has changed.
    """
    q = (
        stream.writeStream.foreachBatch(lambda batch, n: merge(batch, n, path, keys, order, buckets) and None)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
