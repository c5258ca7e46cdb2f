"""Dataset adapters by name: find result folders, read each in its layout, give canonical rows (U-03).

    runs = adapters.read(spark, "trajectories", "results/*_n64", runs="release_v[56]")

Folders are listed and narrowed by name before anything is read; filters and
columns of the query then reach the scan as usual. All folders of one layout are
one scan. A folder's layout is seen from the first bytes of one of its files:
Parquet, a JSON array, or JSON lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import problem_id, trajectory_index
from .arrays import read_large_array

TRAJECTORIES = "id string, original_id string, trajectory_index int, generated_text string, solution string, source string, reward double, termination_reason string"
PROBLEMS = "id string, problem string, solution string"


class Adapter(NamedTuple):
    """What a dataset is made of: the columns its files are read with, and how they become canonical rows."""

    schema: str
    prepare: Callable[[DataFrame], DataFrame]


def trajectories(rows: DataFrame) -> DataFrame:
    """Rows without an id can't be joined to anything and are left out, as malformed lines are."""
    return rows.filter(F.col("id").isNotNull()).select(
        "run_id",
        F.col("id").alias("traj_id"),
        problem_id(F.col("id"), F.col("original_id")).alias("problem_id"),
        F.coalesce("trajectory_index", trajectory_index(F.col("id"))).alias("traj_idx"),
        "generated_text", "solution", "source", "reward", "termination_reason",
    )


def problems(rows: DataFrame) -> DataFrame:
    """S-16 with the run kept; a record without an id takes the hash of its text."""
    own = rows.withColumn("id", F.coalesce("id", F.format_string("sample_%016x", F.xxhash64("problem"))))
    return own.select("run_id", "id", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("solution", F.lit("")).alias("solution"))


ADAPTERS: dict[str, Adapter] = {"trajectories": Adapter(TRAJECTORIES, trajectories), "problems": Adapter(PROBLEMS, problems)}


def register(name: str, schema: str, prepare: Callable[[DataFrame], DataFrame]) -> None:
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is there already")
    ADAPTERS[name] = Adapter(schema, prepare)


def _layout(fs, file) -> str:
    with_bytes = fs.open(file)
    try:
        head = bytes(with_bytes.readNBytes(64))
    finally:
        with_bytes.close()
    return "parquet" if head[:4] == b"PAR1" else "array" if head.lstrip()[:1] == b"[" else "lines"


def discover(spark: SparkSession, pattern: str, runs: str | None = None) -> dict[str, list[str]]:
    """Folders that a glob matches, by layout. `runs` is a pattern that their names must hold; folders without files are passed over.

    The driver sees names of folders and 64 bytes of a file in each.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for folder in fs.globStatus(path) or []:
        name = folder.getPath().getName()
        if not folder.isDirectory() or (runs is not None and not re.search(runs, name)):
            continue
        files = fs.listStatusIterator(folder.getPath())
        while files.hasNext():
            f = files.next()
            if f.isFile() and f.getLen() > 0 and f.getPath().getName()[0] not in "._":
                found.setdefault(_layout(fs, f.getPath()), []).append(folder.getPath().toString())
                break
    return {k: sorted(v) for k, v in found.items()}


def read(spark: SparkSession, name: str, pattern: str, runs: str | None = None, span: int = 1 << 27) -> DataFrame:
    """Canonical rows of all result folders with their folder's name as `run_id`; no folder gives no rows.

    Arrays are read in byte ranges of `span`.
    """
    adapter = ADAPTERS[name]
    found = discover(spark, pattern, runs)
    run = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id")
    parts = []
    if "lines" in found:
        parts.append(spark.read.schema(adapter.schema).option("mode", "DROPMALFORMED").json(found["lines"]).select("*", run))
    if "parquet" in found:
        held = spark.read.parquet(*found["parquet"])
        have = {c.lower() for c in held.columns}
        wanted = [c.split() for c in adapter.schema.split(", ")]
        parts.append(held.select(*[(F.col(c) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in wanted], run))
    for folder in found.get("array", []):
        parts.append(read_large_array(spark, folder, adapter.schema, span).withColumn("run_id", F.lit(folder.rsplit("/", 1)[-1])))
    if not parts:
        return adapter.prepare(spark.createDataFrame([], f"{adapter.schema}, run_id string"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return adapter.prepare(rows)


__all__ = ["ADAPTERS", "Adapter", "discover", "read", "register"]
