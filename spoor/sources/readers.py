"""Scans of trajectory, evaluation, confidence and agent records (S-01 .. S-10, S-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.keys import problem_id, release, trajectory_index


def read_array(spark: SparkSession, path: str, schema: str = schemas.TRAJECTORY) -> DataFrame:
    """S-01: whole-file JSON arrays. Not splittable: convert once with `to_lines` or `to_parquet`."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str = schemas.TRAJECTORY) -> DataFrame:
    """S-02/S-04: JSON Lines in splits, malformed lines dropped; `arrival` orders rows as they were written."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    m = "_metadata."
    return df.withColumn(
        "arrival",
        F.struct(
            F.col(m + "file_modification_time").alias("t"),
            F.col(m + "file_path").alias("f"),
            F.col(m + "file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ),
    )


def read_slim(spark: SparkSession, path: str) -> DataFrame:
    """S-03: only what entropy analysis reads. On Parquet the nested struct is pruned in the scan."""
    if path.rstrip("/").endswith(".parquet"):
        slim = F.transform(
            "entropy_sequence", lambda x: F.struct(x["token"].alias("token"), x["token_id"].alias("token_id"), x["position"].alias("position"), x["entropy"].alias("entropy"))
        )
        keep = ["id", "original_id", "trajectory_index", "solution", "source", "reward", "termination_reason"]
        return spark.read.schema(schemas.TRAJECTORY).parquet(path).select(*keep, slim.alias("entropy_sequence"))
    return spark.read.schema(schemas.TRAJECTORY_SLIM).option("mode", "DROPMALFORMED").json(path)


def to_lines(df: DataFrame, path: str) -> None:
    """S-05."""
    df.drop("arrival").write.mode("overwrite").json(path)


def to_parquet(df: DataFrame, path: str) -> None:
    """S-05: the canonical form, splittable and prunable."""
    df.drop("arrival").write.mode("overwrite").parquet(path)


def keep_last(df: DataFrame, key: str = "id", order: str = "arrival") -> DataFrame:
    """S-06: the last row of each id in arrival order; null ids dropped. Duplicates collapse map-side."""
    cols = [c for c in df.columns]
    last = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r"))
    return last.select("r.*")


def read_runs(spark: SparkSession, glob: str, schema: str = schemas.TRAJECTORY, depth: int = 1) -> DataFrame:
    """S-07: every directory a glob matches, at any depth, tagged with its run id (the directory path)."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(glob)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    run = F.array_join(F.slice(parts, F.size(parts) - depth, depth), "/")
    return df.select("*", run.alias("run_id"), release(path).alias("release"))


def token_rows(trajectories: DataFrame) -> DataFrame:
    """Trajectory records to the long token table. Positions are array places, as the readers count them."""
    t = trajectories.select(
        F.col("id").alias("traj_id"),
        problem_id(F.col("id"), F.col("original_id")).alias("problem_id"),
        F.coalesce("trajectory_index", trajectory_index(F.col("id"))).alias("traj_idx"),
        F.posexplode("entropy_sequence").alias("position", "e"),
    )
    return t.select("traj_id", "problem_id", "traj_idx", "position", "e.token", "e.token_id", "e.entropy")


def decoded_list(column: str | Column, item: str = "double") -> Column:
    """S-10: a list stored as JSON text."""
    return F.from_json(F.col(column) if isinstance(column, str) else column, f"array<{item}>")


def read_confidence(spark: SparkSession, path: str) -> DataFrame:
    """S-10: confidence lists, one row per candidate."""
    df = spark.read.parquet(path)
    out = decoded_list("output", "string") if df.schema["output"].dataType.simpleString() == "string" else F.col("output")
    conf = decoded_list("confidence_list") if df.schema["confidence_list"].dataType.simpleString() == "string" else F.col("confidence_list")
    rows = df.select("question_id", out.alias("output"), conf.alias("confidence"))
    rows = rows.select("question_id", F.posexplode(F.arrays_zip("output", "confidence")).alias("traj_idx", "z"))
    return rows.select(F.col("question_id").alias("problem_id"), "traj_idx", "z.output", "z.confidence")


def score_file_columns(path: Column) -> list[Column]:
    """S-15: model, question type and mode from `model_type_..._mode.jsonl`; mixed modes are their own type."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")
    parts = F.split(name, "_")
    mode = F.element_at(parts, -1)
    return [F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("question_type"), mode.alias("mode")]
