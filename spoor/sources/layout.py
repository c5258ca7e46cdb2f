"""Result tables and sinks (S-11 .. S-14)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAMS = ("method", "top", "bottom", "cons")


def nested_outputs(rows: DataFrame, problem: str, order: str, text: str) -> DataFrame:
    """S-11: one record per problem with its outputs in trajectory order; the record is the format."""
    out = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(problem).agg(out.alias("output"))


def write_results(df: DataFrame, path: str, params: Sequence[str] = PARAMS) -> None:
    """S-12: replaces exactly the parameter sets in `df`; exact values name the folders."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*params).parquet(path)


def with_fallback(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S-13: rows of the first table, else of the second for keys the first lacks."""
    keys = list(keys)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def write_checked(df: DataFrame, path: str, params: Sequence[str] = PARAMS) -> None:
    """S-13: `write_results`, then a line in the manifest for each parameter set of `df`, with its row count and columns.

    Rows are staged as files first, so they are computed once and their counts come
    from footers. Lines of other sets stay as they are. A write that fails before
    its manifest leaves counts that differ, so that set counts as invalid.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    write_results(rows, path, params)
    columns = ",".join(sorted(set(df.columns) - set(params)))
    noted = rows.groupBy(*params).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(columns))
    write_results(noted.coalesce(1), f"{path}/_manifest", params)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _is(params: Mapping[str, object]):
    same = F.lit(True)
    for name, value in params.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return same


def reusable(spark: SparkSession, path: str, schema: str, params: Mapping[str, object]) -> bool:
    """S-13: whether the table at `path` holds exactly this parameter set, whole and with the columns of `schema`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    table = spark.read.schema(schema).parquet(path)
    kinds = T.StructType([f for f in table.schema.fields if f.name in params]).add("rows", "long").add("columns", "string")
    noted = spark.read.schema(kinds).parquet(f"{path}/_manifest").filter(_is(params)).select("rows", "columns").head(1)
    if not noted or not set(table.columns) - set(params) <= set(noted[0]["columns"].split(",")):
        return False
    return table.filter(_is(params)).count() == noted[0]["rows"]


def reuse(
    spark: SparkSession,
    path: str,
    schema: str,
    params: Mapping[str, object],
    compute: Callable[[], DataFrame],
    analysed: DataFrame | None = None,
    methods: Sequence[str] = ("hep",),
) -> DataFrame:
    """S-13: results of one parameter set: the checked table, else an analysis with the same parameters, else computed anew.

    Only `methods` may fall back on the analysis, since it is made by them. What
    is computed is written, so the next call finds it. `origin` says where rows
    came from: cache, analysis or computed. `schema` names all columns, the
    parameters included.
    """
    stored = lambda: spark.read.schema(schema).parquet(path).filter(_is(params))
    if reusable(spark, path, schema, params):
        return stored().withColumn("origin", F.lit("cache"))
    if analysed is not None and params.get("method") in methods:
        rows = analysed.filter(_is({k: v for k, v in params.items() if k != "method"}))
        if rows.head(1):
            return rows.withColumn("method", F.lit(params["method"])).select(*stored_columns(spark, schema)).withColumn("origin", F.lit("analysis"))
    rows = compute()
    for name, value in params.items():
        rows = rows.withColumn(name, F.lit(value))
    write_checked(rows.select(*stored_columns(spark, schema)), path, list(params))
    return stored().withColumn("origin", F.lit("computed"))


def stored_columns(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def write_csv(df: DataFrame, path: str) -> None:
    """S-14."""
    df.write.mode("overwrite").option("header", True).csv(path)
