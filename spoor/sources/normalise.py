"""Dataset records to problem rows (S-16 .. S-20)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, fields: Mapping[str, str], index: str) -> DataFrame:
    """S-16: fields renamed, missing ids numbered, list answers joined. `index` is an explicit order column."""
    auto = F.format_string("sample_%05d", F.col(index))
    key = fields.get("id")
    ident = F.coalesce(F.col(key).cast("string"), auto) if key in df.columns else auto
    sol = F.col(fields.get("solution", "solution"))
    if df.schema[fields.get("solution", "solution")].dataType.simpleString().startswith("array"):
        sol = F.array_join(sol, ", ")
    return df.select(
        ident.alias("id"),
        F.coalesce(F.col(fields.get("problem", "problem")), F.lit("")).alias("problem"),
        F.coalesce(sol, F.lit("")).alias("solution"),
    )


def first_path(json: str, paths: Sequence[str]) -> Column:
    """S-17: the first non-empty value among JSON paths."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths])


def task_of(data_source: Column, source_file: Column) -> Column:
    """S-17: last segment of the data source, else the first of the source file."""
    last = F.nullif(F.element_at(F.split(data_source, "/"), -1), F.lit(""))
    return F.coalesce(last, F.nullif(F.get(F.split(source_file, "/"), F.lit(0)), F.lit("")))


def with_rules(samples: DataFrame, rules: DataFrame, key: str = "rule_id") -> DataFrame:
    """S-18: reference rules by id; Spark broadcasts the rule table when its measured size allows."""
    return samples.join(rules, key, "left")


def list_column(text: Column) -> Column:
    """S-19: a list written as text with single quotes."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def window(df: DataFrame, date: str, start: str | None = None, end: str | None = None, platform: str | None = None) -> DataFrame:
    """S-20: contest dates with both ends included, and platform; both reach the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("timestamp"))
    if platform is not None:
        df = df.filter(F.col("platform") == platform)
    return df
