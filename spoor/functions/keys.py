"""Keys read out of ids, paths and sources (P-01 .. P-09, S-08, S-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "_traj_"


def problem_id(traj_id: Column, original_id: Column | None = None) -> Column:
    """P-01: the original id, else the text before the first mark."""
    head = F.substring_index(traj_id, MARK, 1)
    return head if original_id is None else F.coalesce(F.nullif(original_id, F.lit("")), head)


def trajectory_index(traj_id: Column) -> Column:
    """P-02: number after the last mark; a bare id is 0; anything else is null."""
    tail = F.substring_index(traj_id, MARK, -1)
    number = F.when(tail.rlike(r"^\s*[+-]?\d+\s*$"), tail.try_cast("int"))
    return F.when(traj_id.contains(MARK), number).otherwise(0)


def task_type(
    traj_id: Column, prefixes: Sequence[tuple[str, str]], original_id: Column, prompt: Column,
    marked: str, markers: Sequence[str], default: str = "math",
) -> Column:
    """P-03: type by id prefix, else `marked` for numeric ids whose prompt holds a marker, else the default."""
    out = F.lit(default)
    numeric = original_id.rlike(r"^\d+$") & F.substring_index(traj_id, MARK, 1).rlike(r"^\d+$") & traj_id.contains(MARK)
    hit = F.lit(False)
    for m in markers:
        hit = hit | prompt.contains(m)
    out = F.when(numeric & F.coalesce(hit, F.lit(False)), marked).otherwise(out)
    for prefix, label in reversed(list(prefixes)):
        out = F.when(traj_id.startswith(prefix), label).otherwise(out)
    return out


def task_between(traj_id: Column, prefix: str) -> Column:
    """P-04: text between the prefix and the last underscore, trajectory suffix removed first."""
    rest = F.regexp_replace(F.substr(traj_id, F.lit(len(prefix) + 1)), MARK + ".*$", "")
    head = F.regexp_extract(rest, r"^(.+)_[^_]*$", 1)
    return F.when(~traj_id.startswith(prefix), "unknown").otherwise(
        F.coalesce(F.nullif(head, F.lit("")), F.nullif(rest, F.lit("")), F.lit("unknown"))
    )


def category(traj_id: Column) -> Column:
    """P-05: second underscore part."""
    return F.coalesce(F.get(F.split(traj_id, "_"), F.lit(1)), F.lit("unknown"))


def intent(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"^\[([a-zA-Z_]+)\]", 1)


def persona(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"\[PERSONA:([a-zA-Z_]+)\]", 1)


def n_issues(task_id: Column) -> Column:
    return F.size(F.split(task_id, r"\|"))


def domain(source: Column, prefix: str) -> Column:
    """P-09: the source without its prefix."""
    return F.when(source.startswith(prefix), F.substr(source, F.lit(len(prefix) + 1))).otherwise(source)


def succeeded(reward: Column) -> Column:
    """P-08: any positive reward; null is a failure."""
    return F.coalesce(reward, F.lit(0.0)) > 0


def succeeded_strictly(reward: Column) -> Column:
    """P-08: reward within 1e-6 of one."""
    return F.coalesce((reward >= 1 - 1e-6) & (reward <= 1 + 1e-6), F.lit(False))


def correctness(is_correct: Column, reward: Column) -> Column:
    """P-11: flag if present, else by reward, else false."""
    return F.coalesce(is_correct, reward > 0, F.lit(False))


def release(path: Column) -> Column:
    """S-08."""
    return F.regexp_extract(path, r"release_v\d+", 0)


def model_from_path(path: Column) -> Column:
    """S-09: `org/model` from a run directory name.

    The part holding the model size (14B, 120b) is the model and the part before
    it the organisation, if there is one; a last folder without a size defers to its parent.
    """
    parts = F.split(path, "/")
    leaf, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    name = F.split(F.when(leaf.rlike(r"\d+[bB]"), leaf).otherwise(F.coalesce(parent, leaf)), "_")
    at = F.array_position(F.transform(name, lambda p: p.rlike(r"\d+[bB]")), True)
    return F.when(at > 1, F.concat_ws("/", F.get(name, (at - 2).cast("int")), F.get(name, (at - 1).cast("int")))).when(at == 1, F.get(name, F.lit(0)))
