"""Incremental tables of streams: only touched buckets are written, a repeated batch changes nothing, late rows are dropped."""

import datetime as dt
import os

from spoor.streaming import jobs, tables

SCHEMA = "id long, n long, bucket string"


def rows(spark, path, schema=SCHEMA, version=None):
    return sorted((tuple(r) for r in tables.read(spark, path, schema, version).collect()), key=str)


def test_merge_rewrites_touched_buckets(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    first = [(i, 1, "a") for i in range(400)] + [(None, 1, "a")]
    tables.merge(spark.createDataFrame(first, SCHEMA), 0, path, ["id"], "n", 16)
    before = tables.folders(spark, path, 0)
    touched = tables.merge(spark.createDataFrame([(7, 5, "b"), (7, 3, "c"), (8, 0, "old"), (900, 1, None)], SCHEMA), 1, path, ["id"], "n", 16)
    after = tables.folders(spark, path, 1)
    assert 1 <= len(touched) <= 3 and len(before) == 16
    assert {b for b in after if after[b] != before[b]} == set(touched)
    want = {r[0]: r for r in first} | {7: (7, 5, "b"), 900: (900, 1, None)}
    assert rows(spark, path) == sorted(want.values(), key=str)
    written = {n for n in os.listdir(tmp_path / "t" / "data" / "v=1") if not n.startswith(("_", "."))}
    assert len(written) == len(touched)


def test_repeated_batch_and_earlier_version(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    one, two = spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), spark.createDataFrame([(2, 0, "b"), (3, 1, "b")], SCHEMA)
    tables.merge(one, 0, path, ["id"])
    tables.merge(two, 1, path, ["id"])
    want = [(1, 1, "a"), (2, 0, "b"), (3, 1, "b")]  # without an order the later batch wins
    assert rows(spark, path) == want
    tables.merge(two, 1, path, ["id"])
    assert rows(spark, path) == want and rows(spark, path, version=0) == [(1, 1, "a"), (2, 1, "a")]
    tables.merge(two.limit(0), 2, path, ["id"])
    assert tables.versions(spark, path) == [0, 1, 2]
    tables.vacuum(spark, path, 1)
    assert rows(spark, path) == want and tables.versions(spark, path) == [2]


def test_empty_table(spark, tmp_path):
    assert rows(spark, f"file:{tmp_path}/none") == []


def test_late_row_is_dropped_and_windows_close_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    src, schema = f"{tmp_path}/in", "ts timestamp, event_type string, value double"
    for hours in ([1, 10, 30], [60], [2, 70]):  # hour 2 comes after its window has closed
        spark.createDataFrame([(start + dt.timedelta(hours=h), "x", float(h)) for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
    counts = jobs.tumbling_counts(jobs.read_stream(spark, src, schema, 1), "ts", "1 day", "1 hour")
    out = f"{tmp_path}/out"
    jobs.append_to(counts, out, f"{out}-c")
    got = sorted((r["n"], r["mean_value"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 30.0), (2, 5.5)]  # day 0 without the late row, day 1; day 2 is open


def test_update_mode_writes_changed_groups(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "problem_id string, extracted_answer string, is_correct boolean"
    files = [[(f"p{i}", "a", True) for i in range(40)], [("p1", "a", True), ("p1", None, False)]]
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(src)
    votes = jobs.running_votes(jobs.read_stream(spark, src, schema, 1))
    out = f"file:{tmp_path}/out"
    tables.keep(votes, out, f"{tmp_path}/c", ["problem_id", "extracted_answer"], mode="update", buckets=16)
    got = {(r[0], r[1]): (r[2], r[3]) for r in tables.read(spark, out, votes.schema).collect()}
    assert len(got) == 41 and got["p1", "a"] == (2, 2) and got["p1", None] == (1, 0)
    known = tables.versions(spark, out)
    a, b = (tables.folders(spark, out, v) for v in known[:2])
    assert 1 <= sum(a.get(k) != f for k, f in b.items()) <= 2
