"""Huge JSON arrays in byte ranges against whole-file parsing."""

import json
import random

from spoor.sources import arrays

SCHEMA = "id long, s string, xs array<string>, o map<string,string>"


def rows(n, seed=1):
    r = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "😀", "a", " ", '\\"', "}{", '"}', '\\"}', " "]
    text = lambda k: "".join(r.choice(bits) for _ in range(r.randrange(k)))
    return [{"id": i, "s": text(60), "xs": [text(9) for _ in range(r.randrange(4))], "o": {text(5) + "k": text(9)}} for i in range(n)]


def same(got, want):
    key = lambda x: x["id"]
    assert sorted((json.loads(j) for j in got), key=key) == want


def test_every_split_size_gives_the_records(spark, tmp_path):
    want = rows(300)
    for name, kw in {"tight": {}, "wide": {"indent": 2}, "ascii": {"ensure_ascii": False}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(want, **kw))
        for size in (200, 1999, 1 << 20):
            found = arrays.records(spark, str(tmp_path / f"{name}.json"), size)
            same([r.json for r in found.collect()], want)


def test_order_and_parsing(spark, tmp_path):
    want = rows(120, 3)
    (tmp_path / "a.json").write_text(json.dumps(want))
    found = arrays.records(spark, str(tmp_path), 700).orderBy("number").collect()
    assert [json.loads(r.json)["id"] for r in found] == list(range(120)) and [r.number for r in found] == list(range(120))
    parsed = arrays.read_large_array(spark, str(tmp_path), SCHEMA, 700).collect()
    assert sorted((r.id, r.s, r.xs, r.o) for r in parsed) == [(w["id"], w["s"], w["xs"], w["o"]) for w in want]


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(rows(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert arrays.fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_files(spark, tmp_path):
    for name, text in {"empty": "[]", "blank": " [ \n ]\n", "cut": '[{"id": 1}, {"id": 2', "deep": '[{"id": 3, "o": {"a": "]}"}, "xs": [["{"]]}]', "bad": '[{"id": 4}, {"id": x}, {"id": 5}]', "none": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = arrays.read_large_array(spark, str(tmp_path), "id long", 16)
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]
