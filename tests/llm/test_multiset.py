import hashlib

from pyspark.sql import functions as F

from spoor.llm import multiset
from spoor.llm.common import next_ids


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition("k")
    return [r.fp for r in multiset.fingerprints(df, ["k"]).orderBy("k").collect()]


def test_equality_order_and_edits(spark):
    a, b, c, whole, turned, twice = prints(spark, ["one two\nthree", "three\none two", "x y", "one two\nthree\nx y", "x y\nthree\none two", "one two\none two\nthree"])
    assert a == b and whole == turned and len({a, c, whole, twice}) == 4
    row = spark.range(1).select(multiset.combined(F.lit(a), F.lit(c)).alias("plus"), multiset.combined(F.lit(whole), F.lit(c), -1).alias("minus"), multiset.likeness(F.lit(a), F.lit(b)).alias("same"), multiset.likeness(F.lit(a), F.lit(whole)).alias("near")).first()
    assert (row.plus, row.minus, row.same) == (whole, a, 1.0) and 0 < row.near < 1


def test_next_ids(spark):
    ids = [-5_000_000, -1, 0, 1, 4095, 4096, 10**6, 10**9, 10**9 + 1, 10**15]
    df = spark.createDataFrame([(i,) for i in ids + [1, None]], "doc_id long")
    assert dict(next_ids(df).collect()) == dict(zip(ids, ids[1:] + ids[:1]))
    assert dict(next_ids(df, width=2).collect()) == dict(zip(ids, ids[1:] + ids[:1]))


def test_compared_with_brute_force(spark, documents, odd_rows):
    rows = odd_rows + [(20, "alpha beta\ngamma delta epsilon zeta " * 9), (21, "eta theta iota " * 20), (30, "kappa lambda\n" * 7)]
    text_of = {}
    for i, t in rows:
        if i is not None:
            text_of[i] = min(text_of.get(i, t or ""), t or "")
    ids = sorted(text_of)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    want = []
    for i, t in rows:
        t = t or ""
        m = len(t) // 4
        new = t[: len(t) - m] + (text_of[after[i]][:m] if i is not None else "")
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    got = multiset.compared(documents(rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    assert by[20].near_edited > 0.5 > by[20].near_next and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert by[None].near_next == 0.0


def test_empty_and_alone(documents):
    assert multiset.compared(documents([])).collect() == []
    row = multiset.compared(documents([(7, "abcdefgh")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
