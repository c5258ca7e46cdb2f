import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from spoor.llm import pii, simhash

RNG = random.Random(21)


def say(n, parts=("the", "er", "tion", "an", "re", "ing", "of")):
    return " ".join("".join(RNG.choice(parts) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(text, n):
    w = text.split()
    for i in RNG.sample(range(len(w)), n):
        w[i] = "zz" + w[i]
    return " ".join(w)


def test_near_copies_against_brute_force(documents):
    base = [say(RNG.randint(40, 400)) for _ in range(60)]
    rows = list(enumerate(base))
    copies = {}
    for k in range(60):
        if k % 3 == 0:
            copies[100 + k] = k
            rows.append((100 + k, base[k]))
        if k % 3 == 1:
            t = edited(base[k], max(1, len(base[k].split()) // 200))
            rows.append((100 + k, t))
            if jaccard(base[k], t) >= 0.87:
                copies[100 + k] = k
    RNG.shuffle(rows)
    kept = {r.doc_id for r in simhash.without_near_copies(documents(rows)).collect()}
    texts = dict(rows)
    near = {i for i in texts if i >= 100 and jaccard(texts[i], texts[i - 100]) >= 0.8}
    assert set(range(60)) <= kept
    assert len(set(copies) & kept) <= 0.05 * len(copies)
    assert len(near & kept) <= 0.1 * len(near) + 1
    assert all(jaccard(texts[i], texts[i - 100]) >= 0.65 for i in range(100, 160) if i in texts and i not in kept)


def test_near_copies_of_odd_rows(documents, odd_rows):
    df = documents(odd_rows)
    out = simhash.without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0)]
    assert simhash.without_near_copies(documents([])).collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    leak = "what is the least number of anstionre that eringof can reach by tionan of rean ofre steps"
    rows = [(1, say(90), "en"), (2, None, "en"), (3, "12 !! 34", None), (5, say(60) + " mail ann.lee@mail3.example.com now", "en"), (6, say(30) + " " + leak + " " + say(30), "en")]
    rows += [(4, rows[0][1], "en"), (7, "", "de"), (8, say(80, ("der", "sch", "ung", "ein", "keit", "üb")), "de")]
    df = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [{1, 4, 5, 6, 8}, {1, 5, 6, 8}, {1, 5, 8}, {1, 5, 8}]
    for (name, stage), ids in zip(pipeline.STAGES, want):
        out = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids, name
        docs = out
    assert docs.filter(F.col("text").rlike(pii.PATTERNS["email"])).count() == 1 and docs.filter(F.col("text").contains("ann.lee")).count() == 0
    rows = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert set(rows) == {1, 5, 8} and {i: r.text for i, r in rows.items()} == {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_ids == len(r.ids) > 0 for r in rows.values())


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def words(n):
    return [f"w{RNG.getrandbits(40):x}" for _ in range(n)]


def changed(w, at):
    """Each place in `at`, five words or more apart, changes five shingles."""
    return [f"x{RNG.getrandbits(40):x}" if i in at else x for i, x in enumerate(w)]


def test_near_copies_are_settled_by_exact_similarity(documents):
    rows, gone = [], set()
    for k in range(0, 400, 2):  # 104 words: 100 shingles; two changes leave 90 of 110, three 85 of 115
        w = words(104)
        n = 2 if k < 200 else 3
        t = " ".join(changed(w, set(range(10, 10 + 10 * n, 10))))
        rows += [(k, " ".join(w)), (k + 1, t)]
        assert (jaccard(rows[-2][1], t) >= 0.8) == (n == 2)
        if n == 2:
            gone.add(k + 1)
    kept = {r.doc_id for r in simhash.without_near_copies(documents(rows)).collect()}
    assert set(range(400)) - kept == gone


def test_near_copies_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows, w = [], words(204)
    for k in range(60):  # a chain: each is near the one before only
        rows.append((k, " ".join(w)))
        w = changed(w, {(7 * k + 15 * j) % 200 + 2 for j in range(4)})
    assert all(jaccard(rows[a][1], rows[b][1]) < 0.8 for a in range(60) for b in range(a + 3, 60))
    RNG.shuffle(rows)
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_stages_hold_with_columns_that_clash(spark):
    """A table that already has the inner and outer names of the stages keeps them as they are."""
    names = ("hits", "lang_pred", "score", "text_read", "near_g", "near_m", "t", "root", "least", "node", "key")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    sf = "/root/testdata/sf0.001"
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
