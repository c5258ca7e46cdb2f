import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spoor.llm import toxicity as T

RNG = random.Random(9)


def say(n, bad=False):
    w = ["".join(RNG.choice(["th", "er", "an", "ou", "ing", "e"]) for _ in range(RNG.randint(1, 4))) for _ in range(n)]
    if bad:
        for _ in range(max(1, n // 40)):
            w[RNG.randrange(n)] = RNG.choice(["moron", "scum", "loweia", "loweich"])
    return " ".join(w)


def rows(spark, n=900):
    data = [(i, say(RNG.randint(5, 150), i % 6 == 0), int(i % 6 == 0)) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return df, df.select("doc_id", "toxic")


def test_held_out_ranking(spark):
    docs, labels = rows(spark)
    model = T.train(T.labelled(docs.filter("doc_id < 600"), labels))
    out = T.scored(docs.filter("doc_id >= 600"), model, {"doc_id": F.col("doc_id")}).collect()
    s = np.array([r.score for r in out])
    y = np.array([r.doc_id % 6 == 0 for r in out])
    auc = (s[y][:, None] > s[~y][None, :]).mean()
    assert auc > 0.97 and ((s >= 0.7) == y).mean() > 0.93 and s.min() >= 0 and s.max() <= 1


def test_log_ratios_against_brute_force(spark):
    texts = [("Idiot! the end", 1), ("the end, the idea", 0), ("an end", 0), ("idiots", 1)]
    df = T.labelled(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    known, lefts = T.log_ratios(df)
    n = [Counter(), Counter()]
    grams, off = T._grams([t.encode() for t, _ in texts])
    for i, (_, y) in enumerate(texts):
        n[1 - y].update(grams[off[i] : off[i + 1]].tolist())
    every = set(n[0]) | set(n[1])
    tri, bi, two, one = Counter(g & 0xFFFFFF for g in every), Counter(), Counter(), Counter()
    for t, d in tri.items():
        bi[t >> 8] += d
        two[t >> 8] += 1
        one[t & 255] += d
    d, total = T.DISCOUNT, sum(one.values())

    def chance(c, g):
        shared = (max(tri[g & 0xFFFFFF] - d, 0) + d * two[g >> 8 & 0xFFFF] * one[g & 255] / total) / bi[g >> 8 & 0xFFFF]
        own = {k: v for k, v in n[c].items() if k >> 8 == g >> 8}
        m = sum(own.values())
        return shared if not m else max(n[c][g] - d, 0) / m + d * len(own) / m * shared

    got = {r.gram: r.ratio for r in known.collect()}
    assert set(got) == every and all(math.isclose(got[g], math.log(chance(0, g) / chance(1, g)), abs_tol=1e-9) for g in every)


def test_all_labelled_rows_are_counted(spark):
    docs, labels = rows(spark, 90)
    told = T.labelled(docs, labels)
    model, (known, _) = T.train(told), T.log_ratios(told)
    want = T.dense(known, T.GRAM_BITS)
    assert np.allclose(model.known, want, atol=1e-5, equal_nan=True) and model.curve != (0.0, 0.0)


def test_odd_rows_and_one_class(spark, documents, odd_rows):
    docs = documents(odd_rows)
    model = T.train(T.labelled(docs, spark.createDataFrame([(5, 1), (6, None), (7, 3), (None, 0)], "doc_id long, toxic int")))
    out = T.scored(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(out) == len(odd_rows) and {r.score for r in out} == {0.5}
    assert T.scored(documents([]), model, {"doc_id": F.col("doc_id")}).collect() == []
