import random
from collections import Counter

from pyspark.sql import functions as F

from spoor.llm import language as L

RNG = random.Random(6)
PARTS = {"en": ["the", "th", "er", "ing", "ou", "wh"], "de": ["sch", "ung", "ein", "keit", "ü", "ß"], "fr": ["eau", "ée", "tion", "eux", "que", "ç"]}


def say(lang, n):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def grams(text):
    """Counts of the n-grams of one text, by strings."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        for n in L.SIZES:
            out.update(p[i : i + n] for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return out


def test_counts_against_brute_force():
    texts = ["Ab ab, Ça 12va!", "", "x", "İI ΣΑΣ 中文 a\nb  c", " . ", say("fr", 50)]
    for _, _, keys, counts in L.counted(texts):
        who = keys >> L._BITS
        for i, t in enumerate(texts):
            assert sorted(counts[who == i].tolist()) == sorted(grams(t).values()), t


def test_held_out_accuracy_and_odd_rows(spark, documents, odd_rows):
    rows = [(i, say(x, RNG.randint(3, 200)), x) for i, x in enumerate(["en", "de", "fr"] * 60)]
    train = spark.createDataFrame([r for r in rows if r[0] % 3 != 7], "doc_id long, text string, lang string")
    model = L.profiles(train.filter("doc_id % 4 <> 0"))
    assert set(model) == {"en", "de", "fr"} and all(0 < len(v) <= L.TOP for v in model.values())
    out = L.identified(train.filter("doc_id % 4 = 0"), model, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 < r.score <= 1 for r in out)
    odd = L.identified(documents(odd_rows), model, {"doc_id": F.col("doc_id")}).collect()
    assert len(odd) == len(odd_rows) and {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3}
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert L.identified(documents([]), model, {"doc_id": F.col("doc_id")}).collect() == []
    none = L.identified(documents(odd_rows), L.profiles(documents([]).select("lang", "text")), {"doc_id": F.col("doc_id")}).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_long_text_in_pieces_counts_the_same(monkeypatch):
    text = say("de", 3000)
    whole = [sorted(c.tolist()) for _, _, _, c in L.counted([text])]
    monkeypatch.setattr(L, "_CHUNK", 1000)
    assert [sorted(c.tolist()) for _, _, _, c in L.counted([text])] == whole
