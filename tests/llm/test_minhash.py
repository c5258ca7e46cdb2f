"""MinHash near-duplicates against plain sets; hot lists, odd rows."""

import random
import re

import pytest

from spoor.llm import minhash

from .conftest import DOCS


def plain(rows, width=4, percent=80):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(up))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, passage = [], [r.choice(words) for _ in range(60)]
    for d in range(40):  # texts that are mostly one passage, but not near
        rows.append([r.choice(words) for _ in range(20)] + passage + [r.choice(words) for _ in range(12)])
    origin = [r.choice(words) for _ in range(150)]
    rows.append(origin)
    for d in range(60):  # a family around the bound
        t = list(origin)
        for _ in range(r.choice([1, 2, 3, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append(t)
    for d in range(30):  # pairs from short to long, edited here and there
        t = [r.choice(words) for _ in range(r.choice([3, 4, 5, 9, 40, 900]))]
        u = list(t)
        for _ in range(max(1, len(t) // 40)):
            u[r.randrange(len(u))] = r.choice(words)
        rows += [t, u, [*t, r.choice(words)]]
    out = [(i + 1, " ".join(w), None, None, None) for i, w in enumerate(rows)]
    r.shuffle(out)
    return out


def test_equals_plain_sets(spark):
    rows = corpus()
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_blocks_of_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(2)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, text), (8, text), (3, text.upper()), (None, text), (9, "one  two"), (2, "ONE two"),
        (4, "x" * 100_000 + " " + "word " * 50_000), (11, "ein wort"), (12, "ein wort"), (13, "É a b c d"), (14, "é a b c d"),
    ]
    df = spark.createDataFrame([(a, b, "k", "v", 1) for a, b in rows], "doc_id long, text string, t string, sketch string, n long")
    rows_out = minhash.near_duplicates(df).collect()
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows_out}
    assert len(rows_out) == len(rows)
    assert out[(5, 0)] == (5, True) and out[(6, 0)] == (6, True) and out[(7, 0)] == (7, True)
    assert out[(8, 9)] == (3, False) and out[(3, 9)] == (3, True) and out[(None, 9)] == (3, False)
    assert out[(9, 1)] == (2, False) and out[(2, 1)] == (2, True)
    assert out[(4, 2)] == (4, True) and out[(11, 1)] == (11, True) and out[(12, 1)] == (12, True)
    assert out[(13, 2)] == (13, True) and out[(14, 2)] == (14, True)


def test_empty_table(spark):
    df = minhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert df.count() == 0 and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_few_near_pairs_share_less(similarity):
    from math import comb

    least, k = minhash.shared_least(similarity), minhash.SKETCH
    assert sum(comb(k, i) * similarity**i * (1 - similarity) ** (k - i) for i in range(least)) < 1e-9


def test_sketches_are_not_checkpointed_number_by_number(documents, monkeypatch):
    from spoor.llm import minhash

    sizes, stage = [], minhash.stage

    def counted(df):
        out = stage(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(120))) for i in range(50)] + [(99, " ".join(f"w0x{k}" for k in range(118)))]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert out == {i: i for i in range(50)} | {99: 0}
    assert max(sizes) < 64 * 10  # a row for each number would be 64 * 51
