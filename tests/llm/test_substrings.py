import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoor.llm import substrings as S


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text(alphabet="ab", max_size=120).map(str.encode), st.text(alphabet="aab c", max_size=300).map(str.encode)))
def test_suffix_array_and_prefixes(raw):
    t = np.frombuffer(raw, np.uint8)
    if not len(t):
        return
    sa = S.suffix_array(t)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert sa.tolist() == want
    phi, shared = S.common_prefixes(t, sa)
    for x, y in zip(want, want[1:]):
        n = 0
        while max(x, y) + n < len(raw) and raw[x + n] == raw[y + n]:
            n += 1
        assert phi[y] == x and shared[y] == n
    assert phi[want[0]] == -1


def test_larger_suffix_array():
    rng = random.Random(2)
    raw = b" ".join(rng.choice([b"the", b"an", b"er", b"tion", b"ea"]) for _ in range(3000))
    assert S.suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def brute(rows, width=200):
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for r, (_, b) in enumerate(texts):
        for p in range(len(b) - width + 1):
            seen.setdefault(b[p : p + width], []).append((r, p))
    gone = [np.zeros(len(b), bool) for _, b in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, p in places:
                gone[r][p : p + width] = True
    out = []
    for (i, b), g in zip(texts, gone):
        left = bytes(np.frombuffer(b, np.uint8)[~g])
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "an", "é", "er", "tion", "x"]) for _ in range(rng.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = [say(60) for _ in range(3)]
    out = [say(rng.randint(1, 120)) for _ in range(25)]
    out += [f"{say(rng.randint(0, 40))} {rng.choice(shared)} {say(rng.randint(0, 40))}" for _ in range(40)]
    near = say(150).split()
    for _ in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [out[0] * 5, "ab" * 400, "y" * 900, "z" * 199, "z" * 200, shared[0] + shared[0]]
    return out + out[:6] + [out[30]] * 5


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = list(enumerate(texts())) + [(None, None), (None, "q" * 300), (900, ""), (900, "once " * 90), (900, "once " * 90)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(documents(rows)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_long_texts_are_cut_and_joined(documents):
    rng = random.Random(8)
    long = " ".join(str(rng.random()) for _ in range(120_000))
    rows = [(1, long), (2, long[1_048_000:1_049_500]), (3, "only here " + str(rng.random()))]
    got = {r.doc_id: r for r in S.without_repeats(documents(rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (1500, 1, 1500, 0)


def test_empty(documents):
    assert S.without_repeats(documents([])).collect() == []


def test_keys_stay_whole_beside_hot_ones(spark, monkeypatch):
    """With hot keys and many partitions a key's pieces still meet in one shard."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, rows = say(40), []
    for k in range(60):
        own = say(45)
        rows += [(2 * k, f"{say(30)} {own} {say(20)}"), (2 * k + 1, f"{say(50)} {own} {say(9)}" + (f" {common} {say(30)}" if k < 12 else ""))]
    monkeypatch.setattr(S, "HOT", 3)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).drop("kept").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(tuple(r) for r in got) == brute(rows)
