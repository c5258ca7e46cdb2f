import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from spoor.llm import simhash
from spoor.llm.common import portions


def brute_print(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints, radius=2):
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Alpha", "beta", "É", "d!", "e", "f", "g"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts = base + [re.sub(r"\w+$", "zz", t) for t in base] + base[:10] + [t.upper() for t in base[:10]]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    comp = brute(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_odd_rows(documents, odd_rows):
    rows = simhash.near_duplicates(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == comp[6] == 5 and comp[None] is None
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).collect() == []


def test_hot_groups_are_cut_and_whole(spark, monkeypatch):
    rng = random.Random(5)
    near = {0x1234_5678_0000_0000}
    while len(near) < 300:  # a chain of near fingerprints that share two blocks
        near.add(rng.choice(sorted(near)) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32))
    far = {rng.getrandbits(63) for _ in range(200)}
    fps = sorted(near | far)
    monkeypatch.setattr(simhash, "HOT", 20)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = brute(dict(zip(fps, fps)))
    links = simhash.links(df).collect()
    root = {f: f for f in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() < 64
        x, y = sorted((top(r.u), top(r.v)))
        root[y] = x
    assert {f: top(f) for f in fps} == comp
    assert len(links) < 60 * len(fps)


def test_majority_of_long_texts():
    h = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64) * 2 + 1
    off = np.array([0, 700, 700, 701, 2000])
    want = [sum(1 << b for b in range(64) if 2 * int(((h[a:z] >> np.uint64(b)) & np.uint64(1)).sum()) > z - a) for a, z in zip(off[:-1], off[1:])]
    assert simhash.majority(h, off).tolist() == want


def test_portions_cover_a_batch_once():
    texts = ["é" * 40, None, "", "x" * 500, "yz", "😀", None]
    got = list(portions(pa.array(texts), 90))
    assert [a for a, _, _ in got] == [0] + [z for _, z, _ in got[:-1]] and got[-1][1] == len(texts)
    assert [t for _, _, ts in got for t in ts] == [(t or "").encode() for t in texts]
    assert all(z - a == 1 or sum(len(t) + 1 for t in ts) <= 90 for a, z, ts in got) and len(got) > 2
    assert list(portions(pa.array([], pa.string()))) == []
