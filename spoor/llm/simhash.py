"""Near-duplicates by SimHash: fingerprints, pivot-pruned links of distinct fingerprints, components.

Candidates meet under two equal 16-bit blocks of four (two differing bits touch
two blocks at most). In each such group every fingerprint's Hamming distances to
many reference fingerprints are tabled once; a pair whose distances differ by
more than the radius in any coordinate cannot be near and is discarded; survivors
are verified. A group gives a spanning forest of its links, never its pairs.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows and ties share a fingerprint and fall together before any
link is sought; a null doc_id is never a component's name unless nothing else is
in it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import components, encoded, free, hashed_words, mix, portions, steps

#: Groups above this are cut by the next two of four blocks of their free 32 bits; such a part has at most 2**16 members.
HOT = 2048
_ONES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text's hashes h[off[i]:off[i + 1]] the bits set in more than half of them; 0 without hashes."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if not len(full):
        return out
    size = n[full]
    per = -(-size // 255)  # byte counters hold 255 rows
    first = np.repeat(off[:-1][full], per)
    piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at, group = first + 255 * piece, np.cumsum(per) - per
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _ONES, at)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
        over = (2 * count > size[:, None]).astype(np.uint64)
        bits |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(b))).sum(1, dtype=np.uint64)
    out[full] = bits
    return out


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words: of all of them."""
    w = text.lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII blanks
    if not w:
        return []
    s, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= width:
        return [h(s, 42)]
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(w) - width]]]
    return [h(s[a:z], 42) for a, z in zip(starts, ends[width - 1 :])]


def _print(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, z in steps(texts, 1 << 19):
                hs = [np.array(shingle_hashes(t, width), np.uint64) for t in texts[a:z]]
                off = np.concatenate([[0], np.cumsum([len(x) for x in hs])]).astype(np.int64)
                got = majority(np.concatenate(hs), off).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(got)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_print(width), f"doc_id {kind}, fp long")


#: Reference fingerprints: fixed pseudo-random values.
PIVOTS = mix(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """A label for each of the distinct fingerprints of one group: the index of a member of its part."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    lab, n = np.arange(len(fp)), len(fp)
    high = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    rows = max(1, (1 << 20) // n)
    for a in range(0, n, rows):
        z = min(n, a + rows)
        to = int(high[z - 1])
        ok = np.ones((z - a, to - a), bool)
        for k in range(table.shape[1]):
            ok &= np.abs(table[a:z, None, k] - table[None, a:to, k]) <= radius
        i, j = np.nonzero(ok)
        keep = j > i
        i, j = i[keep] + a, j[keep] + a
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[near], j[near]
        while len(i):
            x, y = lab[i], lab[j]
            differ = x != y
            if not differ.any():
                break
            np.minimum.at(lab, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (up := lab[lab] != lab).any():
                lab[up] = lab[lab[up]]
    out = np.empty(n, np.int64)
    out[order] = order[lab]
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(keys)) + 1
            u, v = [], []
            for part in np.split(fps, cut):
                if len(part) > 1:
                    lab = _forest(part.view(np.uint64), radius)
                    own = lab != np.arange(len(part))
                    u.append(part[own])
                    v.append(part[lab[own]])
            empty = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or empty)), pa.array(np.concatenate(v or empty))], names=["u", "v"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy()])
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last group may go on
            held_k, held_f = k[last:], f[last:]
            if last:
                yield groups(k[:last], f[:last])
        if len(held_k):
            yield groups(held_k, held_f)

    return run


def _blocks(base, bits: list[tuple[int, int]]):
    """Keys of all pairs of blocks: tag, and the two blocks' values."""
    block = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    out = []
    for tag, ((s, w), (t, _)) in enumerate(combinations(bits, 2)):
        value = F.shiftleft(block(s, w), w).bitwiseOR(block(t, w))
        out.append(F.shiftleft(base * 8 + tag, 2 * w).bitwiseOR(value))
    return F.array(*out)


_FREE = [[b for b in range(4) if b not in c] for c in combinations(range(4), 2)]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints at `radius` or fewer differing bits, as forests.

    radius is 2 at most: the blocks that must be equal are sized for it.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2")
    one = prints.select("fp").distinct()
    rows = one.select("fp", F.explode(_blocks(F.lit(0).cast("long"), [(0, 16), (16, 16), (32, 16), (48, 16)])).alias("key"))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(rows.join(many, "key"))
    cool = met.filter(F.col("n") <= HOT).select(F.col("key").alias("g"), "fp")
    # the tag tells which two blocks are equal; the other two are cut into bytes, of which two of four are equal again
    tag = F.shiftright("key", 32)
    finer = None
    for t, (p, q) in enumerate(_FREE):
        arr = _blocks(F.col("key") + 8, [(16 * p, 8), (16 * p + 8, 8), (16 * q, 8), (16 * q + 8, 8)])
        finer = F.when(tag == t, arr) if finer is None else finer.when(tag == t, arr)
    hot = met.filter(F.col("n") > HOT).select(F.explode(finer).alias("g"), "fp")
    grouped = cool.union(hot).repartition("g").sortWithinPartitions("g")
    return grouped.mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    prints = stage(fingerprints(docs, width))
    found = components(links(prints, radius))
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.join(roots, "root").select("fp", "component_id")
    return prints.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity

#: Bands of so many minima of hashes: texts at similarity s share a band with probability 1 - (1 - s**MINIMA)**BANDS.
BANDS = 32
MINIMA = 6
#: Texts and bytes of text that one side of a comparison holds, about; a family above either is cut into blocks.
BLOCK = 1024
BYTES = 4 << 20
_ASCII_BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = mix(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of `width` words of each text (fewer words: of all of them), and each text's first."""
    h, off = hashed_words([t.lower() for t in texts], _ASCII_BLANKS)
    sets = [np.zeros(0, np.uint64)]
    for a, z in zip(off[:-1], off[1:]):
        w = h[a:z]
        k = min(width, len(w))
        s = np.zeros(len(w) - k + 1 if k else 0, np.uint64)
        for j in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
        sets.append(np.unique(mix(s)))
    return np.concatenate(sets), np.cumsum([len(s) for s in sets])


def _bands(width: int):
    """g, keys: for each text with words the keys of its BANDS bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, texts in portions(batch.column(1), 1 << 19):
                flat, ends = shingle_sets(texts, width)
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                keys = np.empty((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(some), b, np.uint64)
                    for odd in _ODD[b * MINIMA : (b + 1) * MINIMA]:
                        key = mix(key + np.minimum.reduceat(flat * odd, ends[:-1][some]))
                    keys[:, b] = key
                off = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                listed = pa.ListArray.from_arrays(off, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(some)), listed], names=["g", "keys"])

    return run


def near_links(flat: np.ndarray, ends: np.ndarray, similarity: float) -> np.ndarray:
    """A label for each of the sets flat[ends[i]:ends[i + 1]]: the index of a member of its part.

    Two sets are linked if their Jaccard similarity is `similarity` or more. Every
    pair is counted out but those already in one part and those whose sizes
    rule it out.
    """
    size = np.diff(ends)
    order = np.argsort(size, kind="stable")
    lab = np.arange(len(size))
    kinds, place = np.unique(flat, return_inverse=True)
    flag = np.zeros(len(kinds), bool)
    ranked = size[order]
    for r, i in enumerate(order.tolist()):
        if not size[i]:
            continue
        z = int(np.searchsorted(ranked, size[i] / similarity + 1e-9, side="right"))
        j = order[r + 1 : z]
        j = j[lab[j] != lab[i]]
        if not len(j):
            continue
        own = place[ends[i] : ends[i + 1]]
        flag[own] = True
        n = size[j]
        first = np.cumsum(n) - n
        at = np.repeat(ends[j] - first, n) + np.arange(int(n.sum()))
        both = np.add.reduceat(flag[place[at]].astype(np.int64), first)
        flag[own] = False
        j = j[both >= similarity * (size[i] + n - both) - 1e-9]
        for old in np.unique(lab[j]).tolist():
            lab[lab == max(old, lab[i])] = min(old, lab[i])
    return lab


def _verified(width: int, similarity: float):
    """Links inside groups (k, g, text), which come sorted by k: one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts = None, [], []

        def solved() -> pa.RecordBatch:
            lab, own = near_links(*shingle_sets(texts, width), similarity), np.array(ids, np.int64)
            far = np.flatnonzero(lab != np.arange(len(lab)))
            return pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[lab[far]])], names=["u", "v"])

        for batch in batches:
            for k, g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2))):
                if k != key:
                    if len(ids) > 1:
                        yield solved()
                    key, ids, texts = k, [], []
                ids.append(g)
                texts.append(t)
        if len(ids) > 1:
            yield solved()

    return run


def near_copies(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) that join all of the distinct (g, text) whose sets of shingles have that Jaccard similarity, as forests.

    Texts that share a band are candidates. Each is tied to the smallest g of the
    band, so a band of any size gives a row per text, and candidates that hang
    together are a family. In a family every pair is compared by its exact sets; a
    large one is cut into blocks, and each two blocks meet in a task of their own.
    """
    bands = texts.mapInArrow(_bands(width), "g long, keys array<long>")
    rows = stage(bands.select("g", F.explode("keys").alias("key")))
    least = rows.groupBy("key").agg(F.min("g").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "least")
    family = components(rows.join(least, "key").select(F.col("g").alias("u"), F.col("least").alias("v")))
    met = stage(texts.join(family, F.col("g") == F.col("node")).select("g", "text", "root"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("text").cast("long")) / BYTES)).cast("int")
    sizes = met.groupBy("root").agg(parts.alias("parts")).select(F.col("root").alias("r"), "parts")
    dealt = met.join(sizes, F.col("root") == F.col("r")).withColumn("own", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
    # with one block it meets itself; with more each meets every other, and so its own rows too
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("root", "own", "g", "text", F.explode(others).alias("other"))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "g", "text")
    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(_verified(width, similarity), "u long, v long")


def without_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` but for near copies: of each group the row with the smallest doc_id stays.

    Equal texts are one node from the start. Two texts are near if the Jaccard
    similarity of their sets of word shingles is `similarity` or more; groups are
    what hangs together over near pairs. Candidates come from bands of minima:
    pairs at similarity 0.8 share one with probability 0.9999.
    """
    names = docs.columns
    g, m, least, bg, bm = (free(names, n) for n in ("near_g", "near_m", "near_least", "near_bg", "near_bm"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text).alias(g), F.md5(text).alias(m))
    # a text is known by both hashes; as a node by one made of them
    nodes = stage(keyed.groupBy(g, m).agg(F.min("doc_id").alias("least"), F.first(text).alias("text")).withColumn("g", F.xxhash64(g, m)))
    found = components(near_copies(nodes.select("g", "text"), width, similarity))
    named = nodes.select(g, m, "least", "g").join(found, F.col("g") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "g"))
    # empty texts are equal texts; null ids come last
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", m, g)).alias("b")).select(F.col("b.least").alias(least), F.col(f"b.{g}").alias(bg), F.col(f"b.{m}").alias(bm))
    # not an equality, so that both steps are dealt by the text's hashes
    chosen = F.coalesce(F.col("doc_id") == F.col(least), F.col("doc_id").isNull() & F.col(least).isNull())
    kept = keyed.join(best, (F.col(g) == F.col(bg)) & (F.col(m) == F.col(bm)) & chosen)
    return kept.dropDuplicates([g, m]).select(*[F.col(f"`{c}`") for c in names])
