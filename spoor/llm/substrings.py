"""Exact removal of repeated substrings with suffix arrays built by induced sorting.

A byte goes if it lies in a string of WIDTH bytes that also starts anywhere else
in the corpus, the same document included. All windows of WIDTH bytes are dealt
by content: a window's key is the least hash among its GRAM-byte substrings, so
equal windows meet, and windows in a row mostly share their key and travel as
one piece of text.

1. Pieces are made on the executors and known by key and hash, 64 bits each.
   Keys with a single window run in the whole corpus are done: nothing repeats.
2. Pieces that occur twice or more are repeated from end to end: counted before
   any exchange, so thousands of copies are one row per task.
3. Where a key has several different pieces, each goes once to its key's shard.
   A shard's text gets a suffix array: suffixes are classified, leftmost-smaller
   ones sorted by their substrings, the rest induced in two linear scans of
   buckets; permuted common prefixes in text order tell the windows that another
   position shares.
4. Keys with more than HOT different pieces are cut into single windows, counted
   by the 128-bit hash of the whole window: no shard grows with a common passage.
5. Repeated runs return to their documents, which are joined once with the text.

Defined results: null text is empty; texts under WIDTH bytes lose nothing;
repeated rows are other places of one text, so they lose all of it that is WIDTH
bytes or longer; a null doc_id stays null; an empty table gives an empty result;
other columns are not read. Equality of pieces is that of both their hashes, 128 bits
in all; inside shards it is that of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import encoded, mix, powers, steps

WIDTH = 200
GRAM = 32
#: Different pieces of one key that a shard may hold; about 0.7 MB of text.
HOT = 2048
#: Bytes of one suffix array, unless a key alone has more (HOT bounds that).
SHARD = 1 << 20


# ---------------------------------------------------------------- windows and pieces


def _rolling(b: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every substring of `width` bytes."""
    n = len(b) - width + 1
    up, down = powers(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1 + 977 * salt)) * up[: len(b)], out=h[1:])
    return mix((h[width:] - h[:n]) * down[:n] + np.uint64(salt))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours of h."""
    n = len(h) - width + 1
    x = np.concatenate([h, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()[width - 1 : width - 1 + n]
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(left, right)


_SPAN = 21  # bits for a piece's windows; slices are shorter


def _slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[tuple[int, int, bytes]]]:
    """Steps of (text index, offset, bytes); a long text comes in parts that overlap by WIDTH - 1 bytes."""
    for a, z in steps(texts, limit):
        if z - a > 1 or len(texts[a]) <= limit:
            yield [(i, 0, texts[i]) for i in range(a, z)]
        else:
            for at in range(0, len(texts[a]) - WIDTH + 1, limit):
                yield [(a, at, texts[a][at : at + limit + WIDTH - 1])]


def _pieces(parts: list[tuple[int, int, bytes]]):
    """Runs of windows with one key: text index, key, hash of the piece, offset, windows, occurrences of the key (2 at most)."""
    parts = [p for p in parts if len(p[2]) >= WIDTH]
    if not parts:
        return None
    b = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    size = np.array([len(p[2]) for p in parts])
    first = np.cumsum(size) - size
    h = _rolling(b, GRAM)
    low = _least(h, WIDTH - GRAM + 1)
    owner = np.repeat(np.arange(len(parts)), size)
    at = np.flatnonzero(owner[: len(low)] == owner[WIDTH - 1 :])  # windows inside one part
    low, who = low[at], owner[at]
    start = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (who[1:] != who[:-1])]))
    wins = np.diff(np.append(start, len(low)))
    s = at[start]
    e = s + wins + WIDTH - 1
    up, down = powers(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(mix(b.astype(np.uint64) + np.uint64(256)) * up[: len(b)], out=c[1:])
    content = mix((c[e] - c[s]) * down[s] + wins.astype(np.uint64))
    ordered = np.sort(h)
    key = low[start]
    seen = np.minimum(np.searchsorted(ordered, key, side="right") - np.searchsorted(ordered, key), 2)
    w = who[start]
    offset = s - first[w] + np.array([p[1] for p in parts])[w]
    return np.array([p[0] for p in parts])[w], key, content, offset, wins, seen


_RUNS = "id long, h long, key long, a long, sw long, n int"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for parts in _slices(encoded(batch.column(2))):
            got = _pieces(parts)
            if got is not None:
                i, key, a, offset, wins, seen = got
                cols = [ids[i], hs[i], key.view(np.int64), a.view(np.int64), (offset << _SPAN) | wins, seen.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in _RUNS.split(", ")])


# ---------------------------------------------------------------- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the one after them; the end is smaller than any."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    run = np.searchsorted(change, np.arange(n))  # the next place where the letter changes
    at = np.append(change, n - 1)[run]
    nxt = np.append(t[1:], -1)[at]
    return nxt > t


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes sorted, from the leftmost-smaller ones in order; two scans of buckets, each bucket in whole steps."""
    n, letters = len(t), np.flatnonzero(size)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    by = t[lms]
    cut = np.searchsorted(by, letters), np.searchsorted(by, letters, side="right")

    def placed(j: np.ndarray, at: np.ndarray, step: int) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        inside = np.arange(len(j)) - np.repeat(new, np.diff(np.append(new, len(j))))
        sa[at[c] + step * inside] = j
        at[c[new]] += step * np.diff(np.append(new, len(j)))

    def scan(order, at: np.ndarray, step: int, want: bool, extra) -> None:
        for k in order:
            c = letters[k]
            i, out = (begin[c], []) if step > 0 else (end[c] - 1, [])
            while (at[c] - i) * step > 0:
                seg = sa[i : at[c]] if step > 0 else sa[at[c] + 1 : i + 1][::-1]
                i = at[c]
                j = seg[seg > 0] - 1
                j = j[small[j] == want]
                same = t[j] == c
                if same.any():
                    own = j[same]
                    if step > 0:
                        sa[at[c] : at[c] + len(own)] = own
                    else:
                        sa[at[c] - len(own) + 1 : at[c] + 1] = own[::-1]
                    at[c] += step * len(own)
                out.append(j[~same])
            seg = extra(k, c)
            j = seg[seg > 0] - 1
            out.append(j[small[j] == want])
            j = np.concatenate(out)
            if len(j):
                placed(j, at, step)

    heads = begin.copy()
    sa[heads[t[n - 1]]] = n - 1  # the end comes first, and before it stands the last suffix
    heads[t[n - 1]] += 1
    scan(range(len(letters)), heads, 1, False, lambda k, c: lms[cut[0][k] : cut[1][k]])
    tails = end - 1
    scan(range(len(letters) - 1, -1, -1), tails, -1, True, lambda k, c: sa[begin[c] : heads[c]][::-1])
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet by doubling of ranks."""
    n, k = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        up = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank[order] = up
        if up[-1] == n - 1:
            return order
        k *= 2


def suffix_array(t: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """Suffix array by induced sorting; names over a large alphabet are ordered by doubling."""
    t = t.astype(np.int64)
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    small = _types(t)
    size = np.bincount(t, minlength=alphabet)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induced(t, small, lms, size)
    rough = _induced(t, small, lms[np.argsort(t[lms], kind="stable")], size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    k = place[rough]
    ends = np.append(lms[1:] + 1, n + 1)[k]  # a substring ends with the next leftmost-smaller letter
    up, down = powers(n + 2)
    c = np.zeros(n + 2, np.uint64)
    np.cumsum(mix(np.append(t, -1).astype(np.uint64) + np.uint64(7)) * up[: n + 1], out=c[1:])
    content = mix((c[ends] - c[rough]) * down[rough] + (ends - rough).astype(np.uint64))
    name = np.cumsum(np.concatenate([[0], content[1:] != content[:-1]]))
    if name[-1] == len(lms) - 1:
        return _induced(t, small, rough, size)
    reduced = np.empty(len(lms), np.int64)
    reduced[k] = name
    order = suffix_array(reduced, int(name[-1]) + 1) if name[-1] < 1024 else _doubled(reduced)
    return _induced(t, small, lms[order], size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in text order: the suffix before it in the array (-1: none), and their common prefix.

    Only where the letters before differ is a prefix compared, eight bytes at a
    time; elsewhere it is one less than its left neighbour's.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = np.where(i > 0, t[i - 1].astype(np.int64), -1)
    own = (phi <= 0) | (i == 0) | (before != before[phi])
    p = np.flatnonzero(own)
    q = phi[p]
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: n + 8].view(np.uint8), shape=(n + 1, 8), strides=(1, 1))
    value = np.zeros(len(p), np.int64)
    live = np.flatnonzero(q >= 0)
    room = n - np.maximum(p, q)
    while len(live):
        x, y = words[p[live] + value[live]], words[q[live] + value[live]]
        same = np.minimum((np.cumprod(x == y, axis=1)).sum(1), room[live] - value[live])
        value[live] += same
        live = live[(same == 8) & (room[live] > value[live])]
    whole = np.zeros(n, np.int64)
    whole[p] = value
    last = np.maximum.accumulate(np.where(own, i, 0))
    return phi, np.maximum(whole[last] - (i - last), 0)


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, whether each of its windows of WIDTH bytes also starts elsewhere in the pieces."""
    t = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no text in UTF-8 has this byte
    phi, shared = common_prefixes(t, suffix_array(t))
    hit = np.zeros(len(t), bool)
    long = np.flatnonzero(shared >= WIDTH)
    hit[long] = True
    hit[phi[long]] = True
    out, at = [], 0
    for p in pieces:
        out.append(hit[at : at + len(p) - WIDTH + 1])
        at += len(p) + 1
    return out


# ---------------------------------------------------------------- shards


def _intervals(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_TAKEN = "key long, id long, h long, off long, piece binary, hot boolean"


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted pieces of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("id", "h", "zt", "want")}
            text = zstandard.decompress(row["zt"])
            keys, offs, cut, hot = [], [], [], []
            for w in row["want"]:
                off, wins = w["sw"] >> _SPAN, w["sw"] & ((1 << _SPAN) - 1)
                keys.append(w["key"])
                offs.append(off)
                cut.append(text[off : off + wins + WIDTH - 1])
                hot.append(w["hot"])
            n = len(keys)
            cols = [pa.array(keys), pa.array([row["id"]] * n), pa.array([row["h"]] * n), pa.array(offs), pa.array(cut, pa.binary()), pa.array(hot, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _TAKEN.split(", ")])


_FOUND = "id long, h long, lo long, hi long"


def _found(ids: list, hs: list, lo: list, hi: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hs, lo, hi)], names=["id", "h", "lo", "hi"])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole key groups, which come sorted."""
    held: list[tuple] = []
    size, last = 0, None

    def solved() -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (i, h, off, _), ok in zip(held, repeated_windows([x[3] for x in held])):
            for a, z in zip(*(x.tolist() for x in _intervals(ok))):
                for column, v in zip(out, (i, h, off + a, off + z + WIDTH - 1)):
                    column.append(v)
        return _found(*out)

    for batch in batches:
        for key, i, h, off, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last and size >= SHARD:
                yield solved()
                held, size = [], 0
            last = key
            held.append((i, h, off, piece))
            size += len(piece)
    if held:
        yield solved()


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the pieces of hot keys, by the 128-bit hash of its bytes."""
    for batch in batches:
        for _, i, h, off, piece in zip(*(c.to_pylist() for c in batch.columns)):
            b = np.frombuffer(piece, np.uint8)
            x, y = (_rolling(b, WIDTH, s).view(np.int64) for s in (1, 2))
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(n, i)), pa.array(np.full(n, h)), pa.array(np.arange(n) + off)], names=["x", "y", "id", "h", "off"])


#: Places of the bitmap that marks texts; a fixed size (512 KB), so a wrong mark only sends a text for nothing.
MARKS = 1 << 22


def _marked(texts: DataFrame) -> np.ndarray:
    """A bitmap of hashed (id, h), MARKS bits for any number of texts."""
    at = texts.select(F.pmod(F.xxhash64("id", "h"), F.lit(MARKS)).alias("p")).distinct()
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).collect()
    out = np.zeros(MARKS >> 6, np.int64)
    for r in words:
        out[r.w] = r.b
    return out.view(np.uint64)


def _on(marks: np.ndarray, place: pa.Array) -> np.ndarray:
    p = place.to_numpy()
    return (marks[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1


def _packed(marks):
    """The marked texts, compressed for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_on(marks.value, batch.column(4))))
            z = zstandard.ZstdCompressor(level=1)
            small = pa.array([z.compress(t) for t in encoded(some.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], small], names=["doc_id", "id", "h", "zt"])

    return run


def _untouched(marks):
    """Results of the texts without a mark: nothing of them repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(~_on(marks.value, batch.column(4))))
            texts = encoded(some.column(3))
            yield _result(some.column(0), [(len(t), 0, 0, hashlib.sha256(t).hexdigest(), t) for t in texts])

    return run


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *cols], names=[c.split()[0] for c in _KEPT.split(", ")])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for z, cuts in zip(batch.column("zt").to_pylist(), batch.column("cuts").to_pylist()):
            text = zstandard.decompress(z)
            at, kept, spans, gone = 0, [], 0, 0
            hi = -1
            for c in sorted(cuts or [], key=lambda c: c["lo"]):
                if c["lo"] > hi:
                    kept.append(text[at : c["lo"]])
                    spans += 1
                    hi = c["hi"]
                else:
                    hi = max(hi, c["hi"])
                at = hi
            kept.append(text[at:])
            left = b"".join(kept)
            gone = len(text) - len(left)
            rows.append((len(text), gone, spans, hashlib.sha256(left).hexdigest(), left))
        yield _result(batch.column("doc_id"), rows)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    real = F.col("doc_id").cast("long")
    rows = docs.select(real.alias("doc_id"), F.coalesce(real, F.lit(0)).cast("long").alias("id"), F.xxhash64(real.isNull(), text).alias("h"), text.alias("t"))
    runs = rows.filter(F.octet_length("t") >= WIDTH).select("id", "h", "t").mapInArrow(_find, _RUNS)
    many = runs.groupBy("key").agg(F.sum("n").alias("s")).filter("s > 1").select("key")
    met = stage(runs.select("id", "h", "key", "a", "sw").join(many, "key"))
    same = met.groupBy("key", "a").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "h", "sw")).alias("one"))
    kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    alone = (F.col("k") == 1) & (F.col("c") > 1)
    checked = stage(same.join(kinds, "key").filter(~alone).select("key", "c", "k", "one.*"))
    # pieces that occur again are repeated from end to end
    copied = met.join(same.filter("c > 1").select("key", "a"), ["key", "a"], "left_semi")
    off, wins = F.shiftright("sw", _SPAN), F.col("sw").bitwiseAND(F.lit((1 << _SPAN) - 1))
    cuts = copied.select("id", "h", off.alias("lo"), (off + wins + (WIDTH - 1)).alias("hi"))
    # different pieces of one key go to shards, once each
    send = docs.sparkSession.sparkContext.broadcast
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "h"), F.lit(MARKS)))
    packed = lambda marks: rows.mapInArrow(_packed(marks), "doc_id long, id long, h long, zt binary")
    want = checked.groupBy("id", "h").agg(F.collect_list(F.struct("key", "sw", (F.col("k") > HOT).alias("hot"))).alias("want"))
    taken = packed(send(_marked(checked))).select("id", "h", "zt").dropDuplicates(["id", "h"]).join(want, ["id", "h"]).mapInArrow(_take, _TAKEN)
    taken = stage(taken)
    # no join by key before the exchange: Spark would leave the exchange out, and a broadcast join deals no key whole
    cool = taken.filter("not hot").drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_shard, _FOUND)
    each = taken.filter("hot").drop("hot").mapInArrow(_single, "x long, y long, id long, h long, off long")
    twice = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("x", "y")
    split = each.join(twice, ["x", "y"], "left_semi").select("id", "h", F.col("off").alias("lo"), (F.col("off") + WIDTH).alias("hi"))
    cuts = stage(cuts.union(cool).union(split).groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts")))
    marks = send(_marked(cuts))
    done = packed(marks).join(cuts, ["id", "h"], "left").select("doc_id", "zt", "cuts").mapInArrow(_removed, _KEPT)
    return done.union(rows.mapInArrow(_untouched(marks), _KEPT))
