"""What the operators share: tables, row keys, word hashes over whole batches, components, order."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage, work_dir

#: Bytes of text that one vectorised step works on; longer texts are cut between words.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again: branches then read only their columns."""
    folder = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free(columns: Sequence[str], name: str) -> str:
    """The name, with a line below it for as long as the table has it (column names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: Sequence[bytes], limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about `limit` bytes together, one text at least."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def portions(column: pa.Array, limit: int = STEP) -> Iterator[tuple[int, int, list[bytes]]]:
    """Index ranges of consecutive texts with about `limit` bytes together, one text at least, and these texts as UTF-8 bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, z, encoded(column.slice(a, z - a))
        a = z


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 16, 1 << (int(n) - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of b[s:e] for each pair; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=h[1:])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts cut at a blank or line end; one longer word stays whole."""
    a = 0
    while len(text) - a > limit:
        cut = max(text.rfind(b" ", a, a + limit), text.rfind(b"\n", a, a + limit))
        if cut <= a:
            at = [x for x in (text.find(b" ", a + limit), text.find(b"\n", a + limit)) if x >= 0]
            cut = min(at, default=len(text))
        yield text[a:cut]
        a = cut
    yield text[a:]


def hashed_words(texts: Sequence[bytes], blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's first position (one more at the end).

    `blanks` says for each byte value whether it separates words. Texts are
    joined for the vector steps; a text over STEP is cut between words, so the
    work space stays bounded while the result has eight bytes per word.
    """
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    for a, z in steps(texts):
        if z - a == 1 and len(texts[a]) > STEP:
            for piece in _pieces(texts[a], STEP):
                h, _ = _hashed(piece, blanks)
                parts.append(h)
                counts[a + 1] += len(h)
            continue
        h, at = _hashed(b"\n".join(texts[a:z]), blanks)
        ends = np.cumsum([len(t) + 1 for t in texts[a:z]])
        counts[a + 1 : z + 1] = np.diff(np.searchsorted(at, ends), prepend=0)
        parts.append(h)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def _hashed(text: bytes, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~blanks[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return window_hashes(b, starts, ends), starts


def blank_table(keep: Iterable[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(keep)] = False
    return t


#: Letters, digits and all bytes of non-ASCII characters make words.
WORDS = blank_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def next_ids(ids: DataFrame, name: str = "doc_id", out: str = "next_id", width: int = 4096) -> DataFrame:
    """Each distinct id with the next larger one; the last gets the first of all.

    Ids are cut into ranges of `width`, ranges again, so a window never holds
    more than `width` ids; the last level has a row per width**2 ids.
    """
    one = ids.select(F.col(name).alias("k")).filter("k is not null").distinct()
    lead = lambda c, *by: F.lead(c).over(W.partitionBy(*by).orderBy(c))
    rows = one.withColumn("a", F.floor(F.col("k") / width)).withColumn("n", lead("k", "a"))
    firsts = rows.groupBy("a").agg(F.min("k").alias("first")).withColumn("b", F.floor(F.col("a") / width)).withColumn("n1", lead("first", "b"))
    tops = firsts.groupBy("b").agg(F.min("first").alias("top")).withColumn("n2", F.lead("top").over(W.orderBy("b")))
    tops = tops.withColumn("n2", F.coalesce("n2", F.min("top").over(W.partitionBy(F.lit(0)))))
    after = firsts.join(tops, "b").select("a", F.coalesce("n1", "n2").alias("after"))
    return rows.join(after, "a").select(F.col("k").alias(name), F.coalesce("n", "after").alias(out))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of (u, v) links of longs: one row (node, root) for each linked node, root the smallest.

    Alternates the two star steps: every node hands its larger, then its smaller
    neighbours to the smallest one it knows. Joins and map-side minima only, so a
    hub is split like any skewed key; each round is checkpointed.
    """
    e = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e = stage(small.filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
