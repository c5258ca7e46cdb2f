"""Token-id files: id blocks in document order with Elias-Fano coded document boundaries.

Format. A file set is a Parquet folder whose rows are blocks: `part`, `block`,
`docs`, `ids` (little-endian unsigned 32-bit), `bounds` and `names`. `bounds`
codes the running end offset of each document inside the block, `names` the
document ids less the block's `base`; both are non-decreasing, so both are
Elias-Fano coded. Blocks are written by Spark's committer: a task that is lost
or run twice leaves one copy.

Defined results: null text is empty and gives the end id alone; repeated rows
stay, in any order among themselves; rows with a null doc_id come first, without
name; an empty table gives an empty folder; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block is closed when it has so many ids; one longer document makes a longer block.
BLOCK_IDS = 1 << 18
_SAMPLE = 64  # one select sample for so many documents

BLOCKS = "part long, block long, docs long, nameless long, base long, ids binary, bounds binary, names binary"


class EliasFano:
    """A non-decreasing list of n integers below u in about n * (2 + log2(u / n)) bits.

    Low bits are packed one after another; high parts are unary in a bit vector
    whose i-th one stands at (value >> low) + i. Samples of the ones' places make
    select a look at a few bytes.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low = max(0, int(int(v[-1]) // max(n, 1)).bit_length() - 1) if n else 0
        lows = np.zeros(0, np.uint8)
        if n and low:
            cut = v & np.uint64((1 << low) - 1)
            bits = (cut[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low, lows, np.packbits(bits, bitorder="little"), ones[::_SAMPLE].astype(np.uint32))

    def bytes(self) -> bytes:
        head = np.array([self.n, self.low, len(self.lows), len(self.highs)], np.uint32)
        return b"".join(x.tobytes() for x in (head, self.samples, self.lows, self.highs))

    @classmethod
    def read(cls, raw: bytes) -> EliasFano:
        n, low, nl, nh = (int(x) for x in np.frombuffer(raw, np.uint32, 4))
        s = -(-n // _SAMPLE)
        at = 16 + 4 * s
        b = np.frombuffer(raw, np.uint8)
        return cls(n, low, b[at : at + nl], b[at + nl : at + nl + nh], np.frombuffer(raw, np.uint32, s, 16))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        word = int(self.highs[byte]) & (0xFF << (at & 7))
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        value = place - i
        for k in range(self.low):
            bit = i * self.low + self.low - 1 - k
            value = value << 1 | (int(self.lows[bit >> 3]) >> (bit & 7) & 1)
        return value

    def all(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64)
        if self.low:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            out = (out << self.low) | (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return out


#: Bytes that the memory of words holds, about; a word over LONG characters is not kept.
MEMORY = 72 << 20
LONG = 256


def _weight(word: str, ids: bytes) -> int:
    return 190 + len(word) + len(ids)


class Words:
    """Encodes texts word by word through memories of bounded size.

    White space never joins over, so a text's ids are its words' ids; the
    tokenizer file's own pattern cuts a word into pieces, whose letters go
    through the tokenizer's merges alone. Texts where lower-casing or white space
    could differ between libraries (beyond Latin-1, separator controls, marks of
    special tokens) are encoded whole by the tokenizer.
    """

    def __init__(self, path: str, bound: int = MEMORY):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        self.tok, self.bound, self.words, self.held = Tokenizer.from_file(path), bound, {}, 0
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = told["pre_tokenizer"]["pretokenizers"]
        norms = [n["type"] for n in told["normalizer"]["normalizers"]]
        self.plain = norms == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"]
        if self.plain:
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.odd = regex.compile("[\x1c-\x1f\u0100-\U0010ffff]|<\\|").search
            self.letters = _byte_letters()
            self.merge = self.tok.model.tokenize

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        if self.held > self.bound:  # the oldest are the most frequent
            self.words = dict(islice(self.words.items(), len(self.words) // 2))
            self.held = sum(map(_weight, self.words, self.words.values()))
        known = self.words
        for w in words:
            if w.isalpha():  # the pattern takes letters in a row as one piece
                cut = (w,)
            elif w[-1:] in (".", ",") and w[:-1].isalpha():
                cut = (w[:-1], w[-1])
            else:
                cut = self.pieces(w)
            for p in cut:  # a piece is cut into itself, so it is a word like any other
                if p not in known:
                    known[p] = got = self._piece(p)
                    self.held += _weight(p, got)
            if w not in known:
                known[w] = got = b"".join([known[p] for p in cut])
                self.held += _weight(w, got)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [self._whole(t) for t in texts]
        cut = [None if self.odd(t) else t.lower().replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*[ws for ws in cut if ws])
        new = [w for w in seen if w not in self.words]
        if new:
            self._learn(new)
            lost = [w for w in seen if w not in self.words]  # what the bound has pushed out
            for w in lost:
                self.words[w] = got = b"".join([self._piece(p) for p in self.pieces(w)])
                self.held += _weight(w, got)
        words = self.words
        out = [self._whole(t) if ws is None else b"".join([words[w] for w in ws]) for t, ws in zip(texts, cut)]
        for w in new:
            if len(w) > LONG and w in words:
                self.held -= _weight(w, words.pop(w))
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers show for each byte: printable Latin-1 itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One memory for all tasks of a worker."""
    return Words(path)


def _writer(path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([end_id], np.uint32).tobytes()
        part, block = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids])
            named = np.array([x for x in names if x is not None], np.int64)
            base = int(named[0]) if len(named) else 0
            row = [part, block, len(ids), len(ids) - len(named), base, b"".join(ids), EliasFano.of(ends).bytes(), EliasFano.of(named - base).bytes()]
            kinds = [pa.int64()] * 5 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                for name, got in zip(some.column(0).to_pylist(), words.encode(["" if x is None else x for x in some.column(1).to_pylist()])):
                    ids.append(got + end)
                    names.append(name)
                    size += len(got) // 4 + 1
                    if size >= block_ids:
                        yield closed()
                        block, ids, names, size = block + 1, [], [], 0
        if ids:
            yield closed()

    return write


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS, mode: str = "errorifexists") -> None:
    """Encode doc_id, text and write the id blocks in ascending doc_id order.

    Text moves once, by ranges of doc_id; encoding follows the exchange, so that
    finding the ranges does not encode. No task holds more than a block.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(_writer(tokenizer, end_id, block_ids), BLOCKS).write.mode(mode).parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            ids = np.frombuffer(row["ids"].as_buffer(), np.uint32)
            ends = EliasFano.read(row["bounds"].as_py()).all()
            names = EliasFano.read(row["names"].as_py()).all() + row["base"].as_py()
            starts = np.concatenate([[0], ends[:-1]])
            out = {
                "doc_id": pa.array([None] * row["nameless"].as_py() + names.tolist(), pa.int64()),
                "part": pa.array([row["part"].as_py()] * len(ends), pa.int64()),
                "block": pa.array([row["block"].as_py()] * len(ends), pa.int64()),
                "inside": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens, ids_crc32.

    Offsets inside a block come from its bounds; what lies before a block is
    summed over blocks in their part, and over one row per part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    sizes = blocks.select("part", "block", (F.octet_length("ids") / 4).cast("long").alias("n"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", zero(F.sum("n").over(before(W.orderBy("part")))).alias("p"))
    firsts = sizes.select("part", "block", zero(F.sum("n").over(before(W.partitionBy("part").orderBy("block")))).alias("b")).join(parts, "part").select("part", "block", (F.col("p") + F.col("b")).alias("first"))
    rows = blocks.mapInArrow(_reader, "doc_id long, part long, block long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(firsts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
