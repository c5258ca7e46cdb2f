"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text's blanks become marks and it falls into marked words, over whose borders
no piece reaches. The distinct words of a batch are sorted, so they form a trie
read depth-first: the best scores and open piece matches up to the prefix that a
word shares with the one before are kept on a stack and reused. A text's ids are
its words' ids one after another, which is the best segmentation of the whole
text under the model's piece scores. Characters without a piece become their
UTF-8 bytes' ids, or the unknown id in models without byte pieces.

Ties go to the longest last piece. For a model made by merges this is the best
scoring segmentation, not the order of merges.

Defined results: null and empty texts have no ids and decode to the empty text;
the mark character itself decodes to a blank; repeated rows stay; an empty table
gives an empty result; columns other than those asked for are not read. A task
keeps a memory of words of bounded size; a very long word is not kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

MARK = "▁"
#: Bytes that the memory of words holds, about; a word over LONG characters is not kept.
MEMORY = 48 << 20
LONG = 256
_END = ""  # key of a node's own piece: no character is empty


def _weight(word: str) -> int:
    """Bytes that a word and its ids take in the memory, about."""
    return 220 + 3 * len(word)


class Pieces:
    def __init__(self, path: str, bound: int = MEMORY):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.root: dict = {}
        raws: list[bytes] = []
        self.byte: dict[int, int] = {}
        least = 0.0
        for i in range(n):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raws.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raws.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
                continue
            raws.append(piece.replace(MARK, " ").encode())
            least = min(least, score)
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("pieces of this model reach over word borders")
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[_END] = (score, i)
        self.blob = np.frombuffer(b"".join(raws) + b"\0", np.uint8)
        self.size = np.array([len(r) for r in raws])
        self.at = np.cumsum(self.size) - self.size
        self.unknown, self.unknown_score = sp.unk_id(), least - 10.0
        lines = not any("\n" in p for p in map(sp.id_to_piece, range(n)))
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.bound = bound

    def _fallback(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if len(self.byte) == 256 else [self.unknown]

    def solve(self, words: list[str]) -> None:
        """Ids of the words, kept in `known`; `words` is sorted here."""
        root, unknown = self.root, self.unknown_score
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]
        opened: list[list[tuple[int, dict]]] = [[]]
        last = ""
        for word in sorted(words):
            n, d = min(len(last), len(word)), 0
            while d < n and last[d] == word[d]:
                d += 1
            del best[d + 1 :], back[d + 1 :], opened[d + 1 :]
            for d in range(d, len(word)):
                c = word[d]
                on, top, how = [], -1e300, (d, -1)
                for start, node in opened[d]:
                    node = node.get(c)
                    if node is not None:
                        on.append((start, node))
                        own = node.get(_END)
                        if own is not None:
                            score = own[0] + best[start]
                            if score > top:
                                top, how = score, (start, own[1])
                node = root.get(c)
                if node is not None:
                    on.append((d, node))
                if node is not None and _END in node:
                    score, i = node[_END]
                    score += best[d]
                    if score > top:
                        top, how = score, (d, i)
                elif best[d] + unknown > top:
                    top = best[d] + unknown
                best.append(top)
                back.append(how)
                opened.append(on)
            last = word
            at, ids = len(word), []
            while at:
                start, i = back[at]
                ids += [i] if i >= 0 else self._fallback(word[start])[::-1]
                at = start
            ids.reverse()
            self.known[word] = array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = set().union(*cut)
        new = [w for w in seen if w not in self.known]
        if self.held + sum(map(_weight, new)) > self.bound:  # the oldest are the most frequent
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.held = sum(map(_weight, self.known))
            new = [w for w in seen if w not in self.known]
        self.solve(new)
        known = self.known
        out = [b"".join([known[w] for w in ws]) for ws in cut]
        self.held += sum(map(_weight, new))
        for w in new:
            if len(w) > LONG:
                self.held -= _weight(w)
                del known[w]
        return out

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of ids[off[i]:off[i + 1]]: all pieces' bytes are gathered at once."""
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.blob[np.repeat(self.at[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = ends[off].tolist()
        texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(cut, cut[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One memory for all tasks of a worker."""
    return Pieces(path)


def _runs(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, n in enumerate(sizes):
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encoded(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns of `keep`, then ids (array of int) of `text`."""
    own = free(keep, "text_read")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        try:
            yield from each(batches, p)
        finally:
            p.forget()  # a worker goes on to other stages

    def each(batches: Iterator[pa.RecordBatch], p: Pieces) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(len(keep)).to_pylist()]
            for a, z in _runs([len(t) for t in texts]):
                got = p.encode(texts[a:z])
                values = pa.Array.from_buffers(pa.int32(), sum(map(len, got)) // 4, [None, pa.py_buffer(b"".join(got))])
                ends = [0]
                for x in got:
                    ends.append(ends[-1] + len(x) // 4)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in batch.columns[:-1]], ids], names=[*keep, "ids"])

    return rows.mapInArrow(run, ", ".join(x for x in (_kinds(rows.drop(own)), "ids array<int>") if x))


def decoded(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The table with the text of its `ids` in `out`."""
    names = rows.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for batch in batches:
            column = batch.column(at)
            off, flat = column.offsets.to_numpy(), column.values
            for a, z in _runs((off[1:] - off[:-1]).tolist(), 1 << 18):
                some = flat[int(off[a]) : int(off[z])].to_numpy()
                texts = p.decode(some, off[a : z + 1] - off[a])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in batch.columns], pa.array(texts, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, f"{_kinds(rows)}, `{out}` string")
