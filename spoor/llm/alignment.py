"""Alignment of two tokenizers over a corpus: each distinct text once, pair counts by multiplicity, measures to documents.

Texts are dealt by their full text and counted, so copies are tokenised once.
Both tokenizers must give back a blank and the text, byte for byte; then the end
offsets of their tokens cut the bytes into segments, each inside one token of
either side, and a segment is a link. Texts are worked on in portions of
PORTION bytes. Both tokenizers start a token at a blank that follows something
else (the pieces are looked through for that), so inside a portion texts are cut
there, and each different word is tokenised and aligned once. A portion leaves
one row: measures per text, the words of each, the different linked id pairs
with their weight, and the places of each word's links among them. Weights are
summed over the corpus, every portion gets back the sums of its own pairs, and
the measures that need them follow from words and places alone, so nothing is
tokenised twice and no row is made per link.

Defined results: null and empty texts, and texts that a tokenizer does not give
back exactly, have no tokens: zeros and an empty digest; strings of special
tokens are plain text; repeated rows and rows without doc_id stay, each with the
measures of its text; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, steps, written

#: Bytes of text in a portion; one longer text makes a longer portion.
PORTION = 4 << 20
#: Characters of words that go to a tokenizer in one text.
CALL = 1 << 12
#: Tasks that the rows of one text of many copies are dealt to.
SALTS = 16

_PORTIONS = (
    "portion long, texts array<struct<k1: long, k2: binary, n: long, one: long, n_a: long, n_b: long, n_groups: long, n_links: long, n_words: long, groups_sha256: string>>, "
    "pairs array<long>, weights array<long>, words binary, links array<int>, places binary"
)
#: A blank that follows something else and is not the last: no tokens at all stand for an empty word.
_FREE = re.compile(r"(?<=\S) (?!\Z)")
_MEASURES = "k1 long, k2 binary, n long, one long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: ids of texts, the bytes of each id, and each id in decimal before `,`, before the group's end and at the end."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)

    def digits(self, last: bytes) -> list[bytes]:
        return [b"%d%s" % (i, s) for i in range(len(self.entries)) for s in (b",", last, b"")]


@lru_cache(maxsize=1)
def _tools(path_a: str, path_b: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    to_byte = byte_level()
    names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
    side_a = Side([bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for s in names])
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    side_b = Side([piece(i) for i in range(b.get_piece_size())])
    # a piece that goes on over a blank would tie words together
    cut = _FREE if not any(re.search(rb"[^ ] ", e) for e in side_b.entries) else None
    give_a = lambda texts: [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    give_b = lambda texts: b.encode(texts, num_threads=1)
    return cut, give_a, side_a, side_a.digits(b"|"), give_b, side_b, side_b.digits(b";")


def aligned(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token and each B token, and the A and B token of each link, from tokens' end offsets."""
    marks = np.zeros(max(end_a[-1:].sum(), end_b[-1:].sum()) + 1, np.int8)
    marks[end_a] += 1
    marks[end_b] += 2
    shared, cuts = np.flatnonzero(marks == 3), np.flatnonzero(marks)
    return np.searchsorted(shared, end_a), np.searchsorted(shared, end_b), np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)


def _written_out(ids_a, ids_b, group_a, group_b, bounds_a, bounds_b, digits_a, digits_b) -> list[bytes]:
    """Each word's groups `a1,a2|b1;a3|b2,b3`, from whole-portion arrays and words' first tokens."""
    # before `,` inside a group's side, before its end at the last; a word's very last token closes nothing
    last_a = np.diff(group_a, append=-1) != 0
    form_b = (np.diff(group_b, append=-1) != 0).astype(np.int64)
    form_b[bounds_b[1:][np.diff(bounds_b) > 0] - 1] = 2
    # all A tokens of a group stand before its B tokens
    at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, side="left")
    at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
    parts = np.empty(len(ids_a) + len(ids_b), object)
    parts[at_a] = [digits_a[i] for i in (3 * ids_a + last_a).tolist()]
    parts[at_b] = [digits_b[i] for i in (3 * ids_b + form_b).tolist()]
    listed, firsts = parts.tolist(), (bounds_a + bounds_b).tolist()
    return [b"".join(listed[s:e]) for s, e in zip(firsts, firsts[1:])]


def _bounds(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class _Numbers(dict):
    """Numbers of keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def words_of(texts: list[bytes], cut: re.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of all texts, each text's words by their numbers, and each text's first."""
    number, flat = _Numbers(), [np.zeros(0, np.int32)]
    for text in texts:
        whole = " " + text.decode()
        parts = ([whole] if cut is None else cut.split(whole)) if text else []
        if parts:
            parts[0] = parts[0][1:]
        flat.append(np.fromiter(map(number.__getitem__, parts), np.int32, len(parts)))
    return list(number), np.concatenate(flat), _bounds([len(x) for x in flat[1:]])


def _runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Words that can stand in one text: only the last may end in white space, which would run into the next blank."""
    s, size = 0, 0
    for e, w in enumerate(words, 1):
        size += len(w)
        if size > CALL or w[-1:].isspace() or e == len(words):
            yield s, e
            s, size = e, 0


def _given(words: list[str], give, side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all words, each word's first, and whether a blank and the word are given back."""
    ids, sizes, whole = [], [], np.ones(len(words), bool)
    spans = list(_runs(words))
    back = lambda got, text: b"".join(map(side.entries.__getitem__, got)) == b" " + text.encode()
    for a in range(0, len(spans), 64):
        some = spans[a : a + 64]
        texts = [" ".join(words[s:e]) for s, e in some]
        for (s, e), text, got in zip(some, texts, give(texts)):
            if back(got, text):
                flat = np.array(got, np.int64)
                ends = np.cumsum([len(w.encode()) + 1 for w in words[s:e]])
                ids.append(flat)
                sizes.append(np.diff(np.searchsorted(np.cumsum(side.sizes[flat]), ends, side="right"), prepend=0))
                continue
            for w, got in enumerate(give(words[s:e]), s):
                whole[w] = back(got, words[w])
                got = got if whole[w] else ()
                ids.append(np.array(got, np.int64))
                sizes.append([len(got)])
    return np.concatenate(ids), _bounds(np.concatenate(sizes)), whole


def _words(words: list[str], tools):
    """For each word: whether both sides give it back, its A and B tokens, groups, links, written groups; and pairs of all links."""
    _, give_a, side_a, digits_a, give_b, side_b, digits_b = tools
    (flat_a, bounds_a, whole_a), (flat_b, bounds_b, whole_b) = _given(words, give_a, side_a), _given(words, give_b, side_b)
    whole = whole_a & whole_b
    if not whole.all():  # what one side does not give back has no tokens on the other either
        flat_a, bounds_a = flat_a[np.repeat(whole, np.diff(bounds_a))], _bounds(np.diff(bounds_a) * whole)
        flat_b, bounds_b = flat_b[np.repeat(whole, np.diff(bounds_b))], _bounds(np.diff(bounds_b) * whole)
    # a word's bytes are as many on both sides, so offsets run on from word to word
    group_a, group_b, link_a, link_b = aligned(np.cumsum(side_a.sizes[flat_a]), np.cumsum(side_b.sizes[flat_b]))
    groups = _written_out(flat_a, flat_b, group_a, group_b, bounds_a, bounds_b, digits_a, digits_b)
    # no group spans two words
    n_groups = np.diff(np.concatenate([group_a, [group_a[-1] + 1 if len(group_a) else 0]])[bounds_a])
    word = np.searchsorted(bounds_a, link_a, side="right") - 1
    n_links = np.bincount(word, minlength=len(words))
    return whole, np.diff(bounds_a), np.diff(bounds_b), n_groups, n_links, groups, word, (flat_b[link_b] << 32) | flat_a[link_a]


def _portion(texts: list[bytes], weights: np.ndarray, tools) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each text; the different pairs (B id, A id) and their weights; texts' words; each word's links, as places of pairs."""
    words, flat, bounds = words_of(texts, tools[0])
    if not words:
        none = np.zeros(0, np.int64)
        return [(0, 0, 0, 0, 0, "")] * len(texts), none, none, flat, none, none
    whole, n_a, n_b, n_groups, n_links, groups, word, pair = _words(words, tools)
    # a text with a word that is not given back has no tokens
    lost = np.diff(_bounds(~whole[flat])[bounds]) > 0
    sizes = np.where(lost, 0, np.diff(bounds))
    flat, bounds = flat[np.repeat(~lost, np.diff(bounds))], _bounds(sizes)
    times = np.bincount(flat, weights=np.repeat(weights, sizes), minlength=len(words)).astype(np.int64)
    pairs, place = np.unique(pair, return_inverse=True)
    summed = np.zeros(len(pairs), np.int64)
    np.add.at(summed, place, times[word])
    total = lambda x: np.diff(_bounds(x[flat])[bounds]).tolist()
    digests = [hashlib.sha256(b";".join(map(groups.__getitem__, flat[s:e].tolist()))).hexdigest() if e > s else "" for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
    rows = list(zip(total(n_a), total(n_b), total(n_groups), total(n_links), sizes.tolist(), digests))
    return rows, pairs, summed, flat, n_links, place


def _tokenised(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, part, number = _tools(path_a, path_b), TaskContext.get().partitionId(), 0
        names = ("k1", "k2", "n", "one", "n_a", "n_b", "n_groups", "n_links", "n_words", "groups_sha256")
        kind = pa.list_(pa.struct([(x, pa.binary() if x == "k2" else pa.string() if x == "groups_sha256" else pa.int64()) for x in names]))

        def row(held: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            *keys, texts = zip(*held)
            rows, pairs, weights, words, links, places = _portion(list(texts), np.array(keys[2], np.int64), tools)
            listed = [dict(zip(names, (*k, *m))) for *k, m in zip(*keys, rows)]
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number]), pa.array([listed], kind), pa.array([pairs]), pa.array([weights]),
                    pa.array([words.astype(np.int32).tobytes()]), pa.array([links.astype(np.int32)]), pa.array([places.astype(np.int32).tobytes()]),
                ],
                names=["portion", "texts", "pairs", "weights", "words", "links", "places"],
            )

        held, size = [], 0
        for batch in batches:
            for *keys, text in zip(*[batch.column(c).to_pylist() for c in range(4)], encoded(batch.column(4))):
                if held and size + len(text) > PORTION:
                    yield row(held)
                    held, size = [], 0
                held.append((*keys, text))
                size += len(text)
        if held:
            yield row(held)

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From portions and their pairs' (place, count, whether the highest of its B id): the measures of each text."""
    names = [c.split()[0] for c in _MEASURES.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            texts, links = batch.column(0)[i].values, batch.column(2)[i].values.to_numpy()
            words, place = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (1, 3))
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            if batch.column(4)[i].is_valid and len(place):
                sums = batch.column(4)[i].values
                at = sums.field("place").to_numpy()
                by_place, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                by_place[at] = sums.field("count").to_numpy()
                is_best[at] = sums.field("best").cast(pa.int64()).to_numpy()
                count, best = by_place[place], is_best[place]
            # links of words, words of texts
            of_word = lambda x: np.diff(_bounds(x)[_bounds(links)])  # noqa: B023, E731
            of_text = lambda x: np.diff(_bounds(of_word(x)[words])[_bounds(texts.field("n_words").to_numpy())])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*[texts.field(f) for f in names[:-2]], pa.array(of_text(best)), pa.array(of_text(count))], names=names)


def _key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.unhex(F.sha2(text, 256))


def compared(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: how the tokens of A (byte-level) and B (pieces) align."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # dealt by the full text; a text of one row takes that row's doc_id along
    kinds = docs.select("doc_id", text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("one"))
    k1, k2 = _key(F.col("text"))
    kinds = kinds.select(k1.alias("k1"), k2.alias("k2"), "n", F.col("one").cast("long").alias("one"), "text")
    portions = written(kinds.mapInArrow(_tokenised(path_a, path_b), _PORTIONS))
    linked = portions.select("portion", F.posexplode(F.arrays_zip("pairs", "weights")).alias("place", "e")).select("portion", "place", F.col("e.pairs").alias("pair"), F.col("e.weights").alias("w"))
    sums = linked.groupBy("pair").agg(F.sum("w").alias("count"))
    of_b = F.shiftright("pair", 32)
    sums = sums.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(of_b)))
    back = linked.join(sums, "pair").groupBy("portion").agg(F.collect_list(F.struct("place", "count", "best")).alias("sums"))
    whole = portions.select("portion", "texts", "words", "links", "places").join(back, "portion", "left")
    each = written(whole.select("texts", "words", "links", "places", "sums").mapInArrow(_measured, _MEASURES))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    single = each.filter("n = 1").select(F.col("one").alias("doc_id"), *columns)
    # rows of copies are salted, so a text of very many is no single task's
    copies = each.filter("n > 1").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    d1, d2 = _key(text)
    rows = docs.select("doc_id", d1.alias("k1"), d2.alias("k2"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return single.union(rows.join(copies, ["k1", "k2", "salt"]).select("doc_id", *columns))
