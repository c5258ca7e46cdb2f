"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent letter n-grams over
all its training texts. A text's own ranked list is compared with each profile:
the out-of-place distance sums how far each n-gram's rank lies from its rank in
the profile, TOP where the profile lacks it. The nearest language wins.

n-grams are taken inside words with a blank at either end, lower-cased, over
whole texts; they are known by 44-bit hashes, so a profile holds no strings.

Defined results: null texts and texts without a letter are `und` with score 0;
ties between languages go to the first in order, ties between n-grams to the
smaller hash; repeated rows stay; without training rows all are `und`; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, mix

SIZES = (1, 2, 3)
TOP = 300
_BITS = 44
_CHUNK = 1 << 18  # characters in one vectorised step
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every n-gram of every text, as one sorted key array with counts: keys, counts."""
    s = "\n".join(texts).lower()
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(texts) == 1:
        owner = np.zeros(len(code), np.uint64)
    else:
        # lower-casing may lengthen a text, so texts are told by the line ends put between them
        sizes = np.array([len(t.lower()) + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)[: len(code)]
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter | np.concatenate([[True], letter[:-1]])  # one blank between words
    code, owner, letter = code[keep], owner[keep], letter[keep]
    # a blank before the first word of the step, one after the last
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    letter = np.concatenate([[False], letter, [False]])
    owner = np.concatenate([owner[:1], owner, owner[-1:]]) if len(owner) else np.zeros(2, np.uint64)
    keys = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
        if n not in SIZES:
            continue
        m = len(h)
        ok = letter[:m] if n == 1 else np.ones(m, bool)
        for k in range(1, n - 1):
            ok = ok & letter[k : k + m]
        if n == 2:
            ok = letter[:m] | letter[1 : 1 + m]
        who = np.where(letter[:m], owner[:m], owner[min(1, len(owner) - 1) : m + 1][:m]) if n > 1 else owner[:m]
        keys.append((who << np.uint64(_BITS)) | (mix(h) >> np.uint64(64 - _BITS)))
        keys[-1] = keys[-1][ok]
    k = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of one text over _CHUNK characters, piece by piece; pieces end between words where they can."""
    at, ks, cs = 0, [], []
    while at < len(text):
        z = at + _CHUNK
        if z < len(text):
            cut = max(text.rfind(" ", at, z), text.rfind("\n", at, z))
            z = cut if cut > at else z
        k, c = _grams([text[at:z]])
        ks.append(k)
        cs.append(c)
        if len(ks) == 16:
            k, c = _merged(np.concatenate(ks), np.concatenate(cs))
            ks, cs = [k], [c]
        at = z
    return _merged(np.concatenate(ks), np.concatenate(cs))


def counted(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, keys, counts) for runs of texts; keys hold the text's place in its run above the hash bits."""
    a, size = 0, 0
    for i in range(len(texts) + 1):
        n = len(texts[i]) if i < len(texts) else 0
        if i > a and (i == len(texts) or size + n > _CHUNK):
            yield (a, i, *(_grams(texts[a:i]) if size <= _CHUNK or i - a > 1 else _long(texts[a])))
            a, size = i, 0
        size += n


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


_HASH = np.uint64((1 << _BITS) - 1)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n partial counts of a task; given out whenever many have gathered."""
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, c = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), _strings(batch.column(1))
        for lang in dict.fromkeys(langs):
            for _, _, k, c in counted([t for t, x in zip(texts, langs) if x == lang]):
                held.setdefault(lang, []).append(_merged(k & _HASH, c))
                size += len(k)
                if len(held[lang]) > 32:
                    held[lang] = [_merged(np.concatenate([p[0] for p in held[lang]]), np.concatenate([p[1] for p in held[lang]]))]
                    size = sum(len(p[0]) for ps in held.values() for p in ps)
        if size > 1 << 21:
            yield from out()
            held, size = {}, 0
    yield from out()


def profiles(train: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The `top` most frequent n-grams of each language, best first, counted over all rows of (lang, text).

    Tasks count and add before the exchange; what reaches the driver is `top`
    numbers per language.
    """
    rows = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for r in ranked.select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _predict(model: dict[str, list[int]], top: int, at: int, kept: int, out: tuple[str, str]):
    langs = sorted(model)
    union = np.array(sorted({g for gs in model.values() for g in gs}), np.uint64)
    places = np.full((len(union) + 1, max(len(langs), 1)), -1, np.int32)  # the last row: in no profile
    for j, lang in enumerate(langs):
        places[np.searchsorted(union, np.array(model[lang], np.uint64)), j] = np.arange(len(model[lang]))

    def scored(keys: np.ndarray, counts: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        who, gram = (keys >> np.uint64(_BITS)).astype(np.int64), keys & _HASH
        first = np.searchsorted(who, np.arange(n + 1))
        # rank inside each text: more frequent first, then the smaller hash; both already in hash order
        order = np.argsort((who.astype(np.uint64) << np.uint64(40)) | np.uint64((1 << 40) - 1) - np.minimum(counts, (1 << 40) - 1).astype(np.uint64), kind="stable")
        rank = np.arange(len(keys)) - first[who]
        chosen = rank < top
        gram, who, rank = gram[order][chosen], who[chosen], rank[chosen]
        at = np.minimum(np.searchsorted(union, gram), max(len(union) - 1, 0))
        at = np.where(union[at] == gram, at, len(union)) if len(union) else np.zeros(len(gram), np.int64)
        place = places[at]
        off = np.where(place < 0, top, np.abs(place - rank[:, None]))
        size = np.bincount(who, minlength=n)
        total = np.stack([np.bincount(who, weights=off[:, j], minlength=n) for j in range(off.shape[1])], 1)
        best = total.argmin(1)
        seen = (size > 0) & bool(langs)
        score = np.where(seen, 1 - total[np.arange(n), best] / np.maximum(size * top, 1), 0.0)
        return [langs[b] if s else UND for b, s in zip(best, seen)], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, scores = [], []
            for a, z, k, c in counted(_strings(batch.column(at))):
                names, s = scored(k, c, z - a)
                got += names
                scores.append(s)
            cols = [batch.column(i) for i in range(kept)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=[*batch.schema.names[:kept], *out])

    return run


def identified(docs: DataFrame, model: dict[str, list[int]], keep: dict[str, Column], top: int = TOP, text: str | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of `keep`, then language and score of `text`, named by `out`.

    `text` names the column of `keep` that is the text itself, a string, which
    then goes to Python once.
    """
    kept = docs.select(*[c.alias(n) for n, c in keep.items()])
    names = kept.columns
    if text is None or kept.schema[text].dataType.simpleString() != "string":
        rows, at = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("text").cast("string").alias(free(names, "text_read"))), len(names)
    else:
        rows, at = kept, names.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(_predict(model, top, at, len(names), out), f"{kinds}, `{out[0]}` string, `{out[1]}` double")
