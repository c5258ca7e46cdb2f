"""Token alignment against plain Python over byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spoor.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ranges(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def plain(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    to_byte = {v: k for k, v in _bytes_to_unicode().items()}
    counts, found = Counter(), []
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ba = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            found.append((doc, [], [], [], None))
            continue
        ra, rb = ranges(map(len, ba)), ranges(map(len, bb))
        links = [(x, y) for x, (s, e) in enumerate(ra) for y, (u, v) in enumerate(rb) if s < v and u < e]
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, s = [], 0
        for e in ends:
            side = lambda ids, rs: ",".join(str(i) for i, (_, z) in zip(ids, rs) if s < z <= e)  # noqa: B023, E731
            groups.append(f"{side(ia, ra)}|{side(ib, rb)}")
            s = e
        counts.update((ib[y], ia[x]) for x, y in links)
        found.append((doc, ia, ib, [(ib[y], ia[x]) for x, y in links], groups))
    top = {}
    for (y, _), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for doc, ia, ib, links, groups in found:
        digest = "" if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(ia), len(ib), len(groups or ()), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def _bytes_to_unicode():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."), (3, "Größe und Maß: naïve café 中文字 😀😀"),
    (4, "<|endoftext|> and <s> </s> <unk> are plain <0x41>"), (5, None), (6, ""), (7, "  two  blanks\tand\n\nlines ▁ marked "), (8, "x"),
    (None, "The quick brown fox jumps over the lazy dog."), (None, "lonely"), (9, "a\u0000b ﻿ ć"), (10, "1234567890 " * 30), (1, "again one"),
]


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_byte_ranges(documents, spark):
    docs = documents(ROWS)
    assert got(alignment.compared(docs, A, B)) == plain(ROWS)


def test_small_portions_and_given_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PORTION", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 3000]
    few = docs.filter("length(text) < 3000")
    assert got(alignment.compared(few, A, B)) == plain(rows)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "some text here", 2, "z")], "doc_id long, text string, k1 long, salt string").selectExpr("*", "k1 AS n", "k1 AS one", "k1 AS n_a")
    assert got(alignment.compared(df, A, B)) == plain([(1, "some text here")])


def test_empty_table(documents):
    assert got(alignment.compared(documents([]), A, B)) == []


def test_long_text(documents):
    text = "lorem ipsum dolor sit amet " * 8000 + "z" * 20_000
    (row,) = got(alignment.compared(documents([(1, text)]), A, B))
    assert row[1] > 0 and row[2] > 0 and row[4] >= max(row[1], row[2])
