import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoor.llm.tokenfile import EliasFano, Words, read_ids, write_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    read = EliasFano.read(EliasFano.of(np.array(values, np.uint64)).bytes())
    assert read.all().tolist() == values
    assert [read.select(i) for i in range(len(values))] == values


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 5000))
    assert len(EliasFano.of(ends).bytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 2


def test_word_memory_equals_whole_texts():
    texts = ["It's  the\n\nend.", "a\u0085b c\td\x1ce", "ΑΣ ΣΑΣ, É é x", "<|endoftext|> a<|startoftext|>b", "", " ", "don't 12 3!!?"]
    assert [np.frombuffer(x, np.uint32).tolist() + [2] for x in Words(PATH, bound=4).encode(texts)] == [ids_of(t) for t in texts]


def test_files_in_id_order_with_small_blocks(spark, documents, odd_rows, tmp_path):
    rows = odd_rows + [(i, f"document {i} says {i * i}") for i in range(100, 160)]
    write_ids(documents(rows), f"{tmp_path}/x", PATH, block_ids=40)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_ids(spark, f"{tmp_path}/x").collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t)
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark, documents, tmp_path):
    write_ids(documents([]), f"{tmp_path}/x", PATH)
    assert read_ids(spark, f"{tmp_path}/x").collect() == []
