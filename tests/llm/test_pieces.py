import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from spoor.llm.pieces import Pieces, decoded, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
P = Pieces(PATH)
# the library's own Viterbi over the same pieces: the last entry of a message's field wins, and model type 1 is Viterbi
LIB = SentencePieceProcessor(model_proto=open(PATH, "rb").read() + b"\x12\x02\x18\x01")


def ids_of(p, text):
    return list(memoryview(p.encode([text])[0]).cast("i"))


def score(ids):
    return sum(LIB.get_score(i) for i in ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \nabcdeéßth_▁"), st.characters(codec="utf-8")), max_size=40))
def test_equals_the_library_and_comes_back(text):
    ids = ids_of(P, text)
    want = LIB.encode(text)
    assert ids == want or score(ids) > score(want)  # the library adds scores in single precision
    assert P.decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [text.replace("▁", " ")]


def test_prefix_sharing_and_small_memory():
    rng = random.Random(1)
    words = ["inter" + "".join(rng.choice("naltiose") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    small = Pieces(PATH, bound=5)
    texts = [" ".join(words[i : i + 9]) for i in range(0, 400, 9)]
    assert [list(memoryview(x).cast("i")) for x in small.encode(texts)] == [[i for w in t.split() for i in LIB.encode(w)] for t in texts]


def test_column_operators_and_odd_rows(spark, documents, odd_rows):
    rows = odd_rows + [(9, "x" * 50_000)]
    out = decoded(encoded(documents(rows), PATH, ["doc_id", "text", "n"]), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "") and (r.ids == [] if not r.text else LIB.decode(r.ids) == r.text), r.doc_id
    assert decoded(encoded(documents([]), PATH, ["doc_id"]), PATH).collect() == []
