import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from loamline.llm.bpe import TreeBPE, encode_decode

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    yield from ["", " ", "a" * 3000, "ab" * 700, "\x1c\x1d a\x85\xa0b　  c", "l'été don't 12345  \n\n x", "日本語のテキスト🙂🙂 ok", "ß́é" * 50]
    for alphabet in ("ab", "the an", "abcdefgh éü\n", "0129 .,!-"):
        for n in (5, 40, 200, 900):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def test_tree_equals_tiktoken(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "x")]
    got = {r.doc_id: r for r in encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN).collect()}
    for i, t in rows:
        assert got[i].ids == reference.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].n_tokens == len(got[i].ids)


def test_join_of_any_split(reference):
    bpe, rng = TreeBPE(RANKS), random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("abcethinor") for _ in range(rng.randint(2, 120))).encode()
        cut = rng.randint(0, len(piece))
        assert bpe.join(bpe.merge(piece[:cut]), bpe.merge(piece[cut:])) == bpe.merge(piece) == bpe.tree(piece)
        assert bpe._merge_heap(piece) == bpe.merge(piece)
        assert bpe.decode(bpe.tree(piece)) == piece


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string, ids int"), RANKS, P.PATTERN, digests=True).collect() == []
