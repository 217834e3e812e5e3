import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm import packing
from loamline.llm.packing import ChunkEncoder, pack, windows

PATH = P.path("word_bpe_49k.json")


def check(spark, rows, capacity):
    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    pieces = pack(df, PATH, capacity)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * capacity + r.offset == at and 0 < r.length <= capacity - r.offset
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.length
    want = sorted((tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows), key=str)
    docs = []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        docs.append(list(r.ids)) if r.start == 0 else docs[-1].extend(r.ids)
    assert sorted(docs, key=str) == want
    return pieces, at


def test_every_id_lies_in_one_piece(spark):
    rows = [(i, t, "x") for i, t in enumerate(["Hello, World's  end\n\tAÇA é 12", None, "", "<|endoftext|>a<|startoftext|>", "x" * 5000, "ab " * 9000, "é   \x1cq \x85z", "İstanbul ΣΑΣ"])] + [(None, "same", "y"), (1, "same", "y")]
    pieces, total = check(spark, rows, 4096)
    sizes = [r.n for r in windows(pieces).select(F.size("ids").alias("n"), "sequence_id").orderBy("sequence_id").collect()]
    assert all(n == 4096 for n in sizes[:-1]) and len(sizes) == -(-total // 4096)
    check(spark, rows, 7)


def test_word_by_word_equals_the_tokenizer():
    enc, tok = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    assert enc.by_word
    rng = random.Random(4)
    letters = "abtheINGéÉßñŁøяжЯ日ǅİΣσς's't.,!?%&|0 9\n-_\u0301ªº"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_many_chunks_equal_the_tokenizer_and_are_not_kept():
    enc, tok = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(6)
    syllables = ["the", "er", "nd", "ing", "ou", "ß", "ñe", "é", "÷", "ü", "s", "x", "'", ".", "***", "$$$", ","]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 12))) for _ in range(400)) for _ in range(60)]
    texts += [None, "", " ", "<|ENDOFTEXT|> <|StartOfText|>", "a <|endoftext|>", "\n", "q" * 65 + "z" * 64 + " " + "z" * 64 + "." * 64, "Ünd'S 12 œuf"]
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_all(texts, np.array([2], enc.dtype).tobytes()).to_pylist()]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert enc.encode_all([]).to_pylist() == [] and enc.encode_all([None, ""]).to_pylist() == [b"", b""]

    words = [f"{a}{b}{c}" for a in syllables[:5] for b in map(chr, range(97, 123)) for c in map(chr, range(97, 123))]
    before = len(enc) + len(enc.older)
    enc.encode_all([" ".join(words), " ".join(w + ",***" for w in words)])
    assert len(enc) + len(enc.older) == before


def test_upper_case_of_a_special_token_is_text_and_marks_join_punctuation():
    enc, tok = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("<|ENDOFTEXT|>", "x <|EndOfText|> y", "<|endoftext|> <|ENDOFTEXT|>", "Σ İ.", "\ufb2a,"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_merged_chunks_are_remembered_within_their_bound(monkeypatch):
    monkeypatch.setattr(packing, "MERGED_CHUNKS", 300)
    enc, tok = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    merged = []
    inner = enc.merges.merge
    monkeypatch.setattr(enc.merges, "merge", lambda data, starts, lengths: merged.append(len(lengths) // 2) or inner(data, starts, lengths))
    rng = random.Random(8)
    usual = ["".join(rng.choices("abdeghinorstuéß", k=rng.randint(2, 12))) + rng.choice(["", ".", ",", "***"]) for _ in range(200)]
    for _ in range(6):
        rare = ["".join(rng.choices("abdeghinorstuéß", k=14)) for _ in range(250)]
        texts = [" ".join(rng.sample(usual + rare, 450)) + " 12 Œuf", None, "", " ".join(usual)]
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_all(texts).to_pylist()]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(enc.words) <= 300
    # In the end few but rare words are merged, the usual ones have been remembered.
    assert merged[-1] < 300 < 440 < merged[0], merged
