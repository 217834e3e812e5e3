"""Queries without SQL, over whole tables, against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from loamline.llm.queries import QUERIES
from loamline.session import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_packing(spark):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in table(spark, SMALL, "documents").collect()}
    got = QUERIES["op1_packing"](spark, SMALL).collect()
    at, covered = 0, dict.fromkeys(docs, 0)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at and r.offset + r.length <= 4096
        ids = docs[r.doc_id]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        at += r.length
    assert all(covered[d] == len(ids) for d, ids in docs.items())


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nearest_neighbours(spark):
    rows = table(spark, LARGER, "embeddings").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in QUERIES["op10_permindex"](spark, LARGER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        distance = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, distance)) if ids[i] != q][:10]
        hits += len({int(ids[i]) for i in order} & {i for i, _ in found})
        total += 10
        assert all(abs(s - distance[ids == i][0]) < 1e-12 for i, s in found)
    assert hits / total >= 0.9


@pytest.mark.parametrize("name,label,least", [("op3_toxicity", "toxic", 0.93), ("op8_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    known = {r.doc_id: r[label] for r in table(spark, LARGER, "labels").collect()}
    rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) == table(spark, LARGER, "documents").count()
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) >= least
