import numpy as np
import pytest
from test_dedup import components_by_hand, removed_by_hand

import corpus_pipeline
from loamline.llm import minhash, quality, substring, toxicity
from loamline.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = table(spark, SF, "documents")
    odd = [(10**6, None, "en", "x", 0), (10**6 + 1, "", None, "x", None), (None, "No id but words enough to make a shingle of them.", "en", "x", 5), (10**6 + 2, "wort " * 30_000, "de", "x", 1)]
    return base.unionByName(spark.createDataFrame(odd + [tuple(base.first())], SCHEMA))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filters_keep_whole_rows(spark, docs):
    labels = table(spark, SF, "labels")
    for stage, module, kept in ((corpus_pipeline.quality_stage, quality, 1), (corpus_pipeline.toxicity_stage, toxicity, 0)):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        verdicts = module.score(docs, module.train(docs, labels)).collect()
        wanted = {}
        for r in verdicts:
            wanted[r.doc_id] = wanted.get(r.doc_id, 0) + (r.predicted == kept)
        count = {}
        for r in got.select("doc_id").collect():
            count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert count == {k: v for k, v in wanted.items() if v}
        assert not set(plain(got)) - set(plain(docs))


def test_one_of_each_group_stays(spark, docs):
    rows = plain(docs)
    kept = {d for d, _, _, stays in components_by_hand(rows) if stays}
    assert {r[0] for r in plain(corpus_pipeline.near_dedup_stage(spark, docs, SF))} == kept


def test_near_copies_from_80_percent_go(spark):
    words = [f"w{i}" for i in range(204)]
    rows = [(n, " ".join(words[:200]) + f" {n}", "en", "x", 1) for n in (1, 2)]
    # 200 shingles each; a changed word in the middle spoils five of them on either side.
    for n, changed in ((10, 2), (20, 3), (30, 4), (40, 5), (50, 8)):
        other = [f"{n}{w}" for w in words]
        rows.append((n, " ".join(other), "en", "x", 1))
        for c in range(changed):
            other[20 * c + 20] = f"new{c}"
        rows.append((n + 1, " ".join(other), "en", "x", 1))
    kept = {d for d, _, _, stays in components_by_hand(rows, 80) if stays}
    assert kept != {d for d, _, _, stays in components_by_hand(rows, 85) if stays}
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert {r.doc_id for r in got.collect()} == kept


def test_stage_equals_brute_force_at_80(spark, docs):
    kept = {d for d, _, _, stays in components_by_hand(plain(docs), 80) if stays}
    assert {r[0] for r in plain(corpus_pipeline.near_dedup_stage(spark, docs, SF))} == kept


def test_bands_and_estimates_find_links_of_80_percent():
    for percent in (80, 85, 95):
        rows = minhash.rows_per_band(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.HASHES // rows) <= 1e-6
    rng, least = np.random.default_rng(4), minhash.least_estimate(80)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 1125, dtype=np.int64).astype(np.uint64)
        one, two = minhash.minima(pool[:1000]), minhash.minima(pool[125:])
        assert minhash.estimate(*(np.frombuffer(minhash.pack(m), "<u8") for m in (one,)), np.frombuffer(minhash.pack(two), "<u8")[None])[0] >= least
        assert (minhash.band_keys(one, 4) == minhash.band_keys(two, 4)).any()


def test_repeated_passages_go(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.substring_stage(spark, docs, SF).collect()}
    digests = {d: (n - gone) for d, n, gone, _ in removed_by_hand(plain(docs), substring.WINDOW)}
    assert {d: len((r.text or "").encode().split()) for d, r in got.items()} == digests
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_all_stages(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "substring", "packing"]
    at = 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at and len(r.ids) == r.length
        at += r.length


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_packing_stage_holds_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {1: "Un mot, naïve***", 2: None, 3: "an <|ENDOFTEXT|> in upper case", 4: "word " * 9000}
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {d: [] for d in texts}
    for r in sorted(corpus_pipeline.packing_stage(spark, df, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id])
        got[r.doc_id] += r.ids
    assert got == {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts.items()}
