"""Long texts are read in pieces: the results are the same, and memory stays in proportion."""

import hashlib
import tracemalloc

import numpy as np
import pytest

from loamline.llm import minhash, quality, substring, toxicity, wordhash


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(5000)])
    return " ".join(words[rng.integers(0, 5000, n)].tolist()) + " tail\tof\n\nit"


def test_pieces_change_nothing(monkeypatch):
    text = sample(30_000)
    raw = text.encode()
    words = [f"{a} {b}" for a, b in zip(text.split(), text.split()[1:])]
    whole = wordhash.hash_words([raw, b"x y"], True), minhash.shingle_sets([raw])[0], substring.window_hashes(raw, 20)
    share = quality.repeats(text)
    model = quality.AttentionMIL()
    model.fitted = True
    score = quality.batch_scores(model, [text])[0]
    monkeypatch.setattr(wordhash, "GROUP_BYTES", 1000)
    monkeypatch.setattr(quality, "GROUP_BYTES", 4000)
    again = wordhash.hash_words([raw, b"x y"], True), minhash.shingle_sets([raw])[0], substring.window_hashes(raw, 20)
    assert all((a == b).all() for a, b in zip(whole[0], again[0])) and (whole[1] == again[1]).all() and (whole[2] == again[2]).all()
    assert b"".join(wordhash.pieces(raw)) == raw and len(words) == len(text.split()) - 1
    assert abs(quality.repeats(text) - share) < 1e-12
    assert abs(quality.batch_scores(model, [text])[0] - score) < 1e-5
    n, keep = substring.kept_words(raw, [(10, 5), (900, 1)], 20)
    wanted = [w for i, w in enumerate(raw.split()) if not (10 <= i < 34 or 900 <= i < 920)]
    assert n == len(raw.split()) and substring.kept_digest(raw, keep) == hashlib.sha256(b" ".join(wanted)).hexdigest()
    assert substring.kept_digest(raw, None) == hashlib.sha256(b" ".join(raw.split())).hexdigest()


def test_segments_keep_all_windows(monkeypatch):
    raw = sample(5000).encode()
    monkeypatch.setattr(substring, "SEGMENT", 700)
    _, start, count, _, _ = substring.records([raw], 20, 6)
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)])
    assert sorted(covered.tolist()) == list(range(len(raw.split()) - 19))


def test_removal_of_shifted_passages_equals_brute_force(spark):
    from test_dedup import SCHEMA, removed_by_hand

    a, b = sample(400, 1), sample(300, 2)
    rows = [(1, a, 1, "n"), (2, f"{b} {a} {b}", 1, "n"), (3, "x " + b[200:] + " " + a[37:], 1, "n"), (4, b, 1, "n")]
    wanted = removed_by_hand(rows, 20)
    got = substring.deduplicate(spark.createDataFrame(rows, SCHEMA), digests=True).collect()
    assert sorted(map(tuple, got), key=repr) == wanted


@pytest.mark.parametrize("work", ["minhash", "substring", "quality", "toxicity"])
def test_memory_stays_in_proportion(work):
    text = sample(1_200_000)
    raw = text.encode()
    model = quality.AttentionMIL()
    model.fitted = True
    wordhash.hash_words([b"a"], True), wordhash.hash_letters(["a"])
    table = wordhash.HashTable(wordhash.hash_letters(["w tail of it"])[0])
    tasks = {
        "minhash": lambda: minhash.shingle_sets([raw]),
        "substring": lambda: (substring.records([raw], 20, 6), substring.kept_digest(raw, substring.kept_words(raw, [(5, 9)], 20)[1])),
        "quality": lambda: quality.batch_scores(model, [text]),
        "toxicity": lambda: toxicity.counted_terms([text], table),
    }
    tracemalloc.start()
    tasks[work]()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 7 MB of text; a hundred of them would take a hundred times what goes with the text, and the rest once.
    assert peak < 12 * len(raw) + 60e6, peak / len(raw)
