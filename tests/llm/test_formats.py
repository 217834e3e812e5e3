import base64
import hashlib
import io

import pytest

from loamline.llm import chat, warc

PAGES = "page_id long, url string, html string, type string, digest int"


def test_captures(spark):
    rows = [(4, "http://a/é", "<p>same</p>", "t", 1), (2, "http://b\r\nX: y", "<p>same</p>", "t", 1), (3, None, None, "t", 1), (1, "u", "", "t", 1), (9, "u", "x\r\n\r\ny" * 50_000, "t", 1), (7, "u", "Zoë", "t", 1)]
    rows += [(7, "u", "Zoë", "t", 1), (2, "http://b", "<p>same</p>", "t", 1), (None, "u", "<p>same</p>", "t", 1), (None, "u", "alone", "t", 1)]
    got = sorted(map(tuple, warc.captures(spark.createDataFrame(rows, PAGES).repartition(3)).collect()), key=repr)
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)


def test_short_payloads_are_responses(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)], PAGES)
    assert {r.page_id: r.refers_to for r in warc.captures(df, min_revisit_bytes=3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_transactions_nest_three_records(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>", "", 0), (2, "http://b", "<p>", "", 0)], PAGES)
    got = {r.page_id: r for r in warc.transactions(warc.read_records(warc.write_archives(df))).collect()}
    assert got[1].request.type == "request" and got[1].metadata.type == "metadata" and got[1].response.content.endswith(b"\r\n\r\n<p>")
    assert got[2].response.type == "revisit" and got[2].response.refers_to == got[1].response.record_id and got[2].request.target == "http://b"


def test_many_copies_of_one_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 3)
    df = spark.createDataFrame([(1, "u", "x", "", 0)] * 10 + [(2, "u", "y", "", 0)], PAGES)
    assert {(r.page_id, r["count"]) for r in warc.captures(df).groupBy("page_id").count().collect()} == {(1, 10), (2, 1)}


def test_no_pages(spark):
    assert warc.captures(spark.createDataFrame([], PAGES)).count() == 0


def test_broken_archives():
    good = warc.capture(1, "u", "h" * 100_000, None)
    assert [h["warc-type"] for h, _ in warc.parse(warc.inflate(io.BytesIO(good), 7))] == ["request", "response", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"HTTP/1.1 200\r\n\r\n"])))


TURNS = "pair_id long, turn int, role string, text string, section int, s string"


def test_preferences(spark):
    row = lambda p, t, r, x: (p, t, r, x, 0, "")
    chosen = [row(1, 0, "user", "hi"), row(1, 1, "assistant", "yes"), row(1, 2, "user", "and?"), row(1, 3, "assistant", "é"), row(2, 0, "user", "q"), row(3, 0, "user", None), row(4, 0, "user", "u"), row(4, 2, "assistant", "x"), row(None, 0, "a", "b"), row(1, None, "a", "b"), row(1, 0, "user", "zz"), row(1, 0, "user", "hi")]
    rejected = [row(1, 0, "user", "hi"), row(1, 1, "assistant", "no"), row(2, 0, "user", "q"), row(5, 0, "assistant", "lone"), row(4, 0, "user", "u"), row(4, 1, "assistant", "y")]
    found = chat.format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS))
    got = {r.pair_id: r for r in chat.assemble(found).collect()}
    turn = lambda r, x: f"<|{r}|>\n{x}<|end|>\n"
    assert got[1].prompt == turn("user", "hi")
    assert got[1].chosen == turn("assistant", "yes") + turn("user", "and?") + turn("assistant", "é")
    assert [got[1].chosen[m.start : m.end] for m in got[1].chosen_mask if m.learn] == [turn("assistant", "yes"), turn("assistant", "é")]
    assert [got[1].chosen[m.start : m.end] for m in got[1].chosen_mask if not m.learn] == [turn("user", "and?")]
    assert got[1].rejected == turn("assistant", "no")
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == (turn("user", "q"), "", "")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("", turn("user", ""), "")
    assert (got[4].prompt, got[4].chosen, got[4].rejected) == (turn("user", "u"), turn("assistant", "x"), turn("assistant", "y"))
    assert (got[5].prompt, got[5].rejected) == ("", turn("assistant", "lone")) and len(got) == 5


def test_preferences_without_python(spark):
    df = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"), (2, 0, "user", "e")], "conv_id long, turn int, role string, text string")
    found = chat.format_preferences(*chat.pairs_from_conversations(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    rows = {(r.pair_id, r.section, r.turn): (r.rendered, r.learn) for r in found.collect()}
    assert rows[(0, "rejected", 1)] == ("<|assistant|>\nd<|end|>\n", True) and rows[(0, "prompt", 0)][1] is False
    assert (2, "prompt", 0) in rows and len(rows) == 7


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.format_preferences(none, none).count() == 0 and chat.assemble(chat.format_preferences(none, none)).count() == 0


def test_long_conversations_are_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    rows = [(0, n, "user" if n % 2 == 0 else "assistant", f"t{n}é") for n in range(10)] + [(1, n, "user" if n % 2 == 0 else "assistant", f"u{n}") for n in range(2)]
    rows += [rows[3], (0, 3, "assistant", "t3é later"), (None, 1, "user", "x"), (0, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    found = chat.preferences_of_conversations(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    parts = {(r.pair_id, r.part): r for r in found.collect()}
    turn = lambda n, x: f"<|{'user' if n % 2 == 0 else 'assistant'}|>\n{x}<|end|>\n"
    assert sorted(parts) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert "".join(parts[0, p].prompt for p in range(3)) == "".join(turn(n, f"t{n}é") for n in range(9))
    last = parts[0, 2]
    assert (last.chosen, last.rejected) == (turn(9, "t9é"), turn(9, "u1"))
    assert [last.chosen[m.start : m.end] for m in last.chosen_mask if m.learn] == [last.chosen]
    assert parts[1, 0].prompt == turn(0, "u0") and parts[1, 0].rejected == turn(1, "t9é")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_only_repeated_turns_are_aggregated(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "BROADCAST_ROWS", limit)
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "z", "a"), (1, 1, None, None), (2, 0, "user", "c"), (2, 0, "user", "c")]
    got = chat.turns(spark.createDataFrame(rows, "pair_id long, turn int, role string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "user", "a"), (1, 1, "", ""), (2, 0, "user", "c")]


def test_urls_of_one_page_are_captures_of_their_own(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>", "", 0), (1, "http://b", "<p>", "", 0), (2, "http://c", "<p>", "", 0), (None, "http://d", "<p>", "", 0)], PAGES)
    got = warc.transactions(warc.read_records(warc.write_archives(df))).collect()
    assert sorted(r.request.target for r in got) == ["http://a", "http://b", "http://c", "http://d"]
    by = {r.request.target: r for r in got}
    assert by["http://c"].response.refers_to == by["http://a"].response.record_id and by["http://c"].metadata.refers_page == 1
    assert [by[f"http://{x}"].response.type for x in "abd"] == ["response"] * 3
