import pytest
from pyspark.sql import functions as F

from loamline.functions import languages, people, text
from loamline.operators import commits, history, indicators, users
from loamline.plans import queries


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def files(spark, rows):
    return spark.createDataFrame([(n, n, c, len(c)) for n, c in rows], "path string, name string, content binary, length long")


def test_leading_white_space(spark):
    assert tuple(one(spark, " \t \t foo", text.leading)) == (3, 2, 3)
    assert tuple(one(spark, "①②③④⑤⑥⑦⑧⑨⑩", text.leading)) == (0, 0, 10)
    assert one(spark, " \t  ", text.leading).text == 0


def test_decoding(spark):
    assert one(spark, bytearray(b"\xef\xbb\xbfa"), text.decoded, "binary") == "a"
    assert one(spark, bytearray("é".encode("latin-1") + b"x"), text.decoded, "binary") == "�x"
    assert one(spark, bytearray(b"\xff\xfea\0"), text.decoded, "binary") == "a"


def test_binary_files(spark):
    for content, wanted in ((b"abc", False), (b"a\0b", True), (b"\xff\xfea\0", False), (b"%PDF-1", True), (b"", False), (b"x" * 1024 + b"\0", False)):
        assert one(spark, bytearray(content), text.is_binary, "binary") is wanted, content


def test_loc(spark):
    rows = [("parent.clj", b"(ns a)\n; no\n\n(foo)"), ("a.txt", b"hello\nthere"), ("foo.unknown", b"a\n\n b"), ("bin.dat", b"\0\1\2"), (".hidden", b"x"), ("e.py", b""), ("n.rs", b"/* a /* b */\n still */ fn x() {}\n// c\n\"//\"\n")]
    got = {r.path: tuple(r.loc) for r in indicators.loc(files(spark, rows)).collect()}
    assert got["parent.clj"] == ("Clojure", False, 1, 2, 1, 4, 18)
    assert got["a.txt"] == ("Plain Text", False, 0, 0, 2, 2, 11)
    assert got["foo.unknown"] == ("unknown", False, 1, 0, 2, 3, 5)
    assert got["bin.dat"] == ("dat", True, 0, 0, 0, 0, 3)
    assert got[".hidden"][0] == "no_extension"
    assert got["e.py"] == ("Python", False, 0, 0, 0, 0, 0)
    assert got["n.rs"] == ("Rust", False, 0, 2, 2, 4, len(rows[-1][1]))
    loose = {r.path: r.loc for r in indicators.loc(files(spark, rows), unknown_as_text=False).collect()}
    assert loose["foo.unknown"].code == 2


def test_indentation(spark):
    rows = [("a.clj", b"(a\n  (b\n  c))\n; z\n"), ("foo.unknown", b"a\n  b\n\n"), ("blank.unknown", b"\n \n"), ("t.odd", b"\tx\n  \ty")]
    got = {r.path: r.indentation for r in indicators.indentation(indicators.code_lines(files(spark, rows))).collect()}
    assert (got["a.clj"].lines, got["a.clj"].sum, got["a.clj"].p99, got["a.clj"].maximum) == (3, 4, 2, 2)
    assert (got["foo.unknown"].lines, got["foo.unknown"].sum, got["foo.unknown"].median) == (2, 2, 0)
    assert "blank.unknown" not in got and got["t.odd"].sum == 10


@pytest.mark.parametrize("name,text,kinds", [("Python", '"""\n# in\n"""\n# out\n\nx = "#"', "111201"), ("HTML", "<!-- a\n\n--> <p>\n<p>", "2311"), ("Lua", "--[[ a\n]]\nx", "221"), ("JSON", "{\n}", "11"), ("Plain Text", "a\n\nb\n", "202")])
def test_classes_of_lines(name, text, kinds):
    assert "".join(map(str, languages.classify(text, languages.BY_NAME[name]))) == kinds


def test_languages(spark):
    known = lambda n: one(spark, n, languages.known_language)
    assert [known(n) for n in ("a.clj", "Makefile", "a.tar.RS", ".rs", "noext")] == ["Clojure", "Makefile", "Rust", None, None]
    row = spark.createDataFrame([("run", "#!/usr/bin/env python3\n")], "n string, t string").select(languages.known_language(F.col("n"), F.col("t"))).first()
    assert row[0] == "Python"


def test_co_authors(spark):
    message = "fix\n\nCo-authored-by: Ann Ex <ann@x.org>\n  Co-authored-by:bob@x.org \nco-authored-by: no\nCo-authored-by: Cy\nCo-authored-by: <d@x.org>"
    assert [tuple(u) for u in one(spark, message, people.co_authors)] == [("Ann Ex", "ann@x.org"), (None, "bob@x.org"), ("Cy", None), (None, "d@x.org")]
    assert one(spark, None, people.co_authors) == []
    assert one(spark, " \n", people.summary) == "[no message]" and one(spark, "\n a b\nc", people.summary) == "a b"


def test_dictionary_keeps_the_first_spelling(spark):
    rows = [(("Bo", "B@x"), 1), (("ann", None), 0), (("bO", "b@X"), 0), ((None, None), 2)]
    found = users.dictionary(spark.createDataFrame(rows, "user struct<name:string,email:string>, place int")).orderBy("user_id").collect()
    assert [tuple(r.user) for r in found] == [("ann", None), ("bO", "b@X"), (None, None)]


def test_horizon_ends_the_walk(spark):
    log = spark.createDataFrame([("r", 0, 50), ("r", 1, 10), ("r", 2, 60), ("s", 0, 5)], "repo string, ord long, commit_time long")
    assert [(r.repo, r.ord) for r in commits.until_horizon(log, 20).collect()] == [("r", 0)]
    assert commits.until_horizon(log, 10).filter("repo = 'r'").count() == 3


def test_activity_and_details(spark):
    rows = [("f", "Add", 100, 90, 2, 0, [0]), ("f", "Modify", 86_500, 95, 1, 1, [0, 1]), ("g", "Modify", 50, 10, 1, 0, [1]), ("g", "Add", 60, 20, 1, 0, [1])]
    h = spark.createDataFrame(rows, "file string, change string, commit_time long, author_time long, lines_added long, lines_deleted long, users array<bigint>")
    got = {r.file: r for r in history.activity(h, 2 * 86_400 + 100).collect()}
    assert (got["f"].last_update, got["f"].age_in_days, got["f"].creation_date, got["f"].users, got["f"].user_count) == (86_500, 1, 90, [0, 1], 2)
    assert got["g"].creation_date is None
    days = {r.file: [tuple(d) for d in r.details] for r in history.nested_details(h).collect()}
    assert days["f"] == [(0, [0], 1, 2, 0), (0, [0, 1], 1, 1, 1)] and days["g"] == [(0, [1], 2, 2, 0)]


def test_activity_reads_its_history_once(spark):
    rows = [("f", "Add", 5, 5, [2, 1]), ("f", "Modify", 9, 6, None), ("f", "Modify", 8, 7, []), ("f", "Modify", 8, 7, [2, None, 3]), ("g", "Modify", 7, 3, []), (None, "Add", 1, 1, [4]), (None, "Add", 2, 0, [4])]
    h = spark.createDataFrame(rows, "file string, change string, commit_time long, author_time long, users array<bigint>")
    found = history.activity(h, 9)
    assert {tuple(r) for r in found.selectExpr("file", "last_update", "creation_date", "array_join(users, ' ')", "user_count").collect()} == {("f", 9, 5, "1 2 3", 3), ("g", 7, None, "", 0), (None, 2, 0, "4", 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    by_repo = history.activity(h.withColumn("repo", F.lit("r")), spark.createDataFrame([("r", 9)], "repo string, last_commit long"))
    assert {(r.file, r.user_count) for r in by_repo.collect()} == {("f", 3), ("g", 0), (None, 1)}


def test_newest_item_without_an_order(spark, tmp_path):
    """The newest items have no order, so they are no changes; without any, there is no newest one."""
    items = spark.createDataFrame([(1, 10, 1, 1, 86_400), (1, 11, 1, 2, 2 * 86_400), (9, 10, 1, 1, 5 * 86_400)], "k long, p long, s long, n int, t long")
    items = items.selectExpr("k AS l_orderkey", "p AS l_partkey", "s AS l_suppkey", "n AS l_linenumber", "1D AS l_quantity", "0D AS l_discount", "timestamp_seconds(t) AS l_shipdate")
    for name, key in (("some", 1), ("all", 9), ("none", 7)):
        items.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        spark.range(1).selectExpr(f"{key}L AS o_orderkey", "5L AS o_custkey", "timestamp_seconds(0) AS o_orderdate").write.parquet(f"{tmp_path}/{name}/orders.parquet")
    ages = {name: {(r.file, r.age_in_days) for r in queries.file_activity(spark, f"{tmp_path}/{name}").collect()} for name in ("some", "all", "none")}
    assert ages == {"some": {(10, 1), (11, 0)}, "all": {(10, 0)}, "none": set()}


def test_repository_by_prefix(spark):
    paths = spark.createDataFrame([(["a", "b", "c"],), (["a", "x"],), (["z"],)], "path array<string>")
    repos = spark.createDataFrame([("outer", ["a"], 0), ("inner", ["a", "b"], 1)], "repo string, root array<string>, load_ord int")
    assert {"/".join(r.path): r.repo for r in history.repository_of(paths, repos).collect()} == {"a/b/c": "outer", "a/x": "outer"}
    assert {"/".join(r.path): r.repo for r in history.repository_of(paths, repos, nearest=True).collect()} == {"a/b/c": "inner", "a/x": "outer"}


@pytest.mark.parametrize("raw", [b"\xff\xfea", b"\xfe\xff", b"\xff\xfe\x01\xd8a\0", b"\xff\xfe\x01\xdc", b"\xfe\xff\xd8\x01\xd8\x01\xdc\x01\0z", b"\xfe\xff\xdc\x01\xd8\x01", b"\xff\xfe" + "a😀é".encode("utf-16-le") + b"\x01"])
def test_no_wide_text_is_an_error(spark, raw):
    charset = "utf-16-le" if raw.startswith(b"\xff") else "utf-16-be"
    assert one(spark, bytearray(raw), text.decoded, "binary") == raw[2:].decode(charset, "replace")


def test_malformed_files_are_counted(spark):
    got = {r.path: r.loc for r in indicators.loc(files(spark, [("a.txt", b"\xff\xfea"), ("b.py", b"\xff\xfe\x01\xd8\n\0")])).collect()}
    assert got["a.txt"].lines == 1 and got["b.py"].bytes == 6


@pytest.mark.parametrize("message,wanted", [("one\ntwo lines\n\nbody", "one two lines"), ("a \n  b", "a b"), ("a\n \t\nb", "a"), ("\n\n a  b\n", "a  b"), (" \n", "[no message]"), (None, "[no message]"), ("x\r\ny\r\n\r\nz", "x y")])
def test_first_paragraph(spark, message, wanted):
    assert one(spark, message, people.first_paragraph) == wanted
