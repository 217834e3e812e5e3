import json
import random
import os
import subprocess

import pytest

from loamline import cli
from loamline.config import CouplingConfig, ScanConfig
from loamline.operators import commits, renames
from loamline.plans import registry
from loamline.plans.scan import register_sources, scan_document
from loamline.sources import gitlog
from loamline.sources.ignore import ignored, rules
from loamline.sources.tree import walk

START = 1_600_000_000


class Repo:
    def __init__(self, path):
        self.path, self.clock = path, START
        path.mkdir(parents=True, exist_ok=True)
        self.git("init", "-q", "-b", "main")

    def git(self, *args):
        self.clock += 60
        date = f"{self.clock} +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_CONFIG_GLOBAL": "/dev/null"}
        who = ["-c", "user.name=Ann", "-c", "user.email=Ann@x.org", "-c", "commit.gpgsign=false"]
        return subprocess.run(["git", *who, "-C", str(self.path), *args], env=env, check=True, capture_output=True, text=True).stdout.strip()

    def write(self, name, text):
        (self.path / name).parent.mkdir(parents=True, exist_ok=True)
        (self.path / name).write_text(text)

    def commit(self, message):
        self.git("add", "-A")
        self.git("commit", "-q", "-m", message)
        return self.git("rev-parse", "HEAD")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("repo"))
    r.write("a.txt", "one\ntwo\nthree\nfour\nfive\n")
    r.write("src/parent.clj", "(ns parent)\n\n(def x\n  1)\n")
    r.commit("first")
    r.git("checkout", "-q", "-b", "side")
    r.write("a.txt", "one\ntwo\nthree\nfour\nfive\nsix\n")
    r.commit("on the side\n\nCo-authored-by: Bo <bo@x.org>")
    r.git("checkout", "-q", "main")
    r.write("a.txt", "zero\none\ntwo\nthree\nfour\nfive\n")
    r.write("gone.txt", "x\ny\nz\n")
    r.commit("on main")
    r.git("merge", "-q", "--no-ff", "-m", "merge", "side")
    r.git("mv", "a.txt", "b.txt")
    r.git("rm", "-q", "gone.txt")
    r.commit("rename and delete")
    r.write("b.txt", "zero\none\ntwo\nthree\nfour\nfive\nsix\nseven\n")
    r.write("a.txt", "another\n")
    r.commit("reuse the name")
    r.write(".gitignore", "*.log\n/build/\n")
    r.write("x.log", "no")
    r.write("build/y.txt", "no")
    r.write("bin.dat", "a\0b")
    return r


def test_log(spark, repo):
    register_sources(spark)
    log = spark.read.format("git_log").load(str(repo.path / "src"))
    rows = commits.summarised(log).orderBy("ord").collect()
    assert [r.summary for r in rows] == ["reuse the name", "rename and delete", "merge", "on the side", "on main", "first"]
    assert rows[3].co_authors[0].email == "bo@x.org" and rows[0].author.name == "Ann"
    merge = rows[2]
    assert len(merge.parents) == 2 and sorted((c.file, c.lines_added) for c in merge.file_changes) == [("a.txt", 1), ("a.txt", 1), ("gone.txt", 3)]
    assert {(c.file, c.old_file, c.change) for c in rows[1].file_changes} == {("b.txt", "a.txt", "Rename"), ("gone.txt", None, "Delete")}
    assert commits.changes(log, include_merges=False).count() == 2 + 1 + 2 + 2 + 2


def test_final_names(spark, repo):
    log = spark.read.format("git_log").load(str(repo.path))
    changes = commits.changes(log)
    final = renames.final_names(changes.select("repo", "id", "file"), log, changes)
    found = changes.join(final, ["repo", "id", "file"]).orderBy("ord").collect()
    by = {}
    for r in found:
        by.setdefault(r.final, []).append(r.change)
    assert by["a.txt"] == ["Add"] and len(by["b.txt"]) == 7 and len(by["src/parent.clj"]) == 1
    assert "gone.txt" not in by


def test_names_over_a_graph(spark):
    """01 comes before 02, which comes before 04 and 05, which meet in 06."""
    log = spark.createDataFrame([("r", 0, "06", ["04", "05"]), ("r", 1, "04", ["02"]), ("r", 2, "05", ["02"]), ("r", 3, "02", ["01"]), ("r", 4, "01", [])], "repo string, ord long, id string, parents array<string>")
    changes = spark.createDataFrame(
        [("r", "02", 0, "b", "a", "Rename"), ("r", "04", 0, "c", "b", "Rename"), ("r", "04", 1, "z", None, "Delete"), ("r", "06", 0, "end", "c", "Rename"), ("r", "05", 0, "never", "b", "Rename")],
        "repo string, id string, change_ord int, file string, old_file string, change string",
    )
    asked = spark.createDataFrame([("r", "01", "a"), ("r", "01", "z"), ("r", "02", "b"), ("r", "05", "q"), ("r", "06", "end"), ("r", "05", "never")], "repo string, id string, file string")
    got = {(r.id, r.file): r.final for r in renames.final_names(asked, log, changes).collect()}
    assert got == {("01", "a"): "end", ("02", "b"): "end", ("05", "q"): "q", ("06", "end"): "end", ("05", "never"): "never"}


def test_names_equal_a_walk_over_any_graph(spark):
    """Few names that come and go again, in repositories of branches and merges."""
    rng, commits_of, log, changes = random.Random(5), 40, [], []
    for repo in "rst":
        for i in range(commits_of):
            parents = sorted({rng.randrange(max(0, i - 4), i) for _ in range(rng.choice((1, 1, 2)))} if i else set())
            log.append((repo, commits_of - i, f"{i:02}", [f"{p:02}" for p in parents]))
            for at in range(rng.randrange(4)):
                old, new = rng.sample("abcdef", 2)
                changes.append((repo, f"{i:02}", at, *((new, old, "Rename") if rng.random() < 0.8 else (old, None, "Delete"))))
    child = {(repo, p): c for repo, _, c, parents in sorted(log, key=lambda r: -r[1]) for p in parents}
    event = {(repo, c, old if kind == "Rename" else file): file if kind == "Rename" else None for repo, c, _, file, old, kind in changes}

    def walk(repo, at, name):
        while at is not None and name is not None:
            name, at = event.get((repo, at, name), name), child.get((repo, at))
        return name

    asked = [(repo, c, name) for repo, _, c, _ in log for name in "abcdefg"]
    want = {a: final for a in asked if (final := walk(*a)) is not None}
    frames = (
        spark.createDataFrame(asked, "repo string, id string, file string"),
        spark.createDataFrame(log, "repo string, ord long, id string, parents array<string>"),
        spark.createDataFrame(changes, "repo string, id string, change_ord int, file string, old_file string, change string"),
    )
    rows = renames.final_names(*frames).collect()
    assert len(rows) == len(want) and {(r.repo, r.id, r.file): r.final for r in rows} == want


def test_rounds_of_a_long_chain_of_renames(spark, monkeypatch):
    """100 renames one after another: chains are halved, they aren't followed step by step."""
    n, written = 100, []
    monkeypatch.setattr(renames, "materialize", lambda df, label, real=renames.materialize: written.append(label) or real(df, label))
    log = spark.createDataFrame([("r", n - i, str(i), [str(i - 1)] if i else []) for i in range(n)], "repo string, ord long, id string, parents array<string>")
    changes = spark.createDataFrame([("r", str(i), 0, f"f{i}", f"f{i - 1}" if i else None, "Rename" if i else "Add") for i in range(n)], "repo string, id string, change_ord int, file string, old_file string, change string")
    found = renames.final_names(changes.select("repo", "id", "file"), log, changes)
    assert len(written) < 15
    assert found.count() == n and [r.final for r in found.select("final").distinct().collect()] == [f"f{n - 1}"]


def test_document(spark, repo):
    config = ScanConfig(str(repo.path), name="t", id="7", coupling=CouplingConfig(1, 1, 0.1, 10, 600, 0))
    found = scan_document(spark, config, now=START + 86_400)
    found = json.loads(json.dumps(found))
    assert (found["name"], found["id"], found["tree"]["name"]) == ("t", "7", "<root>")
    names = [c["name"] for c in found["tree"]["children"]]
    assert names == ["a.txt", "b.txt", "bin.dat", "src"]
    b = found["tree"]["children"][1]["data"]
    assert b["loc"]["language"] == "Plain Text" and b["git"]["user_count"] == 2 and b["git"]["activity"] == []
    assert b["git"]["creation_date"] is not None and sum(d["commits"] for d in b["git"]["details"]) == 7
    assert set(b["file_stats"]) == {"created", "modified"}
    clj = found["tree"]["children"][3]["children"][0]["data"]
    assert clj["loc"]["code"] == 3 and clj["indentation"]["p99"] == 2 and clj["coupling"]["buckets"][0]["coupled_files"] == []
    assert "git" not in found["tree"]["children"][2]["data"] and "children" not in found["tree"]["children"][2]
    root = found["tree"]["data"]["git"]
    assert root["remote_url"] is None and len(root["head"]) == 40
    assert [u["user"]["email"] for u in found["metadata"]["git"]["users"]] == ["Ann@x.org", "bo@x.org"]
    assert found["metadata"]["coupling"]["buckets"]["bucket_count"] == 1


def test_scan_without_git_and_own_calculator(spark, tmp_path):
    (tmp_path / "x.py").write_text("a = 1\n")

    @registry.register
    class Shout:
        name = "shout"

        def compute(self, context):
            from pyspark.sql import functions as F

            return context.nodes.select("path", F.struct(F.upper("name").alias("name")).alias("shout"))

        def metadata(self, context):
            return {"shout": True}

    config = ScanConfig(str(tmp_path), git=False, git_details=False, calculators=("shout", "loc"))
    found = scan_document(spark, config)
    assert found["tree"]["children"][0]["data"]["shout"] == {"name": "X.PY"} and found["metadata"] == {"shout": True}
    with pytest.raises(ValueError):
        registry.calculators(ScanConfig(".", git=False, git_details=False, calculators=("nothing",)))


def test_bare_and_missing_repositories(tmp_path):
    subprocess.run(["git", "init", "-q", "--bare", str(tmp_path / "bare")], check=True)
    with pytest.raises(ValueError):
        gitlog.discover(str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        gitlog.discover("/")


def test_walk(tmp_path):
    for name in ("b/c.txt", "a.txt", "b/skip.log", "d/.hidden", "d/keep.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    (tmp_path / "link").symlink_to(tmp_path / "b")
    (tmp_path / "loop").symlink_to(tmp_path)
    os.mkfifo(tmp_path / "pipe")
    assert ["/".join(p) for p in walk(str(tmp_path))] == ["", "a.txt", "b", "b/c.txt", "d", "d/keep.log", "link"]
    assert "link/c.txt" in ["/".join(p) for p in walk(str(tmp_path), follow_symlinks=True)]


@pytest.mark.parametrize("pattern,path,directory,wanted", [("*.o", "a/b.o", False, True), ("/x", "a/x", False, False), ("x/", "x", False, False), ("x/", "a/x", True, True), ("a/**/z", "a/b/c/z", False, True), ("a/**/z", "a/z", False, True), ("d/**", "d/e", False, True), ("[!a].c", "b.c", False, True), ("[!a].c", "a.c", False, False), ("# c", "# c", False, False), (r"\#c", "#c", False, True), ("q?", "qq", False, True)])
def test_ignore_rules(pattern, path, directory, wanted):
    assert ignored([(path, rules(pattern))], directory) is wanted


def test_command_line(spark, repo, tmp_path):
    out = tmp_path / "out.json"
    assert cli.main([str(repo.path), "-o", str(out), "--no-detailed-git", "--parquet", str(tmp_path / "flat")]) == 0
    found = json.loads(out.read_text())
    assert found["features"] == {"git": True, "coupling": False, "git_details": False, "file_stats": True}
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 6
    assert cli.main(["--no-git", "--coupling"]) == 2 and cli.main(["--no-git", "--no-detailed-git"]) == 2


@pytest.fixture(scope="module")
def six_commits(tmp_path_factory):
    """A file that is changed on two branches, merged and renamed, beside one that is changed on one of them."""
    r = Repo(tmp_path_factory.mktemp("six"))
    r.times = iter([1558521386, 1558521648, 1558521550, 1558521695, 1558524371, 1558533240])

    def git(*args):
        date = f"{r.clock} +0100"
        env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_CONFIG_GLOBAL": "/dev/null"}
        who = ["-c", "user.name=Ann Ex", "-c", "user.email=ann@x.org", "-c", "commit.gpgsign=false"]
        return subprocess.run(["git", *who, "-C", str(r.path), *args], env=env, check=True, capture_output=True, text=True).stdout.strip()

    def commit(message):
        r.clock = next(r.times)
        git("add", "-A")
        git("commit", "-q", "-m", message)

    a, clj = "s/child/a.txt", "s/parent.clj"
    r.write(a, "p\nq\n")
    r.write(clj, "(a)\n(b)\n(c)\n(d)\n")
    commit("begin")
    git("branch", "side")
    r.write(a, "other\n")
    commit("less")
    git("checkout", "-q", "side")
    r.write(a, "P\nq\n")
    r.write(clj, "(a)\n(b)\n(c)\n(e)\n(f)\n(g)\n")
    commit("more\nof it\n\nWhy.\n\nCo-authored-by: Bo <bo@y.org>")
    git("checkout", "-q", "main")
    r.clock = next(r.times)
    subprocess.run(["git", "-C", str(r.path), "-c", "user.name=x", "-c", "user.email=x", "merge", "-q", "--no-ff", "--no-commit", "side"], capture_output=True)
    r.write(a, "P\nq\nnew\n")
    git("add", "-A")
    git("commit", "-q", "-m", "both")
    r.write(clj, "(a)\n(b)\n(c)\n(e)\n(f)\n(g)\n(h)\n")
    commit("one line")
    git("mv", a, "s/child/b.txt")
    commit("another name")
    r.head = git("rev-parse", "HEAD")
    return r


@pytest.mark.parametrize("shown", [True, False])
def test_whole_document_of_six_commits(spark, six_commits, shown):
    config = ScanConfig(str(six_commits.path), name="test", id="7", git_details=shown, file_stats=False, calculators=("git",))
    found = json.loads(json.dumps(scan_document(spark, config, now=1558533240)))

    def node(updated, *days):
        rows = [dict(zip(("commit_day", "users", "commits", "lines_added", "lines_deleted"), (1558483200, *d))) for d in days]
        data = dict(age_in_days=0, creation_date=1558521386, last_update=updated, user_count=2, users=[0, 1], activity=[], details=rows if shown else [])
        return {"git": data}

    child = {"name": "child", "children": [{"name": "b.txt", "data": node(1558533240, ([0], 5, 7, 3), ([0, 1], 1, 1, 1))}]}
    clj = {"name": "parent.clj", "data": node(1558524371, ([0], 3, 8, 1), ([0, 1], 1, 3, 1))}
    root = {"name": "<root>", "data": {"git": {"remote_url": None, "head": six_commits.head}}, "children": [{"name": "s", "children": [child, clj]}]}
    people = [{"id": i, "user": {"name": n, "email": e}} for i, (n, e) in enumerate([("Ann Ex", "ann@x.org"), ("Bo", "bo@y.org")])]
    features = dict(git=True, coupling=False, git_details=shown, file_stats=False)
    assert found == {"version": "1.0.4", "name": "test", "id": "7", "tree": root, "metadata": {"git": {"users": people}}, "features": features}


def test_log_of_six_commits(spark, six_commits):
    register_sources(spark)
    rows = commits.summarised(spark.read.format("git_log").load(str(six_commits.path))).orderBy("ord").collect()
    found = sorted((r.commit_time - 1558521386, r.summary, len(r.file_changes)) for r in rows)
    assert found == [(0, "begin", 2), (164, "more of it", 2), (262, "less", 1), (309, "both", 3), (2985, "one line", 1), (11854, "another name", 1)]
    assert [tuple(c)[2:] for c in rows[2].file_changes] == [("Modify", 3, 1), ("Modify", 3, 1), ("Modify", 1, 0)]


def test_whole_document_of_lines(spark, tmp_path):
    (tmp_path / "child").mkdir()
    (tmp_path / "child" / "a.txt").write_text("some text\nand more.")
    (tmp_path / "b.clj").write_text("(ns b)\n\n(def x\n  1)")
    found = scan_document(spark, ScanConfig(str(tmp_path), name="t", id="7", git=False, git_details=False, file_stats=False, calculators=("loc",)))

    def loc(language, blanks, code, comments, size):
        return {"loc": dict(language=language, binary=False, blanks=blanks, code=code, comments=comments, lines=blanks + code + comments, bytes=size)}

    tree = {"name": "<root>", "children": [{"name": "b.clj", "data": loc("Clojure", 1, 3, 0, 19)}, {"name": "child", "children": [{"name": "a.txt", "data": loc("Plain Text", 0, 0, 2, 19)}]}]}
    assert found["tree"] == tree and found["metadata"] == {} and not any(found["features"].values())


def test_coupling_metadata(spark, repo):
    config = CouplingConfig(1, 1, 0.1, 10, 600, 0)
    found = scan_document(spark, ScanConfig(str(repo.path), name="t", coupling=config), now=START + 86_400)["metadata"]["coupling"]
    assert set(found) == {"buckets", "config"}
    assert found["config"] == dict(bucket_days=1, min_bursts=1, min_coupling_ratio=0.1, min_activity_gap=10, coupling_time_distance=600, min_distance=0, max_common_roots=None)


def test_a_broken_history_is_an_error(tmp_path):
    r = Repo(tmp_path / "r")
    with pytest.raises(ValueError, match="does not have any commits"):
        list(gitlog.commits(str(r.path)))
    r.write("a.txt", "1\n")
    first = r.commit("one")
    r.write("a.txt", "2\n")
    r.commit("two")
    assert len(list(gitlog.commits(str(r.path)))) == 2
    (r.path / ".git" / "objects" / first[:2] / first[2:]).unlink()
    with pytest.raises(ValueError, match="ended with code"):
        list(gitlog.commits(str(r.path)))


def test_option_names():
    a = cli.parser().parse_args(["-n", "x", "-c", "--coupling-bucket-days", "5", "--coupling-min-bursts", "2", "--coupling-min-ratio", "0.5", "--coupling-min-activity-gap-minutes", "7", "--coupling-time-overlap-minutes", "8", "--coupling-min-distance", "1", "--coupling-max-common-roots", "4"])
    assert cli.config(a).coupling == CouplingConfig.from_minutes(7, 8, bucket_days=5, min_bursts=2, min_ratio=0.5, min_distance=1, max_common_roots=4)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from loamline.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
