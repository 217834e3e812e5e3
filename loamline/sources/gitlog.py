"""Commit logs as a table: ``spark.read.format("git_log").load(repository)``.

One row per commit that HEAD reaches, in topological order, with the files that
differ from each parent. One repository is one partition, streamed from git.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHANGE = "struct<file:string,old_file:string,change:string,lines_added:bigint,lines_deleted:bigint>"
PERSON = "struct<name:string,email:string>"
SCHEMA = (
    "repo string, ord long, id string, message string, parents array<string>, "
    f"committer {PERSON}, commit_time long, author {PERSON}, author_time long, file_changes array<{CHANGE}>"
)
_KINDS = {"A": "Add", "R": "Rename", "D": "Delete", "M": "Modify", "C": "Copied"}
_FORMAT = "%x01%H%x02%P%x02%cn%x02%ce%x02%ct%x02%an%x02%ae%x02%at%x02%B%x03"


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed in {repo}")
    return done.stdout.decode(errors="replace").strip()


def discover(path: str) -> str:
    """The working directory of the nearest repository around a path; bare ones are an error."""
    if git(path, "rev-parse", "--is-bare-repository") == "true":
        raise ValueError(f"{path} lies in a bare repository")
    return git(path, "rev-parse", "--show-toplevel")


def info(path: str) -> tuple[str | None, str | None]:
    """The address of origin and the commit of HEAD, each null if there is none."""

    def ask(*args: str) -> str | None:
        try:
            return git(path, *args) or None
        except ValueError:
            return None

    return ask("config", "--get", "remote.origin.url"), ask("rev-parse", "--verify", "HEAD")


def file_changes(text: str) -> list[tuple]:
    """Changes of one diff from its raw and numstat fields (separated by zero bytes)."""
    fields = iter(x.lstrip("\n") for x in text.split("\0"))
    kinds: dict[str, tuple[str, str | None]] = {}
    out: list[tuple] = []
    for field in fields:
        if field.startswith(":"):
            letter = field.rsplit(" ", 1)[1][:1]
            first = next(fields)
            if letter in "RC":
                kinds[next(fields)] = (_KINDS[letter], first)
            elif letter == "T":
                # A file that becomes another kind of entry is one that went and one that came.
                kinds[first] = ("T", None)
            elif letter in _KINDS:
                kinds[first] = (_KINDS[letter], None)
        elif field.count("\t") >= 2:
            added, deleted, name = field.split("\t", 2)
            if not name:
                next(fields)
                name = next(fields)
            if name not in kinds:
                continue
            kind, old = kinds[name]
            lines = [int(x) if x != "-" else 0 for x in (added, deleted)]
            if kind == "T":
                out += [(name, None, "Delete", 0, lines[1]), (name, None, "Add", lines[0], 0)]
            else:
                out.append((name, old, kind, *lines))
    return out


def commits(repo: str) -> Iterator[tuple]:
    """Rows of the schema; a merge's diffs against its parents follow one another in one row.

    A walk that git can't begin or can't finish is an error: no part of a history passes for the whole.
    """
    command = ["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", repo, "log", "--topo-order", "-m", "--raw", "--numstat", "-M", "-z", f"--format={_FORMAT}"]
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said) as run:
        held, current, order = b"", None, 0

        def one(block: bytes) -> tuple[list[str], list[tuple]]:
            head, _, diff = block.decode(errors="replace").partition("\x03")
            return head.split("\x02"), file_changes(diff)

        def row(current: list, order: int) -> tuple:
            (sha, parents, cn, ce, ct, an, ae, at, message), changed = current
            return (
                repo, order, sha, message, parents.split(), (cn or None, ce or None), int(ct), (an or None, ae or None), int(at), changed,
            )

        def take(block: bytes) -> Iterator[tuple]:
            nonlocal current, order
            head, changed = one(block)
            if current and current[0][0] == head[0]:
                current[1].extend(changed)
                return
            if current:
                yield row(current, order)
                order += 1
            current = [head, changed]

        while chunk := run.stdout.read(1 << 16):
            *blocks, held = (held + chunk).split(b"\x01")
            for block in blocks:
                if block.strip(b"\0\n"):
                    yield from take(block)
        if held.strip(b"\0\n"):
            yield from take(held)
        if code := run.wait():
            said.seek(0)
            raise ValueError(f"the log of {repo} ended with code {code}: {said.read().decode(errors='replace').strip()}")
        if current:
            yield row(current, order)


class _Repository(InputPartition):
    def __init__(self, repo: str) -> None:
        self.repo = repo


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repos = [discover(p) for p in options["path"].split("\n")]

    def partitions(self) -> list[InputPartition]:
        return [_Repository(r) for r in dict.fromkeys(self.repos)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from commits(partition.repo)


class GitLog(DataSource):
    """Option: path, one repository or several separated by line feeds."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)
