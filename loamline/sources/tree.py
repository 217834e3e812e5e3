"""Source trees as a table: ``spark.read.format("source_tree").load(root)``.

One row per file and directory with its place in the walk (pre-order, siblings
by name). The driver lists names alone; contents and times are read by the
executors, a bounded number of paths to a partition.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamline.sources.ignore import FILES, Rule, ignored, rules

SCHEMA = "path array<string>, name string, is_file boolean, length long, content binary, created long, modified long, walk_ord long, git_dir boolean"
PER_PARTITION = 256


def walk(root: str, follow_symlinks: bool = False, hidden: bool = False) -> Iterator[tuple[str, ...]]:
    """Component paths of the root (empty) and all that lies below and isn't ignored."""

    def below(directory: Path, parts: tuple[str, ...], known: list[tuple[int, list[Rule]]], seen: frozenset) -> Iterator[tuple[str, ...]]:
        yield parts
        if directory.is_symlink() and parts and not follow_symlinks:
            return
        here = [r for f in FILES if (directory / f).is_file() for r in rules((directory / f).read_text(errors="replace"))]
        if here:
            known = [*known, (len(parts), here)]
        for name in sorted(os.listdir(directory)):
            entry, path = directory / name, (*parts, name)
            if name.startswith(".") and not hidden:
                continue
            is_directory = entry.is_dir()
            if ignored([("/".join(path[n:]), found) for n, found in known], is_directory):
                continue
            if is_directory:
                real = os.path.realpath(entry)
                if real not in seen:
                    yield from below(entry, path, known, seen | {real})
            elif entry.is_file():
                yield path
            # Sockets, pipes and broken links are no part of a tree.

    yield from below(Path(root), (), [], frozenset({os.path.realpath(root)}))


class _Slice(InputPartition):
    def __init__(self, paths: list[tuple[int, tuple[str, ...]]]) -> None:
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.follow = str(options.get("follow_symlinks", "false")).lower() == "true"
        self.hidden = str(options.get("hidden", "false")).lower() == "true"
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no directory")

    def partitions(self) -> list[InputPartition]:
        paths = list(enumerate(walk(self.root, self.follow, self.hidden)))
        return [_Slice(paths[i : i + PER_PARTITION]) for i in range(0, len(paths), PER_PARTITION)] or [_Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for order, parts in partition.paths:
            place = os.path.join(self.root, *parts)
            info = os.stat(place)
            is_file = stat.S_ISREG(info.st_mode)
            content = None
            if is_file:
                with open(place, "rb") as f:
                    content = f.read()
            modified = int(info.st_mtime)
            created = int(getattr(info, "st_birthtime", modified))
            yield list(parts), parts[-1] if parts else "", is_file, len(content or b""), content, created, modified, order, not is_file and os.path.isdir(os.path.join(place, ".git"))


class SourceTree(DataSource):
    """Options: path, follow_symlinks (false), hidden (false)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)
