"""The nested JSON document of a scan, written from flat rows in walk order."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, Row

VERSION = "1.0.4"
ROOT = "<root>"


def plain(value):
    """Rows as dictionaries, with their nulls."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def node_data(row: Row, indicators: Iterable[str]) -> dict:
    """A node's indicators; absent ones are left out, nulls inside them stay."""
    data = {name: plain(row[name]) for name in indicators if row[name] is not None}
    if "coupling" in data:
        for bucket in data["coupling"]["buckets"]:
            bucket["coupled_files"] = [["/".join(c["file"]), c["count"]] for c in bucket["coupled_files"]]
    return data


def tree(rows: Iterable[Row], indicators: list[str]) -> dict:
    """Nodes nested by their paths; a parent comes before its children."""
    root: dict | None = None
    at: list[dict] = []
    for row in rows:
        node: dict = {"name": row.name if row.path else ROOT}
        if data := node_data(row, indicators):
            node["data"] = data
        if not row.is_file:
            node["children"] = []
        del at[len(row.path) :]
        if len(at) != len(row.path):
            raise ValueError(f"{'/'.join(row.path)} comes before its parent")
        if at:
            at[-1]["children"].append(node)
        else:
            root = node
        at.append(node)
    return root or {"name": ROOT, "children": []}


def document(nodes: DataFrame, indicators: list[str], name: str, id: str | None, metadata: dict, features: dict) -> dict:
    """The whole document. ``nodes``: path, name, is_file, walk_ord and the indicator columns; one partition of rows is held at a time."""
    rows = nodes.select("path", "name", "is_file", *indicators, "walk_ord").orderBy("walk_ord").toLocalIterator()
    return {"version": VERSION, "name": name, "id": id or str(uuid.uuid4()), "tree": tree(rows, indicators), "metadata": {k: v for k, v in metadata.items() if v is not None}, "features": features}


def user_list(users: DataFrame) -> list[dict]:
    """People by number."""
    return [{"id": r.user_id, "user": plain(r.user)} for r in users.orderBy("user_id").toLocalIterator()]


def write(found: dict, out: TextIO) -> None:
    json.dump(found, out, indent=2, ensure_ascii=False)
    out.write("\n")


def write_flat(nodes: DataFrame, path: str) -> None:
    """The same nodes as Parquet, for trees that no single document should hold."""
    nodes.write.mode("overwrite").parquet(path)
