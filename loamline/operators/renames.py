"""Final names of files through later renames and deletions.

A commit's first child is the first of its children in visiting order; these
edges form a forest. The next thing that happens to a name is the nearest event
on the way from its commit to the root of that forest. Pre-order numbers turn
"on the way" into an interval; intervals of one name lie in or beside each
other, so sorting their ends finds the nearest one, without pairs of names and
events. Every event then knows the one that follows it, and chains of them are
halved in every round: there are as many rounds as the longest chain's length
has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.session import discard, materialize, ship

#: Rows of an Arrow batch of numbers.
ROWS = 10_000


def events(changes: DataFrame) -> DataFrame:
    """repo, id, name, new_name (null: deleted) of renames and deletions; of several events of a name in a commit the last one holds."""
    renamed = changes.filter(F.col("change").isin("Rename", "Delete"))
    name = F.when(F.col("change") == "Rename", F.col("old_file")).otherwise(F.col("file"))
    target = F.when(F.col("change") == "Rename", F.col("file"))
    rows = renamed.select("repo", "id", name.alias("name"), F.struct(target.alias("new_name")).alias("e"), "change_ord")
    return rows.groupBy("repo", "id", "name").agg(F.max_by("e", "change_ord").alias("e")).select("repo", "id", "name", "e.new_name")


def first_children(log: DataFrame) -> DataFrame:
    """repo, id, child: the child that is visited first."""
    edges = log.select("repo", "ord", F.col("id").alias("child"), F.explode("parents").alias("id"))
    return edges.groupBy("repo", "id").agg(F.min_by("child", "ord").alias("child"))


def _number(edges: list[tuple[str, str | None]]) -> Iterator[tuple[str, int, int, int | None]]:
    """Commits with their pre-order numbers and the child's; a commit hangs on its first child."""
    child_of = dict(edges)
    below: dict[str, list[str]] = {}
    for commit, child in edges:
        below.setdefault(child if child is not None else "", []).append(commit)
    stack = [(c, 0) for parent, kids in below.items() if parent not in child_of for c in sorted(kids, reverse=True)]
    ends: list[int] = []
    place: dict[str, int] = {}
    open_: list[int] = []
    while stack:
        commit, depth = stack.pop()
        for done in open_[depth:]:
            ends[done] = len(ends)
        del open_[depth:]
        place[commit] = len(ends)
        open_.append(len(ends))
        ends.append(0)
        stack += [(c, depth + 1) for c in sorted(below.get(commit, ()), reverse=True)]
    for done in open_:
        ends[done] = len(ends)
    return ((commit, tin, ends[tin], place.get(child_of[commit])) for commit, tin in place.items())


def _number_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of one repository after another; rows come sorted by repo, and only one repository's are held."""
    edges = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    numbers = ((repo, *row) for repo, own in groupby(edges, key=itemgetter(0)) for row in _number([(commit, child) for _, commit, child in own]))
    schema = pa.schema([("repo", pa.string()), ("id", pa.string()), ("tin", pa.int64()), ("tout", pa.int64()), ("child_tin", pa.int64())])
    while rows := list(islice(numbers, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def numbered(log: DataFrame) -> DataFrame:
    """repo, id, tin, tout, child_tin: commit c hangs below e exactly if tin(e) <= tin(c) < tout(e); child_tin is the first child's tin. A repository's ids meet in one task."""
    ship(log.sparkSession)
    edges = log.select("repo", "id").join(first_children(log), ["repo", "id"], "left").select("repo", "id", "child")
    sorted_ = edges.repartition("repo").sortWithinPartitions("repo")
    return sorted_.mapInArrow(_number_all, "repo string, id string, tin long, tout long, child_tin long")


def next_events(points: DataFrame, happened: DataFrame) -> DataFrame:
    """``points`` (repo, name, at, ...) with the event that comes next for the name, null if none does.

    ``happened``: event, repo, name, tin, tout. The level of a place is the number
    of the name's intervals around it; the innermost of them is the last one
    before it that begins on that level.
    """
    begin = happened.select("repo", "name", F.col("tin").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step"), F.col("event").alias("next"))
    end = happened.select("repo", "name", F.col("tout").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    asked = points.withColumns({"kind": F.lit(2), "step": F.lit(0)})
    rows = asked.unionByName(begin, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    before = Window.partitionBy("repo", "name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    levels = rows.withColumn("level", F.sum("step").over(before)).filter("kind > 0")
    level = Window.partitionBy("repo", "name", "level").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn("next", F.last("next", ignorenulls=True).over(level)).filter("kind = 2").select(*points.columns, "next")


def last_events(links: DataFrame) -> DataFrame:
    """event, to, ended (true) of ``links``: the last event of the chain that begins with each."""
    while not links.filter(~F.col("ended")).isEmpty():
        beyond = links.select(F.col("event").alias("to"), F.col("to").alias("beyond"), F.col("ended").alias("beyond_ended"))
        further = links.filter(~F.col("ended")).select("event", "to").join(beyond, "to").select("event", F.col("beyond").alias("to"), F.col("beyond_ended").alias("ended"))
        halved = materialize(links.filter("ended").unionByName(further), "chains")
        discard(links)
        links = halved
    return links


def final_names(names: DataFrame, log: DataFrame, changes: DataFrame) -> DataFrame:
    """repo, id, file, final of every (repo, id, file) whose file isn't deleted later."""
    places = materialize(numbered(log), "places")
    # A name that is null has no events.
    found = events(changes).filter(F.col("name").isNotNull()).join(places, ["repo", "id"])
    # Numbers of events stay as they are written.
    happened = materialize(found.select(F.monotonically_increasing_id().alias("event"), "repo", "name", "new_name", "tin", "tout", "child_tin"), "events")
    start = names.select("repo", "id", "file").distinct().join(places, ["repo", "id"]).select("repo", "id", F.col("file").alias("name"), F.col("tin").alias("at"))
    # A rename in the last commit of all has no child to go on from.
    on = happened.filter(F.col("new_name").isNotNull() & F.col("child_tin").isNotNull()).select("repo", F.col("new_name").alias("name"), F.col("child_tin").alias("at"), "event")
    met = materialize(next_events(start.unionByName(on, allowMissingColumns=True), happened), "names")
    discard(places)
    followed = happened.select("event").join(met.filter(F.col("event").isNotNull()).select("event", "next"), "event", "left")
    last = last_events(materialize(followed.select("event", F.coalesce("next", "event").alias("to"), F.col("next").isNull().alias("ended")), "chains"))
    asked = met.filter(F.col("event").isNull()).select("repo", "id", F.col("name").alias("file"), "next")
    settled = asked.filter(F.col("next").isNull()).select("repo", "id", "file", F.col("file").alias("final"))
    targets = last.join(happened.filter(F.col("new_name").isNotNull()).select(F.col("event").alias("to"), F.col("new_name").alias("final")), "to").select(F.col("event").alias("next"), "final")
    return settled.unionByName(asked.filter(F.col("next").isNotNull()).join(targets, "next").select("repo", "id", "file", "final"))
