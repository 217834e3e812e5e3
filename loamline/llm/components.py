"""Links inside groups of any size, and connected components of link tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import discard, materialize, ship

#: Given payload columns of one block, a function from (row, other rows) to which of them it is linked with.
Linker = Callable[[pa.RecordBatch], Callable[[int, np.ndarray], np.ndarray]]


def forest(batch: pa.RecordBatch, linker: Linker) -> tuple[list[int], list[int]]:
    """Edges that span the components of one block: a search that compares a row it reached with those not reached yet."""
    linked = linker(batch)
    open_rows, a, b = np.arange(batch.num_rows), [], []
    while len(open_rows):
        reached, open_rows = [int(open_rows[0])], open_rows[1:]
        while reached and len(open_rows):
            row = reached.pop()
            hit = linked(row, open_rows)
            new = open_rows[hit].tolist()
            a += [row] * len(new)
            b += new
            reached += new
            open_rows = open_rows[~hit]
    return a, b


def links_within(rows: DataFrame, capacity: int, linker: Linker) -> DataFrame:
    """(a, b) edges whose components are those of all links between members of a group.

    ``rows``: group_id, member (long), weight, and the payload columns. A group
    heavier than ``capacity`` is cut into chunks by the hash of the member, and no
    task holds more than about two of them. First every chunk meets the first
    one. If a group has more than two, what lies outside its largest component by
    then meets all of its chunks; two members of that component needn't meet
    again. So no link between components is lost, and a huge group whose members
    hang together takes about two passes over it, not one per pair of chunks.
    """
    payload = [c for c in rows.columns if c not in ("group_id", "member", "weight")]
    ship(rows.sparkSession)
    sizes = rows.groupBy("group_id").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.select("group_id", F.ceil(F.col("total") / F.lit(float(capacity))).cast("int").alias("chunks")), "sizes")
    chunk = F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")
    chunked = rows.join(sizes, "group_id").withColumn("chunk", chunk)
    last = F.col("chunks") - 1
    first_meets = F.when(F.col("chunk") > 0, F.array("chunk")).otherwise(F.sequence(F.least(F.lit(1), last), last))
    met = chunked.withColumn("other", F.explode(first_meets)).select("group_id", F.lit(0).alias("low"), F.col("other").alias("high"), "member", *payload)
    found = met.repartition("group_id", "high").sortWithinPartitions("group_id", "high", "member").mapInArrow(_forests(linker), "a long, b long")
    large = sizes.filter("chunks > 2")
    if large.isEmpty():
        return found
    found = materialize(found, "links")
    roots = components(found)
    many = materialize(rows.join(large, "group_id").withColumn("chunk", chunk), "large")
    labelled = many.select("group_id", "member", "weight").join(roots, F.col("member") == F.col("node"), "left").select("group_id", "member", "weight", F.coalesce("root", "member").alias("root"))
    counted = labelled.groupBy("group_id", "root").agg(F.count("*").alias("n"))
    main = counted.groupBy("group_id").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = materialize(labelled.join(main, "group_id").filter("root <> main").select("group_id", "member", "weight"), "rest")
    parts = rest.groupBy("group_id").agg(F.ceil(F.sum("weight") / F.lit(float(capacity))).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("member", F.lit(1)), F.col("parts")).cast("int")
    each_part, each_chunk = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    probes = many.join(rest.select("group_id", "member"), ["group_id", "member"]).join(parts, "group_id").withColumn("low", part).withColumn("high", F.explode(each_chunk))
    bases = many.join(parts, "group_id").withColumn("low", F.explode(each_part)).withColumn("high", F.col("chunk"))
    columns = ["group_id", "low", "high", "member", *payload]
    both = probes.select(columns).unionByName(bases.select(columns))
    again = both.repartition("group_id", "low", "high").sortWithinPartitions("group_id", "low", "high", "member").mapInArrow(_forests(linker), "a long, b long")
    return found.unionByName(again)


def _forests(linker: Linker):
    """Edges of each block of rows in a sorted stream of (group_id, low, high, member, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            if block.num_rows > 1:
                a, b = forest(block, linker)
                if a:
                    member = block.column(3)
                    yield pa.RecordBatch.from_arrays([member.take(pa.array(a)), member.take(pa.array(b))], ["a", "b"])

        at = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            begin = 0
            for i, key in enumerate(keys):
                if key != at:
                    if i > begin:
                        waiting.append(batch.slice(begin, i - begin))
                    if waiting:
                        yield from emit()
                    waiting.clear()
                    begin, at = i, key
            waiting.append(batch.slice(begin))
        if waiting:
            yield from emit()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternates large stars and small stars until the edges no longer change,
    which takes a number of rounds logarithmic in the longest path; each round
    is written to the shared folder. A node's neighbours are never collected:
    each star takes one minimum and one join.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            # Neighbours above the node hang on its smallest neighbour; those below keep their own rows' turn.
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def print_of(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = print_of(current)
    while seen[0]:
        following = materialize(star(star(current, True), False), "edges")
        discard(current)
        current, before = following, seen
        seen = print_of(current)
        if seen == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
