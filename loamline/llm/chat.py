"""Preference formatting of chosen and rejected conversations, in DataFrame functions alone.

Turns of both sides are compared by hashes of role and text. The first turn in
which they differ ends the longest common prefix; turns before it are rendered once
as the prompt, turns from it on as the chosen and the rejected completion. Text to
learn from is marked: the assistant's turns of a completion, and nothing else.

Only hashes meet to find the prefix; texts are shuffled once, by pair and part. A part
is PART_TURNS turn numbers, so what :func:`assemble` collects to one row is bounded,
whatever the length of a conversation, and a hot pair's parts lie in many tasks.

Defined cases: rows without a pair or turn number are left out; a null role or
text counts as empty; several rows of one turn are one turn, the one with the
smallest (role, text); turns are compared at equal numbers, so a turn that one
side lacks is a difference; equal conversations are all prompt, with empty
completions; a pair that one side lacks has an empty prompt; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.session import materialize

OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"
#: Turn numbers that are assembled to one row at most.
PART_TURNS = 1024
#: Repeated turns (16 bytes each) are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def turns(rows: DataFrame) -> DataFrame:
    """One (pair_id, turn, role, text) per pair and turn; only turns of several rows are aggregated."""
    kept = rows.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).select(
        "pair_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    keys = ["pair_id", "turn"]
    repeated = materialize(kept.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "repeated")
    n = repeated.count()
    if not n:
        return kept
    if n <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    again = kept.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("role", "text")).alias("said")).select(*keys, "said.role", "said.text")
    return kept.join(repeated, keys, "left_anti").unionByName(again)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BETWEEN), text, F.lit(CLOSE))


def part(turn: Column) -> Column:
    return F.floor(turn / F.lit(PART_TURNS)).cast("long")


def hashed(rows: DataFrame) -> DataFrame:
    """pair_id, turn and two hashes of what is said."""
    return rows.select("pair_id", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role").alias("h2"))


def differences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id and first: the first turn in which the :func:`hashed` sides differ; pairs without a difference have no row."""
    sides = chosen.withColumn("side", F.lit(1)).unionByName(rejected.withColumn("side", F.lit(2)))
    met = sides.groupBy("pair_id", "turn", "h1", "h2").agg(F.bit_or("side").alias("sides"))
    return met.filter("sides < 3").groupBy("pair_id").agg(F.min("turn").alias("first"))


def segments(rows: DataFrame, first: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """pair_id, part, section (prompt, chosen, rejected), turn, rendered, learn.

    ``rows``: pair_id, turn, role, text and good: whether a turn is of the chosen
    side. Turns of the rejected side before the difference may be left out.
    """
    placed = rows.withColumn("part", part(F.col("turn")))
    info = placed.select("pair_id", "part").distinct().join(first, "pair_id", "left")
    met = placed.join(info, ["pair_id", "part"])
    in_prompt = F.coalesce(F.col("turn") < F.col("first"), F.lit(True))
    section = F.when(F.col("good"), F.when(in_prompt, "prompt").otherwise("chosen")).when(~in_prompt, "rejected")
    named = met.withColumn("section", section).filter("section is not null")
    learn = (F.col("section") != "prompt") & (F.col("role") == learned_role)
    return named.select("pair_id", "part", "section", "turn", rendered(F.col("role"), F.col("text")).alias("rendered"), learn.alias("learn"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, learned_role: str = LEARNED_ROLE, distinct: bool = False) -> DataFrame:
    """:func:`segments` of two sides.

    Both inputs: pair_id, turn, role, text; ``distinct`` says that they come from
    :func:`turns`, which needn't be repeated then.
    """
    chosen, rejected = (chosen, rejected) if distinct else (turns(chosen), turns(rejected))
    rows = chosen.withColumn("good", F.lit(True)).unionByName(rejected.withColumn("good", F.lit(False)))
    return segments(rows, differences(hashed(chosen), hashed(rejected)), learned_role)


def assemble(found: DataFrame) -> DataFrame:
    """pair_id, part, prompt, and for either completion its text and mask: ranges of characters, with whether to learn them.

    A conversation whose turn numbers lie below PART_TURNS is one row; the texts of
    a longer one are those of its parts, in order, and ranges count from the part's begin.
    """
    ordered = found.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "section", "rendered", "learn"))).alias("s"))

    def of(section: str) -> Column:
        return F.filter("s", lambda x: x["section"] == section)

    def joined(section: str) -> Column:
        return F.array_join(F.transform(of(section), lambda x: x["rendered"]), "")

    def mask(section: str) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,learn:boolean>>").alias("ranges"))

        def step(state: Column, x: Column) -> Column:
            end = state["at"] + F.char_length(x["rendered"])
            piece = F.struct(state["at"].alias("start"), end.alias("end"), x["learn"].alias("learn"))
            return F.struct(end.alias("at"), F.concat(state["ranges"], F.array(piece)).alias("ranges"))

        return F.aggregate(of(section), empty, step, lambda state: state["ranges"])

    return ordered.select(
        "pair_id", "part", joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), joined("rejected").alias("rejected"), mask("rejected").alias("rejected_mask")
    )


def answers(chosen: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """pair_id, last, other: a conversation's last assistant turn, and the answer that its partner has there (null without one)."""
    answer = F.max(F.struct("turn", "text"))
    last = chosen.filter(F.col("role") == learned_role).groupBy("pair_id").agg(answer.alias("a")).select("pair_id", F.col("a.turn").alias("last"), F.col("a.text").alias("answer"))
    last = materialize(last, "last")
    partner = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer").alias("other"))
    return materialize(last.select("pair_id", "last").join(partner, "pair_id", "left"), "answers")


def _before(rows: DataFrame, swap: DataFrame) -> DataFrame:
    met = rows.join(swap.select("pair_id", "last"), "pair_id", "left").filter(F.col("last").isNull() | (F.col("turn") < F.col("last")))
    return met.select(*rows.columns)


def _other(swap: DataFrame, learned_role: str) -> DataFrame:
    return swap.filter("other is not null").select("pair_id", F.col("last").alias("turn"), F.lit(learned_role).alias("role"), F.col("other").alias("text"))


def pairs_from_conversations(conversations: DataFrame, learned_role: str = LEARNED_ROLE) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from a table of single conversations (conv_id, turn, role, text).

    The chosen side is the conversation. The rejected side ends with its last
    assistant turn, where it has the last answer of the conversation's partner,
    whose id differs in the lowest bit; without a partner's answer it ends before
    that turn. A conversation without assistant turns is rejected as it is.
    """
    chosen = turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    swap = answers(chosen, learned_role)
    return chosen, _before(chosen, swap).unionByName(_other(swap, learned_role))


def preferences_of_conversations(conversations: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """:func:`assemble` of the pairs of :func:`pairs_from_conversations`; the common turns of both sides are moved once, as those of the chosen one."""
    chosen = turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    swap = answers(chosen, learned_role)
    other = _other(swap, learned_role)
    first = differences(hashed(chosen), _before(hashed(chosen), swap).unionByName(hashed(other)))
    rows = chosen.withColumn("good", F.lit(True)).unionByName(other.withColumn("good", F.lit(False)))
    return assemble(segments(rows, first, learned_role))


def learned(mask: Column) -> Column:
    """[start, end] of the ranges of a mask that are to be learned."""
    return F.transform(F.filter(mask, lambda m: m["learn"]), lambda m: F.array(m["start"], m["end"]))
