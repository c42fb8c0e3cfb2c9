"""Conversations put together from message rows.

Rows are partitioned by ranges of (channel, root, time) and sorted where they
are, so a conversation's rows stand in the order of their time, and one with a
third of all rows is spread over as many ranges as it needs.  A finite-state
automaton (`step`) reads each range once, row by row, in constant memory: it
validates the root and who wrote it, empty turns and missing replies, counts
positions, and leaves one state for every conversation and range.  The states of
a conversation are composed (`composed`), which gives its verdict and where the
positions of every range begin.

Defined cases: rows with null (or unreadable) ts or null channel_id are
ignored; of rows with one channel and ts the one with the latest scraped_at
holds (a null scraped_at is the earliest; ties: the larger reply_count, then
the larger remaining fields, nulls last); null reply_count counts as 0; a
message of an unknown user is by a participant.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

# Subtypes of rows that the system wrote.
SYSTEM_SUBTYPES = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "bot_message", "file_comment", "tombstone")

# The automaton reads a conversation's rows in time order.  A letter says whether a row is the root and whether a person or
# a bot user said something (a turn), nobody said anything (silent), or the system wrote it.  A state is what the root was
# and how many turns there were, counted up to two; a counter beside it holds the replies.
LETTERS = ("root", "silent root", "system root", "reply", "silent reply", "system reply")
ROOTS = ("absent", "open", "barred")
STATES = tuple(product(ROOTS, range(3)))
VERDICTS = ("kept", "root missing", "root by the system", "replies missing", "empty")


def step(state: tuple[str, int], letter: str) -> tuple[str, int]:
    """One transition."""
    root, turns = state
    if letter.endswith("root"):
        root = max(root, "barred" if letter == "system root" else "open", key=ROOTS.index)
    return root, min(2, turns + (letter in ("root", "reply")))


def composed(first: tuple[str, int], second: tuple[str, int]) -> tuple[str, int]:
    """The state after reading what led to `first` and then what led to `second`, both from the start: what a root was
    never gets better, and turns add up, so reading in ranges gives what reading in one go gives."""
    return max(first[0], second[0], key=ROOTS.index), min(2, first[1] + second[1])


#: The transition table: state and letter numbers to the next state's number.
TABLE = [[STATES.index(step(s, x)) for x in LETTERS] for s in STATES]
START = STATES.index(("absent", 0))


class Run(NamedTuple):
    """What the automaton knows after reading the rows of one conversation in one range."""

    state: int = START
    replies: int = 0
    kept: int = 0
    declared: int = 0


def read(run: Run, letter: int, declared: int) -> Run:
    """One row: the transition, and the counters beside it."""
    return Run(TABLE[run.state][letter], run.replies + (letter >= 3), run.kept + (letter in (0, 3)), max(run.declared, declared if letter < 3 else 0))


def verdict(state: tuple[str, int], replies: int, declared: int) -> str:
    """What the automaton says of a conversation that ends in `state`."""
    if state[0] == "absent":
        return "root missing"
    if state[0] == "barred":
        return "root by the system"
    if declared > replies:
        return "replies missing"
    return "kept" if state[1] == 2 else "empty"


def _number(c: str) -> Column:
    return F.expr(f"try_cast(trim({c}) AS decimal(24, 6))")


def latest(messages: DataFrame) -> DataFrame:
    """One row per channel and ts (as a number): the one scraped last."""
    rest = ("scraped_at", "reply_count", "text", "thread", "subtype", "user_id")
    rows = messages.select("channel_id", _number("ts").alias("at"), "scraped_at", "reply_count", "text", _number("thread_ts").alias("thread"), "subtype", "user_id").where(F.col("at").isNotNull() & F.col("channel_id").isNotNull())
    return rows.groupBy("channel_id", "at").agg(F.max(F.struct(*rest)).alias("r")).select("channel_id", "at", *(F.col(f"r.{c}").alias(c) for c in rest[1:]))


def keyed(messages: DataFrame) -> DataFrame:
    """(channel_id, root, at, letter, declared, user_id, text) of messages of threads; letter is a number in `LETTERS`."""
    root = F.coalesce("thread", F.when(F.coalesce("reply_count", F.lit(0)) > 0, F.col("at")))
    system = F.coalesce(F.col("subtype").isin(*SYSTEM_SUBTYPES), F.lit(False))
    silent = F.col("text").isNull() | ~F.col("text").rlike(r"(?U)[^\s\x{1c}-\x{1f}]")
    letter = F.when(system, 2).when(silent, 1).otherwise(0) + F.when(F.col("at") == F.col("root"), 0).otherwise(3)
    return latest(messages).withColumn("root", root).where(F.col("root").isNotNull()).select("channel_id", "root", "at", letter.alias("letter"), F.coalesce("reply_count", F.lit(0)).alias("declared"), "user_id", "text")


_READ = "state int, replies bigint, kept bigint, declared bigint, part int, own bigint"


def automaton(rows: DataFrame) -> DataFrame:
    """`rows` of `keyed` in sorted ranges, read by the automaton: those that stay in a conversation with `own`, their
    position among the rows of it in the range `part`, and after each conversation a row without time that has its `Run`."""
    ordered = rows.repartitionByRange("channel_id", "root", "at").sortWithinPartitions("channel_id", "root", "at")
    extra = [f.name for f in ordered.schema.fields if f.name not in ("channel_id", "root", "at", "letter", "declared")]

    def run(batches):
        from pyspark import TaskContext

        part, key, now = TaskContext.get().partitionId(), None, Run()

        def batch(columns, own):
            n = len(own)
            blank = pa.nulls(n, pa.int64())
            return [*columns, pa.nulls(n, pa.int32()), blank, blank, blank, pa.array(np.full(n, part, np.int32)), pa.array(own, pa.int64())]

        def ends(done):
            """Rows of the conversations that ended here."""
            if not done:
                return None
            n, (keys, runs) = len(done), zip(*done)
            states, replies, kept, declared = zip(*runs)
            columns = [pa.array([k[0] for k in keys], types[0]), pa.array([k[1] for k in keys], types[1]), pa.nulls(n, types[2]), *(pa.nulls(n, t) for t in types[3:])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.int32()), pa.array(replies, pa.int64()), pa.array(kept, pa.int64()), pa.array(declared, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int64())], names)

        names, types = ["channel_id", "root", "at", *extra, *(c.split()[0] for c in _READ.split(", "))], []
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            types = [cols[c].type for c in names[:3 + len(extra)]]
            done, stay, own = [], [], []
            for i, (k, x, d) in enumerate(zip(zip(cols["channel_id"].to_pylist(), cols["root"].to_pylist()), cols["letter"].to_pylist(), cols["declared"].to_pylist())):
                if k != key:
                    if key is not None:
                        done.append((key, now))
                    key, now = k, Run()
                now = read(now, x, d)
                if x in (0, 3):
                    stay.append(i), own.append(now.kept)
            take = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays(batch([cols[c].take(take) for c in names[:3 + len(extra)]], own), names)
            if (out := ends(done)) is not None:
                yield out
        if key is not None:
            yield ends([(key, now)])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("channel_id", "root", "at", *extra)) + ", " + _READ
    return ordered.mapInArrow(run, schema)


def verdicts(read_rows: DataFrame) -> DataFrame:
    """(channel_id, root, verdict): the states of each conversation composed over its ranges.

    `composed` in columns: a state number is its root's place times three and its turns."""
    runs = read_rows.where("state is not null")
    n = runs.groupBy("channel_id", "root").agg(F.max(F.floor(F.col("state") / 3)).alias("r"), F.sum(F.col("state") % 3).alias("turns"), F.sum("replies").alias("replies"), F.max("declared").alias("declared"))
    said = F.when(F.col("r") == ROOTS.index("absent"), "root missing").when(F.col("r") == ROOTS.index("barred"), "root by the system").when(F.col("declared") > F.col("replies"), "replies missing").when(F.col("turns") < 2, "empty").otherwise("kept")
    return n.select("channel_id", "root", said.alias("verdict"))


def conversations(messages: DataFrame, users: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """(channel_id, root_ts, pos, ts, user_id, role, text) of every kept conversation, pos counted from 1 in time order.

    role is 'starter' (author of the root), 'bot' (users.is_bot) or 'participant'; 'bot' goes before 'starter'.
    Without `users` nobody is a bot; without `texts` user_id, role and text are left out and never shuffled by conversation."""
    key = ("channel_id", "root")
    rows = keyed(messages)
    done = materialize(automaton(rows if texts else rows.drop("user_id", "text")))
    kept = verdicts(done).where(F.col("verdict") == "kept").select(*key)
    # A conversation has one run in each of the ranges it lies in.
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = done.where("state is not null").join(kept, list(key)).select(*key, "part", F.coalesce(F.sum("kept").over(before), F.lit(0)).alias("before"))
    out = done.where("own is not null").join(runs, [*key, "part"]).withColumn("pos", F.col("before") + F.col("own"))
    names = [F.col("channel_id"), F.col("root").cast("string").alias("root_ts"), "pos", F.col("at").cast("string").alias("ts")]
    if not texts:
        return out.select(*names)
    roots = rows.where(F.col("at") == F.col("root")).select(*key, F.col("user_id").alias("starter"))
    out = out.join(roots, list(key))
    bot = F.lit(False)
    if users is not None:
        bots = users.where(F.col("is_bot")).select(F.col("id").alias("user_id"), F.lit(True).alias("bot")).distinct()
        out, bot = out.join(bots, "user_id", "left"), F.coalesce("bot", F.lit(False))
    role = F.when(bot, "bot").when(F.col("user_id") == F.col("starter"), "starter").otherwise("participant")
    return out.select(*names, "user_id", role.alias("role"), "text")
