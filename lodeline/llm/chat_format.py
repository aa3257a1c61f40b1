"""Minimum-cost repair of the roles of conversations, and their rendering.

Legal conversations are: an optional system message, then user and assistant
in turn, ending with the assistant. For each turn a repair keeps its role,
gives it another one, merges it into the message before, or puts an empty
message first; each has a cost, and dynamic programming over the states of the
automaton finds the cheapest sequence.

The costs of a stretch of turns form a small table from entry to exit state,
and tables compose. Conversations are cut into stretches of turns; their
tables are composed in a tree, which gives every stretch its entry and exit
state on the cheapest path, and the stretches are then repaired in parallel.
A stretch goes by turn numbers; one that repeated or missing numbers fill with
many rows is cut again, by role and a hash of the text, and equal rows by
number. So no task holds a whole conversation, however long and however numbered.

Each turn's row has the part of the rendered text that it adds; the parts of a
conversation by ``stretch`` and ``position`` are the rendering.

Defined results: turns go by number, nulls first, then role and text (in cut
stretches a hash of the text); repeated turns are turns of their own. Null or unknown roles count as unlabelled and
take any role at a small cost. Null texts are empty. A row without a conv_id is
a conversation of its own. Template marks inside a text get a blank. An empty
table gives an empty result. Among equal costs the first of keep, merge,
insert, relabel wins, then the order of roles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import dropped, shipped, written

# States, legal successions, other names of roles, costs.
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, INSERT, RELABEL, UNLABELLED = 1, 2, 3, 1
STRETCH = 1024  # turn numbers in a stretch
FAN = 1024  # tables that are composed at a time
HOT = 4 * STRETCH  # rows of a stretch from which it is cut
MOST_HOT = 50_000  # stretches up to which their list is broadcast
SPREAD, HASHES = 64, 4096  # tasks over which the rows of one cell are joined; text hashes that cut a stretch
FAR = 10**15

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
OUT = "conv_id long, turn long, role string, new_role string, action string, inserted string, cost int, rendered string, stretch long, position int"


def state_of(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


@lru_cache(None)
def moves(state: int, role: int | None) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(cost, next state, action, empty messages before) for one turn."""
    out = []
    for rank, r in enumerate((SYSTEM, USER, ASSISTANT)):
        own = 0 if r == role else UNLABELLED if role is None else RELABEL
        name = "keep" if r == role else "relabel"
        if r in LEGAL[state]:
            out.append((own, 0 if r == role else 3, rank, r, name, ()))
        if r == state:
            out.append((own + MERGE, 1, rank, r, "merge", ()))
        for x in LEGAL[state]:
            if r in LEGAL[x]:
                out.append((own + INSERT, 2, rank, r, name, (x,)))
    return tuple((cost, r, name, before) for cost, _, _, r, name, before in sorted(out))


#: Cost and empty messages that end a conversation legally.
ENDS = {ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), START: (0, ())}


def cost_table(roles: list[int | None]) -> list[int]:
    """Least costs of a stretch from each entry to each exit state, row by row."""
    rows = []
    for entry in range(4):
        best = [FAR] * 4
        best[entry] = 0
        for role in roles:
            after = [FAR] * 4
            for s in range(4):
                if best[s] < FAR:
                    for cost, r, _, _ in moves(s, role):
                        after[r] = min(after[r], best[s] + cost)
            best = after
        rows += best
    return rows


def composed(tables: list[list[int]]) -> list[int]:
    out = tables[0]
    for t in tables[1:]:
        out = [min(FAR, min(out[4 * a + k] + t[4 * k + b] for k in range(4))) for a in range(4) for b in range(4)]
    return out


def path_through(tables: list[list[int]], entry: int, leave: int | None) -> list[tuple[int, int]]:
    """Entry and exit state of each stretch on the cheapest path; ``leave`` None
    ends the conversation where that is cheapest."""
    best = [[FAR] * 4]
    best[0][entry] = 0
    for t in tables:
        best.append([min(FAR, min(best[-1][a] + t[4 * a + b] for a in range(4))) for b in range(4)])
    at = min(range(4), key=lambda s: (best[-1][s] + ENDS[s][0], s)) if leave is None else leave
    out = []
    for k in range(len(tables) - 1, -1, -1):
        before = min(range(4), key=lambda a: (best[k][a] + tables[k][4 * a + at], a))
        out.append((before, at))
        at = before
    return out[::-1]


def repaired(roles: list[int | None], entry: int, leave: int | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, role, action, empty messages before) of each turn of a stretch."""
    best = [[FAR] * 4]
    best[0][entry] = 0
    back = []
    for role in roles:
        after, steps = [FAR] * 4, [None] * 4
        for s in range(4):
            if best[-1][s] < FAR:
                for m in moves(s, role):
                    if best[-1][s] + m[0] < after[m[1]]:
                        after[m[1]], steps[m[1]] = best[-1][s] + m[0], (s, m)
        best.append(after)
        back.append(steps)
    at = min(range(4), key=lambda s: (best[-1][s] + ENDS[s][0], s)) if leave is None else leave
    out = []
    for steps in reversed(back):
        at, m = steps[at]
        out.append(m)
    return out[::-1]


def empties(states: tuple[int, ...]) -> str:
    return "".join(f"{OPEN}{ROLES[s - 1]}\n{CLOSE}\n" for s in states)


def rendered(turns: list[tuple[int | None, str | None]], entry: int, leave: int | None, last: bool) -> Iterator[tuple]:
    """(new role, action, inserted, cost, part) of each (role, text)."""
    state = entry
    steps = repaired([r for r, _ in turns], entry, leave)
    for k, ((_, text), (cost, r, action, before)) in enumerate(zip(turns, steps)):
        body = (text or "").replace("<|", "< |")
        if action == "merge":
            part = "\n" + body
        else:
            part = (f"{CLOSE}\n" if state != START else "") + empties(before) + f"{OPEN}{ROLES[r - 1]}\n{body}"
        added = [ROLES[s - 1] for s in before]
        if last and k == len(turns) - 1:
            more, after = ENDS[r]
            part, cost = part + f"{CLOSE}\n" + empties(after), cost + more
            added += [ROLES[s - 1] for s in after]
        state = r
        yield ROLES[r - 1], action, ",".join(added), cost, part


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


_TABLES = {"conv_id": pa.int64(), "stretch": pa.int64(), "costs": pa.list_(pa.int64())}
TABLES = "conv_id long, stretch long, costs array<long>"
PATHS = "conv_id long, stretch long, entry int, leave int, last boolean"
_PATHS = {"conv_id": pa.int64(), "stretch": pa.int64(), "entry": pa.int32(), "leave": pa.int32(), "last": pa.bool_()}


def stretch_tables(turns: DataFrame) -> DataFrame:
    """A cost table for each stretch; only roles move."""

    def run(batches):
        def made():
            for (conv, stretch), own in groupby(rows_of(batches), key=lambda r: r[:2]):
                yield conv, stretch, cost_table([state_of(r[3]) for r in own])

        yield from batched(made(), _TABLES)

    rows = turns.select("conv_id", "stretch", "turn", "role")
    return rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", F.asc_nulls_first("turn"), F.asc_nulls_first("role")).mapInArrow(run, TABLES)


def paths(tables: DataFrame) -> DataFrame:
    """Entry and exit states of stretches on the cheapest paths, in a tree of
    groups of at most FAN tables."""
    spread = tables.agg(F.max("stretch").alias("high"), F.min("stretch").alias("low")).first()

    def direct(batches):
        def made():
            for conv, own in groupby(rows_of(batches), key=lambda r: r[0]):
                own = list(own)
                for k, (r, (a, b)) in enumerate(zip(own, path_through([r[2] for r in own], START, None))):
                    yield conv, r[1], a, b, k == len(own) - 1

        yield from batched(made(), _PATHS)

    if spread["high"] is None or spread["high"] - spread["low"] < FAN:
        return tables.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(direct, PATHS)

    def compose(batches):
        def made():
            for (conv, group), own in groupby(rows_of(batches), key=lambda r: (r[0], r[1])):
                yield conv, group, composed([r[3] for r in own])

        yield from batched(made(), _TABLES)

    grouped = tables.select("conv_id", F.floor(F.col("stretch") / FAN).alias("group"), "stretch", "costs")
    upper = written(grouped.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "stretch").mapInArrow(compose, TABLES), "tables")
    above = paths(upper).select("conv_id", F.col("stretch").alias("group"), F.lit(None).cast("long").alias("stretch"), F.lit(None).cast("array<long>").alias("costs"), "entry", "leave", "last")

    def resolve(batches):
        def made():
            for (conv, _), own in groupby(rows_of(batches), key=lambda r: r[:2]):
                head, *own = own
                for k, (r, (a, b)) in enumerate(zip(own, path_through([r[3] for r in own], head[4], head[5]))):
                    yield conv, r[2], a, b, head[6] and k == len(own) - 1

        yield from batched(made(), _PATHS)

    none = [F.lit(None).cast(t).alias(n) for n, t in (("entry", "int"), ("leave", "int"), ("last", "boolean"))]
    both = grouped.select("conv_id", "group", "stretch", "costs", *none).unionByName(above)
    return both.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", F.asc_nulls_first("stretch")).mapInArrow(resolve, PATHS)


_OUT = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "new_role": pa.string(), "action": pa.string(), "inserted": pa.string(), "cost": pa.int32(), "rendered": pa.string(), "stretch": pa.int64(), "position": pa.int32()}


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, stretch) with stretches of bounded
    size. Where rows with repeated or no numbers fill a stretch, it becomes
    several: cells of equal turn, role and text hash are laid out one after the
    other, and a cell of many rows is dealt over stretches by row number."""
    key = ["conv_id", "stretch"]
    sizes = turns.groupBy(*key).agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > HOT).select(*key, F.lit(True).alias("hot")), "hot")
    m = hot.count()
    if not m:
        dropped(hot)
        return turns
    small = lambda df, n=1: F.broadcast(df) if n * m <= MOST_HOT else df
    # Row numbers have to stay what they are, so they are written.
    rows = turns.join(small(hot), key, "left").withColumn("row", F.monotonically_increasing_id()).withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(HASHES)))
    rows = written(rows, "turns")
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "hash").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.where("hot").groupBy(*key, "turn", "role", "hash").agg(F.count("*").alias("n"))
    cells = cells.select(*key, "turn", "role", "hash", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / STRETCH).alias("first"), F.ceil(F.col("n") / STRETCH).alias("parts"))
    cells = written(cells, "cells")
    cut = cells.groupBy(*key).agg(F.max(F.col("first") + F.col("parts")).alias("parts"))
    # New numbers for all stretches of conversations with a cut one: a row for each stretch.
    order = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.join(small(hot.select("conv_id").distinct()), "conv_id", "left_semi").join(small(cut), key, "left")
    numbered = written(numbered.select(*key, F.coalesce(F.sum(F.coalesce("parts", F.lit(1))).over(order), F.lit(0)).alias("base")), "numbered")
    based = rows.join(F.broadcast(numbered) if numbered.count() <= MOST_HOT else numbered, key, "left")
    cold = based.where("hot IS NULL").withColumn("stretch", F.coalesce("base", "stretch"))
    spread = cells.withColumnsRenamed({c: f"c_{c}" for c in cells.columns}).withColumn("c_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    same = " AND ".join(f"{c} <=> c_{c}" for c in (*key, "turn", "role", "hash", "spread"))
    dealt = based.where("hot").withColumn("spread", F.pmod("row", F.lit(SPREAD)).cast("int")).join(spread, F.expr(same))
    dealt = dealt.withColumn("stretch", F.col("base") + F.col("c_first") + F.pmod(F.xxhash64("row"), "c_parts"))
    dropped(hot)
    return cold.select(*turns.columns).unionByName(dealt.select(*turns.columns))


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each turn: its new role, what was done, and its rendered part."""
    turns = shipped(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    named = placed(turns.where("conv_id IS NOT NULL"))
    way = paths(written(stretch_tables(named), "tables"))

    def run(batches):
        def made():
            for (conv, _), own in groupby(rows_of(batches), key=lambda r: r[:2]):
                head, *own = own
                for k, (r, new) in enumerate(zip(own, rendered([(state_of(r[4]), r[5]) for r in own], head[6], head[7], head[8]))):
                    yield conv, r[3], r[4], *new, head[1], k

        yield from batched(made(), _OUT, 500)

    def alone(batches):
        def made():
            for turn, role, text in rows_of(batches):
                for new in rendered([(state_of(role), text)], START, None, True):
                    yield None, turn, role, *new, 0, 0

        yield from batched(made(), _OUT, 500)

    none = [F.lit(None).cast(t).alias(n) for n, t in (("entry", "int"), ("leave", "int"), ("last", "boolean"))]
    body = named.select("conv_id", "stretch", F.lit(1).alias("kind"), "turn", "role", "text", *none)
    head = way.select("conv_id", "stretch", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))), "entry", "leave", "last")
    every = body.unionByName(head).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    single = turns.where("conv_id IS NULL").select("turn", "role", "text").mapInArrow(alone, OUT)
    return every.mapInArrow(run, OUT).unionAll(single)
