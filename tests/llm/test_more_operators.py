"""Sharding and chat formatting."""

import collections
import random
from itertools import product

import pytest

from lodeline.llm import chat_format, sharding
from lodeline.llm.chat_format import ASSISTANT, ENDS, LEGAL, ROLES, START

NAMES = [f"shard-{k}" for k in range(12)]


# Sharding.


def test_shares_are_even_and_stable():
    full = sharding.lookup_table(NAMES, 1009)
    counts = collections.Counter(full)
    assert set(counts) == set(range(12)) and max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(NAMES[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 11)
    assert moved < 0.15 * 1009
    shuffled = NAMES[::-1]
    assert [shuffled[k] for k in sharding.lookup_table(shuffled, 1009)] == [NAMES[k] for k in full]


def test_slots_follow_the_preferences():
    import xxhash

    for n in (1, 3, 7):
        table = [None] * 31
        names = sorted(NAMES[:n])
        lists = [[(xxhash.xxh64_intdigest(x, 1) + j * (xxhash.xxh64_intdigest(x, 2) % 30 + 1)) % 31 for j in range(31)] for x in names]
        turn = 0
        while None in table:
            k = turn % n
            table[next(s for s in lists[k] if table[s] is None)] = names[k]
            turn += 1
        assert [NAMES[k] for k in sharding.lookup_table(NAMES[:n], 31)] == table


@pytest.mark.parametrize("names,slots", [(NAMES, 1000), ([], 11), (["a", "a"], 11), (NAMES, 11)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_placement(spark, tmp_path):
    rows = [(k, f"text {k}", "x", 1) for k in range(2000)] + [(None, "a", "x", 1), (None, "a", "x", 1), (None, None, "x", 1), (7, None, "x", 1), (8, "w " * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    placed = sharding.place(df, NAMES, 1009)
    assert placed.columns == [*df.columns, "slot_", "shard_"] and placed.count() == len(rows)
    got = placed.collect()
    table = sharding.lookup_table(NAMES, 1009)
    assert all(table[r["slot_"]] == r["shard_"] for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"], r["text"] if r["doc_id"] is None else ""].add(r["shard_"])
    assert all(len(s) == 1 for s in by_id.values())
    sharding.write_shards(placed, str(tmp_path / "out"), "shard_", 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.groupBy("shard_").count().count() == 12
    assert sharding.place(df.limit(0), NAMES, 1009).count() == 0
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


# Chats.


def exhaustive(roles):
    """The least cost over all choices, by trying every one."""
    best = 10**9
    for choice in product(*(chat_format_choices(r) for r in roles)):
        state, cost = START, 0
        for own, r, kind, before in choice:
            for x in before:
                if x not in LEGAL[state]:
                    break
                state = x
            else:
                if kind == "merge" and state == r or kind == "new" and r in LEGAL[state]:
                    state, cost = r, cost + own
                    continue
            break
        else:
            best = min(best, cost + ENDS[state][0])
    return best


def chat_format_choices(role):
    for r in (1, 2, 3):
        own = 0 if r == role else chat_format.UNLABELLED if role is None else chat_format.RELABEL
        yield own, r, "new", ()
        yield own + chat_format.MERGE, r, "merge", ()
        for x in (1, 2, 3):
            yield own + chat_format.INSERT, r, "new", (x,)


@pytest.mark.parametrize("n", range(1, 4))
def test_repairs_cost_the_least(n):
    for roles in product((1, 2, 3, None), repeat=n):
        steps = chat_format.repaired(list(roles), START, None)
        cost = sum(s[0] for s in steps) + ENDS[steps[-1][1]][0]
        assert cost == exhaustive(roles)


def legal(text):
    """Role by role, whether a rendering is a legal conversation."""
    state = START
    for part in text.split(chat_format.OPEN)[1:]:
        assert part.endswith(chat_format.CLOSE + "\n")
        role = ROLES.index(part.split("\n", 1)[0]) + 1
        assert role in LEGAL[state]
        state = role
    return state == ASSISTANT


def in_order(rows):
    return sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or ""))


@pytest.mark.parametrize("stretch,fan", [(1024, 1024), (3, 2), (1, 3)])
def test_stretches_compose_to_the_least_cost(spark, monkeypatch, stretch, fan):
    monkeypatch.setattr(chat_format, "STRETCH", stretch)
    monkeypatch.setattr(chat_format, "FAN", fan)
    draw = random.Random(11)
    names = ["system", "user", "assistant", "human", "GPT ", None, "narrator"]
    rows = [(c, t, draw.choice(names), f"t{c}.{t} <|im_end|>") for c in range(15) for t in range(draw.randint(1, 40))]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert len(out) == len(rows)
    chats = collections.defaultdict(list)
    for r in out:
        chats[r["conv_id"]].append(r)
    for conv, own in chats.items():
        own = in_order(own)
        text = "".join(r["rendered"] for r in own)
        assert legal(text) and [f"t{conv}.{r['turn']} < |im_end|>" in r["rendered"] for r in own] == [True] * len(own)
        roles = [chat_format.state_of(r["role"]) for r in own]
        steps = chat_format.repaired(roles, START, None)
        assert sum(r["cost"] for r in own) == sum(s[0] for s in steps) + ENDS[steps[-1][1]][0]


def test_good_chats_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    out = in_order(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert "".join(r["rendered"] for r in out) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert all(r["action"] == "keep" and r["cost"] == 0 and r["inserted"] == "" for r in out)


def test_odd_chats(spark):
    rows = [(None, None, None, None, "x"), (None, 0, "user", "alone", "x"), (1, None, "user", None, "x"), (1, 0, "user", "same", "x"), (1, 0, "user", "same", "x"), (2, 0, "assistant", "long " * 100_000, "x"), (3, -5, "system", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string")
    out = chat_format.format_chats(df).collect()
    assert len(out) == len(rows)
    assert all(legal(r["rendered"]) for r in out if r["conv_id"] in (None, 2, 3))
    assert [r["action"] for r in in_order([r for r in out if r["conv_id"] == 1])] == ["keep", "merge", "merge"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("stretch,fan,n", [(1024, 1024, 100_000), (16, 4, 3_000)])
def test_repeated_and_missing_turns_are_cut(spark, monkeypatch, stretch, fan, n):
    """Rows of one turn, equal and different ones, and rows without a number."""
    monkeypatch.setattr(chat_format, "STRETCH", stretch)
    monkeypatch.setattr(chat_format, "FAN", fan)
    monkeypatch.setattr(chat_format, "HOT", 4 * stretch)
    equal = spark.range(n).selectExpr("1L conv_id", "5L turn", "'user' role", "'same' text")
    missing = spark.range(n // 4).selectExpr("1L conv_id", "cast(null as long) turn", "if(id % 3 = 0, 'assistant', if(id % 3 = 1, 'user', cast(null as string))) role", "concat('t', id % 50) text")
    rest = spark.range(100).selectExpr("id % 2 + 1 conv_id", "id * 700 turn", "if(id % 2 = 0, 'assistant', 'user') role", "'x' text")
    rows = equal.unionAll(missing).unionAll(rest).repartition(4)
    out = chat_format.format_chats(rows).cache()
    sizes = out.groupBy("conv_id", "stretch").count()
    assert out.count() == n + n // 4 + 100 and sizes.agg({"count": "max"}).first()[0] <= chat_format.HOT
    assert out.groupBy("conv_id", "stretch", "position").count().where("count > 1").count() == 0
    for conv in (1, 2):
        own = sorted(out.where(f"conv_id = {conv}").collect(), key=lambda r: (r["stretch"], r["position"]))
        places = [(r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "") for r in own]
        assert places == sorted(places) and legal("".join(r["rendered"] for r in own))
        steps = chat_format.repaired([chat_format.state_of(r["role"]) for r in own], START, None)
        assert sum(r["cost"] for r in own) == sum(s[0] for s in steps) + ENDS[steps[-1][1]][0]
