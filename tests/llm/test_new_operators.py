"""Fill-in-middle, conversation trie and exact duplicates against their definitions, on odd rows, and on many small parts."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import CLASH, ODD

from lodeline.llm import exact_dedup, fill_middle, prefix_trie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def odd(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, 2, 3, "z", 4) for d, t in rows], CLASH)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_conversation_prefix_trie", "op13_exact_dedup"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = queries.QUERIES[name](spark, folder), c.sql(queries.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got = [tuple(map(str, r)) for r in ours.select(*theirs.columns).collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in theirs.fetchall())


# --- exact duplicates ---


def brute_copies(rows):
    """(id, keep_id, size, sha) of each row, and how many rows of each text stay."""
    of = collections.defaultdict(list)
    for d, t in rows:
        of[t or ""].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in of.items()}
    return collections.Counter((d, best[t or ""], len(of[t or ""]), sha(t or "")) for d, t in rows), len(of)


def check_copies(spark, rows, frame=None):
    got = exact_dedup.exact_groups(frame if frame is not None else spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, n = brute_copies(rows)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stay = [r for r in got if r["kept"]]
    assert len(stay) == n == len({r["text_sha256"] for r in stay}) and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_copies_of_odd_rows(spark):
    check_copies(spark, ODD * 2, odd(spark, ODD * 2))


def test_copies_that_part_late(spark):
    """Equal lengths and beginnings; the texts part at every level, or in the last byte, or end at a level's bound."""
    base = "".join(random.Random(5).choices("abcdé ", k=300_000))
    rows, k = [], 0
    for length in (0, 1, 63, 64, 65, 4159, 4160, 4161, 40_000, 300_000):
        text = base.encode()[:length].decode(errors="ignore")
        for at in (None, 0, 64, 4159, 4160, 36_927, 36_928, length - 1):
            if at is None or 0 <= at < len(text):
                own = text if at is None else text[:at] + "Z" + text[at + 1 :]
                rows += [(k, own), (k + 1, own), (None, own)]
                k += 2
    check_copies(spark, rows)


def test_copies_with_hot_group(spark):
    """A third of all rows is one text, a third shares beginning and length with it."""
    rows = [(k, "same " * 100 + "end" if k % 3 == 0 else "same " * 100 + f"{k % 997:03d}" if k % 3 == 1 else f"text {k}") for k in range(6000)]
    check_copies(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def exchanged(plan):
    """Bytes that the exchanges of an executed plan have sent, without broadcasts."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return 0 if kind.startswith("Broadcast") else exchanged(plan.plan())
    own = plan.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(exchanged(plan.children().apply(k)) for k in range(plan.children().size()))


def test_first_level_sends_few_texts(spark):
    """Of 3,000 texts with 5 pairs, only texts of pairs (and a few by chance) go through an exchange, whichever join is taken."""
    draw = random.Random(3)
    rows = [(k, "".join(draw.choices("abcdefgh", k=1500))) for k in range(3000)]
    rows += [(3000 + k, rows[k][1]) for k in range(5)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        begun = exact_dedup.opened(docs.select("doc_id", *exact_dedup.measured("text")))
        apart = begun.where("NOT alone").select("doc_id", "tail").collect()
        assert {r["doc_id"] for r in apart} == {*range(5), *range(3000, 3005)}
        begun = begun.select("doc_id", "tail", "alone")
        assert len(begun.collect()) == len(rows)
        assert exchanged(begun._jdf.queryExecution().executedPlan()) < 400_000  # all texts are 4.5 MB
        check_copies(spark, rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1 << 15, 1 << 25])
def test_copies_by_any_bit_table(spark, monkeypatch, most):
    """Cold groups, with a bit table too small to tell much."""
    monkeypatch.setattr(exact_dedup, "MARKS", most)
    draw = random.Random(4)
    rows = [(k, f"{draw.randrange(5000)} " + "x" * draw.randrange(40)) for k in range(9000)]
    check_copies(spark, rows)


def test_copies_of_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.without_copies(odd(spark, [])).count() == 0


def test_without_copies_keeps_columns(spark):
    schema = CLASH.replace("doc_id long", "doc_id long, row_number int, head string, n long, alone string")
    rows = [(d, 7, "h", 3, "a", t, "x", "y", 1, 2, 3, "z", 4) for d, t in ODD * 2]
    table = spark.createDataFrame(rows, schema)
    out = exact_dedup.without_copies(table)
    assert out.columns == table.columns and out.dtypes == table.dtypes
    got = out.collect()
    want, n = brute_copies(ODD * 2)
    keep = {s: d for _, d, _, s in want}
    assert len(got) == n and {sha(r["text"] or ""): r["doc_id"] for r in got} == keep


def test_levels_cover_every_byte():
    for longest in (0, 1, 64, 65, 4160, 4161, 10**7, 10**9):
        found = list(exact_dedup.levels(longest))
        assert found[0][0] == exact_dedup.FIRST and all(a + w == b for (a, w), (b, _) in zip(found, found[1:]))
        assert sum(found[-1]) >= longest


# --- fill in the middle ---


def brute_middle(doc, text, seed=1):
    t = text or ""
    n = len(t)
    x = sha(f"{seed}:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check_middle(table, rows):
    made = fill_middle.fill_in_middle(table).collect()
    assert collections.Counter(tuple(r) for r in made) == collections.Counter((d, *brute_middle(d, t)) for d, t in rows)
    out = fill_middle.fingerprints(fill_middle.fill_in_middle(table)).collect()
    assert collections.Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in out) == collections.Counter((d, sha(brute_middle(d, t)[-1]), sha(t or "")) for d, t in rows)


def test_middle_of_odd_rows(spark):
    check_middle(odd(spark, ODD), ODD)


def test_middle_of_all_classes(spark):
    draw = random.Random(11)
    alphabet = ["a", " ", "\n", "é", "ß", "中", "文", "😀", "𝒳", "́", "<", ">", "<P", "S>", "\x00"]
    rows = [(k, "".join(draw.choices(alphabet, k=draw.randrange(60)))) for k in range(1500)]
    rows += [(k, t) for k, t in enumerate(["<P>", "x<S>y", "<M>", "<<S>", "<P<S", "é" * 5000, "a" * 5000 + "😀" * 3, "", None])]
    check_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_middle_of_long_texts_in_slices(spark):
    rows = [(k, ("wörter und 文字 😀 " * 90_000)[k:]) for k in range(6)]
    check_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)


def test_middle_of_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_find_every_unit():
    text = "aé文😀" * 3 + "zz" + "é" * 4 + "a"
    data = np.frombuffer(text.encode(), np.uint8)
    runs = fill_middle.Runs.of(data)
    assert np.all(runs.width[1:] != runs.width[:-1])
    ends = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert runs.bytes_before(np.arange(len(text) + 1)).tolist() == ends.tolist()
    assert runs.units_before(ends).tolist() == list(range(len(text) + 1))


# --- conversation trie ---


def brute_nodes(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = sha(f"{len(role or '')}:{role or ''}{text or ''}")[:32]
            own[c].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return brute_trie(built)


def brute_trie(built):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        saved[k] += (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        leaves[k] += not children[k]
        if k:
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, ends[k])))) for k, m in members.items()}


TALKS = "conv_id long, turn long, role string, text string"


def talks(draw, n):
    """Conversations of few different turns: shared beginnings, copies, ends inside others, null cells, ties, missing cohorts."""
    rows = []
    for c in range(n):
        if c % 20 == 0 and draw.random() < 0.3:
            continue
        same = c % 3 == 0
        for k in range(6 if same else draw.randrange(9)):
            said = "the same words" if same else draw.choice(["a b", "c", " d  e\tf ", "", None])
            rows.append((c, draw.choice([k, k, k, None, 1]), draw.choice(["user", None]) if not same else "user", said))
    return rows + [(None, 1, "user", "no conversation")]


@pytest.mark.parametrize("part", [1, 7, 60, 10**6])
def test_trie_of_parts(spark, part):
    rows = talks(random.Random(part), 240)
    table = spark.createDataFrame(rows, TALKS).repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(table), part).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute_nodes(rows)


def test_trie_of_long_and_equal_conversations(spark):
    """Long shared paths over many parts, one conversation of 1,500 turns, many copies."""
    rows = [(c, k, "user", f"turn {k}" if k < 300 + c % 5 else f"own {c % 7} {k}") for c in range(30) for k in range(310)]
    rows += [(1000, k, "user", f"turn {k}") for k in range(1500)] + [(c, k, "user", "hello all") for c in range(2000, 2600) for k in range(2)]
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, TALKS)), 500).collect()
    assert set(map(tuple, got)) == brute_nodes(rows) and len(got) == len(brute_nodes(rows))


def test_trie_of_extra_columns(spark):
    rows = talks(random.Random(2), 60)
    table = spark.createDataFrame([(*r, 1, "k", 2, "p") for r in rows], TALKS + ", depth int, key string, words int, part string")
    assert set(map(tuple, prefix_trie.conversation_trie(table).collect())) == brute_nodes(rows)


def test_trie_without_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALKS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TALKS)).count() == 0


def test_trie_of_turnless_conversations(spark):
    # Without the first conversation of its cohort, one with at most h turns has none.
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame([(short, 0, "user", "x")], TALKS)).collect()
    assert tuple(root) == (short, 0, None, 1, 0, 1, 0, sha(str(short)))


def test_ids_are_hashed_in_pieces(spark):
    convs = spark.range(0, 30_000).selectExpr("id AS conv_id", "X'' AS key", "cast(array() AS array<bigint>) AS words").repartition(8)
    (row,) = prefix_trie.sequences(convs).collect()
    assert (row["n"], row["conv_id"], row["ends"]) == (30_000, 0, sha(",".join(map(str, range(30_000)))))


# --- Jaccard join: hubs ---


def test_texts_of_a_hub_go_to_several_tasks(spark, monkeypatch):
    from test_operators import brute_groups

    from lodeline.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", 5)
    draw = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(120):
        own = list(base)
        own[draw.randrange(len(own))] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute_groups(rows, 3, 90, 100)


# --- WARC: target URIs ---


@pytest.mark.parametrize("url", ["http://a.example/é?q=ü#x", "http://a.example/a b\t\\n", "http://a.example/%C3%A9", "", None, "漢字", "http://a.example/line\r\nend: x"])
def test_records_have_percent_encoded_targets(url):
    from lodeline.llm import warc

    raw = warc.record(7, url, b"body", warc.digest32(hashlib.sha1(b"body").hexdigest()), None, False, "2024-01-01T00:00:00Z", "0")
    assert warc.parse(raw)[:3] == (7, url, 4)
    head = raw.partition(b"\r\n\r\n")[0].decode()
    targets = [x.split(": ", 1)[1] for x in head.split("\r\n") if x.startswith("WARC-Target-URI")]
    assert all(t.isascii() and " " not in t for t in targets) and len(targets) == (url is not None)
    assert (warc.SOURCE_URL in head) == (url is not None and targets[0] != url)


# --- batches ---


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    from lodeline.llm import common

    before = spark.conf.get(common.BATCH_KEY)
    try:
        spark.conf.unset(common.BATCH_KEY)
        common.ready(spark)
        assert int(spark.conf.get(common.BATCH_KEY).rstrip("b")) == common.BATCH_BYTES < common.SLICE_BYTES
        spark.conf.set(common.BATCH_KEY, "1m")
        common.ready(spark)
        assert spark.conf.get(common.BATCH_KEY) in ("1m", str(1 << 20), f"{1 << 20}b")
    finally:
        spark.conf.set(common.BATCH_KEY, before)
