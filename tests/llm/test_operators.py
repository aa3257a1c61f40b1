"""The corpus operators against brute force, round trips and odd inputs."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodeline.functions.shipping import shared_dir
from lodeline.llm import decontamination, html_extract, jaccard_join, license_scan, packing, quality_rules, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000

#: Odd documents: nulls, blanks, controls, repeats, very long, other scripts; clashing extra columns.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a b c d e\na b c d e\n\na b c d e"), (6, LONG), (7, "ΑΒΓ ДЕЖ 漢字 \x85  ÄÖÜ"),
    (8, "same text here for two rows of it"), (8, "same text here for two rows of it"), (9, "same text here for two rows of it"), (None, "no id but some words"), (10, "#*$%&|<>\x00!!"),
]
CLASH = "doc_id long, text string, n_words string, label string, salt int, s int, rep int, component_id string, key int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "x", "y", 1, 2, 3, "z", 4) for d, t in ODD], CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Licence notices.


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        parts = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_equals_brute_force(spark, docs, odd):
    made = [(k, t) for k, t in enumerate(("GNU\nGeneral-Public  LICENSE and mit license, MIT License", "cc by-nc cc.by cc  BY", "xmit license", "apache licenses", "Apache License Apache License"))]
    more = spark.createDataFrame(made, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(more).unionAll(odd.select("doc_id", "text"))
    want = sorted(map(repr, ((r["doc_id"], *brute_license(r["text"])) for r in every.collect())))
    got = license_scan.scan_licenses(every)
    assert sorted(map(repr, (tuple(r)[:6] for r in got.collect()))) == want


@pytest.mark.parametrize("text,label,edits", [
    ("licensed under the Apche Licence", "apache", 2), ("GNU Genral Public Lisense", "gpl", 2), ("GNU General Public License", "gpl", 0),
    ("Permission is hereby granted, free of charge, to any persn", "mit", 1), ("All rights reservd.", "proprietary", 1),
])
def test_license_edits(text, label, edits):
    found = license_scan.Scanner().scan(text.encode())
    best = min((m for m in found[7] if m["label"] == label), key=lambda m: m["edits"])
    assert best["edits"] == edits and label in found[5].split(",") and 0 < found[6] <= 1


def test_license_leaves_clean_texts(docs):
    clean = docs.where("NOT regexp_like(lower(text), 'licen|cc by|gnu|rights')")
    assert license_scan.scan_licenses(clean).where("labels <> '' OR score > 0").count() == 0


def test_license_windows_find_what_a_full_search_finds():
    import regex

    draw = random.Random(4)
    scanner = license_scan.Scanner()
    for _ in range(200):
        n = draw.choice(license_scan.NOTICES)
        s = list(n.phrase)
        for _ in range(draw.randint(0, n.edits)):
            k = draw.randrange(len(s))
            s[k : k + 1] = draw.choice([[], [draw.choice("aeiou")], [s[k], "x"]])
        text = " ".join(["lead words", *"".join(s).split(), "tail"])
        whole = regex.search(rf"(?be)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}", text)
        if whole and (whole.start() == 0 or text[whole.start() - 1] == " ") and (whole.end() == len(text) or text[whole.end()] == " "):
            assert any(m["label"] == n.label for m in scanner.matches(text))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("text,spans", [
    ("gnu general public licenses", [("gpl", 0, 27, 1)]), ("ggnu general public license", [("gpl", 0, 27, 1)]),
    ("mozilla public licensee", [("mpl", 0, 23, 1)]), ("under the mit licensed", [("mit", 0, 22, 1)]),
    ("gnu generl public license or gnu general public license", [("gpl", 0, 25, 1), ("gpl", 29, 55, 0)]),
])
def test_license_edits_at_word_boundaries(text, spans):
    found = license_scan.Scanner().matches(text)
    assert {tuple(m[c] for c in ("label", "start", "end", "edits")) for m in found} >= set(spans)


def test_license_finds_every_aligned_notice_within_the_bound():
    draw = random.Random(6)
    notices = license_scan.NOTICES
    scanners = {n: license_scan.Scanner((n,)) for n in notices}
    for _ in range(150):
        n = draw.choice(notices)
        parts = ["lead"]
        for _ in range(draw.randint(1, 3)):
            s = list(n.phrase)
            for _ in range(draw.randint(0, n.edits + 1)):
                k = draw.choice((0, len(s) - 1, draw.randrange(len(s))))
                s[k : k + 1] = draw.choice([[], [draw.choice("aeiou")], [s[k], "x"], ["x", s[k]], [" "]])
            parts += ["".join(s), *["or"] * draw.randint(0, 1)]
        text = " ".join(" ".join(parts).split())
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        ends = [*(m.start() for m in re.finditer(" ", text)), len(text)]
        size = len(n.phrase)
        every = {(a, b): d for a in starts for b in ends if abs(b - a - size) <= n.edits and (d := levenshtein(n.phrase, text[a:b])) <= n.edits}
        got = {(m["start"], m["end"]): m["edits"] for m in scanners[n].matches(text)}
        assert got.items() <= every.items()
        # Each span within the bound is reported, or one that overlaps it with no more edits.
        assert all(any(a < end and start < b and e <= d for (start, end), e in got.items()) for (a, b), d in every.items())


# Main text.


def test_html_template(spark, data):
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain words without any markup at all", "plain words without any markup at all"),
    ("<article><header><h1>T</h1><span>by me</span></header><p>a &lt;b&gt; &amp;c; <b>d</b>e<script>x</script></p><footer>f</footer></article>", "T a <b> &c; de"),
    ("<article><p>Text of the article<div class='comments'><p>reader says</p></div><form>Name</form></article>", "Text of the article"),
    ("<div class='has-sidebar'><main><p>Main text</p><aside>side</aside></main></div><nav>menu</nav>", "Main text"),
    ("<body><div id='cookie-banner'>We use cookies</div><article><p>one<p>two", "one two"),
    ("<article><p hidden>no</p><div style='display: none'>no</div><p>yes</p></article>", "no yes"),
])
def test_html_parts(html, text):
    assert html_extract.extract(html or "")[0] == text


SAID = "A sentence with a good number of words in it, so that it is content. " * 4
LONG_BLOCK = f"<p>{SAID}</p>"


@pytest.mark.parametrize("html,times", [
    # A form around the page, with and without an article; small forms go.
    (f"<body><form id=aspnetForm><div>menu</div><article>{LONG_BLOCK}</article></form></body>", 1),
    (f"<body><form id=aspnetForm><div><a href=x>menu</a></div><div>{LONG_BLOCK}{LONG_BLOCK}</div></form></body>", 2),
    (f"<form><main>{LONG_BLOCK}</main></form>", 1),
    (f"<article>{LONG_BLOCK}<form><p>Your mail</p><input></form></article>", 1),
    # Anchors that are no links, or never closed.
    (f"<div><a name=top>{LONG_BLOCK}{LONG_BLOCK}</div>", 2), (f"<div><a id=x/>{LONG_BLOCK}{LONG_BLOCK}</div>", 2),
    (f"<div><p><a href=x>Read this</p>{LONG_BLOCK}{LONG_BLOCK}</div>", 2),
    # A menu that is never closed; one that is, with an article in it.
    (f"<body><nav><a href=x>menu</a><article>{LONG_BLOCK}</article></body>", 1),
    (f"<article>{LONG_BLOCK}</article><aside><article>{LONG_BLOCK}</article></aside>", 1),
    # Articles beside each other, and a teaser.
    (f"<body><article>{LONG_BLOCK}{LONG_BLOCK}</article><article>{LONG_BLOCK}</article><article><p>teaser</p></article></body>", 3),
    # Adverts and notices in blocks and inside of them.
    (f"<article><p class=advert>buy now</p>{LONG_BLOCK}<p>{SAID}<span class=advertisement>buy <span>this</span></span></p><p class='cookie-notice'>we use</p><div class=widget-title>W</div></article>", 2),
])
def test_html_of_real_shapes(html, times):
    text = html_extract.extract(html)[0]
    assert text.removeprefix("Read this").strip() == " ".join([SAID.strip()] * times)


def test_html_without_article():
    words = "a sentence with a good number of words in it, so that it is content. "
    page = f"<body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div><h2>Title</h2><p>{words * 3}</p><p>Short.</p><p>{words * 3}</p></div><div class=footer>(c) us</div></body>"
    text = html_extract.extract(page)[0]
    assert "Short." in text and text.count("good number") == 6 and "Home" not in text and "(c)" not in text


SENTENCE = "A sentence with a good number of words in it, so that it is content."


@pytest.mark.parametrize("html,text", [
    (f"<body><div><p>{SENTENCE * 4}</p><blockquote><p>{SENTENCE * 13}</p></blockquote></div></body>", f"{SENTENCE * 4} {SENTENCE * 13}"),
    (f"<body><div class='content no-sidebar'><p>{SENTENCE}</p></div><div class='site-footer'>{SENTENCE}</div></body>", SENTENCE),
    (f"<body class='comments-open'><p>{SENTENCE}</p></body>", SENTENCE),
    (f"<main><p>{SENTENCE * 9}</p><article><p>{SENTENCE}</p></article></main>", f"{SENTENCE * 9} {SENTENCE}"),
    (f"<main><article><p>{SENTENCE * 9}</p></article><p>{SENTENCE}</p></main>", SENTENCE * 9),
    (f"<body><ul><li><a href=x>Home page of the site</a></li></ul><h1>T</h1><p>By me</p><h2>U</h2><div>{''.join(f'<p>{SENTENCE * 9}</p>' for _ in range(4))}</div></body>", " ".join(["T By me U", *[SENTENCE * 9] * 4])),
    (f"<body><div>{''.join(f'<p>{SENTENCE * 9}</p>' for _ in range(4))}<p>a</p><p>b</p><p>c</p><p>d</p></div><p>e</p></body>", " ".join([*[SENTENCE * 9] * 4, "a b c d"])),
])
def test_html_keeps_the_whole_article(html, text):
    assert html_extract.extract(html)[0] == text


def test_clusters_equal_their_definition():
    draw = random.Random(3)
    for _ in range(50):
        n = draw.randint(1, 30)
        sizes, tags, live, marked = ([f() for _ in range(n)] for f in (lambda: draw.choice((0, 3, 20, 200)), lambda: draw.randint(0, 5), lambda: draw.random() < 0.8, lambda: draw.random() < 0.3))
        lines = []
        for t, a in zip(tags, live):
            lines.append(html_extract.Line(0, a))
            lines[-1].tags = t
        r = np.array([(2 if m else 1) * s / max(1, t) if a else 0 for s, t, a, m in zip(sizes, tags, live, marked)])
        kernel = np.exp(-np.arange(-2, 3) ** 2 / 2)
        smooth = np.convolve(np.pad(r, 2), kernel, "valid") / np.convolve(np.pad(np.ones(n), 2), kernel, "valid")
        want = [a and s > 0 and x >= min(smooth.std(), smooth.mean()) - 1e-9 for a, s, x in zip(live, sizes, smooth)]
        content, core = html_extract.clustered(lines, sizes, marked)
        assert content == want
        assert core == [c and x >= min(smooth.std(), smooth.mean()) - 1e-9 for c, x in zip(want, r)]


def test_clusters_choose_the_content_without_any_telling_element(monkeypatch):
    """Pages of nameless divs: only the ratios tell menus and footers from the text."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 8)))
    links = lambda n: "".join(f"<div><b><i>{word()}</i></b> <span>{word()}</span></div>" for _ in range(n))
    pages = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(draw.randint(60, 120))) for _ in range(draw.randint(4, 9))]
        title = f"{word()} {word()}"
        pages.append((f"<body><div>{links(8)}</div><div><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in parts)}</div><div>{links(8)}</div></body>", " ".join([title, *parts])))
    equal = lambda: sum(html_extract.extract(h)[0] == t for h, t in pages)
    assert equal() >= 36
    monkeypatch.setattr(html_extract, "clustered", lambda lines, sizes, marked: ([x.live and n > 0 for x, n in zip(lines, sizes)],) * 2)
    assert equal() == 0


def test_clusters_choose_between_articles():
    teaser = "<article><h2>Other</h2><p><b>a</b> <i>b</i> <b>c</b></p></article>"
    page = f"<body><div>{teaser * 6}</div><div><article><h1>T</h1><p>{SENTENCE * 9}</p><p>{SENTENCE * 9}</p></article></div></body>"
    assert html_extract.extract(page)[0] == f"T {SENTENCE * 9} {SENTENCE * 9}"


def test_html_is_linear_in_depth():
    import time

    def took(n):
        start = time.perf_counter()
        html_extract.extract("<div>x" * n + "</section>" * n)
        return time.perf_counter() - start

    took(1000)
    assert took(32_000) < 5


def test_html_odd_rows(spark):
    rows = [(1, None, None), (1, "u", "<article>x</article>"), (None, "u", LONG), (2, "u", "<b" * 1000)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.count() == 4 and got.where("n_chars <> length(text)").count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


# Packing.


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[k] -= n
    return sorted(rooms)


def test_plan_equals_best_fit_step_by_step():
    draw = random.Random(1)
    for _ in range(300):
        capacity = draw.choice((5, 10, 31, 64))
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 80))]
        counts = collections.Counter(lengths)
        runs, made = packing.plan(counts, capacity)
        parts = collections.defaultdict(list)
        for n, own in runs.items():
            for j, (rank, first, at, each) in enumerate(own):
                end = own[j + 1][0] if j + 1 < len(own) else counts[n]
                for k in range(end - rank):
                    parts[first + k // each].append((at + k % each * n, n))
        for own in parts.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sorted(capacity - sum(n for _, n in parts[k]) for k in range(made)) == best_fit(lengths, capacity)


def test_packing_equals_the_tokenizer(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    every = docs.select("doc_id", "text").unionAll(odd.where("doc_id <> 8 OR doc_id IS NULL").selectExpr("doc_id + 1000000", "text"))
    rows = packing.pack_documents(every).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    texts = every.collect()
    assert len(pieces) == len(texts)
    for doc_id, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == [0, *np.cumsum([r["length"] for r in got])[:-1]] and sum(r["length"] for r in got) == len(ids)
        assert all(r["length"] == packing.CAPACITY for r in got[1:]) and [r["piece"] for r in got] == list(range(len(got)))
        assert [r["ids_crc32"] for r in got] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got]
    check_sequences(rows)
    assert sorted(packing.CAPACITY - n for n in check_sequences(rows)) == best_fit([r["length"] for r in rows], packing.CAPACITY)


def check_sequences(rows):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    sizes = [sum(n for _, n in own) for own in sequences.values()]
    assert max(sizes, default=0) <= packing.CAPACITY
    return sizes


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    check_sequences(rows)
    assert packing.pack_documents(none).count() == 0


def test_hot_length_is_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    df = spark.createDataFrame([(k, "same words") for k in range(500)], "doc_id long, text string")
    check_sequences(packing.pack_documents(df).collect())


def test_equal_rows_are_salted_apart(spark):
    df = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'' text").repartition(4)
    packed = packing.pack_documents(df)
    groups = packing.written(packing.tokenize(df), "pieces").selectExpr("length", f"pmod(xxhash64(row), {100_000 // packing.SALT_ROWS}) salt").groupBy("length", "salt").count()
    assert groups.agg({"count": "max"}).first()[0] < 2 * packing.SALT_ROWS
    sizes = packed.groupBy("sequence_id").agg({"offset": "max", "length": "sum", "*": "count"}).collect()
    assert len(sizes) == -(-100_000 // packing.CAPACITY) and all(r["max(offset)"] + 1 == r["sum(length)"] == r["count(1)"] <= packing.CAPACITY for r in sizes)


def test_unusual_characters_tokenize_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.Ids(packing.VOCABULARY)
    draw = random.Random(2)
    alphabet = [chr(c) for c in (*range(1, 0x300), *range(0x370, 0x500), 0x2028, 0x3000, 0x4E00, 0x1F600, 0xA0, 0x85)]
    for _ in range(300):
        text = "".join(draw.choice(alphabet) if draw.random() < 0.5 else draw.choice("ab 1'\n s") for _ in range(40))
        assert ids.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|><|endoftext|>é"):
        assert ids.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_every_character_of_the_ranked_form_tokenizes_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.Ids(packing.VOCABULARY)
    plain = [c for c in map(chr, range(0x2B0)) if not ids.odd(c)]
    assert len(plain) == 0x2B0 - 5 and ids.odd("<|endoftext|>")
    texts = [f.format(c) for c in plain for f in ("{0}", "a{0}b", " {0} {0}", "1{0}{0}2", "'{0}", "{0}'s  {0}\n{0}", "x {0}y\t{0} ")]
    texts += [a + b + a for a in plain for b in (" ", "\n", "'", "a", "1", "é", "!", "\u00a0")]
    assert all(ids.encode(t).tolist() == e.ids for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False)))


# Toxicity.


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_model(docs, labels.where("doc_id % 3 <> 0"))
    held = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in held.groupBy("label", "toxic").count().collect()}
    assert n[1, True] >= 0.85 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.005 * n[0, False]
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2


def test_candidates_equal_brute_force(spark, docs, labels):
    sample = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).cache()
    seen = collections.defaultdict(lambda: [0, 0])
    rows = sample.collect()
    for r in rows:
        own = set()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").lower()):
            own |= {w, *(w[:k] + "~" for k in toxicity.STEMS if len(w) > k)}
        for f in own:
            seen[f][r["toxic"]] += 1
    n = collections.Counter(r["toxic"] for r in rows)
    strength, odds = {}, {}
    for f, (clean, tox) in seen.items():
        odds[f] = np.log((tox + 0.1) / (n[1] + 1)) - np.log((clean + 0.1) / (n[0] + 1))
        if tox + clean >= toxicity.LEAST_DOCS and not (odds[f] > 0 and clean * n[1] > 0.2 * tox * n[0]):
            strength[f] = abs(odds[f]) * np.sqrt(min(tox + clean, 50)) * (0.1 if odds[f] < 0 else 1)
    got = toxicity.candidates(sample, n[1], n[0], 300)
    assert len(got) == min(300, len(strength)) and all(abs(x - odds[f]) < 1e-9 for f, x in got)
    least = sorted(strength.values())[-len(got)]
    assert all(strength[f] >= least - 1e-9 for f, _ in got)


def test_ordinal_regression_orders_grades():
    draw = np.random.default_rng(0)
    x = draw.normal(size=600)
    grades = (x > -0.5).astype(int) + (x > 0.8)
    w, t = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x, grades, 1, 3)
    assert t[0] < t[1] and ((x * w[0])[:, None] > t).sum(1).tolist().count(0) > 0
    assert (((x * w[0])[:, None] > t).sum(1) == grades).mean() > 0.9


def test_toxicity_odd_rows(docs, labels, odd, none, spark):
    model = toxicity.fit_model(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["severity"] <= 2 for r in got)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0
    empty = toxicity.fit_model(docs, labels.limit(0))
    assert toxicity.keep_clean(odd, empty).count() == len(ODD)
    confused = labels.selectExpr("doc_id", "quality", "1 - toxic toxic").unionAll(labels.select("doc_id", "quality", "toxic"))
    assert toxicity.fit_model(docs, confused) == toxicity.Model({}, ())


# Similar groups.


def brute_groups(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(lower(t))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(frozenset(own))
    ids = [d for d in sets if d is not None]
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(d, len(s)): None if d is None else root(d) for d, own in sets.items() for s in own}


def near(seed, n=400):
    draw = random.Random(seed)
    base = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 70))) for _ in range(25)]
    out = []
    for k in range(n):
        w = draw.choice(base).split()
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(w))
            w[at : at + 1] = draw.choice([[], [w[at], "x"], [draw.choice("abcxyz")]]) or ["q"]
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 8, 10)])
def test_groups_equal_brute_force(spark, n, num, den):
    rows = [(d, t) for d, t in near(n) + [(d and d + 1000, t) for d, t in ODD]]
    rows += [(2000, "p q r s t u v"), (2000, "a completely different text of one id"), (2001, "p q r s t u v"), (2002, "a completely different text of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.similar_groups(df, n, num, den).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == brute_groups(rows, n, num, den)


def test_hot_group_of_near_copies(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(500):
        w = list(base)
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = f"v{draw.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == brute_groups(rows, 3, 90, 100)


def test_small_sets_share_the_subsets_that_links_need():
    draw = np.random.default_rng(3)
    for s in range(1, 26):
        x = np.unique(draw.integers(0, 2**63, s, np.uint64))
        for t in jaccard_join.partners(9, 10, s):
            o = jaccard_join.common_needed(9, 10, s, t)
            if t < o or s < o or (s == t == o):
                continue
            y = np.unique(np.concatenate([x[: min(o, s)], draw.integers(0, 2**63, t - min(o, s), np.uint64)]))
            keys = [{(k, side) for k, side in jaccard_join.subset_keys(z, 9, 10, 48)} for z in (x, y)]
            assert {k for k, _ in keys[0]} & {k for k, _ in keys[1]}


def test_keep_one(odd, none):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[8] == 2 and 9 not in ids and ids[None] == 1 and ids[1] == ids[2] == ids[3] == 1
    assert jaccard_join.similar_groups(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


# Archives.


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int, path string")


def test_archives_round_trip(spark):
    urls = ["http://b.example.com/x?Q=1#f", "https://www.example.org:443/", None, "no url", "http://[bad", "http://b.example.com/x?Q=1#f"]
    html = ["<p>ü漢\r\n\r\n</p>", None, "", "<p>ü漢\r\n\r\n</p>", LONG, "<p>ü漢\r\n\r\n</p>"]
    rows = [(k + 1, u, h, 0, "p") for k, (u, h) in enumerate(zip(urls, html))] + [(1, urls[0], html[0], 0, "p"), (None, "http://x.y/", html[0], 0, "p")]
    captures, directory = warc.archive_pages(spark, pages_of(spark, rows).repartition(3), block_lines=2)
    got = warc.read_back(directory).collect()
    assert len(got) == len(rows) == captures.count()
    first = {}
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for r in got:
        h = next((x or "") for p, u, x, *_ in rows if p == r["page_id"] and u == r["url"])
        assert r["payload_bytes"] == len(h.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        revisit = r["page_id"] != first[h]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else h)
    index = warc.CaptureIndex([tuple(r)[:4] for r in directory.collect()])
    assert sorted(str(r[0]) for r in index.lookup("http://B.example.com/x?Q=1")) == ["1", "1", "6"]
    assert index.lookup("http://b.example.com/x?q=1") == []
    assert index.lookup("http://nowhere.example/") == []
    keys = [k for r in sorted(directory.collect()) for k, *_ in warc.block_lines_of(r["path"], r["start"], r["length"])]
    assert keys == sorted(keys) and len(keys) == len(rows)


@pytest.mark.parametrize("lines", [1, 2, 3, 1000])
def test_bisection_finds_what_a_full_read_finds(spark, lines):
    draw = random.Random(lines)
    urls = [f"http://h{draw.randrange(9)}.example/{'Aab'[k % 3]}{draw.randrange(6)}" for k in range(90)] + ["http://hot.example/x"] * 60 + [None, "no url", "http://é.example/ü"]
    captures, directory = warc.archive_pages(spark, pages_of(spark, [(k, u, f"<p>{k % 7}</p>", 0, "p") for k, u in enumerate(urls)]).repartition(5), block_lines=lines)
    every = sorted(map(str, warc.read_back(directory).collect()))
    assert len(every) == len(urls)
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(map(str, warc.read_back(warc.asked_blocks(asked, directory, 2)).collect())) == every
    some = ["http://hot.example/x", "http://h3.example/A1", "http://h3.example/none", "zzz", None]
    got = warc.read_back(warc.asked_blocks(spark.createDataFrame([(u,) for u in some], "url string"), directory)).collect()
    assert sorted(r["page_id"] for r in got) == [k for k, u in enumerate(urls) if u in some]
    index = warc.CaptureIndex([tuple(r)[:4] for r in directory.collect()])
    for u in some:
        assert sorted(r[0] for r in index.lookup(u)) == [k for k, x in enumerate(urls) if x == u]


def test_records_are_http_messages_with_dates():
    raw = warc.record(7, "http://x.y/é", "<p>é</p>".encode(), "D", None, False, "2024-01-02T03:04:05Z", "a.0")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert fields["WARC-Date"] == "2024-01-02T03:04:05Z" and fields["Content-Type"] == "application/http; msgtype=response"
    assert rest.startswith(b"HTTP/1.1 200 OK\r\n") and rest.endswith(b"\r\n\r\n<p>\xc3\xa9</p>\r\n\r\n") and len(rest) == int(fields["Content-Length"]) + 4
    revisit = warc.record(8, None, b"<p>", "D", 7, True, "2024-01-02T03:04:05Z", "a.9")
    assert warc.parse(revisit)[:6] == (8, None, 3, "D", "revisit", 7) and b"<urn:page:8:D:a.9>" in revisit and b"WARC-Refers-To: " + fields["WARC-Record-ID"].encode() in revisit


def test_short_payloads_are_responses(spark):
    rows = [(k, "http://x.y/", "ab", 0, "p") for k in range(3)]
    _, directory = warc.archive_pages(spark, pages_of(spark, rows), least_bytes=3)
    assert {r["record_type"] for r in warc.read_back(directory).collect()} == {"response"}
    _, directory = warc.archive_pages(spark, pages_of(spark, []))
    assert warc.read_back(directory).count() == 0


def test_surt():
    assert warc.surt("https://User@WWW.Example.com:8080/A/b?C=d#e") == "com,example,www:8080)/A/b?C=d"
    assert warc.surt("http://example.com") == "com,example)/" and warc.surt(None) == ""


# Quality rules.


def brute_statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    spans = collections.defaultdict(list)
    for k in range(len(w) - 4):
        spans[tuple(w[k : k + 5])].append(k)
    covered = {k + j for at in spans.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(docs, odd):
    every = docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    got = quality_rules.judge(every, [])
    want = collections.Counter((r["doc_id"], *brute_statistics(r["text"])) for r in every.collect())
    assert collections.Counter(tuple(r)[:6] for r in got.collect()) == want
    assert got.where("base_failed <> (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) OR kept = base_failed").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_long_texts_are_cut_and_counted_alike(spark, monkeypatch, piece):
    draw = random.Random(piece)
    marks = [" ", " ", "\n", "\n\n", "\t ", "\r\n", "\u00a0"]
    text = lambda n: "".join(draw.choice(["a", "b", "c1!", "d#", "\u00e9\U0001f600", "w" * 250]) + draw.choice(marks) for _ in range(n))
    texts = [*(text(n) for n in (1, 4, 5, 6, 9, 60, 300)), "a " * 500, " \n\t" * 90, "w" * 2000, "same line\n" * 80, "\n x" * 40, None, "", "short one"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5]), (None, texts[6])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_key string").repartition(3)
    whole = quality_rules.measured(docs, "s").selectExpr("doc_id", "text", "s.*").collect()
    for name, value in (("LONG_SPACES", 8), ("LONG_BYTES", 600), ("PIECE", piece)):
        monkeypatch.setattr(quality_rules, name, value)
    cut = quality_rules.measured(docs, "s")
    assert cut.columns == [*docs.columns, "s"]
    assert collections.Counter(map(tuple, cut.selectExpr("doc_id", "text", "s.*").collect())) == collections.Counter(map(tuple, whole))
    want = collections.Counter((d, *brute_statistics(t)) for d, t in rows)
    assert collections.Counter(tuple(r)[:6] for r in quality_rules.judge(docs, []).collect()) == want
    longs = docs.where(quality_rules.is_long(quality_rules.text_of(docs)))
    assert longs.count() > 8
    most = quality_rules.pieces(longs, quality_rules.spaced(quality_rules.text_of(longs)), " ").selectExpr("max(length(part))").first()[0]
    assert most <= max(2000, piece + 252)  # a word is not cut


def test_rules_are_native_and_good(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit_rules(docs, labels.where("doc_id % 3 <> 0"))
    assert rules and all(str(r) for r in rules)
    judged = quality_rules.judge(docs, rules)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    held = judged.join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in held}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_learned_lists_find_planted_rules():
    draw = random.Random(6)
    rows = [tuple(draw.random() for _ in quality_rules.FEATURES) for _ in range(1500)]
    bad = [r[2] > 0.8 or (r[0] <= 0.3 and r[4] > 0.7) for r in rows]
    rules = quality_rules.learn(rows, bad)
    said = [any(x.covers(r) for x in rules) for r in rows]
    assert sum(a == b for a, b in zip(said, bad)) > 0.97 * len(rows)


def brute_cover(rows, bad, most_tests=4):
    """The covering from its definition: every test on every feature, gains counted from scratch."""
    every = lambda live: [
        quality_rules.Test(name, above, (a + b) / 2)
        for k, name in enumerate(quality_rules.FEATURES)
        for a, b in zip(sorted({rows[i][k] for i in live}), sorted({rows[i][k] for i in live})[1:])
        for above in (False, True)
    ]
    covered = lambda tests, some: [i for i in some if all(t.holds(rows[i]) for t in tests)]
    share = lambda some: np.mean([bad[i] for i in some]) if some else 0.0
    out, left = [], list(range(len(rows)))
    while len(out) < 12:
        held, grown, tests = left[::3], [i for k, i in enumerate(left) if k % 3], []
        while len(tests) < most_tests and 0 < share(live := covered(tests, grown)) < 1:
            best, chosen = 1e-9, None
            for t in every(live):
                hit = covered([t], live)
                gain = sum(bad[i] for i in hit) * np.log2(share(hit) / share(live)) if share(hit) else 0.0
                if gain > best:
                    best, chosen = gain + 1e-9, t
            if not chosen:
                break
            tests.append(chosen)
        if not tests:
            break

        def worth(n):
            hit = covered(tests[:n], held)
            return (sum(bad[i] for i in hit) + 1) / (len(hit) + 2) + sum(bad[i] for i in hit) / (10 * len(held) + 1)

        while len(tests) > 1 and worth(len(tests) - 1) >= worth(len(tests)):
            tests.pop()
        hit = covered(tests, left)
        if sum(bad[i] for i in hit) < 3 or share(hit) < 0.9 or covered(tests, held) and share(covered(tests, held)) < 0.9:
            break
        out.append(quality_rules.Rule(tuple(tests)))
        left = [i for i in left if i not in hit]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_covering_equals_a_full_search(seed):
    draw = random.Random(seed)
    rows = [tuple(float(draw.randrange(9)) for _ in quality_rules.FEATURES) for _ in range(240)]
    bad = [(r[1] > 5 and r[3] <= 4) or r[6] > 7 or draw.random() < 0.01 * seed for r in rows]
    rules = quality_rules.learn(rows, bad)
    assert rules and rules == brute_cover(rows, bad)


def test_quality_odd_rows(odd, none, labels, docs):
    rules = quality_rules.fit_rules(docs, labels)
    assert quality_rules.judge(odd, rules).count() == len(ODD) and quality_rules.judge(none, rules).count() == 0
    assert quality_rules.keep_good(odd, rules).columns == odd.columns
    assert quality_rules.fit_rules(docs, labels.limit(0)) == [] and quality_rules.fit_rules(none.selectExpr("doc_id", "text"), labels) == []
    both = labels.unionAll(labels.selectExpr("doc_id", "1 - quality", "toxic"))
    assert quality_rules.fit_rules(docs, both) == []


# Decontamination.


def test_leaks(spark, data):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = decontamination.word_list
    grams = collections.defaultdict(set)
    for k, t in items.items():
        w = words(t)
        for j in range(len(w) - 5):
            grams[tuple(w[j : j + 6])].add(k)

    def shares(text):
        found = collections.defaultdict(set)
        w = words(text)
        for j in range(len(w) - 5):
            for k in grams.get(tuple(w[j : j + 6]), ()):
                found[k].add(tuple(w[j : j + 6]))
        return {k: len(s) / (len(words(items[k])) - 5) for k, s in found.items()}

    draw = random.Random(5)
    planted, rows = set(), [(r["doc_id"], r["text"]) for r in docs]
    clean = [r["text"] for r in docs if not shares(r["text"]) and len(r["text"]) > 400]
    for j, (k, t) in enumerate(sorted(items.items())):
        w = t.split()
        for _ in range(len(w) // 10 if j % 2 else 0):  # every other copy with words changed
            w[draw.randrange(len(w))] = "changed"
        host = clean[j % len(clean)].split()
        at = draw.randrange(len(host))
        rows.append((100_000 + j, " ".join(host[:at] + w + host[at:])))
        planted.add((100_000 + j, k))
    exact = {(d, k) for d, t in rows for k, s in shares(t).items() if s >= 0.99}
    known = {(d, k) for d, t in rows for k, s in shares(t).items() if s > 0}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, benchmark).collect()}
    assert exact <= got
    assert len(planted & got) >= 0.95 * len(planted)
    assert got <= planted | known
    left = {r["doc_id"] for r in decontamination.without_leaks(df, benchmark).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_short_and_edited_items(spark):
    """Copies of items of 8 to 31 words, as they are and with a quarter of the words replaced."""
    draw = random.Random(9)
    words = decontamination.word_list
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(400)
    rows = [(r["doc_id"], " ".join(r["text"].split())) for r in docs.collect()]
    hosts = [(d, t.split()) for d, t in rows if len(t.split()) > 80 and "|" not in t and len(words(t)) == len(t.split())]
    benchmark, copies = [], set()
    for k, n in enumerate([8] * 40 + [9, 10, 12, 16, 24, 31] * 10):
        d, host = hosts[k % len(hosts)]
        at = draw.choice([j for j in range(len(host) - n) if all(len(words(x)) == 1 for x in host[j : j + n])])
        item = host[at : at + n]
        benchmark.append((k, " ".join(item)))
        copies.add((d, k))
        where = draw.sample(range(n), n // 4)
        other = draw.choice(hosts)[1]
        cut = draw.randrange(len(other))
        rows.append((100_000 + k, " ".join(other[:cut] + ["changed" if j in where else x for j, x in enumerate(item)] + other[cut:])))
        answer = set(range(decontamination.Queries.of(benchmark[-1:]).items[0].answer, n))
        if len(answer - set(where)) >= 0.5 * len(answer):
            copies.add((100_000 + k, k))
    more = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").selectExpr("item_id + 1000", "text")
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, spark.createDataFrame(benchmark, "item_id long, text string").unionAll(more)).where("item_id < 1000").collect()}
    assert copies <= got, f"{len(copies & got)} of {len(copies)} found"
    texts = dict(rows)
    for d, k in got - copies:  # nothing but what has most of the item in order
        terms = {}
        ids = np.array([terms.setdefault(x, len(terms)) for x in words(benchmark[k][1])])
        own = decontamination.common_length(decontamination.masks(ids), np.array([terms.get(x, -1) for x in words(texts[d])]), len(ids))
        assert own >= 0.6 * len(ids)
    print(f"{len(copies & got)} of {len(copies)} copies, {len(got - copies)} other pairs")


def test_recall_of_paraphrases_against_brute_force(spark):
    """Copies with words replaced, dropped and inserted and with sentences in another order: all
    pairs that verification accepts anywhere in a document, tried at every window, against the search."""
    draw = random.Random(12)
    given = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").limit(60)
    items = [(r["item_id"], r["text"]) for r in given.collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND length(text) BETWEEN 300 AND 1500").orderBy("doc_id").limit(120)
    rows = []
    for k, (d, text) in enumerate((r["doc_id"], r["text"]) for r in docs.collect()):
        host = text.split()
        _, item = items[k % len(items)]
        sentences = re.split(r"(?<=[.!?])\s+", item)
        draw.shuffle(sentences)
        own = (" ".join(sentences) if k % 3 == 0 else item).split()
        for _ in range(len(own) // draw.choice((4, 5, 8))):
            at = draw.randrange(len(own))
            own[at : at + 1] = draw.choice([["changed"], [], [own[at], "extra"]])
        cut = draw.randrange(len(host))
        rows.append((d, " ".join(host[:cut] + own + host[cut:])))
    queries = decontamination.Queries.of(items)
    wordings = [(decontamination.Wording(i.ids, i.sentences), decontamination.Wording(i.ids[i.answer :], i.sentences), i) for i in queries.items]
    every = set()
    for d, text in rows:
        ids = np.array([queries.terms.get(w, -1) for w in decontamination.word_list(text)], np.int32)
        for whole, answer, i in wordings:
            n = len(i.ids)
            if len(set(ids.tolist()) & set(i.ids.tolist())) < 0.6 * len(set(i.ids.tolist())) / 2:
                continue
            for start in range(0, len(ids), decontamination.STRIDE):
                region = ids[max(0, start - n) : start + decontamination.WINDOW + n]
                if whole.share(region, decontamination.ITEM_SHARE) >= decontamination.ITEM_SHARE and answer.share(region, decontamination.ANSWER_SHARE) >= decontamination.ANSWER_SHARE:
                    every.add((d, i.item_id))
                    break
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, given).collect()}
    assert len(every) > 80 and len(got & every) >= 0.9 * len(every), f"{len(got & every)} of {len(every)}"
    print(f"{len(got & every)} of {len(every)}, {len(got - every)} others")


def test_nystroem_finds_the_leading_vectors():
    draw = np.random.default_rng(4)
    a = draw.normal(size=(400, 60)) * np.linspace(3, 0.01, 60) ** 8
    start, _ = np.linalg.qr(draw.normal(size=(60, 30)))
    vectors, values = decontamination.nystroem(a.T @ (a @ start), start)
    true, own = np.linalg.eigh(a.T @ a)
    assert np.all(np.diff(values) <= 0) and np.allclose(values[:8], true[::-1][:8], rtol=0.02)
    assert np.linalg.norm(own[:, -5:].T @ vectors[:, :8], axis=1).min() > 0.99
    vectors, values = decontamination.nystroem(np.zeros((60, 30)), start)
    assert vectors.shape == (60, 30) and np.isfinite(vectors).all()


def test_reordered_sentences(spark, docs):
    a, b = "One two three four five six seven eight nine ten.", "Red green blue white black grey pink brown gold lime."
    given = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").selectExpr("item_id + 10 item_id", "text")
    several = [(k, s) for k, t in given.collect() if len(s := re.split(r"(?<=[.!?])\s+", t)) > 1]
    benchmark = spark.createDataFrame([(1, f"{a} {b}")], "item_id long, text string").unionAll(given)
    rows = [(1, f"before {b} {a} after"), (2, f"before {a} after {a}"), (3, " ".join(reversed(f"{a} {b}".split())))]
    rows += [(k, f"before {' '.join(reversed(s))} after") for k, s in several]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionAll(docs.selectExpr("doc_id + 100000", "text")).coalesce(2)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, benchmark).where("doc_id < 100000").collect()}
    want = {(1, 1), *((k, k) for k, _ in several)}
    assert got == want, f"{len(want & got)} of {len(want)} found, {len(got - want)} others"


@pytest.mark.parametrize("more", [[], [(9, "an item that is long enough for the search of windows")]])
def test_items_of_a_few_words(spark, more):
    benchmark = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "name the the capital"), (3, "one"), (4, "x y z a b c d"), *more], "item_id long, text string")
    rows = [(1, "and who  wrote: faust, she asked"), (2, "who wrote the faust"), (3, "Who wrote"), (4, "faust?"), (5, "name the the capital"), (6, "name the capital"), (7, "two one"), (8, "0 x y z a b c d"), (9, "x y z a b c"), (10, "d x y z a b c")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got) == [(1, 1, 1), (5, 2, 0), (7, 3, 1), (8, 4, 1)]


def test_longest_common_subsequence():
    draw = random.Random(8)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_length(decontamination.masks(np.array(a, int)), np.array(b, int), len(a)) == table[-1][-1]


def test_windows_are_the_matrix():
    draw = np.random.default_rng(2)
    blobs = [draw.integers(-1, 9, n).astype(np.int32) for n in (0, 1, 16, 17, 32, 40, 100)]
    w = decontamination.Windows([b.tobytes() for b in blobs], 9)
    dense = []
    for b in blobs:
        halves = [b[k : k + 16] for k in range(0, len(b), 16)]
        for k in range(max(1, len(halves) - 1) if halves else 0):
            dense.append(np.concatenate(halves[k : k + 2]))
    a = np.array([[np.sum(x == t) for t in range(9)] for x in dense], float)
    table = draw.normal(size=(9, 4)).astype(np.float32)
    assert len(w) == len(dense) and np.allclose(w.projected(table), a @ table, atol=1e-4)
    rows = draw.normal(size=(len(dense), 3)).astype(np.float32)
    assert np.allclose(w.back(rows, 9), a.T @ rows, atol=1e-4)
    idf = draw.random(9)
    assert np.allclose(w.norms(idf, 2.0) ** 2, ((a * idf) ** 2).sum(1) + [4.0 * np.sum(x < 0) for x in dense], rtol=1e-4)


def test_decontamination_odd_rows(spark, odd, none, data):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "an item without an id has no name to report here"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontamination.contaminated(odd, benchmark).count() == 0
    assert decontamination.contaminated(none, benchmark).count() == 0
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0
    assert decontamination.without_leaks(odd, benchmark).columns == odd.columns
    leak = spark.createDataFrame([(7, "before one two three four five six seven eight nine ten after"), (7, "One, two: three four five six seven eight nine ten!")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontamination.contaminated(leak, benchmark).collect()] == [(7, 4)]


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


# Registered queries and the pipeline.


def test_thirteen_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages_equal_their_definitions(spark, data, docs, labels):
    import corpus_pipeline

    stage, benchmark = docs, spark.read.parquet(f"{data}/benchmark.parquet")

    def kept(name, before):
        return {
            "toxicity": lambda: {r["doc_id"] for r in toxicity.score(before, toxicity.fit_model(docs, labels)).collect() if not r["toxic"]},
            "quality_rules": lambda: {r["doc_id"] for r in quality_rules.judge(before, quality_rules.fit_rules(docs, labels)).collect() if r["kept"]},
            "jaccard_join": lambda: set(brute_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 8, 10).values()),
            "decontamination": lambda: {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in decontamination.contaminated(before, benchmark).collect()},
        }[name]()

    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, data)
        assert after.columns == docs.columns
        path = f"{shared_dir(spark)}/test-{name}"
        after.write.mode("overwrite").parquet(path)
        want = kept(name, stage)
        stage = spark.read.parquet(path)
        assert {r["doc_id"] for r in stage.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, data).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in stage.collect()}
    check_sequences(packed)
