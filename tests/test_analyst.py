"""Fixtures with known outcomes: roles, cleaning, series, frames, briefs, questions."""

import collections
import json
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.functions.columns import spark_names, unique_names
from lodeline.functions.text import format_number, format_period, plain
from lodeline.operators import cleaning, evidence, frames, report, roles, stats, timeseries
from lodeline.plans import compiler, parser, planner
from lodeline.plans.model import QueryPlan, Roles, ValueFilter
from lodeline.sources.demo import demo


@pytest.fixture(scope="module")
def orders(spark):
    return demo(spark, rows=900).cache()


@pytest.fixture(scope="module")
def found(orders):
    return roles.detect_roles(orders)


def series(spark, values, start=datetime(2024, 1, 1)):
    return spark.createDataFrame([(timeseries.add_months(start, k), float(v)) for k, v in enumerate(values)], "period timestamp_ntz, value double")


# Names and numbers.


def test_names():
    assert unique_names([" a  b ", "a b", None, "x", "x_2", "x"]) == ["a b", "a b_2", "column_3", "x", "x_2", "x_3"]
    assert spark_names(["Region", "region"]) == ["Region", "region_2"]
    assert plain("  Order-ID? ") == "order id"


def test_numbers():
    assert format_number(1_250_000, "Revenue") == "$1.2M"
    assert format_number(12.0) == "12" and format_number(12.345) == "12.35" and format_number(-5, "cost") == "$-5.00"
    assert format_number(float("nan")) == format_number(None) == "—" and format_number(2_500) == "2.5K"
    at = datetime(2025, 3, 8)
    assert [format_period(at, g) for g in "QWDYM"] == ["Q1 2025", "08 Mar 2025", "08 Mar 2025", "2025", "Mar 2025"]


# Roles and focus.


def test_roles(found):
    assert (found.date, found.measure, found.dimension, found.identifier) == ("Order Date", "Revenue", "Product", "Order ID")
    assert found.dimensions == ("Product", "Region", "Channel")


def test_identifier_is_no_measure(spark):
    df = spark.createDataFrame([(10_000 + k, 100 + k, "West" if k % 2 else "East") for k in range(20)], "`Customer ID` long, Revenue long, Region string")
    r = roles.detect_roles(df)
    assert (r.measure, r.identifier, r.dimension) == ("Revenue", "Customer ID", "Region")


@pytest.mark.parametrize("table,date,measure,dimension,identifier", [
    ("lineitem", "l_shipdate", "l_extendedprice", "l_linestatus", None),
    ("orders", "o_orderdate", "o_totalprice", "o_orderstatus", None),
    ("events", "ts", "value", "event_type", "event_id"),
    ("labels", None, "quality", None, "doc_id"),
])
def test_roles_of_tables(spark, table, date, measure, dimension, identifier):
    r = roles.detect_roles(spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet"))
    assert (r.date, r.measure, r.dimension, r.identifier) == (date, measure, dimension, identifier)


def test_focus(orders, found):
    options = roles.focus_options(orders, found).collect()
    assert options[0]["value"] == "Core" and len(options) == 4
    part, own = roles.apply_focus(orders, found, "Enterprise")
    assert own.dimension == "Region" and part.select("Product").distinct().count() == 1
    assert roles.apply_focus(orders, found, "nothing")[1] == found
    assert roles.select_roles(found, date="None", measure="Profit", dimension="Channel") == Roles(None, "Profit", "Channel", "Order ID", found.numeric, found.dimensions)


# Cleaning.


def test_cleaning(spark):
    raw = spark.createDataFrame([(k, " 10.5 " if not k else "20", "2024-01-01" if not k else "2024-01-02", " West " if not k else "East", None) for k in range(4)], "`Unnamed: 0` long, ` amount ` string, `Order Date` string, Region string, Empty double").coalesce(1)
    df, audit = cleaning.clean(raw)
    out = df.orderBy("_ord").drop("_ord")
    assert out.columns == ["amount", "Order Date", "Region"]
    assert dict(out.dtypes) == {"amount": "double", "Order Date": "timestamp_ntz", "Region": "string"}
    assert out.first()["Region"] == "West" and out.count() == 2
    assert [audit.operations[f"{x} removed"] for x in ("Exported index columns", "Empty columns", "Duplicate rows")] == [1, 1, 2]
    assert {r["operation"]: r["count"] for r in cleaning.audit_frame(df, audit).collect()}["Numeric columns inferred"] == 1


def test_cleaning_refuses_nothing(spark):
    with pytest.raises(ValueError):
        cleaning.clean(spark.createDataFrame([], "a string"))
    with pytest.raises(ValueError):
        cleaning.clean(spark.createDataFrame([(None,)], "a string"))


@pytest.mark.parametrize("text,value", [("1,000", None), ("$5", None), ("1d", None), ("1f", None), ("0x10", None), (" 5 ", 5.0), ("1e3", 1000.0), ("+5", 5.0), (".5", 0.5), ("1.", 1.0), ("nan", None), ("inf", float("inf"))])
def test_parsed_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(cleaning.parsed_number(cleaning.stripped("v")).alias("x")).first()["x"] == value


def test_blanks_count_against_typing(spark):
    rows = [(str(k), "a1") for k in range(18)] + [(" ", "a1"), (" ", "a1")]
    df, audit = cleaning.clean(spark.createDataFrame(rows, "amount string, zip string"))
    assert audit.operations["Numeric columns inferred"] == 0 and dict(df.dtypes)["amount"] == "string"


def test_bound(spark):
    prepared = cleaning.prepare(demo(spark, rows=100), row_limit=80)
    assert prepared.truncated_rows == 20 and prepared.audit.before[0] == 80
    assert prepared.analyze().facts


# Statistics.


def test_insights(spark):
    df = spark.createDataFrame([(10, 1, "West"), (20, 2, "West"), (30, 3, "West"), (40, 4, "East"), (1000, 100, "West")], "sales long, units long, region string")
    titles = [i.title for i in evidence.insights(df)]
    assert "Strongest numeric relationship" in titles and "Largest category share" in titles and "Potential outliers" not in titles


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0), (None, 9.0)], "k string, v double")
    assert {r["segment"]: r["value"] for r in frames.segments(df, Roles(None, "v", "k")).collect()} == {"a": 0.0, "b": 2.0}
    assert {r["column"]: r["missing"] for r in stats.missing_by_column(df).collect()} == {"v": 2, "k": 1}
    means = {r["segment"]: r["value"] for r in frames.grouped(df, "k", "v", "mean").collect()}
    assert means == {"a": None, "b": 2.0}


def test_constant_correlation_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 5.0, float(k)) for k in range(4)], "a double, b double, c double")
    assert stats.strongest_pair(df, ["a", "b", "c"]).first() is None


def test_profile(spark):
    df = spark.createDataFrame([("x", True, 1.5), ("y", None, 2.5)], "`a.b` string, flag boolean, n double")
    p = {r["column"]: r for r in stats.profile(df).collect()}
    assert p["a.b"]["type"] == "category" and p["flag"]["type"] == "numeric" and p["flag"]["missing"] == 1 and p["flag"]["example"] == "True"


# Time series.


def test_spike(spark):
    values = 100 + np.random.default_rng(7).normal(0, 3, 18)
    values[9] = 200
    (a,) = timeseries.detect_anomalies(series(spark, values))
    assert a.period == datetime(2024, 10, 1) and a.direction == "above" and a.severity > 3


def test_dip_line_and_short(spark):
    values = 500 + np.random.default_rng(11).normal(0, 10, 16)
    values[12] = 180
    assert timeseries.detect_anomalies(series(spark, values))[0].direction == "below"
    assert timeseries.detect_anomalies(series(spark, [100 + 10 * k for k in range(14)])) == ()
    assert timeseries.detect_anomalies(series(spark, [1, 2, 300, 4, 5])) == ()


def test_forecasts(spark):
    line = timeseries.build_forecast(series(spark, [100 + 10 * k for k in range(16)]))
    assert len(line.ahead) == 6 and abs(line.ahead[0][1] - 260) < 1e-6 and line.error_percent == 0.0
    assert timeseries.build_forecast(series(spark, range(100, 170, 10))) is None
    assert len(timeseries.build_forecast(series(spark, range(100, 108))).ahead) == 4
    noise = np.random.default_rng(9).normal(0, 6, 30)
    seasonal = timeseries.build_forecast(series(spark, [1000 + 12 * k + 90 * np.sin(2 * np.pi * k / 12) + noise[k] for k in range(30)]))
    assert "seasonality" in seasonal.method and seasonal.error_percent < 15
    falling = timeseries.build_forecast(series(spark, [*range(800, 0, -100), 50, 10]))
    assert min(x for _, *row in falling.ahead for x in row) >= 0
    gapped = timeseries.build_forecast(series(spark, [100 + 5 * k for k in range(14)]).where("period <> timestamp_ntz'2024-07-01'"))
    periods = [row[0] for row in gapped.ahead]
    assert len(periods) == 6 and periods == sorted(set(periods))


# Frames and briefs.


def test_drivers_sum_to_the_change(orders, found):
    trend = frames.trend(orders, found, "M")
    (before, a), (now, b) = frames.last_two(trend)
    change = frames.period_change(orders, found, "M", before, now)
    assert abs(sum(r["change"] for r in frames.drivers(change, 2).collect()) - (b - a)) < 1e-6
    assert frames.segments(orders, found).first()["segment"] == "Enterprise"
    wide = frames.matrix(frames.heatmap(orders, found, limit=3, grain="Q"))
    assert len(wide.columns) == 9 and wide.count() == 3


def test_brief(orders, found):
    brief = evidence.analyze(orders, found)
    assert [e.kind for e in brief.facts][:3] == ["trend", "driver", "leader"]
    assert len(brief.tiles) == 4 and 1 <= len(brief.steps) <= 4 and all(t.value for t in brief.tiles)
    text = report.business_report(orders, brief, source_name="demo", context="Q4")
    assert brief.headline in text and all(e.calculation in text for e in brief.facts)


def test_decline_starts_with_its_segment(spark):
    rows = [(datetime(2025, m, 15), float(v), r) for m, v, r in zip(range(1, 6), (1000, 1100, 1200, 1300, 600), ("West", "West", "East", "East", "West"))]
    df = spark.createDataFrame(rows, "Date timestamp_ntz, Revenue double, Region string")
    brief = evidence.analyze(df, Roles("Date", "Revenue", "Region", None, ("Revenue",), ("Region",)))
    assert brief.steps[0].title == "Start with East"


def test_generic_report(spark, orders):
    df, audit = cleaning.clean(orders)
    text = report.data_report(df, audit, evidence.insights(df))
    assert "## Data dictionary" in text and "**Revenue**" in text


# Questions.


@pytest.mark.parametrize("question,expected", [
    ("What is the total revenue?", {"intent": "aggregate", "aggregation": "sum", "measure": "Revenue"}),
    ("average profit by region", {"intent": "breakdown", "aggregation": "mean", "dimension": "Region", "measure": "Profit"}),
    ("top 3 products by revenue", {"intent": "rank", "top_n": 3, "ascending": False, "dimension": "Product"}),
    ("bottom 2 regions by profit", {"intent": "rank", "top_n": 2, "ascending": True}),
    ("monthly revenue trend", {"intent": "trend", "grain": "M"}),
    ("which product grew fastest?", {"intent": "growth", "dimension": "Product"}),
    ("how many orders are there?", {"intent": "count", "count_column": "Order ID"}),
    ("how many rows do we have?", {"intent": "count", "count_column": None}),
    ("total revenue in 2025", {"intent": "aggregate", "year": 2025}),
    ("total revenue in March 2025", {"year": 2025, "month": 3}),
    ("total revenue in the West", {"filters": (ValueFilter("Region", ("West",)),)}),
])
def test_questions(orders, found, question, expected):
    plan = parser.parse(question, orders, found)
    assert {k: getattr(plan, k) for k in expected} == expected
    assert compiler.answer(question, orders, found).answer


def test_refusals(orders, found):
    assert parser.parse("tell me a joke", orders, found) is None
    assert parser.parse("  ?", orders, found) is None
    dateless = Roles(None, "Revenue", "Product", None, found.numeric, found.dimensions)
    assert parser.parse("monthly revenue trend", orders, dateless).intent != "trend"
    with pytest.raises(ValueError):
        compiler.execute(QueryPlan("aggregate", measure="Nope"), orders, found)
    assert "nothing was calculated" in compiler.execute(QueryPlan("count", year=1980), orders, found).answer


def test_suggestions_are_answerable(orders, found):
    for s in parser.suggestions(found):
        assert compiler.answer(s, orders, found) is not None


def test_answers_hold_numbers(orders, found):
    exact = orders.where("year(`Order Date`) = 2025 AND Region = 'West'").agg(F.sum("Revenue")).first()[0]
    assert format_number(exact, "Revenue") in compiler.answer("total revenue in 2025 in the West", orders, found).answer
    assert "May 2025" in compiler.answer("total revenue in May 2025", orders, found).answer
    share = compiler.answer("top 3 products by revenue", orders, found).table
    assert share.columns == ["Product", "Total Revenue", "Share %"] and share.count() == 3


def test_zero_base_has_no_growth(spark):
    rows = [(datetime(2025, 1, 1), "a", 0.0), (datetime(2025, 2, 1), "a", 5.0)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, k string, v double")
    own = Roles("d", "v", "k", None, ("v",), ("k",))
    assert "zero" in compiler.execute(QueryPlan("growth", measure="v", grain="M"), df, own).answer
    assert "no rate" in compiler.execute(QueryPlan("growth", measure="v", dimension="k", grain="M"), df, own).answer


# The model boundary.


def test_planner(orders, found):
    payload = planner.planner_payload("west revenue", orders, found)
    assert "Enterprise" not in payload and "Revenue" in payload
    plan = planner.plan_with(lambda *_: {"answerable": True, "intent": "aggregate", "measure": "Revenue", "filters": [{"column": "Region", "value": "west"}]}, "west revenue", orders, found)
    assert plan.source == "ai" and plan.filters == (ValueFilter("Region", ("West",)),)
    for refused in ({"answerable": False}, {"answerable": True, "measure": "Nope"}, {"answerable": True, "filters": [{"column": "Region", "value": "Mars"}]}, None):
        assert planner.plan_with(lambda *_, r=refused: r, "x", orders, found) is None
    assert planner.to_plan(planner.ProposedPlan(True, "trend"), orders, Roles(None, "Revenue")) is None
    with pytest.raises(ValueError):
        planner.ProposedPlan(True, top_n=99)


def test_narrative(orders, found):
    brief = evidence.analyze(orders, found)
    subject = next(e.subject for e in brief.facts if e.subject)
    assert subject in planner.narrative_payload(brief) and subject not in planner.narrative_payload(brief, redact=True)
    own = planner.fingerprint(planner.narrative_payload(brief))
    assert len(own) == 64 and own == planner.fingerprint(planner.narrative_payload(brief)) != planner.fingerprint(planner.narrative_payload(brief, redact=True))
    raw = {"executive_summary": "s", "strategic_read": "r", "actions": [{"title": "t", "recommendation": "d", "evidence": "e", "confidence": "low"}]}
    assert "low confidence" in planner.narrative_markdown(planner.narrate_with(lambda *_: raw, brief), model="m")
    with pytest.raises(RuntimeError):
        planner.narrate_with(lambda *_: None, brief)


# Percentiles by rank.


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], list(range(1000)), [7] * 900 + [8] * 3 + [1e9], [0] * 500 + [1] * 500, [0] * 500 + [1] * 501, [-1e300, 0, 1e300] * 50, [None, float("nan"), 3.0, 4.5]])
@pytest.mark.parametrize("small", [4, 10_000])
def test_percentiles_are_exact(spark, values, small):
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    n, got = stats.percentiles(df, ["v"], shares, small)["v"]
    own = [float(v) for v in values if v is not None and v == v]
    assert n == len(own)
    assert got == ([None] * len(shares) if not own else pytest.approx(np.percentile(own, [100 * p for p in shares]).tolist()))


def test_redaction_takes_whole_words_of_values():
    names = ["A", "facts", "segment 1", "number", "West", "West Coast"]
    texts = ["A leads; facts of West Coast, not West", "segment 1 and AA, Western, number", "x"]
    got = planner.redacted(texts, names)
    place = {n: f"segment {k}" for k, n in enumerate(sorted(names, key=lambda n: (-len(n), n)), 1)}
    assert got == [f"{place['A']} leads; {place['facts']} of {place['West Coast']}, not {place['West']}", f"{place['segment 1']} and AA, Western, {place['number']}", "x"]
    assert planner.redacted(texts, []) == texts


def test_redacted_payload_keeps_its_shape(orders, found):
    brief = evidence.analyze(orders, found)
    for name in ("A", "facts", "number", "segment 1"):
        facts = tuple(replace(f, subject=name, statement=f"{name} moved") if f.subject else f for f in brief.facts)
        open_, shut = (json.loads(planner.narrative_payload(replace(brief, facts=facts), redact=r)) for r in (False, True))
        assert shut["instructions"] == open_["instructions"] and shut["roles"] == open_["roles"]
        assert [set(f) for f in shut["facts"]] == [set(f) for f in open_["facts"]]
        assert all(f["segment"] in ("", "segment 1") for f in shut["facts"])


def test_narratives_are_told_once(orders, found):
    brief, calls = evidence.analyze(orders, found), []
    raw = {"executive_summary": "s", "strategic_read": "r", "actions": [{"title": "t", "recommendation": "d", "evidence": "e", "confidence": "low"}]}
    told = planner.Narratives(lambda *a: calls.append(a) or raw)
    assert not told.fits(brief) and told.of(brief) is told.of(brief) and told.fits(brief) and len(calls) == 1
    told.of(brief, redact=True)
    told.of(replace(brief, facts=brief.facts[1:]))
    assert len(calls) == 3
    none = planner.Narratives(lambda *_: None)
    with pytest.raises(RuntimeError):
        none.of(brief)
    assert not none.told


def test_scatter_is_bounded_and_repeats(spark):
    rows = spark.range(40_000).selectExpr("concat('s', cast(sqrt(id % 400) AS int)) AS seg", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 97 END AS x", "id * 1.5 AS y", "id AS k")
    of = Roles(None, "y", "seg", None, ("x", "y"), ("seg",))
    got = frames.scatter_sample(rows, of, "x", "y", ("k",)).collect()
    counts = collections.Counter(r["segment"] for r in got)
    assert len(counts) == frames.COLOURS + 1 and set(counts.values()) == {frames.POINTS}
    assert sorted(map(tuple, got)) == sorted(map(tuple, frames.scatter_sample(rows.repartition(7), of, "x", "y", ("k",)).collect()))
    few = frames.scatter_sample(rows.where("k < 30"), of, "x", "y", ("k",)).collect()
    assert len(few) == 27
    equal = frames.scatter_sample(rows.withColumn("k", F.lit(1)), of, "x", "y", ("k",), points=5).collect()
    assert set(collections.Counter(r["segment"] for r in equal).values()) == {5}
    grid = frames.scatter_grid(rows, "x", "y")
    assert grid.count() <= frames.BINS**2 and grid.agg(F.sum("rows")).first()[0] == rows.where("x IS NOT NULL").count()
    none = rows.where("k < 0")
    assert frames.scatter_grid(none, "x", "y").count() == frames.scatter_sample(none, of, "x", "y").count() == 0
    flat = rows.withColumn("x", F.lit(2.0))
    assert frames.scatter_grid(flat, "x", "y").select("x_bin").distinct().count() == 1
    assert frames.scatter_sample(rows, replace(of, dimension=None), "x", "y", ("k",)).count() == frames.POINTS


def test_scatter_partner_has_more_than_two_values(spark):
    rows = spark.createDataFrame([(1.0, 5, 0, 3.0, None), (2.0, 5, 1, None, None), (3.0, 5, 0, 7.0, None), (4.0, 5, 1, 5.0, None)], "m double, one int, two int, three double, none double")
    of = lambda *c: Roles(None, "m", None, None, ("m", *c))
    assert frames.scatter_partner(rows, of("none", "one", "two", "three")) == "three"
    assert frames.scatter_partner(rows, of("none", "one", "two")) is None and frames.scatter_partner(rows, of()) is None


def test_figure_of_an_answer(orders, found):
    bars = compiler.figure(compiler.answer("top 3 products by revenue", orders, found)).collect()
    assert [r["value"] for r in bars] == sorted(r["value"] for r in bars) and len(bars) == 3
    change = compiler.answer("which product grew fastest", orders, found)
    assert [r["value"] for r in compiler.figure(change).collect()] == sorted(r["Change %"] for r in change.table.collect())
    line = compiler.figure(compiler.answer("revenue trend by month", orders, found)).collect()
    assert [r["period"] for r in line] == sorted(r["period"] for r in line)
    assert compiler.figure(compiler.answer("how many orders", orders, found)) is None


@pytest.mark.parametrize("share,small", [(0.5, 50), (0.5, 3000), (0.9, 50), (0.25, 50), (0.0, 50), (1.0, 50)])
def test_percentiles_of_segments(spark, share, small):
    """Constant, two-valued, tied, heavy-tailed, negative and empty segments, above and below the bound."""
    big = spark.range(30_000).selectExpr(
        "concat('s', id % 6) AS seg",
        "CASE id % 6 WHEN 0 THEN 5.0D WHEN 1 THEN cast(id % 12 = 1 AS double) WHEN 2 THEN pow(pmod(xxhash64(id), 9973) / 100, 5) WHEN 3 THEN cast(pmod(xxhash64(id), 7) AS double) WHEN 5 THEN -exp(pmod(xxhash64(id), 4999) / 99) END AS m",
    )
    df = big.unionAll(spark.range(31).selectExpr("'few'", "id * 1.5D")).unionAll(spark.range(5).selectExpr("cast(NULL AS string)", "1.0D"))
    got = {r["segment"]: r["value"] for r in stats.grouped_percentile(df, F.col("seg"), "m", share, small).collect()}
    want = {r["seg"]: r["v"] for r in df.where("seg IS NOT NULL").groupBy("seg").agg(F.percentile("m", F.lit(share)).alias("v")).collect()}
    assert set(got) == set(want) and want["s4"] is None and got["s4"] is None
    assert all(got[s] == pytest.approx(v, rel=1e-9) for s, v in want.items() if v is not None)


def test_distinct_counts_are_bounded(spark):
    df = spark.range(5000).selectExpr("id AS key", "cast(id AS string) AS text", "cast(id % 100 AS double) AS hundred", "id % 101 AS more", "CASE WHEN id % 2 = 0 THEN 0.0D ELSE -0.0D END AS zeros", "CASE WHEN id < 3 THEN id END AS three", "cast(NULL AS int) AS none", "array(id % 4) AS list", "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE 1.0D END AS nan")
    rough, whole = stats.column_stats(df), stats.column_stats(df, exact=df.columns)
    assert {n: s.distinct for n, s in whole.items()} == {"key": 5000, "text": 5000, "hundred": 100, "more": 101, "zeros": 1, "three": 3, "none": 0, "list": 4, "nan": 1}
    assert all(s.exact for s in whole.values())
    assert {n for n, s in rough.items() if not s.exact} == {"key", "text"}
    assert all(s.distinct == whole[n].distinct for n, s in rough.items() if s.exact)
    assert all(abs(rough[n].distinct / 5000 - 1) < 0.15 for n in ("key", "text"))


def test_identifiers_at_the_limit_are_counted_exactly(spark):
    """A ratio near 0.8 is not left to an estimate, and one far from it is not exchanged."""
    def stat(n):
        return roles.role_stats(spark.range(10_000).selectExpr(f"id % {n} AS order_id", f"id % {n} AS amount"))
    for n, marked in ((7999, False), (8000, True), (8001, True)):
        found = stat(n)
        assert found["order_id"].exact and found["order_id"].distinct == n and roles.is_identifier(found["order_id"]) == marked
        assert not found["amount"].exact
    assert not stat(9999)["order_id"].exact and roles.is_identifier(stat(9999)["order_id"])


def test_wide_correlations_equal_corr(spark):
    """Two hundred columns in blocks, with gaps, constants, equal columns and far-off means."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 200)) @ np.diag(draw.uniform(0.1, 50, 200)) + draw.uniform(-1e6, 1e6, 200)
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = -x[:, 0]
    x[:, 3] = 7.3
    x[draw.random(x.shape) < 0.1] = np.nan
    x[:, 4] = np.nan
    names = [f"c {k}" for k in range(200)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r["left"], r["right"]): (r["position"], r["r"]) for r in stats.correlations(df, names).collect()}
    assert len(got) == 200 * 199 // 2 and [p for p, _ in got.values()] and sorted(p for p, _ in got.values()) == list(range(len(got)))
    for (k, a), (m, b) in [((k, a), (m, b)) for k, a in enumerate(names) for m, b in enumerate(names) if k < m]:
        both = ~np.isnan(x[:, k]) & ~np.isnan(x[:, m])
        u, v = x[both, k], x[both, m]
        r = got[a, b][1]
        if not both.any() or (u == u[0]).all() or (v == v[0]).all():
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-7), (a, b)
    few = {(r["left"], r["right"]): r["r"] for r in stats.correlations(df, names[:6]).collect()}
    assert all(got[p][1] == pytest.approx(r, abs=1e-7) if r is not None else got[p][1] is None for p, r in few.items())
    assert tuple(stats.strongest_pair(df, names).first())[1:3] in {("c 0", "c 1"), ("c 0", "c 2"), ("c 1", "c 2")}


def test_forecasts_of_segments_equal_those_of_series(spark):
    draw, rows, want = np.random.default_rng(5), [], {}
    shapes = {"season": 30, "short": 8, "none": 7, "line": 17, "gaps": 20, "weeks": 24, "below": 12, "flat": 9, "quarters": 12}
    for name, n in shapes.items():
        step = {"weeks": lambda k: datetime(2024, 1, 1) + timedelta(days=7 * k), "quarters": lambda k: timeseries.add_months(datetime(2020, 1, 1), 3 * k)}.get(name, lambda k: timeseries.add_months(datetime(2022, 11, 1), k))
        periods = [step(k + (k > 5 and name == "gaps")) for k in range(n)]
        values = [5.0 if name == "flat" else 100 + 3 * k + 20 * np.sin(k / 2) + draw.normal(0, 4) - 300 * (name == "below") for k in range(n)]
        rows += [(name, p, float(v)) for p, v in zip(periods, values)]
        found = timeseries.forecast_series(periods, [float(v) for v in values])
        want |= {(name, t): (v, low, high) for t, v, low, high in (found.ahead if found else ())}
    df = spark.createDataFrame(rows, "segment string, period timestamp_ntz, value double")
    got = {(r["segment"], r["period"]): (r["value"], r["lower"], r["upper"]) for r in timeseries.forecast_by_segment(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())


def test_cleaning_takes_few_passes(spark):
    from test_sources import jobs_of

    df = spark.range(3000).selectExpr("concat('r', id % 7) AS Region", "cast(id * 1.5 AS string) AS Revenue", "CASE WHEN id % 50 = 0 THEN NULL ELSE 'x' END AS Note")
    (table, audit), jobs = jobs_of(spark, lambda: cleaning.clean(df))
    # Three actions: counts, the write, and fingerprints that meet; the first and the last have two stages.
    assert jobs <= 5 and table.count() == 3000 and audit.operations["Duplicate rows removed"] == 0
    again, audit = cleaning.clean(df.unionAll(df.limit(1000)))
    assert audit.operations["Duplicate rows removed"] == 1000 and again.count() == 3000


def test_repeats_keep_the_first_row(spark):
    rows = [(1.0, "a", 0.0), (1.0, "a", -0.0), (None, None, None), (None, None, None), (1.0, "b", 0.0), (None, "a", 0.0), (1.0, "a", 0.0)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "x double, y string, _hash_0 double, _ord long").repartition(3)
    out, n = cleaning.without_repeats(df, ["x", "y", "_hash_0"])
    assert n == 3 and sorted(r["_ord"] for r in out.collect()) == [0, 2, 4, 5] and out.columns == ["x", "y", "_hash_0", "_ord"]


def test_bounded_takes_the_first_rows(spark):
    df = spark.range(1000).selectExpr("id * 2 AS x").repartition(4).sortWithinPartitions("x")
    from lodeline.sources.tabular import with_order

    numbered = with_order(df)
    for rows, want in ((10, 10), (333, 333), (1000, 1000), (5000, 1000), (0, 0)):
        out, beyond = cleaning.bounded(numbered, rows)
        assert out.count() == want and beyond == 1000 - want
    firsts = [r["_ord"] for r in numbered.orderBy("_ord").limit(333).collect()]
    assert sorted(r["_ord"] for r in cleaning.bounded(numbered, 333)[0].collect()) == firsts
    assert "Sort" not in cleaning.bounded(with_order(spark.range(1000).toDF("x")), 333)[0]._jdf.queryExecution().executedPlan().toString()
    gaps = numbered.where("x % 4 = 0")
    assert sorted(r["_ord"] for r in cleaning.bounded(gaps, 100)[0].collect()) == [r["_ord"] for r in gaps.orderBy("_ord").limit(100).collect()]


def test_a_brief_asks_the_table_four_times(spark):
    from test_sources import jobs_of

    rows = spark.range(4000).selectExpr("timestamp_ntz'2023-01-01' + make_dt_interval(cast(id % 800 AS int)) AS `Order Date`", "concat('r', id % 4) AS Region", "cast(id % 50 AS double) * (1 + id % 3) AS Revenue", "cast(id % 50 AS double) + rand(1) AS Profit").persist()
    rows.count()
    of = Roles("Order Date", "Revenue", "Region", None, ("Revenue", "Profit"), ("Region",))
    brief, jobs = jobs_of(spark, lambda: evidence.analyze(rows, of))
    assert {f.kind for f in brief.facts} >= {"trend", "driver", "leader", "relationship"}
    # Adaptive execution runs the stages of the four as jobs of their own.
    assert jobs <= 20
    total = rows.agg(F.sum("Revenue")).first()[0]
    assert next(t for t in brief.tiles if t.label == "Total Revenue").value == format_number(total, "Revenue")


def test_outliers_of_few_values_equal_those_of_many(spark):
    draw = np.random.default_rng(2)
    for values in ([], [1.0], [2.0] * 20, list(draw.normal(size=57)), [*draw.normal(size=40), 99.0, -70.0], [None, 1.0, 2.0, 3.0, 50.0, None, 2.0, 2.5]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        many = stats.iqr_outliers(df, ["v"]).first()
        assert stats.few_outliers(df, "v") == pytest.approx((many["outliers"], many["percent"]))
