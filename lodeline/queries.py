"""The registered queries of the analyst, each with its SQL.

Roles are pinned, so that the SQL doesn't depend on their detection. Sums of
doubles are rounded to 2 places and other doubles to 4 in both.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.columns import col, unique_names
from lodeline.functions.periods import in_year
from lodeline.functions.shipping import scratch, ship
from lodeline.functions.text import format_number, format_period
from lodeline.operators import cleaning, evidence, frames, report, roles, stats, timeseries
from lodeline.plans import compiler, parser, planner
from lodeline.plans.model import QueryPlan, Roles, ValueFilter
from lodeline.sources import csv_shape, memo, tabular, workbook

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM = Roles("l_shipdate", "l_extendedprice", "l_linestatus", None, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"))
FLAGS = Roles("l_shipdate", "l_extendedprice", "l_returnflag", None, LINEITEM.numeric, LINEITEM.dimensions)
ORDERS = Roles("o_orderdate", "o_totalprice", "o_orderpriority", None, ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"))
EVENTS = Roles("ts", "value", "event_type", "event_id", ("event_id", "user_id", "value"), ("event_type",))
PART = Roles(None, "p_retailprice", "p_brand", None, ("p_retailprice",), ("p_brand", "p_type"))

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(table: str, sql: str | None = None) -> Callable:
    """Registers a function of a table under its own name."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r2(*names: str) -> list:
    return [F.round(n, 2).alias(n) for n in names]


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


# Scalars: A-1 to A-3.


def _scalar(aggregation: str, sql: str, digits: int) -> None:
    def run(df: DataFrame) -> DataFrame:
        return frames.scalar(df, "l_extendedprice", aggregation).select(F.round("value", digits).alias("value"))

    run.__name__ = f"agg_{aggregation}"
    query("lineitem", f"SELECT {sql} AS value FROM lineitem")(run)


for _name, _sql in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    _scalar(_name, f"round({_sql}(l_extendedprice), {2 if _name == 'sum' else 4})", 2 if _name == "sum" else 4)


@query("lineitem", "SELECT count(l_extendedprice) AS value FROM lineitem")
def agg_count(df):
    return df.agg(frames.aggregate("l_extendedprice", "count").alias("value"))


@query("orders", "SELECT count(*) AS value FROM orders")
def row_count(df):
    return compiler.table_of(QueryPlan("count", "count"), df, ORDERS)


@query("orders", "SELECT count(DISTINCT o_custkey) AS value FROM orders")
def count_distinct_entity(df):
    return compiler.table_of(QueryPlan("count", "count", count_column="o_custkey"), df, ORDERS)


# Filters: F-6 to F-9, R-5.


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def filter_in_list(df):
    rows, _ = compiler.scoped(QueryPlan("count", filters=(ValueFilter("l_returnflag", ("A", "R")),)), df, LINEITEM)
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("lineitem", "SELECT l_linestatus, count(*) AS rows, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus IN ('F') GROUP BY 1")
def filter_multi_column(df):
    plan = QueryPlan("count", filters=(ValueFilter("l_returnflag", ("A", "N")), ValueFilter("l_linestatus", ("F",))))
    rows, _ = compiler.scoped(plan, df, LINEITEM)
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


def _when(name: str, year: int | None, month: int | None, sql: str) -> None:
    def run(df: DataFrame) -> DataFrame:
        rows, _ = compiler.scoped(QueryPlan("count", year=year, month=month), df, ORDERS)
        return rows.agg(F.count("*").alias("rows"), F.round(frames.aggregate("o_totalprice", "sum"), 2).alias("value"))

    run.__name__ = name
    query("orders", f"SELECT count(*) AS rows, round(coalesce(sum(o_totalprice), 0), 2) AS value FROM orders WHERE {sql}")(run)


_when("filter_year", 1997, None, "year(o_orderdate) = 1997")
_when("filter_month", None, 3, "month(o_orderdate) = 3")
_when("filter_year_month", 1997, 3, "year(o_orderdate) = 1997 AND month(o_orderdate) = 3")


@query("orders", "SELECT o_orderstatus AS segment, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def focus_slice(df):
    first = df.agg(F.min("o_orderpriority").alias("v")).first()["v"]
    part, own = roles.apply_focus(df, ORDERS, first)
    return frames.segments(part, own, None).select("segment", *r2("value"))


@query("orders", "SELECT o_orderpriority AS value, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC, value LIMIT 40")
def focus_options(df):
    return roles.focus_options(df, ORDERS)


@query("lineitem", "SELECT l_returnflag AS value, count(*) AS rows FROM lineitem WHERE lower(trim(l_returnflag)) = 'r' GROUP BY 1")
def filter_resolved(df):
    from lodeline.plans.planner import resolve_filter

    found = resolve_filter(df, "l_returnflag", " r ")
    return df.where(col("l_returnflag").isin(*found.values)).groupBy(col("l_returnflag").alias("value")).agg(F.count("*").alias("rows"))


# Grouped aggregates and ranks: A-4, O-1, O-2, W-5.


def _breakdown(name: str, aggregation: str, sql: str, round_value: bool = True) -> None:
    def run(df: DataFrame) -> DataFrame:
        out = frames.grouped(df, "l_returnflag", "l_extendedprice", aggregation)
        return out.select(*(F.round(c, 2 if aggregation == "sum" else 4).alias(c) if c == "value" and round_value else c for c in out.columns))

    run.__name__ = name
    query("lineitem", sql)(run)


_breakdown("breakdown_sum_share", "sum", "SELECT l_returnflag AS segment, round(sum(l_extendedprice), 2) AS value, round_even(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () * 100, 1) AS share FROM lineitem GROUP BY 1")
_breakdown("breakdown_mean", "mean", "SELECT l_returnflag AS segment, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
_breakdown("breakdown_median", "median", "SELECT l_returnflag AS segment, round(median(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
_breakdown("breakdown_count", "count", "SELECT l_returnflag AS segment, count(*) AS value, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS share FROM lineitem GROUP BY 1", False)


def _rank(name: str, n: int, ascending: bool) -> None:
    plan = QueryPlan("rank", "sum", "p_retailprice", "p_brand", top_n=n, ascending=ascending)

    def run(df: DataFrame) -> DataFrame:
        return compiler.table_of(plan, df, PART).select("segment", *r2("value"), "share")

    run.__name__ = name
    order = "value" if ascending else "value DESC"
    query("part", f"WITH g AS (SELECT p_brand AS segment, sum(p_retailprice) AS value FROM part GROUP BY 1) SELECT segment, round(value, 2) AS value, round_even(value / (SELECT sum(value) FROM g) * 100, 1) AS share FROM g ORDER BY g.{order}, segment LIMIT {n}")(run)


_rank("rank_top_n", 5, False)
_rank("rank_bottom_n", 3, True)
_rank("rank_best_one", 1, False)


# Trends: A-5, X-1, X-2.


def _trend(name: str, table: str, own: Roles, grain: str | None, unit: str, value: str) -> None:
    def run(df: DataFrame) -> DataFrame:
        return frames.trend(df, own, grain).select("period", *r2("value"))

    run.__name__ = name
    query(table, f"SELECT date_trunc('{unit}', {own.date})::TIMESTAMP AS period, round({value}, 2) AS value FROM {table} GROUP BY 1")(run)


for _grain, _unit in (("D", "day"), ("W", "week")):
    _trend(f"trend_{_unit}", "events", EVENTS, _grain, _unit, "sum(value)")
for _grain, _unit in (("M", "month"), ("Q", "quarter"), ("Y", "year")):
    _trend(f"trend_{_unit}", "orders", ORDERS, _grain, _unit, "sum(o_totalprice)")
_trend("trend_auto_grain", "orders", ORDERS, None, "quarter", "sum(o_totalprice)")
_trend("trend_row_count", "orders", Roles(date="o_orderdate"), "M", "month", "count(*)::DOUBLE")


@query("orders", "SELECT CASE WHEN d <= 120 THEN 'W' WHEN d <= 900 THEN 'M' ELSE 'Q' END AS grain, d AS days FROM (SELECT floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS d FROM orders)")
def grain_choice(df):
    from lodeline.functions.periods import span_days

    days = span_days(F.min("o_orderdate"), F.max("o_orderdate")).alias("days")
    grain = F.when(F.col("days") <= 120, "W").when(F.col("days") <= 900, "M").otherwise("Q")
    return df.agg(days).select(grain.alias("grain"), "days")


# Changes: A-7, A-8, A-16 to A-18, P-1.

_MONTHS = "t AS (SELECT date_trunc('month', l_shipdate) AS period, l_returnflag AS segment, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT period FROM t ORDER BY period DESC LIMIT 2), c AS (SELECT segment, coalesce(sum(v) FILTER (period = (SELECT min(period) FROM p)), 0) AS previous, coalesce(sum(v) FILTER (period = (SELECT max(period) FROM p)), 0) AS latest FROM t WHERE period IN (SELECT period FROM p) GROUP BY 1)"


def _change(df: DataFrame, own: Roles = FLAGS, grain: str = "M") -> DataFrame:
    (before, _), (now, _) = frames.last_two(frames.trend(df, own, grain))
    return frames.period_change(df, own, grain, before, now)


@query("lineitem", f"WITH {_MONTHS} SELECT segment, round(previous, 2) AS previous, round(latest, 2) AS latest, round(latest - previous, 2) AS change FROM c")
def segment_period_change(df):
    return _change(df).select("segment", *r2("previous", "latest", "change"))


_PART_KEYS = _MONTHS.replace("l_returnflag", "l_linenumber")


@query("lineitem", f"WITH {_PART_KEYS}, r AS (SELECT segment::VARCHAR AS segment, latest - previous AS change, row_number() OVER (ORDER BY abs(latest - previous) DESC, segment::VARCHAR) AS k FROM c) SELECT CASE WHEN k <= 4 THEN segment ELSE 'Other segments' END AS segment, round(sum(change), 2) AS change FROM r GROUP BY 1")
def driver_waterfall(df):
    own = Roles("l_shipdate", "l_extendedprice", "l_linenumber")
    return frames.drivers(_change(df, own), limit=4).select("segment", *r2("change"))


@query("lineitem", f"WITH {_MONTHS}, n AS (SELECT *, latest - previous AS change, sum(latest - previous) OVER () AS net FROM c) SELECT segment, round(change, 2) AS change, round(net, 2) AS net FROM n WHERE net <> 0 ORDER BY CASE WHEN net > 0 THEN n.change ELSE -n.change END DESC, segment LIMIT 1")
def driver_leader(df):
    return frames.largest_driver(_change(df)).select("segment", *r2("change", "net"))


_TREND = "t AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


@query("orders", f"WITH {_TREND}, w AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM t) SELECT period, round(previous, 2) AS previous, round(value, 2) AS latest, round((value - previous) / abs(previous) * 100, 4) AS change_percent FROM w ORDER BY period DESC LIMIT 1")
def growth_latest(df):
    return frames.growth(frames.trend(df, ORDERS, "M")).select("period", *r2("previous", "latest"), *r4("change_percent"))


def _growth(name: str, measure: str | None, value: str) -> None:
    own = Roles("o_orderdate", measure, "o_orderpriority")
    sql = f"WITH t AS (SELECT date_trunc('month', o_orderdate) AS period, o_orderpriority AS segment, {value} AS v FROM orders GROUP BY ALL), p AS (SELECT DISTINCT period FROM t ORDER BY period DESC LIMIT 2), c AS (SELECT segment, coalesce(sum(v) FILTER (period = (SELECT min(period) FROM p)), 0)::DOUBLE AS previous, coalesce(sum(v) FILTER (period = (SELECT max(period) FROM p)), 0)::DOUBLE AS latest FROM t WHERE period IN (SELECT period FROM p) GROUP BY 1) SELECT segment, round(previous, 2) AS previous, round(latest, 2) AS latest, round_even((latest - previous) / abs(previous) * 100, 1) AS change_percent FROM c WHERE previous <> 0"

    def run(df: DataFrame) -> DataFrame:
        return frames.ranked_growth(_change(df, own)).select("segment", *r2("previous", "latest"), "change_percent")

    run.__name__ = name
    query("orders", sql)(run)


_growth("growth_by_segment", "o_totalprice", "sum(o_totalprice)")
_growth("growth_by_segment_rows", None, "count(*)")


# Segments: A-6, A-9, A-15, J-1, F-11, U-1.


@query("part", "SELECT p_type AS segment, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, segment LIMIT 12")
def segment_top12(df):
    return frames.segments(df, Roles(None, "p_retailprice", "p_type")).select("segment", *r2("value"))


_SEGMENTS = "g AS (SELECT p_type AS segment, sum(p_retailprice) AS value FROM part GROUP BY 1 ORDER BY value DESC, segment LIMIT 100), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, segment) AS k FROM g)"


@query("part", f"WITH {_SEGMENTS} SELECT min(segment) FILTER (k = 1) AS leader, round(sum(value) FILTER (k = 1), 2) AS leader_value, round(sum(value) FILTER (k = 1) / sum(value) * 100, 4) AS leader_share FROM r")
def leader_share(df):
    return frames.concentration(df, Roles(None, "p_retailprice", "p_type")).select("leader", *r2("leader_value"), *r4("leader_share"))


@query("part", f"WITH {_SEGMENTS} SELECT round(sum(value) FILTER (k <= 3) / sum(value) * 100, 4) AS top_share, round(sum(value), 2) AS total FROM r")
def top3_concentration(df):
    return frames.concentration(df, Roles(None, "p_retailprice", "p_type")).select(*r4("top_share"), *r2("total"))


_TOP = "(SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3)"


@query("orders", f"SELECT o_orderpriority AS segment, date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority IN {_TOP} GROUP BY ALL")
def heatmap_long(df):
    return frames.heatmap(df, ORDERS, limit=3).select("segment", "period", *r2("value"))


@query("orders", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN {_TOP}")
def top_segment_semi_join(df):
    top = frames.segments(df, ORDERS, 3).select(F.col("segment").alias("o_orderpriority"))
    return df.select("o_orderkey", "o_orderpriority").join(top, "o_orderpriority", "left_semi")


@query("orders", "SELECT o_orderstatus AS segment, " + ", ".join(f"coalesce(round(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 2), 0) AS y{y}" for y in (1996, 1997)) + " FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1")
def heatmap_matrix(df):
    own = Roles("o_orderdate", "o_totalprice", "o_orderstatus")
    long = frames.heatmap(df.where(in_year("o_orderdate", 1996) | in_year("o_orderdate", 1997)), own, grain="Y")
    wide = frames.matrix(long)
    return wide.select("segment", *(F.round(F.col(f"`{c}`"), 2).alias(f"y{c[:4]}") for c in wide.columns[1:]))


# Whole-column statistics: A-10 to A-14, A-22, A-23, C-3, U-2, U-3.

_PAIRS = [(a, b) for k, a in enumerate(LINEITEM.numeric) for b in LINEITEM.numeric[k + 1 :]]
_CORR = "x AS (" + " UNION ALL ".join(f"SELECT {k} AS position, '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM lineitem" for k, (a, b) in enumerate(_PAIRS)) + ")"


@query("lineitem", f'WITH {_CORR} SELECT "left", "right", round(r, 4) AS r FROM x')
def corr_pairs(df):
    return stats.correlations(df, list(LINEITEM.numeric)).select("left", "right", *r4("r"))


@query("lineitem", f'WITH {_CORR} SELECT "left", "right", round(r, 4) AS r FROM x ORDER BY abs(x.r) DESC, position LIMIT 1')
def corr_strongest(df):
    return stats.strongest_pair(df, list(LINEITEM.numeric)).select("left", "right", *r4("r"))


_IQR = "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"


@query("events", f"WITH {_IQR} SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high FROM b")
def iqr_bounds(df):
    return stats.iqr_outliers(df, ["value"]).select(*r4("q1", "q3", "low", "high"))


@query("events", f"WITH {_IQR} SELECT count(*) AS n, count(*) FILTER (value < low OR value > high) AS outliers, round(count(*) FILTER (value < low OR value > high) / count(*) * 100, 4) AS percent FROM events, b")
def iqr_outlier_count(df):
    return stats.iqr_outliers(df, ["value"]).select("n", "outliers", *r4("percent"))


def _holes(df: DataFrame) -> DataFrame:
    """Customers with missing cells put in by rule."""
    return df.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).otherwise(F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan")))).alias("c_acctbal"))


@query("customer", "WITH h AS (SELECT count(*) AS n, 0 AS a, count(*) FILTER (c_custkey % 7 = 0) AS b, count(*) FILTER (c_custkey % 5 = 0) AS c FROM customer) SELECT 'c_custkey' AS \"column\", 0::BIGINT AS missing, 0.0::DOUBLE AS missing_percent FROM h UNION ALL SELECT 'c_name', b, round(b / n * 100, 4) FROM h UNION ALL SELECT 'c_acctbal', c, round(c / n * 100, 4) FROM h")
def missing_by_column(df):
    return stats.missing_by_column(_holes(df)).select("column", "missing", *r4("missing_percent"))


@query("customer", "SELECT 3 * count(*) AS cells, count(*) FILTER (c_custkey % 7 = 0) + count(*) FILTER (c_custkey % 5 = 0) AS missing, round(100 - (count(*) FILTER (c_custkey % 7 = 0) + count(*) FILTER (c_custkey % 5 = 0)) / (3 * count(*)) * 100, 4) AS complete_percent FROM customer")
def completeness(df):
    return stats.completeness(_holes(df)).select("cells", "missing", *r4("complete_percent"))


@query("orders", "WITH g AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) SELECT 'o_orderpriority' AS \"column\", value, round(n / (SELECT sum(n) FROM g) * 100, 4) AS percent FROM g ORDER BY n DESC, value LIMIT 1")
def category_mode_share(df):
    return stats.mode_share(df, "o_orderpriority").select("column", "value", *r4("percent"))


@query("orders", "SELECT min(o_orderdate)::TIMESTAMP AS first, max(o_orderdate)::TIMESTAMP AS last FROM orders")
def time_coverage(df):
    return stats.time_coverage(df, "o_orderdate")


_PROFILED = (("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "category"))


@query("customer", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM customer" for c, k in _PROFILED))
def column_profile(df):
    return stats.profile(df).select("column", "type", "present", "missing", "distinct")


@query("documents", "SELECT DISTINCT lang, source FROM documents")
def distinct_rows(df):
    return df.select("lang", "source").dropDuplicates()


@query("orders", "SELECT column_name AS \"column\", value FROM (SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)")
def value_dictionary(df):
    found = parser.value_dictionary(df, ORDERS.dimensions)
    return df.sparkSession.createDataFrame([(c, v) for c, vs in found.items() for v in vs], "column string, value string")


@query("events", "WITH e AS (SELECT min(value) AS low, (max(value) - min(value)) / 35 AS w FROM events) SELECT least(floor((value - low) / w), 34)::INTEGER AS bin, count(*) AS rows FROM events, e GROUP BY 1")
def histogram_35(df):
    return frames.histogram(df, "value").select("bin", "rows")


# Scatter of two measures: presentation frames.

_RANGE = "r AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 40.0 AS xw, min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 40.0 AS yw FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"


@query("lineitem", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))))
def corr_matrix_blocks(df):
    """Correlations from matrices of sums, in blocks of three columns."""
    return stats.wide_correlations(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], block=3).select("left", "right", *r4("r"))


@query("lineitem", f"""
WITH {_RANGE}, c AS (
  SELECT least(floor((l_quantity - x0) / xw), 39)::INTEGER AS x_bin, least(floor((l_extendedprice - y0) / yw), 39)::INTEGER AS y_bin, count(*) AS rows
  FROM lineitem, r WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL
)
SELECT x_bin, y_bin, round(x0 + x_bin * xw, 4) AS x_low, round(x0 + (x_bin + 1) * xw, 4) AS x_high, round(y0 + y_bin * yw, 4) AS y_low, round(y0 + (y_bin + 1) * yw, 4) AS y_high, rows FROM c, r
""")
def scatter_grid(df):
    return frames.scatter_grid(df, "l_quantity", "l_extendedprice").select("x_bin", "y_bin", *r4("x_low", "x_high", "y_low", "y_high"), "rows")


@query("lineitem", """
WITH n AS (SELECT l_linestatus, count(*) AS rows FROM lineitem GROUP BY 1), t AS (SELECT l_linestatus FROM n WHERE l_linestatus IS NOT NULL ORDER BY rows DESC, l_linestatus LIMIT 1
), h AS (
  SELECT CASE WHEN l_linestatus IN (FROM t) THEN l_linestatus ELSE 'Other segments' END AS segment, l_quantity::DOUBLE AS x, l_extendedprice AS y,
    ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 13))::BIGINT / 4503599627370496 AS spot
  FROM lineitem
)
SELECT segment, x, y FROM h QUALIFY row_number() OVER (PARTITION BY segment ORDER BY spot, x, y) <= 60
""")
def scatter_sample(df):
    return frames.scatter_sample(df, LINEITEM, "l_quantity", "l_extendedprice", ("l_orderkey", "l_linenumber"), colours=1)


@query("lineitem", """
SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS column, unnest([count(DISTINCT l_quantity) > 2, count(DISTINCT l_discount) > 2, count(DISTINCT l_tax) > 2]) AS suits,
  CASE WHEN count(DISTINCT l_quantity) > 2 THEN 'l_quantity' WHEN count(DISTINCT l_discount) > 2 THEN 'l_discount' WHEN count(DISTINCT l_tax) > 2 THEN 'l_tax' END AS partner
FROM lineitem
""")
def scatter_partners(df):
    """Which columns suit as the other axis, and the one that is taken."""
    others = [c for c in LINEITEM.numeric if c != LINEITEM.measure]
    taken = frames.scatter_partner(df, LINEITEM)
    suits = [(c, frames.scatter_partner(df, replace(LINEITEM, numeric=(c,))) == c, taken) for c in others]
    return df.sparkSession.createDataFrame(suits, "column string, suits boolean, partner string")


@query("lineitem", """
WITH t AS (SELECT l_returnflag AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY value, label DESC)::INTEGER AS place, label, value FROM t
""")
def answer_figure(df):
    """The bars of a breakdown's answer, in the order in which they are drawn."""
    drawn = compiler.figure(compiler.execute(QueryPlan("breakdown", measure="l_extendedprice", dimension="l_returnflag"), df, FLAGS)).collect()
    return df.sparkSession.createDataFrame([(k, r["label"], round(r["value"], 2)) for k, r in enumerate(drawn, 1)], "place int, label string, value double")


# Time series: X-3, A-19, A-20, W-1 to W-4, X-5 to X-9.

_FIT = "t AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS k, value - lag(value) OVER (ORDER BY period) AS d FROM t), s AS (SELECT median(d) AS slope FROM i), f AS (SELECT median(value - slope * k) AS icpt FROM i, s), e AS (SELECT period, value, k, icpt + slope * k AS expected, value - (icpt + slope * k) AS residual FROM i, s, f), m AS (SELECT CASE WHEN median(abs(residual)) * 1.4826 = 0 THEN avg(abs(residual)) ELSE median(abs(residual)) * 1.4826 END AS spread FROM e)"


def _monthly(df: DataFrame) -> DataFrame:
    return frames.trend(df, LINEITEM, "M")


@query("lineitem", f"WITH {_FIT} SELECT period, round(value, 2) AS value, round(expected - 3 * spread, 2) AS expected_low, round(expected + 3 * spread, 2) AS expected_high, abs(residual) > 3 * spread AS is_anomaly FROM e, m")
def anomaly_band(df):
    return timeseries.anomaly_band(_monthly(df)).select("period", *r2("value", "expected_low", "expected_high"), "is_anomaly")


@query("lineitem", f"WITH {_FIT} SELECT period, round(value, 2) AS value, CASE WHEN residual > 0 THEN 'above' ELSE 'below' END AS direction, round_even(abs(residual) / spread, 2) AS severity FROM e, m WHERE abs(residual) > 3 * spread ORDER BY severity DESC, period LIMIT 5")
def anomalies_top5(df):
    return timeseries.anomalies(_monthly(df)).select("period", *r2("value"), "direction", "severity")


@query("lineitem", f"WITH {_FIT} SELECT month(period)::INTEGER AS month, round(median(residual), 2) AS residual FROM e GROUP BY 1 HAVING count(*) >= 2")
def seasonal_medians(df):
    return timeseries.seasonal_medians(_monthly(df)).select("month", *r2("residual"))


_SEASON = "h AS (SELECT month(period) AS mo, median(residual) AS adj FROM e GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT e.*, residual - coalesce(adj, 0) AS rest FROM e LEFT JOIN h ON mo = month(period)), w AS (SELECT CASE WHEN median(abs(rest)) = 0 THEN avg(abs(rest)) ELSE median(abs(rest)) * 1.4826 END AS sp, max(period) AS last, max(k) AS lk FROM r), u AS (SELECT (last + to_months(j::INTEGER))::TIMESTAMP AS period, lk + j AS k, sp FROM w, range(1, 7) x(j)), y AS (SELECT u.period, sp, greatest(icpt + slope * k + coalesce(adj, 0), 0) AS p FROM u CROSS JOIN s CROSS JOIN f LEFT JOIN h ON mo = month(u.period))"


@query("lineitem", f"WITH {_FIT}, {_SEASON} SELECT period, round(p, 2) AS value, round(greatest(p - 2 * sp, 0), 2) AS lower, round(p + 2 * sp, 2) AS upper FROM y")
def forecast_next6(df):
    f = timeseries.build_forecast(_monthly(df))
    return df.sparkSession.createDataFrame(f.ahead if f else [], "period timestamp_ntz, value double, lower double, upper double").select("period", *r2("value", "lower", "upper"))


@query("lineitem", """
WITH t AS (SELECT l_returnflag AS segment, date_trunc('month', l_shipdate)::TIMESTAMP AS period, sum(l_extendedprice) AS value FROM lineitem WHERE l_returnflag IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY ALL
), i AS (
  SELECT *, row_number() OVER w - 1 AS k, value - lag(value) OVER w AS d, epoch(period) - epoch(lag(period) OVER w) AS g, date_diff('month', lag(period) OVER w, period) AS m FROM t WINDOW w AS (PARTITION BY segment ORDER BY period)
), s AS (
  SELECT segment, count(*) AS n, median(d) AS slope, bool_and(floor(g / 86400) BETWEEN 28 AND 31) AND count(*) >= 18 AS seasonal, max(period) AS last, min(value) AS low, median(g) AS g, CASE WHEN min(m) = max(m) AND max(m) IN (1, 3, 12) THEN max(m) END AS m
  FROM i GROUP BY 1 HAVING count(*) >= 8
), f AS (SELECT segment, median(value - slope * k) AS icpt FROM i JOIN s USING (segment) GROUP BY 1
), e AS (SELECT segment, month(period) AS mo, value - icpt - slope * k AS residual, seasonal FROM i JOIN (SELECT segment, slope, seasonal FROM s) USING (segment) JOIN f USING (segment)
), h AS (SELECT segment, mo, median(residual) AS adj FROM e WHERE seasonal GROUP BY ALL HAVING count(*) >= 2
), w AS (SELECT segment, CASE WHEN median(abs(residual - coalesce(adj, 0))) = 0 THEN avg(abs(residual - coalesce(adj, 0))) ELSE median(abs(residual - coalesce(adj, 0))) * 1.4826 END AS sp FROM e LEFT JOIN h USING (segment, mo) GROUP BY 1
), u AS (
  SELECT s.*, sp, icpt, j, CASE WHEN m IS NOT NULL THEN last + to_months((m * j)::INTEGER) ELSE last + to_microseconds((g * j * 1000000)::BIGINT) END::TIMESTAMP AS period
  FROM s JOIN w USING (segment) JOIN f USING (segment), range(1, 7) x(j) WHERE j <= greatest(1, least(6, n // 2))
), y AS (
  SELECT u.segment, u.period, sp, low, icpt + slope * (n - 1 + j) + coalesce(adj, 0) AS p FROM u LEFT JOIN h ON h.segment = u.segment AND mo = month(u.period)
), z AS (SELECT segment, period, sp, low, CASE WHEN low >= 0 THEN greatest(p, 0) ELSE p END AS p FROM y)
SELECT segment, period, round(p, 2) AS value, round(CASE WHEN low >= 0 THEN greatest(p - 2 * sp, 0) ELSE p - 2 * sp END, 2) AS lower, round(p + 2 * sp, 2) AS upper FROM z
""")
def forecast_by_segment(df):
    return timeseries.forecast_by_segment(frames.segment_trend(df, FLAGS, "M")).select("segment", "period", *r2("value", "lower", "upper"))


_HELD = "t AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS k, value - lag(value) OVER (ORDER BY period) AS d, count(*) OVER () AS n FROM t), c AS (SELECT *, least(greatest(3, n // 5), n - 5) AS held FROM i), s AS (SELECT median(d) AS slope FROM c WHERE k < n - held), f AS (SELECT median(value - slope * k) AS icpt FROM c, s WHERE k < n - held), h AS (SELECT month(period) AS mo, median(value - icpt - slope * k) AS adj FROM c, s, f WHERE k < n - held GROUP BY 1 HAVING count(*) >= 2)"


@query("lineitem", f"WITH {_HELD} SELECT held::BIGINT AS holdout_periods, round_even(avg(abs(icpt + slope * k + coalesce(adj, 0) - value) / abs(value)) * 100, 1) AS backtest_mape FROM c CROSS JOIN s CROSS JOIN f LEFT JOIN h ON mo = month(period) WHERE k >= n - held GROUP BY 1")
def forecast_backtest(df):
    f = timeseries.build_forecast(_monthly(df))
    return df.sparkSession.createDataFrame([(f.held_out, f.error_percent)], "holdout_periods long, backtest_mape double")


# Typing of text: T-1 to T-3, F-2 to F-4.


@query("orders", "SELECT (o_orderkey % 10 <> 0)::BOOLEAN AS parsed, count(*) AS rows FROM orders GROUP BY 1")
def infer_numeric(df):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("1,000")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
    raw = df.select(text.alias("v"))
    return raw.select(cleaning.parsed_number(cleaning.stripped("v")).isNotNull().alias("parsed")).groupBy("parsed").agg(F.count("*").alias("rows"))


@query("events", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS rows FROM events GROUP BY 1")
def infer_datetime(df):
    raw = df.select(F.date_format("ts", "yyyy-MM-dd").alias("created"), F.monotonically_increasing_id().alias("_ord"))
    found = cleaning.infer(raw, ["created"])
    return cleaning.typed(raw, ["created"], found).groupBy(F.col("created").alias("day")).agg(F.count("*").alias("rows"))


@query("customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS text FROM customer")
def trim_blank_to_null(df):
    padded = F.when(F.col("c_custkey") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t")))
    return df.select("c_custkey", padded.alias("t")).select("c_custkey", cleaning.stripped("t").alias("text"))


@query("customer", "SELECT count(*) AS final_rows, 3::BIGINT AS final_columns, (SELECT count(*) FROM customer) AS duplicate_rows_removed, 1::BIGINT AS empty_columns_removed FROM (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal FROM customer)")
def cleaning_report(df):
    base = df.select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(None).cast("string").alias("nothing"))
    _, audit = cleaning.clean(base.unionAll(base))
    done = audit.operations
    return df.sparkSession.createDataFrame([(*audit.after, done["Duplicate rows removed"], done["Empty columns removed"])], "final_rows long, final_columns long, duplicate_rows_removed long, empty_columns_removed long")


# Questions: Q-1 to Q-13, each from its words to its rows.


def _asked(name: str, table: str, own: Roles, question: str, sql: str, columns: Callable[[DataFrame], DataFrame]) -> None:
    def run(df: DataFrame) -> DataFrame:
        return columns(compiler.table_of(parser.parse(question, df, own), df, own))

    run.__name__ = name
    query(table, sql)(run)


_asked("nlq_count", "orders", Roles("o_orderdate", "o_totalprice", "o_orderstatus", "o_orderkey", ORDERS.numeric, ORDERS.dimensions), "how many rows do we have?", "SELECT count(*) AS value FROM orders", lambda t: t)
_asked("nlq_aggregate", "lineitem", LINEITEM, "What is the total l_extendedprice in 1997?", "SELECT round(sum(l_extendedprice), 2) AS value, count(l_extendedprice) AS rows FROM lineitem WHERE year(l_shipdate) = 1997", lambda t: t.select(*r2("value"), "rows"))
_asked("nlq_rank", "lineitem", LINEITEM, "top 3 l_returnflag by l_extendedprice", "WITH g AS (SELECT l_returnflag AS segment, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1) SELECT segment, round(value, 2) AS value, round_even(value / (SELECT sum(value) FROM g) * 100, 1) AS share FROM g ORDER BY g.value DESC, segment LIMIT 3", lambda t: t.select("segment", *r2("value"), "share"))
_asked("nlq_breakdown", "lineitem", LINEITEM, "average l_quantity by l_linestatus", "SELECT l_linestatus AS segment, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1", lambda t: t.select("segment", *r4("value")))
_asked("nlq_trend", "orders", ORDERS, "monthly o_totalprice trend", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1", lambda t: t.select("period", *r2("value")))
_asked("nlq_growth", "orders", ORDERS, "which o_orderpriority grew fastest per month?", ORACLE_SQL["growth_by_segment"], lambda t: t.select("segment", *r2("previous", "latest"), "change_percent"))


_asked("nlq_count_entity", "orders", Roles("o_orderdate", "o_totalprice", "o_orderstatus", "o_custkey", ORDERS.numeric, ORDERS.dimensions), "how many o_custkey are there?", "SELECT count(DISTINCT o_custkey) AS value FROM orders", lambda t: t)


# Decisions and words: R, E, C-4, Q-14.

BRIEFED = Roles("o_orderdate", "o_totalprice", "o_orderpriority", "o_orderkey", ORDERS.numeric, ORDERS.dimensions)


@query("orders", "SELECT * FROM (VALUES ('Primary metric', 'o_totalprice'), ('Business segment', 'o_orderstatus'), ('Date', 'o_orderdate'), ('Identifier', 'Not detected')) t(role, \"column\")")
def detected_roles(df):
    return roles.schema_frame(df, roles.detect_roles(df))


_FACTS = """
WITH c AS (SELECT o_orderpriority AS s, date_trunc('quarter', o_orderdate)::TIMESTAMP AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
t AS (SELECT p, sum(v) AS v FROM c GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS k, v - lag(v) OVER (ORDER BY p) AS d, row_number() OVER (ORDER BY p DESC) AS back FROM t),
growth AS (SELECT 100 * (b.v - a.v) / abs(a.v) AS x FROM k a, k b WHERE a.back = 2 AND b.back = 1),
moved AS (SELECT s, coalesce(sum(c.v) FILTER (back = 1), 0) - coalesce(sum(c.v) FILTER (back = 2), 0) AS x FROM c JOIN k USING (p) WHERE back <= 2 GROUP BY 1),
driver AS (SELECT s, x FROM moved ORDER BY CASE WHEN (SELECT sum(x) FROM moved) > 0 THEN -x ELSE x END, s LIMIT 1),
sizes AS (SELECT s, sum(v) AS v, row_number() OVER (ORDER BY sum(v) DESC, s) AS place FROM c GROUP BY 1),
slope AS (SELECT median(d) AS a FROM k), base AS (SELECT median(v - a * k) AS b FROM k, slope),
rest AS (SELECT v - a * k - b AS r FROM k, slope, base), mad AS (SELECT median(abs(r)) * 1.4826 AS m FROM rest),
odd AS (SELECT least(count(*), 5) AS n FROM rest, mad WHERE abs(r) > 3 * m),
cut AS (SELECT quantile_cont(o_totalprice, 0.25) AS q, quantile_cont(o_totalprice, 0.75) AS z FROM orders),
far AS (SELECT count(*) AS n FROM orders, cut WHERE o_totalprice < q - 1.5 * (z - q) OR o_totalprice > z + 1.5 * (z - q)),
facts AS (
  SELECT 'trend' AS kind, x AS number, '' AS subject, CASE WHEN x >= 0 THEN 'positive' ELSE 'negative' END AS tone FROM growth
  UNION ALL SELECT 'driver', x, s, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END FROM driver
  UNION ALL SELECT 'leader', 100 * v / (SELECT sum(v) FROM sizes), s, 'positive' FROM sizes WHERE place = 1
  UNION ALL SELECT 'concentration', 100 * sum(v) FILTER (place <= 3) / sum(v), '', CASE WHEN 100 * sum(v) FILTER (place <= 3) / sum(v) >= 70 THEN 'warning' ELSE 'neutral' END FROM sizes
  UNION ALL SELECT 'anomaly', n, '', 'warning' FROM odd WHERE n > 0
  UNION ALL SELECT 'outliers', n, '', 'warning' FROM far WHERE n > 0)
"""


@query("orders", _FACTS + "SELECT kind, round(number, 2) AS number, subject, tone FROM facts")
def brief_evidence(df):
    return evidence.evidence_frame(df, evidence.analyze(df, BRIEFED)).select("kind", *r2("number"), "subject", "tone")


@query(
    "orders",
    _FACTS
    + """, titles AS (
  SELECT 1 AS k, 'Now' AS "when", CASE WHEN g.tone = 'negative' THEN 'Start with ' || d.subject ELSE 'Make ' || d.subject || '''s growth repeatable' END AS title FROM facts g, facts d WHERE g.kind = 'trend' AND d.kind = 'driver'
  UNION ALL SELECT 2, 'Next', CASE WHEN tone = 'warning' THEN 'Reduce concentration risk' ELSE 'Learn from the leader' END FROM facts WHERE kind = 'concentration'
  UNION ALL SELECT 3, 'Now', 'Explain the unusual periods' FROM facts WHERE kind = 'anomaly'
  UNION ALL SELECT 4, 'Watch', 'Review exceptional records' FROM facts WHERE kind = 'outliers')
SELECT "when", title FROM titles ORDER BY k LIMIT 4""",
)
def brief_recommendations(df):
    brief = evidence.analyze(df, BRIEFED)
    return df.sparkSession.createDataFrame([(s.when, s.title) for s in brief.steps], "when string, title string")


@query(
    "events",
    """
WITH pair AS (SELECT corr(value, user_id) AS r FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
cut AS (SELECT quantile_cont(value, 0.25) AS q, quantile_cont(value, 0.75) AS z, quantile_cont(user_id, 0.25) AS uq, quantile_cont(user_id, 0.75) AS uz FROM events),
far AS (SELECT 'value' AS c, count(*) FILTER (value < q - 1.5 * (z - q) OR value > z + 1.5 * (z - q)) AS n, count(value) AS all_n FROM events, cut
  UNION ALL SELECT 'user_id', count(*) FILTER (user_id < uq - 1.5 * (uz - uq) OR user_id > uz + 1.5 * (uz - uq)), count(user_id) FROM events, cut),
top AS (SELECT event_type AS v, 100.0 * count(*) / (SELECT count(event_type) FROM events) AS x FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'Strongest numeric relationship' AS title, format('value and user_id: Pearson correlation {:.2f}. Correlation isn''t causation.', r) AS text, 'info' AS level FROM pair
UNION ALL (SELECT 'Potential outliers', format('{} has {:,} values ({:.1f}%) beyond 1.5 interquartile ranges.', c, n, 100.0 * n / all_n), 'warning' FROM far WHERE n > 0 ORDER BY n / all_n DESC LIMIT 1)
UNION ALL SELECT 'Largest category share', format('{} makes up {:.1f}% of the present values of event_type.', v, x), 'info' FROM top
UNION ALL SELECT 'Time coverage', 'ts runs from ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') || '.', 'info' FROM events
""",
)
def generic_insights(df):
    return df.sparkSession.createDataFrame([(i.title, i.text, i.level) for i in evidence.insights(df.select("ts", "event_type", "value", "user_id"))], "title string, text string, level string")


@query("orders", "SELECT * FROM (VALUES ('Total o_totalprice'), ('Top 5 o_orderpriority by o_totalprice'), ('Monthly o_totalprice trend'), ('Which o_orderpriority grew fastest?')) t(question)")
def suggested_questions(df):
    return df.sparkSession.createDataFrame([(s,) for s in parser.suggestions(ORDERS)], "question string")


@query(
    "customer",
    "SELECT * FROM (VALUES ('Empty rows removed', 1::BIGINT), ('Empty columns removed', 1), ('Exported index columns removed', 0), ('Duplicate rows removed', 0), ('Numeric columns inferred', 1), ('Datetime columns inferred', 1)) t(operation, count)",
)
def cleaning_audit(df):
    blank = F.lit(None).cast("string")
    own = df.select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("balance"), F.lit("2024-01-02").alias("created"), blank.alias("empty"))
    nothing = own.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in own.dtypes))
    df, audit = cleaning.clean(own.unionAll(nothing))
    return cleaning.audit_frame(df, audit)


# Sources and sinks: S-1 to S-6, S-10, S-13, each written and read back.


@query("customer", "SELECT c_custkey::DOUBLE AS c_custkey, c_mktsegment || ', \"' || c_name || '\"' AS note, c_acctbal FROM customer")
def csv_round_trip(df):
    spark, path = df.sparkSession, scratch(df.sparkSession, "csv")
    tabular.write_csv(df.select("c_custkey", F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"')).alias("note"), "c_acctbal"), path, single=True)
    table, _ = cleaning.clean(tabular.read_csv(spark, spark.read.text(path).inputFiles()[0]))
    # A name with "id" or "code" in it would be kept as text; "c_custkey" is a number.
    return table.select("c_custkey", "note", "c_acctbal")


@query("customer", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 3 WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END AS cells, count(*) AS lines FROM customer GROUP BY 1")
def csv_ragged_report(df):
    """Cells of the lines of a file whose records are not all of one width."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "csv")
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', of ""'), "c_mktsegment", F.lit('"""'))
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat_ws(",", "c_custkey", quoted, F.lit("x"))).when(F.col("c_custkey") % 7 == 0, quoted).otherwise(F.concat_ws(",", "c_custkey", quoted))
    df.select(line.alias("value")).write.text(path)
    return csv_shape.widths(spark, path, ",")


@query("customer", "SELECT c_custkey, '1 cell more' AS verdict FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def csv_strict_error(df):
    """Where reading stops in a file that has one cell too many in the record of the first customer."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "csv")
    first = df.agg(F.min("c_custkey").alias("k")).first()["k"]
    rows = df.select(F.concat_ws(",", F.col("c_custkey"), F.when(F.col("c_custkey") == first, F.lit("x,y")).otherwise("c_mktsegment")).alias("key,segment"))
    rows.coalesce(1).write.option("header", True).option("quote", "").csv(path)
    file = spark.read.text(path).inputFiles()[0]
    try:
        tabular.read_csv(spark, file)
    except ValueError as e:
        n, cells, width = map(int, re.search(r"line (\d+) has (\d+) cells, and the header has (\d+)", str(e)).groups())
        line = spark.read.text(file).withColumn("n", F.monotonically_increasing_id() + 1).where(F.col("n") == n)
        return line.select(F.split("value", ",")[0].cast("long").alias("c_custkey"), F.lit(f"{cells - width} cell more").alias("verdict"))


@query("supplier", "SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_acctbal FROM supplier")
def workbook_round_trip(df):
    spark, path = df.sparkSession, scratch(df.sparkSession, "book") + ".xlsx"
    tabular.write_workbook(df.select("s_suppkey", "s_name", "s_acctbal"), path)
    table, _ = cleaning.clean(tabular.read_table(spark, path, "Data"))
    return table.select("s_suppkey", "s_name", "s_acctbal")


@query("supplier", "SELECT 'Suppliers & more' AS sheet, count(*) + 1 AS rows, 3 * (count(*) + 1) AS cells FROM supplier")
def workbook_sheets(df):
    """Rows and cells of all sheets of a workbook, read in parts of 50 rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "book") + ".xlsx"
    tabular.write_workbook(df.select("s_suppkey", "s_name", "s_acctbal"), path, "Suppliers & more")
    every = workbook.register(spark).read.format("workbook").option("path", path).option("sheet", "*").option("rows", 50).load()
    return every.groupBy("sheet").agg(F.count("*").alias("rows"), F.sum(F.size("cells")).alias("cells"))


@query("customer", "SELECT c_mktsegment AS segment, count(*) AS rows, round(sum(c_acctbal), 2) AS value, 1 AS parses FROM customer GROUP BY 1")
def scan_memo(df):
    """A file that is read twice, under two names, and parsed once."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, "csv")
    scans, files = memo.ScanMemo(spark), []
    for name in ("one", "two"):
        tabular.write_csv(df.select("c_mktsegment", "c_acctbal").orderBy("c_custkey"), f"{folder}-{name}", single=True)
        files.append(spark.read.text(f"{folder}-{name}").inputFiles()[0])
    read = [scans.read(f) for f in files]
    table = read[1][1].select(col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("v"))
    return table.groupBy("segment").agg(F.count("*").alias("rows"), F.round(F.sum("v"), 2).alias("value")).withColumn("parses", F.lit(len({key for key, _ in read})))


@query("orders", """
WITH s AS (SELECT o_orderpriority AS name, count(*) AS rows FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY length(name) DESC, name) AS k FROM s)
SELECT k::INTEGER AS place, 'segment ' || k || ' has ' || rows || ' rows; the facts of segment ' || k || ' are no numbers' AS reads FROM k
""")
def redacted_payload(df):
    """Statements about all segments, without their names."""
    rows = df.groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()
    names = sorted((r[0] for r in rows), key=lambda n: (-len(n), n))
    says = {r[0]: f"{r[0]} has {r[1]} rows; the facts of {r[0]} are no numbers" for r in rows}
    return df.sparkSession.createDataFrame(list(enumerate(planner.redacted([says[n] for n in names], names), 1)), "place int, reads string")


@query("part", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 50")
def parquet_preview(df):
    spark, path = df.sparkSession, scratch(df.sparkSession, "parquet")
    df.orderBy("p_partkey").coalesce(1).write.parquet(path)
    return tabular.preview(tabular.read_parquet(spark, path), 50).select("p_partkey", "p_brand")


@query("customer", "SELECT '# ' || count(*) || ' customers' AS line FROM customer")
def text_sink(df):
    spark, path = df.sparkSession, scratch(df.sparkSession, "brief") + ".md"
    tabular.write_text(spark, f"# {df.count()} customers\n", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Files, roles, plans and reports end to end: S-4, S-9, S-11, S-12, F-4, F-15, C-1, C-6, R-4, R-6, X-4, E-5, E-7, N-9 to N-11, Q-4, Q-13 to Q-17.


def _file(df: DataFrame, name: str) -> str:
    """The path of the one file of a table written as lines of text."""
    path = scratch(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return df.sparkSession.read.text(path).inputFiles()[0]


@query("customer", "SELECT c_mktsegment AS segment, count(*) AS rows, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def csv_semicolon(df):
    """A file with semicolons, commas inside of cells, and a byte order mark."""
    body = df.select(F.concat_ws(";", "c_mktsegment", F.concat(F.lit("a, b "), "c_custkey"), "c_acctbal").alias("value"))
    head = df.sparkSession.range(1).select(F.lit("\ufeffsegment;note;balance").alias("value"))
    table = tabular.read_csv(df.sparkSession, _file(head.unionAll(body), "semicolon"))
    return table.groupBy("segment").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("balance").cast("double")), 2).alias("value"))


@query("orders", "SELECT o_orderkey, n - 120 AS beyond FROM orders, (SELECT count(*) AS n FROM orders) QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 120")
def bounded_scan(df):
    """The first rows of a file, and how many are beyond."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "orders")
    df.orderBy("o_orderkey").coalesce(1).write.parquet(path)
    first, beyond = cleaning.bounded(tabular.read_parquet(spark, path), 120)
    return first.select("o_orderkey", F.lit(beyond).cast("long").alias("beyond"))


@query("customer", "SELECT c_name, c_acctbal, (SELECT count(*) FROM customer) AS rows, 1::BIGINT AS indexes FROM customer")
def exported_index(df):
    """A column that numbers the rows from 0 goes, another unnamed one stays."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "customer")
    numbered = df.orderBy("c_custkey").coalesce(1).select(F.monotonically_increasing_id().alias("Unnamed: 0"), "c_name", "c_acctbal", (F.monotonically_increasing_id() * 2).alias("Unnamed: 1"))
    numbered.write.parquet(path)
    table, audit = cleaning.clean(tabular.read_parquet(spark, path))
    assert "Unnamed: 0" not in table.columns and "Unnamed: 1" in table.columns
    return table.select("c_name", "c_acctbal", F.lit(audit.after[0]).cast("long").alias("rows"), F.lit(audit.operations["Exported index columns removed"]).cast("long").alias("indexes"))


@query("customer", "SELECT * FROM (SELECT 'a b' AS \"column\", count(c_custkey) AS present FROM customer UNION ALL SELECT 'a b_2', count(c_name) FROM customer UNION ALL SELECT 'column_3', count(c_acctbal) FROM customer)")
def unique_columns(df):
    names = unique_names([" a  b ", "a b", None])
    table = df.select(*(col(c).alias(n) for c, n in zip(("c_custkey", "c_name", "c_acctbal"), names)))
    return table.agg(F.array(*(F.struct(F.lit(n).alias("column"), F.count(col(n)).alias("present")) for n in names)).alias("all")).select(F.inline("all"))


@query("orders", "SELECT 'o_orderdate' AS date, 'o_totalprice' AS measure, 'o_orderstatus' AS dimension, count(*) AS rows, round(sum(o_totalprice), 2) AS value FROM orders")
def prepared_roles(df):
    """A table cleaned, typed and given roles; status wins over priority by its name."""
    prepared = cleaning.prepare(df.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    r = prepared.roles
    return prepared.table.agg(F.lit(r.date).alias("date"), F.lit(r.measure).alias("measure"), F.lit(r.dimension).alias("dimension"), F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("orders", "SELECT o_orderpriority AS segment, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def selected_roles(df):
    """Segments after a user has picked another segment and cleared the measure."""
    return frames.segments(df, roles.select_roles(roles.override_roles(ORDERS, dimension="o_orderstatus"), date="o_orderdate", measure="None", dimension="o_orderpriority"), None)


@query("orders", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, '{r}' AS role, count({c}) AS present FROM orders" for c, k, r in (("o_orderkey", "numeric", "other"), ("o_custkey", "numeric", "other"), ("o_orderstatus", "category", "dimension"), ("o_totalprice", "numeric", "primary measure"), ("o_orderdate", "datetime", "date"), ("o_orderpriority", "category", "primary dimension"))))
def planner_schema(df):
    """What a planner is told of each column, beside how many values it has."""
    told = df.sparkSession.createDataFrame(planner.query_schema(df, ORDERS), "column string, type string, role string")
    counts = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count(col(c)).alias("present")) for c in df.columns)).alias("all")).select(F.inline("all"))
    return told.join(counts, "column")


@query("orders", "SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label, count(*) AS rows FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def period_labels(df):
    rows = frames.trend(df, replace(ORDERS, measure=None), "Q").collect()
    return df.sparkSession.createDataFrame([(format_period(r["period"], "Q"), int(r["value"])) for r in rows], "label string, rows long")


@query("orders", "SELECT o_orderpriority AS segment, '$' || CASE WHEN sum(o_totalprice) >= 1e9 THEN format('{:.1f}B', sum(o_totalprice) / 1e9) ELSE format('{:.1f}M', sum(o_totalprice) / 1e6) END AS total, format('{:,}', count(*)) AS rows FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 1e6")
def worded_totals(df):
    totals = df.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n")).where("v >= 1e6").collect()
    return df.sparkSession.createDataFrame([(r[0], format_number(r["v"], "o_totalprice"), format_number(r["n"], compact=False)) for r in totals], "segment string, total string, rows string")


@query("orders", "SELECT o_orderpriority AS segment, sha256('[\"' || o_orderpriority || '\", \"' || count(*) || '\"]') AS fingerprint FROM orders GROUP BY 1")
def payload_fingerprints(df):
    rows = df.groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()
    return df.sparkSession.createDataFrame([(r[0], planner.fingerprint(r[0], str(r["n"]))) for r in rows], "segment string, fingerprint string")


@query("lineitem", "SELECT 'relationship' AS kind, round(corr(l_extendedprice, l_quantity + l_extendedprice / 100), 4) AS number, 'neutral' AS tone FROM lineitem")
def evidence_relationship(df):
    table = df.select("l_extendedprice", (F.col("l_quantity") + F.col("l_extendedprice") / 100).alias("weight"), "l_returnflag")
    brief = evidence.analyze(table, Roles(None, "l_extendedprice", "l_returnflag", None, ("l_extendedprice", "weight"), ("l_returnflag",)))
    return evidence.evidence_frame(table, brief).where("kind = 'relationship'").select("kind", *r4("number"), "tone")


@query("lineitem", """
WITH c AS (SELECT count(*) FILTER (l_orderkey % 7 = 0) + count(*) FILTER (l_orderkey % 5 = 0) AS gaps, 3 * count(*) AS cells FROM lineitem)
SELECT 'quality' AS kind, round(100 - 100 * gaps / cells, 4) AS number, 'warning' AS tone, format('{:,} of {:,} cells are missing: the table is {:.1f}% complete.', gaps, cells, 100 - 100 * gaps / cells) AS statement FROM c
""")
def evidence_quality(df):
    gap = lambda c, k: F.when(F.col("l_orderkey") % k != 0, F.col(c)).alias(c)
    table = df.select(gap("l_extendedprice", 7), gap("l_returnflag", 5), "l_linestatus")
    brief = evidence.analyze(table, Roles(None, "l_extendedprice", "l_returnflag", None, ("l_extendedprice",), ("l_returnflag", "l_linestatus")))
    return evidence.evidence_frame(table, brief).where("kind = 'quality'").select("kind", *r4("number"), "tone", "statement")


_asked("nlq_value_filter", "orders", replace(ORDERS, dimensions=("o_orderstatus", "o_orderpriority")), "total o_totalprice for 1 urgent and 5 low", "SELECT round(sum(o_totalprice), 2) AS value, count(o_totalprice) AS rows FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", lambda t: t.select(*r2("value"), "rows"))


@query("orders", """
SELECT 1 AS place, 'The table has ' || format('{:,}', count(*)) || ' rows.' AS answer, 'row count' AS calculation FROM orders
UNION ALL SELECT 2, 'The table has ' || format('{:,}', count(*)) || ' rows for o_orderdate in 1997.', 'row count · filtered to o_orderdate in 1997' FROM orders WHERE year(o_orderdate) = 1997
UNION ALL SELECT 3, CASE WHEN count(*) = 0 THEN 'No row is in that scope, so nothing was calculated.' END, '0 rows after filters · filtered to o_orderdate in 1901' FROM orders WHERE year(o_orderdate) = 1901
UNION ALL SELECT 4, NULL, NULL FROM orders WHERE false
""")
def worded_answers(df):
    """Answers in words: all rows, a scope, an empty scope; a question that the rules can't read has none."""
    asked = ("how many rows are there?", "how many rows in 1997?", "how many rows in 1901?", "is it nice?")
    found = [(k, compiler.answer(q, df, replace(ORDERS, dimension=None, dimensions=()))) for k, q in enumerate(asked, 1)]
    return df.sparkSession.createDataFrame([(k, a.answer, a.calculation) for k, a in found if a], "place int, answer string, calculation string")


@query("orders", "SELECT o_orderpriority AS segment, round(avg(o_totalprice), 4) AS value, 'ai' AS source FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders WHERE lower(o_orderstatus) = 'f') AND year(o_orderdate) = 1997 GROUP BY 1 ORDER BY value DESC, segment LIMIT 3")
def planned_by_client(df):
    """A client's plan, checked and run: its filter is resolved against the stored values."""
    said = {"answerable": True, "intent": "rank", "aggregation": "mean", "measure": "o_totalprice", "dimension": "o_orderpriority", "top_n": 3, "filters": [{"column": "o_orderstatus", "value": " f "}], "year": 1997}
    plan = planner.plan_with(lambda *_: said, "best priorities of finished orders in 1997", df, ORDERS)
    return compiler.table_of(plan, df, ORDERS).select("segment", *r4("value"), F.lit(plan.source).alias("source"))


@query("orders", "SELECT unnest(['unknown column', 'value not stored', 'declined', 'no date']) AS proposal, count(*) AS rows, true AS refused FROM orders")
def refused_plans(df):
    """Plans of a client that can't run are refused."""
    base, n = {"answerable": True, "intent": "rank", "measure": "o_totalprice", "dimension": "o_orderpriority"}, df.count()
    said = {"unknown column": base | {"measure": "nothing"}, "value not stored": base | {"filters": [{"column": "o_orderstatus", "value": "no such"}]}, "declined": base | {"answerable": False}, "no date": base | {"intent": "trend", "dimension": None}}
    plans = [(k, n, planner.plan_with(lambda *_, s=s: s, "x", df, replace(ORDERS, date=None)) is None) for k, s in said.items()]
    return df.sparkSession.createDataFrame(plans, "proposal string, rows long, refused boolean")


@query("orders", """
SELECT 'Total o_totalprice' AS question, 1::BIGINT AS rows, round(sum(o_totalprice), 2) AS first FROM orders
UNION ALL SELECT 'Top 5 o_orderpriority by o_totalprice', least(5, count(*)), max(v) FROM (SELECT round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_orderpriority)
UNION ALL SELECT 'Monthly o_totalprice trend', count(*), round(min_by(v, p), 2) FROM (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1)
""")
def suggested_answers(df):
    """The suggested questions with what the table answers: rows and the first value."""
    out = []
    for q in parser.suggestions(ORDERS)[:3]:
        rows = compiler.answer(q, df, ORDERS, values={}).table.collect()
        out.append((q, len(rows), round(next(v for v in rows[0] if isinstance(v, float)), 2)))
    return df.sparkSession.createDataFrame(out, "question string, rows long, first double")


@query("customer", """
SELECT '- Rows: ' || format('{:,}', count(*)) AS line FROM customer UNION ALL SELECT '- Columns: 2' FROM customer HAVING count(*) > 0 UNION ALL SELECT '- Missing cells: ' || format('{:,}', count(*) FILTER (c_custkey % 4 = 0)) FROM customer UNION ALL SELECT '- Duplicate rows removed: 0' FROM customer HAVING count(*) > 0
UNION ALL SELECT format('- **c_name**: text, 0.00% missing, {:,} distinct', count(DISTINCT c_name)) FROM customer
UNION ALL SELECT format('- **c_mktsegment**: category, {:.2f}% missing, {:,} distinct', round(100.0 * count(*) FILTER (c_custkey % 4 = 0) / count(*), 2), count(DISTINCT CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END)) FROM customer
""")
def data_report_lines(df):
    """Overview and data dictionary of the generic report."""
    table, audit = cleaning.clean(df.select("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment")))
    text = report.data_report(table, audit, evidence.insights(table))
    lines = [x for part in text.split("## ") if part.startswith(("Dataset overview", "Data dictionary")) for x in part.splitlines() if x.startswith("- ")]
    return df.sparkSession.createDataFrame([(x,) for x in lines], "line string")


@query("orders", """
WITH t AS (SELECT sum(o_totalprice) AS v, count(*) AS n FROM orders)
SELECT '**Source:** orders  ' AS line FROM t UNION ALL SELECT '**Rows analyzed:** ' || format('{:,}', n) || '  ' FROM t UNION ALL SELECT '**Business context:** a test' FROM t
UNION ALL SELECT 'o_totalprice adds up to $' || CASE WHEN v >= 1e9 THEN format('{:,.1f}B', v / 1e9) ELSE format('{:,.1f}M', v / 1e6) END || '.' FROM t
""")
def business_report_lines(df):
    """Head and headline of the executive report of a table with a measure alone."""
    table = df.select("o_totalprice")
    text = report.business_report(table, evidence.analyze(table, Roles(None, "o_totalprice", None, None, ("o_totalprice",))), source_name="orders", context=" a test ")
    lines = [x for x in text.splitlines() if x.startswith(("**Source", "**Rows", "**Business", "o_totalprice adds"))]
    return df.sparkSession.createDataFrame([(x,) for x in lines], "line string")


def stream_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: the daily trend of events as a stream, run to its end."""
    from lodeline.streaming.trends import windowed_trend

    source, path = ship(spark).read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "daily")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    daily = windowed_trend(stream, "ts", "value", lateness="3650 days").writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state")
    daily.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("period", F.round("value", 2).alias("value"))


QUERIES["stream_daily_trend"] = stream_daily_trend
ORACLE_SQL["stream_daily_trend"] = ORACLE_SQL["trend_day"]
