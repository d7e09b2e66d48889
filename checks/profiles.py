"""Profiles, series, histograms, distributions and charts."""

from pyspark.sql import functions as F

from sparkelt.operators.profile import (
    aggregate_series, box_stats, chart_dataset, chart_payload, correlation_matrix, describe_numeric,
    histogram, kde_grid, regression_trend, rollup_first, rollup_sums, scatter_points, summary_stats)
from sparkelt.plans.sql import user_transform
from sparkelt.sources.presets import preset_over

from .registry import dec, half_up_mean, money, query, table, total
from .sources import ECOMMERCE


def priced(spark, sf):
    return money(table(spark, sf, "lineitem"), "l_extendedprice")


PROFILE = f"""
    SELECT COUNT(l_extendedprice) AS count, {total('l_extendedprice')} AS sum,
           {half_up_mean('l_extendedprice')} AS mean, MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max,
           ROUND(STDDEV_SAMP(l_extendedprice), 2) AS std
    FROM lineitem"""


@query("stats_summary", PROFILE)
def stats_summary(spark, sf):
    return summary_stats(priced(spark, sf), "l_extendedprice")


@query("stats_nonnumeric", """
    SELECT COUNT(*) AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS min,
           0.0::DOUBLE AS max, 0.0::DOUBLE AS std FROM lineitem""")
def stats_nonnumeric(spark, sf):
    return summary_stats(table(spark, sf, "lineitem"), "l_returnflag")


# -- series over the order day, which has far more than 15 values -----------

DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def by_day(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return money(table(spark, sf, "orders"), "o_totalprice").select(day, "o_totalprice", "o_orderpriority", "o_orderkey")


def series_query(name, measure, value, ranked=None):
    @query(name, f"""
        SELECT {DAY} AS label, {value} AS value FROM orders GROUP BY label
        ORDER BY {ranked or 'value'} DESC, label LIMIT 15""")
    def run(spark, sf):
        return aggregate_series(by_day(spark, sf), "day", "o_totalprice", measure)


series_query("agg_sum_topk", "SUM", total("o_totalprice"))
series_query("agg_avg_topk", "AVG", half_up_mean("o_totalprice"),
             f"CAST(SUM({dec('o_totalprice')}) AS DOUBLE) / COUNT(*)")
series_query("agg_count_topk", "COUNT", "CAST(COUNT(o_totalprice) AS DOUBLE)")
series_query("agg_min_topk", "MIN", "MIN(o_totalprice)")
series_query("agg_max_topk", "MAX", "MAX(o_totalprice)")


@query("agg_text_fallback", f"""
    SELECT {DAY} AS label, CAST(COUNT(o_orderpriority) AS DOUBLE) AS value FROM orders GROUP BY label
    ORDER BY value DESC, label LIMIT 15""")
def agg_text_fallback(spark, sf):
    return aggregate_series(by_day(spark, sf), "day", "o_orderpriority", "SUM")


@query("agg_unknown_measure", f"""
    SELECT {DAY} AS label, {total('o_totalprice')} AS value FROM orders GROUP BY label
    ORDER BY value DESC, label LIMIT 15""")
def agg_unknown_measure(spark, sf):
    return aggregate_series(by_day(spark, sf), "day", "o_totalprice", "MEDIAN")


@query("agg_none_points", f"""
    SELECT {DAY} AS label, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 15""")
def agg_none_points(spark, sf):
    return aggregate_series(by_day(spark, sf), "day", "o_totalprice", "NONE", order=["o_orderkey"])


# -- distributions ----------------------------------------------------------

def bins_sql(bins):
    return f"""
        WITH span AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi,
                             (MAX(l_extendedprice) - MIN(l_extendedprice)) / {bins}.0::DOUBLE AS w FROM lineitem),
        counts AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / w) AS INTEGER), {bins - 1}) AS bin, COUNT(*) AS n
                   FROM lineitem, span GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, ROUND(lo + i * w, 6) AS lower, ROUND(lo + i * w + w, 6) AS upper,
               COALESCE(n, 0) AS n
        FROM range({bins}) AS r(i), span LEFT JOIN counts ON bin = i"""


def histogram_query(name, bins):
    @query(name, bins_sql(bins))
    def run(spark, sf):
        return histogram(table(spark, sf, "lineitem"), "l_extendedprice", bins).select(
            "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


histogram_query("histogram", 8)
histogram_query("histogram_15", 15)
histogram_query("histogram_20", 20)


@query("kde_grid", """
    WITH counted AS (SELECT value AS v, COUNT(*) AS c FROM events GROUP BY value),
    base AS (SELECT SUM(c)::DOUBLE AS n, SUM(v * c) / SUM(c) AS mean, MIN(v) AS lo, MAX(v) AS hi FROM counted),
    wide AS (SELECT sqrt(SUM(c * pow(v - mean, 2)) / (ANY_VALUE(n) - 1)) * pow(ANY_VALUE(n), -0.2) AS w
             FROM counted, base),
    grid AS (SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 63.0::DOUBLE) AS x FROM range(64) AS r(i), base)
    SELECT point, ROUND(x, 6) AS x,
           ROUND(SUM(c * exp(-0.5 * pow((x - v) / w, 2))) / (ANY_VALUE(n) * ANY_VALUE(w) * sqrt(2 * pi())), 8) AS density
    FROM grid, counted, base, wide GROUP BY point, x""")
def kde(spark, sf):
    return kde_grid(table(spark, sf, "events"), "value", 64).select(
        "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("box_stats", """
    WITH q AS (SELECT event_type, COUNT(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, n, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
           MIN(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
           MAX(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
           COUNT(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM events JOIN q USING (event_type) GROUP BY ALL""")
def box(spark, sf):
    return box_stats(table(spark, sf, "events"), "event_type", "value").withColumns(
        {c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("box_stats_many", """
    WITH q AS (SELECT l_partkey, COUNT(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                      quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, n, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
           COUNT(*) FILTER (WHERE NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM lineitem JOIN q USING (l_partkey) GROUP BY ALL""")
def box_many(spark, sf):
    """A box per part: many groups of few rows."""
    return box_stats(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice").select(
        "l_partkey", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "outliers")


@query("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def scatter(spark, sf):
    return scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def described(column):
    return f"""
        SELECT '{column}' AS column, COUNT({column}) AS count, ROUND(AVG({column}), 6) AS mean,
               ROUND(STDDEV_SAMP({column}), 6) AS std, MIN({column}) AS min,
               ROUND(quantile_cont({column}, 0.25), 4) AS q25, ROUND(quantile_cont({column}, 0.5), 4) AS median,
               ROUND(quantile_cont({column}, 0.75), 4) AS q75, MAX({column}) AS max
        FROM lineitem"""


@query("describe_numeric", " UNION ALL ".join(map(described, ("l_quantity", "l_extendedprice", "l_tax"))))
def describe(spark, sf):
    items = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    return describe_numeric(items).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6),
         **{c: F.round(c, 4) for c in ("q25", "median", "q75")}})


@query("describe_null_column", f"""
    {described('l_quantity')} UNION ALL
    SELECT 'nothing', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def describe_null(spark, sf):
    """A column without a single value is described as well."""
    items = table(spark, sf, "lineitem").select("l_quantity", F.lit(None).cast("double").alias("nothing"))
    return describe_numeric(items).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6),
         **{c: F.round(c, 4) for c in ("q25", "median", "q75")}})


@query("correlation_matrix", """
    SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, ROUND(corr(l_quantity, l_discount), 6) AS corr FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_extendedprice', ROUND(corr(l_quantity, l_extendedprice), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_extendedprice', ROUND(corr(l_discount, l_extendedprice), 6) FROM lineitem""")
def correlations(spark, sf):
    pairs = correlation_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return pairs.withColumn("corr", F.round("corr", 6))


@query("regression_trend", """
    SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
           ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           ROUND(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem""")
def trend(spark, sf):
    return regression_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(
        "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round("r2", 8).alias("r2"))


# -- charts -----------------------------------------------------------------

TOP_DAYS = f"""
    SELECT {DAY} AS label, SUM({dec('o_totalprice')}) AS value FROM orders GROUP BY label
    ORDER BY value DESC, label LIMIT 15"""


@query("chart_payload", f"""
    SELECT '{{"type":"line","title":"Revenue","data":{{"labels":[' || string_agg('"' || label || '"', ',' ORDER BY value DESC, label)
        || '],"datasets":[{{"label":"Revenue","data":[' || string_agg(CAST(CAST(value AS DECIMAL(38,2)) AS VARCHAR), ',' ORDER BY value DESC, label)
        || '],"borderColor":"#3fb950","backgroundColor":"rgba(35, 134, 54, 0.2)","borderWidth":2}}]}}}}' AS payload
    FROM ({TOP_DAYS})""")
def payload(spark, sf):
    return chart_payload(aggregate_series(by_day(spark, sf), "day", "o_totalprice"), "LINE", "Revenue")


@query("chart_dataset", f"""
    WITH p AS ({PROFILE.replace('l_extendedprice', 'o_totalprice').replace('lineitem', 'orders')})
    SELECT 'stat' AS kind, label, value FROM (
        UNPIVOT (SELECT count::DOUBLE AS count, sum, mean, min, max, std FROM p)
        ON count, sum, mean, min, max, std INTO NAME label VALUE value)
    UNION ALL SELECT 'series', label, CAST(value AS DOUBLE) FROM ({TOP_DAYS})""")
def dataset(spark, sf):
    return chart_dataset(by_day(spark, sf), "day", "o_totalprice")


# -- gold roll-ups and the two starters -------------------------------------

@query("gold_sum_all", f"""
    SELECT l_returnflag, {total('l_quantity')} AS l_quantity, {total('l_extendedprice')} AS l_extendedprice,
           {total('l_discount')} AS l_discount
    FROM lineitem GROUP BY l_returnflag""")
def gold_sum_all(spark, sf):
    items = money(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return rollup_sums(items.select("l_quantity", "l_returnflag", "l_extendedprice", "l_discount", "l_linestatus"))


@query("gold_count_mean_sum", f"""
    SELECT o_orderpriority, COUNT(o_totalprice) AS count,
           ROUND(CAST(SUM({dec('o_totalprice')}) AS DOUBLE) / COUNT(o_totalprice), 4) AS mean,
           {total('o_totalprice')} AS sum
    FROM orders GROUP BY o_orderpriority""")
def gold_count_mean_sum(spark, sf):
    orders = money(table(spark, sf, "orders"), "o_totalprice").select("o_totalprice", "o_orderpriority", "o_custkey")
    return rollup_first(orders).withColumn("mean", F.round("mean", 4))


@query("gold_head10", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10")
def gold_head10(spark, sf):
    return rollup_first(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"),
                        order=["l_orderkey", "l_linenumber"])


@query("gold_describe_fallback", described("l_quantity"))
def gold_describe_fallback(spark, sf):
    return rollup_sums(table(spark, sf, "lineitem").select("l_quantity")).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6),
         **{c: F.round(c, 4) for c in ("q25", "median", "q75")}})


def text_summary(column):
    return f"""
        SELECT '{column}' AS column, CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS unique, arg_min(v, (-n, v)) AS top, MAX(n) AS freq
        FROM (SELECT {column} AS v, COUNT(*) AS n FROM orders GROUP BY {column})"""


@query("gold_text_only", " UNION ALL ".join(map(text_summary, ("o_orderstatus", "o_orderpriority"))))
def gold_text_only(spark, sf):
    return rollup_sums(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


def sales(spark, sf):
    return money(preset_over(table(spark, sf, "orders"), "o_orderkey", "ecommerce"), "amount")


# The published starter's filter, groups and names.
STARTER = f"""
    SELECT country, category, COUNT(order_id) AS total_orders, {total('amount')} AS total_revenue
    FROM ({ECOMMERCE}) WHERE amount > 50.0 GROUP BY country, category"""


@query("starter_pyspark", STARTER)
def starter_pyspark(spark, sf):
    def change(df):
        return (df.filter(F.col("amount") > 50.0).groupBy("country", "category")
                .agg(F.count("order_id").alias("total_orders"),
                     F.round(F.sum("amount"), 2).cast("double").alias("total_revenue"))
                .orderBy(F.col("total_revenue").desc()))
    return user_transform(sales(spark, sf), change)


@query("starter_pandas", STARTER)
def starter_pandas(spark, sf):
    """The pandas starter's named aggregation, as a Spark aggregate."""
    kept = sales(spark, sf).where("amount > 50.0").groupBy("country", "category")
    return kept.agg(F.count("order_id").alias("total_orders"),
                    F.sum("amount").cast("double").alias("total_revenue")).orderBy(F.desc("total_revenue"))
