"""Query bindings: formatting flags (§2.10) and chart data (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.functions.safe import round_num
from cellar.operators import chartdata as C
from cellar.operators import flags as FG
from cellar.plans.registry import register
from cellar.session import table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@register(
    "cf_color_scale",
    """SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo + 1e-9), 6) AS o_totalprice_scale
       FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)""",
)
def q_scale(spark, d):
    out = FG.color_scale(_orders(spark, d), "o_totalprice")
    return out.select("o_orderkey", round_num("o_totalprice_scale", 6).alias("o_totalprice_scale"))


@register(
    "cf_color_scale_rev",
    """SELECT o_orderkey, round(1.0 - (o_totalprice - lo) / (hi - lo + 1e-9), 6) AS o_totalprice_scale_rev
       FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)""",
)
def q_scale_rev(spark, d):
    out = FG.color_scale(_orders(spark, d), "o_totalprice", reverse=True)
    return out.select("o_orderkey", round_num("o_totalprice_scale_rev", 6).alias("o_totalprice_scale_rev"))


@register(
    "cf_top10pct",
    """SELECT o_orderkey, o_totalprice, o_totalprice >= t AS o_totalprice_top
       FROM orders, (SELECT quantile_cont(o_totalprice, 0.9) t FROM orders)""",
)
def q_top10(spark, d):
    return FG.top_pct(_orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice")


@register(
    "cf_bottom10pct",
    """SELECT o_orderkey, o_totalprice, o_totalprice <= t AS o_totalprice_bottom
       FROM orders, (SELECT quantile_cont(o_totalprice, 0.1) t FROM orders)""",
)
def q_bottom10(spark, d):
    return FG.bottom_pct(_orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice")


@register(
    "cf_above_avg",
    """SELECT o_orderkey, o_totalprice, o_totalprice > m AS o_totalprice_above_avg FROM orders, (SELECT avg(o_totalprice) m FROM orders)""",
)
def q_above(spark, d):
    return FG.above_average(_orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice")


@register(
    "cf_below_avg",
    """SELECT o_orderkey, o_totalprice, o_totalprice < m AS o_totalprice_below_avg FROM orders, (SELECT avg(o_totalprice) m FROM orders)""",
)
def q_below(spark, d):
    return FG.below_average(_orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice")


@register(
    "cf_duplicates",
    """SELECT o_orderkey, k, count(*) OVER (PARTITION BY k) > 1 AS k_dup
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)""",
)
def q_cf_dup(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("o_custkey")).alias("k")
    )
    return FG.duplicates(o, "k")


@register(
    "cf_blanks",
    """SELECT o_orderkey, k, k IS NULL AS k_blank
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)""",
)
def q_cf_blank(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("o_custkey")).alias("k")
    )
    return FG.blanks(o, "k")


@register(
    "ch_histogram",
    """WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi, avg(l_extendedprice) m,
                  quantile_cont(l_extendedprice, 0.5) med FROM lineitem),
       b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(30, CAST(floor((l_extendedprice - lo) * 30 / (hi - lo)) AS INTEGER) + 1) END AS bin
             FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
       SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) AS lower, round(lo + bin * ((hi - lo) / 30), 6) AS upper,
              count(*) AS count, round(m, 6) AS mean, round(med, 6) AS median
       FROM b, s GROUP BY bin, lo, hi, m, med""",
)
def q_hist(spark, d):
    h = C.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30)
    return h.select("bin", *[round_num(c, 6).alias(c) for c in ["lower", "upper"]], "count", *[round_num(c, 6).alias(c) for c in ["mean", "median"]])


@register(
    "ch_scatter",
    "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
)
def q_scatter(spark, d):
    return C.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@register(
    "ch_trendline",
    """SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n_points, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
       FROM lineitem HAVING regr_count(l_extendedprice, l_quantity) > 10""",
)
def q_trend(spark, d):
    t = C.trendline(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select(F.col("n_points").cast("bigint").alias("n_points"), *[round_num(c, 6).alias(c) for c in ["slope", "intercept", "r2"]])


_BOX_SQL = """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) med,
                  quantile_cont(o_totalprice, 0.75) q3 FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT q.o_orderpriority, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
  max(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  count(*) FILTER (WHERE NOT (o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1))) AS n_outliers,
  count(*) AS n
FROM orders JOIN q USING (o_orderpriority) GROUP BY q.o_orderpriority, q1, med, q3
"""


@register("ch_box", _BOX_SQL)
def q_box(spark, d):
    b = C.box(_orders(spark, d), "o_totalprice", "o_orderpriority")
    return b.select("o_orderpriority", *[round_num(c, 6).alias(c) for c in ["q1", "median", "q3"]], "lower_whisker", "upper_whisker", "n_outliers", "n")


@register("ch_box_by_customer", _BOX_SQL.replace("o_orderpriority", "o_custkey"))
def q_box_many(spark, d):
    # a group for every customer
    b = C.box(_orders(spark, d), "o_totalprice", "o_custkey")
    return b.select("o_custkey", *[round_num(c, 6).alias(c) for c in ["q1", "median", "q3"]], "lower_whisker", "upper_whisker", "n_outliers", "n")


@register(
    "ch_box_all",
    """WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) med, quantile_cont(value, 0.75) q3 FROM events)
       SELECT round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
         min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
         max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
         count(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS n_outliers,
         count(*) AS n FROM events, q GROUP BY q1, med, q3""",
)
def q_box_all(spark, d):
    b = C.box(table(spark, d, "events"), "value")
    return b.select(*[round_num(c, 6).alias(c) for c in ["q1", "median", "q3"]], "lower_whisker", "upper_whisker", "n_outliers", "n")


@register(
    "ch_bar_counts",
    "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count DESC, o_orderpriority LIMIT 20",
)
def q_bar(spark, d):
    from cellar.operators.aggregate import top_values

    return top_values(table(spark, d, "orders"), "o_orderpriority", 20)


@register(
    "ch_series",
    """SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 4) AS sum_l_quantity
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def q_series(spark, d):
    s = C.series(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")
    return s.withColumn("sum_l_quantity", round_num("sum_l_quantity", 4))


def _corr2_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            parts.append(
                f"""SELECT '{a}' AS var1, '{b}' AS var2, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 2) AS corr
                FROM (SELECT CAST({a} AS DOUBLE) x, CAST({b} AS DOUBLE) y FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
            )
    return "\nUNION ALL\n".join(parts)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("ch_corr_heatmap", _corr2_sql(_LI_NUM))
def q_heat(spark, d):
    return C.corr_heatmap(table(spark, d, "lineitem"), _LI_NUM)


@register(
    "ch_missing_matrix",
    """SELECT event_id, CAST(event_id % 7 = 0 AS INTEGER) AS value, CAST(event_id % 5 = 0 AS INTEGER) AS event_type FROM events""",
)
def q_missing_matrix(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
    )
    return C.missing_matrix(e, "event_id")


def _dist_sql(cols, bins):
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS "column", bin, round(lo + (bin - 1) * ((hi - lo) / {bins}), 6) AS lower,
                round(lo + bin * ((hi - lo) / {bins}), 6) AS upper, count(*) AS count FROM
              (SELECT CASE WHEN hi = lo THEN 1 ELSE least({bins}, CAST(floor((v - lo) * {bins} / (hi - lo)) AS INTEGER) + 1) END AS bin, lo, hi
               FROM (SELECT CAST({c} AS DOUBLE) v FROM lineitem WHERE {c} IS NOT NULL),
                    (SELECT CAST(min({c}) AS DOUBLE) lo, CAST(max({c}) AS DOUBLE) hi FROM lineitem))
             GROUP BY bin, lo, hi"""
        )
    return "\nUNION ALL\n".join(parts)


@register("ch_distributions", _dist_sql(["l_quantity", "l_discount", "l_tax"], 10))
def q_dist(spark, d):
    r = C.distributions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "histogram", 10)
    return r.select("column", "bin", round_num("lower", 6).alias("lower"), round_num("upper", 6).alias("upper"), "count")


@register(
    "ch_distributions_box",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
            round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def q_dist_box(spark, d):
    r = C.distributions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "box")
    return r.select("column", *[round_num(c, 6).alias(c) for c in ["q1", "median", "q3"]])


@register(
    "ch_pie",
    """SELECT o_orderstatus, round(coalesce(sum(o_totalprice), 0), 4) AS sum_o_totalprice,
              round(coalesce(sum(o_totalprice), 0) * 100.0 / (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus IS NOT NULL), 2) AS share_pct
       FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""",
)
def q_pie(spark, d):
    p = C.pie(_orders(spark, d), "o_orderstatus", "o_totalprice")
    return p.withColumn("sum_o_totalprice", round_num("sum_o_totalprice", 4))


@register(
    "ch_waterfall",
    """SELECT o_orderpriority, round(s, 4) AS sum_o_totalprice,
              round(coalesce(sum(s) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS base,
              round(sum(s) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING), 4) AS "end"
       FROM (SELECT o_orderpriority, coalesce(sum(o_totalprice), 0) s FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)""",
)
def q_waterfall(spark, d):
    w = C.waterfall(_orders(spark, d), "o_orderpriority", "o_totalprice")
    return w.select("o_orderpriority", *[round_num(c, 4).alias(c) for c in ["sum_o_totalprice", "base", "end"]])


@register(
    "ch_funnel",
    """SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 4) AS sum_o_totalprice FROM orders
       WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC""",
)
def q_funnel(spark, d):
    f = C.funnel(_orders(spark, d), "o_orderpriority", "o_totalprice")
    return f.withColumn("sum_o_totalprice", round_num("sum_o_totalprice", 4))
