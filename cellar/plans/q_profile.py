"""Query bindings: profiling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import profile as P
from cellar.plans.registry import register
from cellar.session import table

# lineitem numerics with derived nulls in l_discount
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_VIEW = "(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"


def _li(spark, d):
    return (
        table(spark, d, "lineitem")
        .withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
        .select(*_NUM, "l_returnflag", "l_linestatus", "l_shipdate")
    )


def _num_profile_sql(view: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""
        SELECT '{c}' AS "column",
          count({c}) AS count, count(*) - count({c}) AS missing,
          round(avg({c}), 3) AS mean,
          round(quantile_cont({c}, 0.5), 3) AS median,
          round((SELECT first(v ORDER BY n DESC, v ASC) FROM (SELECT {c} AS v, count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})), 3) AS mode,
          round(stddev_samp({c}), 3) AS std,
          round(min({c}), 3) AS min, round(max({c}), 3) AS max,
          round(quantile_cont({c}, 0.25), 3) AS q1, round(quantile_cont({c}, 0.75), 3) AS q3,
          round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 3) AS iqr,
          round((SELECT avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5)
                 FROM {view}, (SELECT avg({c}) AS m FROM {view}) WHERE {c} IS NOT NULL), 3) AS skewness,
          round(kurtosis_pop({c}), 3) AS kurtosis,
          (SELECT count(*) FROM {view}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {view})
             WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers
        FROM {view}"""
        )
    return "\nUNION ALL\n".join(parts)


@register("agg_numeric_profile", _num_profile_sql(_LI_VIEW, _NUM))
def q_numeric_profile(spark, d):
    return P.numeric_profile(_li(spark, d), _NUM)


def _describe_sql(view, cols):
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM {view}"""
        for c in cols
    ]
    return "\nUNION ALL\n".join(parts)


@register("agg_describe", _describe_sql(_LI_VIEW, _NUM))
def q_describe(spark, d):
    out = P.describe(_li(spark, d), _NUM)
    return out.select(
        "column", "count", *[F.round(c, 6).alias(c) for c in ["mean", "std"]], "min",
        *[F.round(c, 6).alias(c) for c in ["q25", "q50", "q75"]], "max",
    )


_TXT = ["o_orderstatus", "o_orderpriority", "o_clerk_like"]
_ORD_VIEW = "(SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 37 AS VARCHAR) END AS o_clerk_like, o_totalprice, o_orderdate FROM orders)"


def _orders_txt(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderstatus",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 == 0, None).otherwise((F.col("o_custkey") % 37).cast("string")).alias("o_clerk_like"),
        "o_totalprice",
        "o_orderdate",
    )


def _cat_profile_sql(view, cols):
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
            count(DISTINCT {c}) AS unique,
            (SELECT first(v ORDER BY n DESC, v ASC) FROM (SELECT {c} AS v, count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_value,
            (SELECT max(n) FROM (SELECT count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_frequency,
            round((SELECT max(n) FROM (SELECT count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})) * 100.0 / count({c}), 3) AS top_percentage
            FROM {view}"""
        )
    return "\nUNION ALL\n".join(parts)


@register("agg_categorical_profile", _cat_profile_sql(_ORD_VIEW, _TXT))
def q_cat_profile(spark, d):
    return P.categorical_profile(_orders_txt(spark, d), _TXT)


@register(
    "agg_general_info",
    f"""SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(1 AS BIGINT) AS n_numeric,
        CAST(3 AS BIGINT) AS n_categorical, count(*) - count(o_clerk_like) AS total_missing FROM {_ORD_VIEW}""",
)
def q_general_info(spark, d):
    return P.general_info(_orders_txt(spark, d))


@register(
    "agg_overview",
    f"""SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns,
        count(*) - count(l_discount) AS missing_cells,
        round((count(*) - count(l_discount)) * 100.0 / (count(*) * 7), 2) AS missing_pct,
        CAST(6 AS BIGINT) AS cols_complete, CAST(1 AS BIGINT) AS cols_partly_missing, CAST(0 AS BIGINT) AS cols_fully_missing,
        CAST(4 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_text, CAST(1 AS BIGINT) AS n_datetime, CAST(0 AS BIGINT) AS n_boolean
        FROM {_LI_VIEW}""",
)
def q_overview(spark, d):
    return P.overview(_li(spark, d))


def _outlier_iqr_sql(view, cols):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers
        FROM {view}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {view})"""
        for c in cols
    )


_EV_VIEW = "(SELECT event_id, user_id, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n FROM events)"
_EV_NUM = ["user_id", "value", "value_n"]


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value_n"))


@register("agg_outlier_count_iqr", _outlier_iqr_sql(_EV_VIEW, _EV_NUM))
def q_outlier_iqr(spark, d):
    return P.outlier_counts(_events(spark, d), _EV_NUM, "iqr")


def _outlier_z_sql(view, cols):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS outliers
        FROM {view}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {view})"""
        for c in cols
    )


@register("agg_outlier_count_zscore", _outlier_z_sql(_EV_VIEW, _EV_NUM))
def q_outlier_z(spark, d):
    return P.outlier_counts(_events(spark, d), _EV_NUM, "zscore")


def _missing_sql(view, cols_types):
    n = "(SELECT count(*) FROM " + view + ")"
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0 / {n}, 2) AS missing_pct, '{t}' AS data_type FROM {view}"""
        for c, t in cols_types
    )


_LI_TYPES = [
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]


@register("agg_missing", _missing_sql(_LI_VIEW, _LI_TYPES))
def q_missing(spark, d):
    return P.missing(_li(spark, d))


@register(
    "agg_missing_nonzero",
    f"SELECT * FROM ({_missing_sql(_LI_VIEW, _LI_TYPES)}) WHERE missing_count > 0",
)
def q_missing_nz(spark, d):
    return P.missing(_li(spark, d), hide_zero=True)


_CORR_COLS = ["o_totalprice", "o_custkey", "o_orderkey", "price_x2", "price_n"]
_CORR_VIEW = "(SELECT o_totalprice, o_custkey, o_orderkey, o_totalprice * 2 + o_orderkey % 3 AS price_x2, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price_n FROM orders)"


def _corr_df(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_totalprice",
        "o_custkey",
        "o_orderkey",
        (F.col("o_totalprice") * 2 + F.col("o_orderkey") % 3).alias("price_x2"),
        F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_totalprice")).alias("price_n"),
    )


def _corr_sql(view, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            parts.append(
                f"""SELECT '{a}' AS var1, '{b}' AS var2,
                round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 3) AS corr
                FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
            )
    return "\nUNION ALL\n".join(parts)


@register("agg_corr_matrix", _corr_sql(_CORR_VIEW, _CORR_COLS))
def q_corr(spark, d):
    return P.corr_long(_corr_df(spark, d), _CORR_COLS)


_PIVOT = ", ".join(f"max(CASE WHEN var2 = '{c}' THEN corr END) AS {c}" for c in _CORR_COLS)


@register(
    "agg_corr_matrix_square",
    f"""WITH l AS ({_corr_sql(_CORR_VIEW, _CORR_COLS)}),
        b AS (SELECT * FROM l UNION ALL SELECT var2, var1, corr FROM l UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest([{", ".join(f"'{c}'" for c in _CORR_COLS)}]) AS c))
        SELECT var1 AS variable, {_PIVOT} FROM b GROUP BY var1""",
)
def q_corr_square(spark, d):
    return P.corr_matrix(_corr_df(spark, d), _CORR_COLS)


# lineitem's measures and their products: 16 columns, 120 pairs, every third discount and tax missing
_MANY = {
    f"{a}_{k}": e.format(a=c)
    for a, c in (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END"), ("tax", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END"))
    for k, e in (("one", "({a})"), ("sq", "({a}) * ({a})"), ("by_line", "({a}) * l_linenumber"), ("by_qty", "({a}) * l_quantity"))
}
_MANY_VIEW = f"(SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _MANY.items())} FROM lineitem)"


@register("agg_corr_matrix_many", _corr_sql(_MANY_VIEW, list(_MANY)))
def q_corr_many(spark, d):
    li = table(spark, d, "lineitem")
    return P.corr_long(li.select(*[F.expr(e).cast("double").alias(n) for n, e in _MANY.items()]), list(_MANY))


_DATES_VIEW = "(SELECT CAST(l_shipdate AS TIMESTAMP) AS shipped, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_linenumber AS BIGINT)) END AS seen FROM lineitem)"


def _describe_dates_sql(cols):
    us = lambda x: f"make_timestamp(CAST(round({x}) AS BIGINT))"
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {us(f"avg(epoch_us({c}))")} AS mean, min({c}) AS min,
        {us(f"quantile_cont(epoch_us({c})::DOUBLE, 0.25)")} AS q25, {us(f"quantile_cont(epoch_us({c})::DOUBLE, 0.5)")} AS q50,
        {us(f"quantile_cont(epoch_us({c})::DOUBLE, 0.75)")} AS q75, max({c}) AS max FROM {_DATES_VIEW}"""
        for c in cols
    )


@register("agg_describe_datetime", _describe_dates_sql(["shipped", "seen"]))
def q_describe_dates(spark, d):
    li = table(spark, d, "lineitem")
    shipped = F.col("l_shipdate").cast("timestamp_ntz")
    seen = F.when(F.col("l_orderkey") % 7 != 0, shipped + F.make_dt_interval(hours=F.col("l_linenumber").cast("int")))
    return P.describe_datetimes(li.select(shipped.alias("shipped"), seen.alias("seen")))


@register(
    "agg_strong_corr",
    f"""SELECT var1, var2, round(r, 3) AS corr,
        CASE WHEN abs(r) >= 0.9 THEN 'Very Strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate'
             WHEN abs(r) >= 0.3 THEN 'Weak' ELSE 'Very Weak' END AS strength
        FROM ({_corr_sql(_CORR_VIEW, _CORR_COLS).replace('round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 3) AS corr', 'covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r')})
        WHERE abs(r) >= 0.7""",
)
def q_strong_corr(spark, d):
    return P.strong_correlations(_corr_df(spark, d), _CORR_COLS)


_QI_VIEW = "(SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS prio, CAST(NULL AS VARCHAR) AS empty_col, 'x' AS const_col, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 50 END AS k50 FROM orders)"


def _qi_df(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.lit(None).cast("string").alias("empty_col"),
        F.lit("x").alias("const_col"),
        "o_totalprice",
        F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderkey") % 50).alias("k50"),
    )


_QI_SQL = f"""
SELECT 'duplicates' AS issue, CAST(NULL AS VARCHAR) AS "column", (SELECT count(*) FROM {_QI_VIEW}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_QI_VIEW})) AS value
UNION ALL
SELECT 'missing_values', NULL, (SELECT count(*) - count(empty_col) + count(*) - count(k50) FROM {_QI_VIEW})
UNION ALL
SELECT 'all_null', 'empty_col', 1
UNION ALL
SELECT 'single_value', 'const_col', 1
UNION ALL
SELECT 'outliers', c, n FROM (
  SELECT 'o_totalprice' AS c, count(*) FILTER (WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n
  FROM {_QI_VIEW}, (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM {_QI_VIEW})
  UNION ALL
  SELECT 'k50', count(*) FILTER (WHERE k50 < a - 1.5 * (b - a) OR k50 > b + 1.5 * (b - a))
  FROM {_QI_VIEW}, (SELECT quantile_cont(k50, 0.25) a, quantile_cont(k50, 0.75) b FROM {_QI_VIEW})
) WHERE n > 0
UNION ALL
SELECT 'mixed_case', c, 1 FROM (
  SELECT 'prio' AS c,
    bool_or(prio = lower(prio) AND prio <> upper(prio)) AND bool_or(prio = upper(prio) AND prio <> lower(prio)) AS m FROM {_QI_VIEW}
  UNION ALL
  SELECT 'o_orderstatus',
    bool_or(o_orderstatus = lower(o_orderstatus) AND o_orderstatus <> upper(o_orderstatus)) AND bool_or(o_orderstatus = upper(o_orderstatus) AND o_orderstatus <> lower(o_orderstatus)) FROM {_QI_VIEW}
  UNION ALL
  SELECT 'const_col', bool_or(const_col = lower(const_col) AND const_col <> upper(const_col)) AND bool_or(const_col = upper(const_col) AND const_col <> lower(const_col)) FROM {_QI_VIEW}
) WHERE m
"""


@register("agg_quality_issues", _QI_SQL)
def q_quality(spark, d):
    return P.quality_issues(_qi_df(spark, d))


def _metrics_sql(view, cols, text):
    n = f"(SELECT count(*) FROM {view})"
    parts = []
    for c in cols:
        empty = f"count(*) FILTER (WHERE {c} = '')" if c in text else "0"
        parts.append(
            f"""SELECT '{c}' AS "column", round(count({c}) * 100.0 / {n}, 4) AS completeness,
            round(coalesce(count(DISTINCT {c}) * 100.0 / nullif(count({c}), 0), 0.0), 4) AS uniqueness,
            round((count({c}) - {empty}) * 100.0 / {n}, 4) AS validity FROM {view}"""
        )
    return "\nUNION ALL\n".join(parts)


_PM_VIEW = "(SELECT p_name, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS brand, p_size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END AS price FROM part)"


def _pm_df(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_name",
        F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("brand"),
        "p_size",
        F.when(F.col("p_partkey") % 10 == 0, None).otherwise(F.col("p_retailprice")).alias("price"),
    )


@register("agg_profile_metrics", _metrics_sql(_PM_VIEW, ["p_name", "brand", "p_size", "price"], {"p_name", "brand"}))
def q_profile_metrics(spark, d):
    return P.profile_metrics(_pm_df(spark, d))


def _ds_overview_sql(view, cols):
    parts = []
    for c, t, num in cols:
        mm = f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) AS mean" if num else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
        parts.append(
            f"""SELECT '{c}' AS "column", '{t}' AS data_type, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, {mm} FROM {view}"""
        )
    return "\nUNION ALL\n".join(parts)


@register(
    "agg_dataset_overview",
    _ds_overview_sql(_PM_VIEW, [("p_name", "string", False), ("brand", "string", False), ("p_size", "int", True), ("price", "double", True)]),
)
def q_ds_overview(spark, d):
    return P.dataset_overview(_pm_df(spark, d))
