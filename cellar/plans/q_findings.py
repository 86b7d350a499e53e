"""Query bindings: findings over customer, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import findings as FD
from cellar.plans.registry import register
from cellar.session import table

M = FD.MSG


def _q(s: str) -> str:
    return s.replace("'", "''")


def _tpl(template: str, *args: str) -> str:
    """SQL concat of a fixed template with SQL expressions in its '{}' slots."""
    pieces = template.split("{}")
    out = [f"'{_q(pieces[0])}'"]
    for a, p in zip(args, pieces[1:]):
        out += [f"CAST({a} AS VARCHAR)", f"'{_q(p)}'"]
    return " || ".join(out)


def findings_sql(view: str, cols: list[tuple[str, str]]) -> str:
    """DuckDB version of every rule for a table whose columns are (name, class)."""
    k = len(cols)
    num = [(c, i) for i, (c, k_) in enumerate(cols) if k_ == "numeric"]
    txt = [(c, i) for i, (c, k_) in enumerate(cols) if k_ == "text"]
    dts = [c for c, k_ in cols if k_ == "datetime"]
    miss = " + ".join(f"(count(*) - count({c}))" for c, _ in cols)
    parts = [
        f"t AS (SELECT * FROM {view})",
        f"""tm AS (SELECT count(*) AS n_rows, {k} AS n_cols, {miss} AS missing_cells,
                 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates FROM t)""",
        "tm2 AS (SELECT *, missing_cells * 100.0 / (n_rows * n_cols) AS mp FROM tm)",
    ]
    if num:
        nq = []
        for c, p in num:
            skew = f"""(SELECT CASE WHEN avg(power({c} - m, 2)) = 0 THEN NULL ELSE avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) END
                       FROM t, (SELECT avg({c}) m FROM t) WHERE {c} IS NOT NULL)"""
            outl = f"""(SELECT count(*) FROM t, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM t)
                       WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))"""
            nq.append(f"SELECT '{c}' AS col, {p} AS pos, count({c}) AS nn, avg({c}) AS mean, stddev_samp({c}) AS std, {skew} AS skew, {outl} AS outl FROM t")
        parts.append("numm AS (" + " UNION ALL ".join(nq) + ")")
        parts.append(
            """numm2 AS (SELECT *, CASE WHEN mean <> 0 THEN std / abs(mean) ELSE 'inf'::DOUBLE END AS cv,
                         CASE WHEN nn >= 3 THEN skew * sqrt(nn * (nn - 1)) / (nn - 2) END AS g1 FROM numm)"""
        )
    else:
        parts.append("numm2 AS (SELECT NULL::VARCHAR col, 0 pos, 0 nn, NULL::DOUBLE mean, NULL::DOUBLE std, NULL::DOUBLE cv, NULL::DOUBLE g1, 0 outl WHERE false)")
    if txt:
        tq = []
        for c, p in txt:
            tq.append(
                f"""SELECT '{c}' AS col, {p} AS pos, count({c}) = count(TRY_CAST({c} AS DOUBLE)) AS all_numeric, count(DISTINCT {c}) AS nunique,
                (SELECT first(v ORDER BY n DESC, v) FROM (SELECT {c} v, count(*) n FROM t WHERE {c} IS NOT NULL GROUP BY 1)) AS top_value,
                (SELECT max(n) FROM (SELECT count(*) n FROM t WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count FROM t"""
            )
        parts.append("txtm AS (" + " UNION ALL ".join(tq) + ")")
    else:
        parts.append("txtm AS (SELECT NULL::VARCHAR col, 0 pos, false all_numeric, 0 nunique, NULL::VARCHAR top_value, 0 top_count WHERE false)")
    pairs = []
    for i, (a, pa) in enumerate(num):
        for b, pb in num[i + 1 :]:
            pairs.append(
                f"""SELECT '{a}' AS v1, '{b}' AS v2, {pa} AS p1, {pb} AS p2,
                covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r
                FROM (SELECT CAST({a} AS DOUBLE) x, CAST({b} AS DOUBLE) y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
            )
    parts.append("corr AS (" + (" UNION ALL ".join(pairs) if pairs else "SELECT NULL v1, NULL v2, 0 p1, 0 p2, NULL::DOUBLE r WHERE false") + ")")
    n_num, n_txt, n_dt = len(num), len(txt), len(dts)
    dq, st, pt, rc, bz = "data_quality", "statistical", "patterns", "recommendations", "business_insights"
    R = []

    def one(cat, seq, text, cond):
        R.append(f"SELECT '{cat}' AS category, {seq} AS seq, {text} AS insight FROM tm2 WHERE {cond}")

    def listed(cat, seq, template, src, item, cond):
        R.append(
            f"SELECT '{cat}', {seq}, {_tpl(template, f'string_agg({item}, {chr(39)}, {chr(39)} ORDER BY pos)')} FROM {src} WHERE {cond} HAVING count(*) > 0"
        )

    one(dq, 1, _tpl(M["missing_high"], "printf('%.1f', mp)"), "mp > 20")
    one(dq, 2, _tpl(M["missing_moderate"], "printf('%.1f', mp)"), "mp > 5 AND mp <= 20")
    one(dq, 3, f"'{_q(M['missing_excellent'])}'", "mp < 1")
    one(dq, 4, _tpl(M["duplicates"], "duplicates", "printf('%.1f', duplicates * 100.0 / n_rows)"), "duplicates > 0")
    listed(dq, 5, M["mixed_types"], "txtm", "col", "all_numeric")
    one(dq, 6, f"'{_q(M['small'])}'", "n_rows < 100")
    one(dq, 7, f"'{_q(M['large'])}'", "n_rows > 100000")
    one(st, 1, f"'{_q(M['only_categorical'])}'", f"{n_num} = 0")
    listed(st, 2, M["high_var"], "numm2", "col", "std > 0 AND cv > 1")
    listed(st, 3, M["low_var"], "numm2", "col", "std > 0 AND cv < 0.1")
    listed(st, 4, M["skewed"], "numm2", "col || ' (' || CASE WHEN g1 > 0 THEN 'right' ELSE 'left' END || ')'", "abs(g1) > 1")
    listed(st, 5, M["outliers"], "numm2", "col || ' (' || CAST(outl AS VARCHAR) || ' outliers)'", "outl > (SELECT n_rows FROM tm) * 0.05")
    for seq, key, cond in [(1, "corr_pos", "r > 0.7"), (2, "corr_neg", "r < -0.7")]:
        item = "v1 || ' & ' || v2 || ' (' || printf('%.2f', r) || ')'"
        R.append(
            f"SELECT '{pt}', {seq}, {_tpl(M[key], f'string_agg({item}, {chr(39)}, {chr(39)} ORDER BY p1, p2)')} FROM corr WHERE {cond} HAVING count(*) > 0"
        )
    dom = "top_count * 100.0 / (SELECT n_rows FROM tm)"
    R.append(f"SELECT '{pt}', 10 + pos * 2, {_tpl(M['dominated'], 'col', 'top_value', f'printf({chr(39)}%.1f{chr(39)}, {dom})')} FROM txtm WHERE nunique > 1 AND {dom} > 80")
    R.append(f"SELECT '{pt}', 11 + pos * 2, {_tpl(M['cardinality'], 'col', 'nunique')} FROM txtm WHERE nunique > 10")
    one(pt, 1000000, f"'{_q(M['time'])}'", f"{n_dt} > 0 AND {n_num} > 0")
    for seq, key, cond in [
        (1, "rec_regression", f"{n_num} >= 2"),
        (2, "rec_groupby", f"{n_txt} > 0 AND {n_num} > 0"),
        (3, "rec_chi2", f"{n_txt} >= 2"),
        (4, "rec_impute", "mp > 5"),
        (5, "rec_sampling", "n_rows > 10000"),
        (6, "rec_distribution", f"{n_num} > 0"),
        (7, "rec_bar", f"{n_txt} > 0"),
        (8, "rec_scatter", f"{n_num} >= 2"),
    ]:
        one(rc, seq, f"'{_q(M[key])}'", cond)
    for seq, key, cond in [
        (1, "biz_small", "n_rows < 1000"),
        (2, "biz_medium", "n_rows >= 1000 AND n_rows < 10000"),
        (3, "biz_large", "n_rows >= 10000"),
        (4, "biz_rich", "n_cols > 20"),
        (5, "biz_limited", "n_cols < 5"),
        (6, "biz_quality_good", "mp < 2"),
        (7, "biz_quality_bad", "mp > 15"),
        (8, "biz_kpi", f"{n_num} > 0"),
        (9, "biz_segments", f"{n_txt} > 0"),
    ]:
        one(bz, seq, f"'{_q(M[key])}'", cond)
    labels = " ".join(f"WHEN '{k_}' THEN '{v}'" for k_, v in FD.CATEGORIES.items())
    order = " ".join(f"WHEN '{k_}' THEN {i}" for i, k_ in enumerate(FD.CATEGORIES))
    low = " OR ".join(f"contains(insight, '{m}')" for m in FD.LOW_MARKS)
    high = " OR ".join(f"contains(insight, '{m}')" for m in FD.HIGH_MARKS)
    return (
        "WITH "
        + ",\n".join(parts)
        + ",\nallr AS ("
        + "\nUNION ALL\n".join(R)
        + ")\n"
        + f"""SELECT CASE category {labels} END AS category, insight,
               CASE WHEN {low} THEN 'Low' WHEN {high} THEN 'High' ELSE 'Medium' END AS priority,
               row_number() OVER (PARTITION BY category ORDER BY seq) AS "index",
               CASE category {order} END AS category_order, seq FROM allr"""
    )


def _spark_rows(df):
    r = FD.findings(df)
    return r.select("category", "insight", "priority", F.col("index").cast("bigint").alias("index"), "category_order", "seq")


_CUST_COLS = [("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "text")]


@register("ins_rows", findings_sql("customer", _CUST_COLS))
def q_ins_customer(spark, d):
    return _spark_rows(table(spark, d, "customer"))


_ORD_VIEW = """(SELECT o_orderkey % 4000 AS okey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price,
   o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS prio, o_orderdate,
   CAST(o_custkey % 10 AS VARCHAR) AS ck_txt, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 1000.0 END * (o_orderkey % 7) AS spiky,
   o_totalprice * 2 AS price2 FROM orders)"""
_ORD_COLS = [
    ("okey", "numeric"),
    ("price", "numeric"),
    ("o_orderstatus", "text"),
    ("prio", "text"),
    ("o_orderdate", "datetime"),
    ("ck_txt", "text"),
    ("spiky", "numeric"),
    ("price2", "numeric"),
]


# more than a fifth of the values missing: the high-priority findings
_BAD_VIEW = """(SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS price,
   CASE WHEN o_orderkey % 4 > 0 THEN NULL ELSE o_orderpriority END AS prio, o_orderdate FROM orders)"""
_BAD_COLS = [("price", "numeric"), ("prio", "text"), ("o_orderdate", "datetime")]


def _orders_dirty(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (k % 4000).alias("okey"),
        F.when(k % 9 == 0, None).otherwise(F.col("o_totalprice")).alias("price"),
        "o_orderstatus",
        F.when(k % 4 == 0, None).otherwise(F.col("o_orderpriority")).alias("prio"),
        "o_orderdate",
        (F.col("o_custkey") % 10).cast("string").alias("ck_txt"),
        (F.when(k % 3 == 0, F.lit(1.0)).otherwise(F.lit(1000.0)) * (k % 7)).alias("spiky"),
        (F.col("o_totalprice") * 2).alias("price2"),
    )


@register("ins_rows_orders", findings_sql(_ORD_VIEW, _ORD_COLS))
def q_ins_orders(spark, d):
    return _spark_rows(_orders_dirty(spark, d))


@register(
    "ins_all",
    f"SELECT category, \"index\", insight FROM ({findings_sql(_ORD_VIEW, _ORD_COLS)})",
)
def q_ins_all(spark, d):
    return FD.findings_flat(FD.findings(_orders_dirty(spark, d))).withColumn("index", F.col("index").cast("bigint"))


@register(
    "ins_high_priority",
    f"SELECT * FROM ({findings_sql(_BAD_VIEW, _BAD_COLS)}) WHERE priority = 'High'",
)
def q_ins_high(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    bad = o.select(
        F.when(k % 2 == 0, None).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 4 > 0, None).otherwise(F.col("o_orderpriority")).alias("prio"),
        "o_orderdate",
    )
    return FD.high_priority(_spark_rows(bad))


@register(
    "ins_recommendations",
    f"SELECT * FROM ({findings_sql('lineitem', [(c, 'numeric') for c in ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']] + [('l_returnflag', 'text'), ('l_linestatus', 'text'), ('l_shipdate', 'datetime')])}) WHERE category = 'Recommendations'",
)
def q_ins_rec(spark, d):
    return FD.recommendations(_spark_rows(table(spark, d, "lineitem")))


def _report_sql(view: str, cols) -> str:
    """The Markdown report over the findings SQL: sections in category order, lines in index order."""
    names = [c[0] if isinstance(c, tuple) else c for c in cols]
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in names)
    cats = ", ".join(f"'{c}'" for c in FD.CATEGORIES.values())
    nl = "chr(10)"
    title = FD.REPORT_TITLE.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"""WITH f AS ({findings_sql(view, cols)}),
      s AS (SELECT list_position([{cats}], category) AS o, '### ' || category || {nl} || string_agg('- ' || insight, {nl} ORDER BY index) AS block FROM f GROUP BY category),
      t AS (SELECT count(*) AS n, ({nulls}) * 100.0 / (count(*) * {len(names)}) AS miss FROM {view})
      SELECT '{title}' || {nl} || {nl} || '## Dataset Overview' || {nl} || '- **Records**: ' || format('{{:,}}', n) || {nl} || '- **Features**: {len(names)}' || {nl} ||
             '- **Missing Data**: ' || printf('%.1f', miss) || '%' || {nl} || {nl} || '## 🔍 Key Insights' || {nl} || {nl} ||
             (SELECT string_agg(block, {nl} || {nl} ORDER BY o) FROM s) AS report FROM t"""


@register("ins_report", _report_sql(_ORD_VIEW, _ORD_COLS))
def q_ins_report(spark, d):
    return FD.report(_orders_dirty(spark, d))


def _group_query(key: str, label: str):
    @register(key, f"SELECT * FROM ({findings_sql(_ORD_VIEW, _ORD_COLS)}) WHERE category = '{label}'")
    def q(spark, d):
        return _spark_rows(_orders_dirty(spark, d)).filter(F.col("category") == label)

    return q


# one query per finding group (ins_data_quality ... ins_business)
for _key, _cat in [
    ("ins_data_quality", "data_quality"),
    ("ins_statistical", "statistical"),
    ("ins_patterns", "patterns"),
    ("ins_business", "business_insights"),
]:
    _group_query(_key, FD.CATEGORIES[_cat])
