"""Rule-based findings over one set of table metrics.

The metrics are computed once, distributed, by the profile operators: one table
row, one row per column, one row per numeric column pair. Each rule is a tiny
DataFrame over those small tables that yields zero or one finding; the
findings are unioned, numbered per category and given a priority. The report
is one string assembled from the (small) findings table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellar.functions.safe import datetime_columns, numeric_columns, text_columns
from cellar.operators.frequent import text_summary
from cellar.operators.profile import _moments_long, corr_long, distinct_rows, outlier_counts
from cellar.session import materialize

# ---------------------------------------------------------------------------
# Finding texts ({} are filled from the metrics), thresholds,
# category labels and priority marks.
MSG = {
    "missing_high": "⚠️ High missing data detected ({}%). Consider data imputation or collection improvement.",
    "missing_moderate": "📊 Moderate missing data present ({}%). Review data collection processes.",
    "missing_excellent": "✅ Excellent data completeness with minimal missing values.",
    "duplicates": "🔄 Found {} duplicate records ({}%). Consider deduplication.",
    "mixed_types": "🔧 Potential data type issues in columns: {}. Consider type conversion.",
    "small": "📏 Small dataset detected. Results may have limited statistical significance.",
    "large": "📈 Large dataset provides good statistical power for analysis.",
    "only_categorical": "📝 Dataset contains only categorical data. Focus on frequency and distribution analysis.",
    "high_var": "📊 High variability detected in: {}. Consider normalization or outlier analysis.",
    "low_var": "📉 Low variability in: {}. These variables may have limited predictive power.",
    "skewed": "📐 Significant skewness detected in: {}. Consider transformation for normality.",
    "outliers": "🎯 Notable outliers in: {}. Investigate for data quality or special cases.",
    "corr_pos": "🔗 Strong positive correlations found: {}",
    "corr_neg": "🔄 Strong negative correlations found: {}",
    "dominated": "📊 {} is dominated by '{}' ({}% of data)",
    "cardinality": "🗂️ {} has high cardinality ({} unique values). Consider grouping rare categories.",
    "time": "📅 Time-based data detected. Consider seasonal trends and time series analysis.",
    "rec_regression": "📈 Consider regression analysis to model relationships between numeric variables",
    "rec_groupby": "📊 Perform group-by analysis to understand how categories affect numeric metrics",
    "rec_chi2": "🔍 Use chi-square tests to analyze relationships between categorical variables",
    "rec_impute": "🛠️ Implement missing data imputation strategies (mean, median, or advanced methods)",
    "rec_sampling": "⚡ Consider sampling techniques for faster exploratory analysis on this large dataset",
    "rec_distribution": "📊 Create distribution plots to understand data spread and identify outliers",
    "rec_bar": "📋 Use bar charts and pie charts to visualize categorical distributions",
    "rec_scatter": "🎯 Generate scatter plots and correlation heatmaps to explore relationships",
    "biz_small": "🏢 Small-scale dataset suitable for detailed individual analysis and quality review",
    "biz_medium": "🏬 Medium-scale dataset ideal for departmental analysis and tactical decisions",
    "biz_large": "🏭 Large-scale dataset suitable for strategic analysis and predictive modeling",
    "biz_rich": "📋 Rich feature set provides comprehensive analytical opportunities",
    "biz_limited": "📝 Limited feature set may require additional data collection for deeper insights",
    "biz_quality_good": "✅ High data quality supports reliable business decision-making",
    "biz_quality_bad": "⚠️ Data quality issues may impact decision confidence - invest in data collection improvement",
    "biz_kpi": "📊 Quantitative metrics available for KPI tracking and performance measurement",
    "biz_segments": "🏷️ Categorical data enables segmentation and targeted analysis",
}
CATEGORIES = {
    "data_quality": "Data Quality",
    "statistical": "Statistical",
    "patterns": "Patterns",
    "recommendations": "Recommendations",
    "business_insights": "Business Insights",
}
HIGH_MARKS = ("⚠️", "🚨")
LOW_MARKS = ("✅", "📈", "💡")
REPORT_TITLE = "# 📊 Data Analysis Report"
# ---------------------------------------------------------------------------


def _fmt(template: str, *args: Column) -> Column:
    """Fill '{}' slots of a fixed template with Column values."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for a, p in zip(args, pieces[1:]):
        out += [a.cast("string"), F.lit(p)]
    return F.concat(*out)


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f", x)


def _row(src: DataFrame, cat: str, seq: int, text: Column, cond: Column) -> DataFrame:
    return src.filter(cond).select(F.lit(cat).alias("category"), F.lit(seq).alias("seq"), text.alias("insight"))


def _listed(cm: DataFrame, cond: Column, item: Column) -> DataFrame:
    """One row: items of matching columns joined with ', ' in column order (<= #columns rows)."""
    items = cm.filter(cond).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), item.alias("it")))).alias("a"))
    return items.select(F.array_join(F.transform("a", lambda s: s["it"]), ", ").alias("items"), F.size("a").alias("n"))


def table_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table row, per-column metrics, numeric correlation pairs)."""
    fields = df.schema.fields
    num, txt, dts = numeric_columns(df), text_columns(df), datetime_columns(df)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        miss = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
        aggs.append(F.count_if(miss).alias(f"m{i}"))
    for i, c in enumerate(txt):
        aggs.append(F.count(F.col(c)).alias(f"tn{i}"))
        aggs.append(F.count(F.col(c).try_cast("double")).alias(f"tp{i}"))
    wide = df.agg(*aggs)
    n_distinct = distinct_rows(df).select(F.count(F.lit(1))).scalar()
    k = len(fields)
    trow = wide.select(
        "n_rows",
        F.lit(k).alias("n_cols"),
        sum((F.col(f"m{i}") for i in range(k)), F.lit(0).cast("bigint")).alias("missing_cells"),
        (F.col("n_rows") - n_distinct).alias("duplicates"),
        F.lit(len(num)).alias("n_numeric"),
        F.lit(len(txt)).alias("n_text"),
        F.lit(len(dts)).alias("n_datetime"),
    ).withColumn("missing_pct", F.try_divide(F.col("missing_cells") * 100.0, F.col("n_rows") * F.col("n_cols")))

    # text columns: numeric-parsable flag, distinct count and top value
    text_rows = [
        F.struct(F.lit(c).alias("column"), (F.col(f"tp{i}") == F.col(f"tn{i}")).alias("all_numeric")) for i, c in enumerate(txt)
    ]
    pos = {f.name: i for i, f in enumerate(fields)}
    cls = {f.name: ("numeric" if f.name in num else "text" if f.name in txt else "datetime" if f.name in dts else "other") for f in fields}
    base = df.sparkSession.createDataFrame([(c, pos[c], cls[c]) for c in df.columns], "column string, pos int, cls string")
    cm = base
    if txt:
        tflags = wide.select(F.explode(F.array(*text_rows)).alias("r")).select("r.*")
        top = text_summary(df, txt).select("column", F.col("unique").alias("nunique"), "top_value", "top_count")
        cm = cm.join(tflags, "column", "left").join(top, "column", "left")
    else:
        cm = cm.select("*", F.lit(None).cast("boolean").alias("all_numeric"), F.lit(None).cast("bigint").alias("nunique"),
                       F.lit(None).cast("string").alias("top_value"), F.lit(None).cast("bigint").alias("top_count"))
    if num:
        mom = _moments_long(df, num, ("count", "mean", "std", "skewness")).where("count > 0").select("column", F.col("count").alias("n_num"), "mean", "std", "skewness")
        outl = outlier_counts(df, num, "iqr")
        cm = cm.join(mom, "column", "left").join(outl, "column", "left")
    else:
        for c, t in [("n_num", "bigint"), ("mean", "double"), ("std", "double"), ("skewness", "double"), ("outliers", "bigint")]:
            cm = cm.withColumn(c, F.lit(None).cast(t))
    corr = corr_long(df, num, decimals=None) if len(num) >= 2 else df.sparkSession.createDataFrame([], "var1 string, var2 string, corr double")
    corr = corr.join(base.select(F.col("column").alias("var1"), F.col("pos").alias("p1")), "var1").join(
        base.select(F.col("column").alias("var2"), F.col("pos").alias("p2")), "var2"
    )
    # three tiny tables read by ~35 rule branches: materialize them once
    return materialize(trow), materialize(cm), materialize(corr)


def findings(df: DataFrame, metrics: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """ins_rows: (category, insight, priority, index) for the five finding groups."""
    trow, cm, corr = metrics or table_metrics(df)
    n = F.col("n_rows")
    mp = F.col("missing_pct")
    rules: list[DataFrame] = []
    dq, st, pt, rc, bz = "data_quality", "statistical", "patterns", "recommendations", "business_insights"

    # data quality
    rules.append(_row(trow, dq, 1, _fmt(MSG["missing_high"], _pct1(mp)), mp > 20))
    rules.append(_row(trow, dq, 2, _fmt(MSG["missing_moderate"], _pct1(mp)), (mp > 5) & (mp <= 20)))
    rules.append(_row(trow, dq, 3, F.lit(MSG["missing_excellent"]), mp < 1))
    rules.append(_row(trow, dq, 4, _fmt(MSG["duplicates"], F.col("duplicates"), _pct1(F.col("duplicates") * 100.0 / n)), F.col("duplicates") > 0))
    mixed = _listed(cm, (F.col("cls") == "text") & F.col("all_numeric"), F.col("column"))
    rules.append(_row(mixed, dq, 5, _fmt(MSG["mixed_types"], F.col("items")), F.col("n") > 0))
    rules.append(_row(trow, dq, 6, F.lit(MSG["small"]), n < 100))
    rules.append(_row(trow, dq, 7, F.lit(MSG["large"]), n > 100000))

    # statistical
    has_num = F.col("n_numeric") > 0
    rules.append(_row(trow, st, 1, F.lit(MSG["only_categorical"]), ~has_num))
    numc = cm.filter(F.col("cls") == "numeric")
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean"))).otherwise(F.lit(float("inf")))
    hv = _listed(numc, (F.col("std") > 0) & (cv > 1), F.col("column"))
    lv = _listed(numc, (F.col("std") > 0) & (cv < 0.1), F.col("column"))
    rules.append(_row(hv, st, 2, _fmt(MSG["high_var"], F.col("items")), F.col("n") > 0))
    rules.append(_row(lv, st, 3, _fmt(MSG["low_var"], F.col("items")), F.col("n") > 0))
    nn = F.col("n_num")
    g1 = F.when(nn >= 3, F.col("skewness") * F.sqrt(nn * (nn - 1)) / (nn - 2))
    side = F.when(g1 > 0, F.lit("right")).otherwise(F.lit("left"))
    sk = _listed(numc, F.abs(g1) > 1, F.concat(F.col("column"), F.lit(" ("), side, F.lit(")")))
    rules.append(_row(sk, st, 4, _fmt(MSG["skewed"], F.col("items")), F.col("n") > 0))
    rows_n = F.lit(trow.select("n_rows").first()[0])
    ol = _listed(numc, F.col("outliers") > rows_n * 0.05, F.concat(F.col("column"), F.lit(" ("), F.col("outliers").cast("string"), F.lit(" outliers)")))
    rules.append(_row(ol, st, 5, _fmt(MSG["outliers"], F.col("items")), F.col("n") > 0))

    # patterns
    def pairs(cond):
        items = corr.filter(cond).agg(
            F.array_sort(
                F.collect_list(
                    F.struct("p1", "p2", F.concat(F.col("var1"), F.lit(" & "), F.col("var2"), F.lit(" ("), F.format_string("%.2f", F.col("corr")), F.lit(")")).alias("it"))
                )
            ).alias("a")
        )
        return items.select(F.array_join(F.transform("a", lambda s: s["it"]), ", ").alias("items"), F.size("a").alias("n"))

    rules.append(_row(pairs(F.col("corr") > 0.7), pt, 1, _fmt(MSG["corr_pos"], F.col("items")), F.col("n") > 0))
    rules.append(_row(pairs(F.col("corr") < -0.7), pt, 2, _fmt(MSG["corr_neg"], F.col("items")), F.col("n") > 0))
    textc = cm.filter((F.col("cls") == "text") & (F.col("nunique") > 1))
    dom_pct = F.col("top_count") * 100.0 / rows_n
    rules.append(
        textc.filter(dom_pct > 80).select(
            F.lit(pt).alias("category"),
            (F.lit(10) + F.col("pos") * 2).alias("seq"),
            _fmt(MSG["dominated"], F.col("column"), F.col("top_value"), _pct1(dom_pct)).alias("insight"),
        )
    )
    rules.append(
        textc.filter(F.col("nunique") > 10).select(
            F.lit(pt).alias("category"),
            (F.lit(11) + F.col("pos") * 2).alias("seq"),
            _fmt(MSG["cardinality"], F.col("column"), F.col("nunique")).alias("insight"),
        )
    )
    rules.append(_row(trow, pt, 1_000_000, F.lit(MSG["time"]), (F.col("n_datetime") > 0) & has_num))

    # recommendations
    nnum, ntxt = F.col("n_numeric"), F.col("n_text")
    rules.append(_row(trow, rc, 1, F.lit(MSG["rec_regression"]), nnum >= 2))
    rules.append(_row(trow, rc, 2, F.lit(MSG["rec_groupby"]), (ntxt > 0) & (nnum > 0)))
    rules.append(_row(trow, rc, 3, F.lit(MSG["rec_chi2"]), ntxt >= 2))
    rules.append(_row(trow, rc, 4, F.lit(MSG["rec_impute"]), mp > 5))
    rules.append(_row(trow, rc, 5, F.lit(MSG["rec_sampling"]), n > 10000))
    rules.append(_row(trow, rc, 6, F.lit(MSG["rec_distribution"]), nnum > 0))
    rules.append(_row(trow, rc, 7, F.lit(MSG["rec_bar"]), ntxt > 0))
    rules.append(_row(trow, rc, 8, F.lit(MSG["rec_scatter"]), nnum >= 2))

    # business
    rules.append(_row(trow, bz, 1, F.lit(MSG["biz_small"]), n < 1000))
    rules.append(_row(trow, bz, 2, F.lit(MSG["biz_medium"]), (n >= 1000) & (n < 10000)))
    rules.append(_row(trow, bz, 3, F.lit(MSG["biz_large"]), n >= 10000))
    rules.append(_row(trow, bz, 4, F.lit(MSG["biz_rich"]), F.col("n_cols") > 20))
    rules.append(_row(trow, bz, 5, F.lit(MSG["biz_limited"]), F.col("n_cols") < 5))
    rules.append(_row(trow, bz, 6, F.lit(MSG["biz_quality_good"]), mp < 2))
    rules.append(_row(trow, bz, 7, F.lit(MSG["biz_quality_bad"]), mp > 15))
    rules.append(_row(trow, bz, 8, F.lit(MSG["biz_kpi"]), nnum > 0))
    rules.append(_row(trow, bz, 9, F.lit(MSG["biz_segments"]), ntxt > 0))

    allr = rules[0]
    for r in rules[1:]:
        allr = allr.unionByName(r)
    labels = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    high = F.lit(False)
    for m in HIGH_MARKS:
        high = high | F.contains(F.col("insight"), F.lit(m))
    low = F.lit(False)
    for m in LOW_MARKS:
        low = low | F.contains(F.col("insight"), F.lit(m))
    pri = F.when(low, F.lit("Low")).when(high, F.lit("High")).otherwise(F.lit("Medium"))
    order = F.create_map(*[x for i, k in enumerate(CATEGORIES) for x in (F.lit(k), F.lit(i))])
    w = Window.partitionBy("category").orderBy("seq")  # the findings table has a few dozen rows
    return allr.select(
        labels[F.col("category")].alias("category"),
        "insight",
        pri.alias("priority"),
        F.row_number().over(w).alias("index"),
        order[F.col("category")].alias("category_order"),
        "seq",
    )


def findings_flat(rows: DataFrame) -> DataFrame:
    """ins_all: the findings of all groups as one ordered list."""
    return rows.select("category", "index", "insight").orderBy("category_order", "index") if "category_order" in rows.columns else rows


def high_priority(rows: DataFrame) -> DataFrame:
    """ins_high_priority: only the warnings."""
    return rows.filter(F.col("priority") == "High")


def recommendations(rows: DataFrame) -> DataFrame:
    """generate_business_recommendations: the recommendation group only."""
    return rows.filter(F.col("category") == CATEGORIES["recommendations"])


def report(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """ins_report: one-row Markdown report (counts + every finding), from one metrics pass."""
    metrics = table_metrics(df)
    rows = rows if rows is not None else findings(df, metrics)
    trow = metrics[0].withColumn("n_cols", F.lit(len(df.columns)))
    lines = rows.groupBy("category", "category_order").agg(
        F.array_sort(F.collect_list(F.struct("index", F.concat(F.lit("- "), F.col("insight")).alias("t")))).alias("a")
    )
    sect = lines.select(
        "category_order",
        F.concat(F.lit("### "), F.col("category"), F.lit("\n"), F.array_join(F.transform("a", lambda s: s["t"]), "\n")).alias("block"),
    )
    body = sect.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category_order", "block"))), lambda s: s["block"]), "\n\n").alias("body"))
    head = trow.select(
        F.concat(
            F.lit(REPORT_TITLE + "\n\n## Dataset Overview\n- **Records**: "),
            F.format_number(F.col("n_rows"), 0),
            F.lit("\n- **Features**: "),
            F.col("n_cols").cast("string"),
            F.lit("\n- **Missing Data**: "),
            _pct1(F.col("missing_pct")),
            F.lit("%\n\n## 🔍 Key Insights\n\n"),
        ).alias("head")
    )
    return head.select(F.concat(F.col("head"), body.select("body").scalar()).alias("report"))
