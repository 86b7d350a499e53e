"""Query bindings: ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import ordered as O
from cellar.plans.registry import register
from cellar.session import table

_EV = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"
_ORDER = "ts, event_id"


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


@register(
    "win_running_total",
    f"""SELECT event_id, ts, user_id, value,
        CASE WHEN value IS NULL THEN NULL ELSE round(sum(value) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 4) END AS value_running_total,
        round(avg(value) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 8) AS value_running_avg,
        round(value * 100.0 / sum(value) OVER (), 8) AS value_pct_contribution
        FROM {_EV}""",
)
def q_running(spark, d):
    return O.running_totals(_events(spark, d), "value", ["ts", "event_id"], decimals=8, total_decimals=4)


@register(
    "win_running_total_by_user",
    f"""SELECT event_id, ts, user_id, value,
        CASE WHEN value IS NULL THEN NULL ELSE round(sum(value) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 4) END AS value_running_total,
        round(avg(value) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 8) AS value_running_avg,
        round(value * 100.0 / sum(value) OVER (PARTITION BY user_id), 8) AS value_pct_contribution
        FROM {_EV}""",
)
def q_running_user(spark, d):
    return O.running_totals(_events(spark, d), "value", ["ts", "event_id"], partition_by=["user_id"], decimals=8, total_decimals=4)


@register(
    "win_running_avg",
    f"""SELECT event_id, round(avg(value) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 8) AS value_running_avg FROM {_EV}""",
)
def q_running_avg(spark, d):
    return O.running_totals(_events(spark, d), "value", ["ts", "event_id"], decimals=8).select("event_id", "value_running_avg")


@register(
    "win_pct_contribution",
    """SELECT o_orderkey, round(o_totalprice * 100.0 / sum(o_totalprice) OVER (), 2) AS o_totalprice_pct_contribution FROM orders""",
)
def q_pct_contrib(spark, d):
    return O.pct_contribution(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


@register(
    "win_pct_contribution_by_user",
    f"""SELECT event_id, user_id, round(value * 100.0 / sum(value) OVER (PARTITION BY user_id), 8) AS value_pct_contribution FROM {_EV}""",
)
def q_pct_contrib_user(spark, d):
    return O.pct_contribution(_events(spark, d).select("event_id", "user_id", "value"), "value", ["user_id"], decimals=8).drop("value")


@register(
    "win_pct_change",
    f"""WITH f AS (SELECT event_id, ts, value,
          last_value(value IGNORE NULLS) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS ff FROM {_EV})
        SELECT event_id, ts, value,
          round((ff / nullif(lag(ff) OVER (ORDER BY {_ORDER}), 0) - 1) * 100, 6) AS value_pct_change FROM f""",
)
def q_pct_change(spark, d):
    e = _events(spark, d).select("event_id", "ts", "value")
    out = O.pct_change(e, "value", ["ts", "event_id"])
    return out.withColumn("value_pct_change", F.round("value_pct_change", 6))


@register(
    "win_pct_change_by_user",
    f"""WITH f AS (SELECT event_id, ts, user_id, value,
          last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS ff FROM {_EV})
        SELECT event_id, ts, user_id, value,
          round((ff / nullif(lag(ff) OVER (PARTITION BY user_id ORDER BY {_ORDER}), 0) - 1) * 100, 6) AS value_pct_change FROM f""",
)
def q_pct_change_user(spark, d):
    e = _events(spark, d).select("event_id", "ts", "user_id", "value")
    out = O.pct_change(e, "value", ["ts", "event_id"], partition_by=["user_id"])
    return out.withColumn("value_pct_change", F.round("value_pct_change", 6))


@register(
    "win_dense_rank",
    """SELECT p_partkey, p_size, CASE WHEN p_size IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY p_size DESC) END AS rank
       FROM part""",
)
def q_dense_rank(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return O.dense_rank(p, "p_size")


@register(
    "win_dense_rank_asc_nulls",
    """SELECT o_orderkey, v, CASE WHEN v IS NULL THEN NULL ELSE dense_rank() OVER (PARTITION BY v IS NULL ORDER BY v ASC) END AS rank
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE round(o_totalprice / 10000) END AS v FROM orders)""",
)
def q_dense_rank_asc(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.round(F.col("o_totalprice") / 10000)).alias("v")
    )
    return O.dense_rank(o, "v", ascending=True)


@register(
    "win_percentile_rank",
    """SELECT p_partkey, p_size,
       round(((rank() OVER (ORDER BY p_size) - 1) + (count(*) OVER (PARTITION BY p_size) + 1) / 2.0) * 100.0 / count(*) OVER (), 1) AS percentile
       FROM part""",
)
def q_pct_rank(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return O.percentile_rank(p, "p_size")


@register(
    "win_percentile_rank_by_group",
    """SELECT o_orderkey, o_orderpriority, v,
       round(((rank() OVER (PARTITION BY o_orderpriority ORDER BY v) - 1) + (count(*) OVER (PARTITION BY o_orderpriority, v) + 1) / 2.0) * 100.0
             / count(*) OVER (PARTITION BY o_orderpriority), 1) AS percentile
       FROM (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 50000) AS v FROM orders)""",
)
def q_pct_rank_grp(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 50000).alias("v"))
    return O.percentile_rank(o, "v", partition_by=["o_orderpriority"])


@register(
    "win_row_position",
    f"SELECT event_id, ts, row_number() OVER (ORDER BY {_ORDER}) AS row_pos FROM events",
)
def q_row_pos(spark, d):
    return O.row_position(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"])


@register(
    "win_row_position_by_user",
    f"SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {_ORDER}) AS row_pos FROM events",
)
def q_row_pos_user(spark, d):
    return O.row_position(table(spark, d, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], ["user_id"])


@register(
    "tool_fill_forward",
    f"SELECT event_id, ts, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS value FROM {_EV}",
)
def q_ffill(spark, d):
    return O.fill_forward(_events(spark, d), ["value"], ["ts", "event_id"])


@register(
    "tool_fill_backward",
    f"""SELECT event_id, ts, user_id,
        first_value(value IGNORE NULLS) OVER (ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_EV}""",
)
def q_bfill(spark, d):
    return O.fill_backward(_events(spark, d), ["value"], ["ts", "event_id"])


@register(
    "tool_fill_forward_by_user",
    f"""SELECT event_id, ts, user_id,
        last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS value FROM {_EV}""",
)
def q_ffill_user(spark, d):
    return O.fill_forward(_events(spark, d), ["value"], ["ts", "event_id"], partition_by=["user_id"])


@register(
    "tool_fill_backward_by_user",
    f"""SELECT event_id, ts, user_id,
        first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_EV}""",
)
def q_bfill_user(spark, d):
    return O.fill_backward(_events(spark, d), ["value"], ["ts", "event_id"], partition_by=["user_id"])
