"""Window queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spandrel.operators.windows import window_aggregate
from spandrel.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

def _customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 6) AS pr, round(cume_dist() OVER p, 6) AS cd, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank_family(t):
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(_customer()).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.round(F.percent_rank().over(p), 6).alias("pr"), F.round(F.cume_dist().over(p), 6).alias("cd"), F.ntile(3).over(_customer()).alias("nt"))


@query("SELECT o_orderkey, lag(o_totalprice, 1, 0) OVER w AS prev, lead(o_orderkey, 2) OVER w AS nxt, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_offset_family(t):
    whole = _customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.lag("o_totalprice", 1, 0.0).over(_customer()).alias("prev"), F.lead("o_orderkey", 2).over(_customer()).alias("nxt"), F.first("o_orderkey").over(_customer()).alias("f"), F.last("o_orderkey").over(_customer()).alias("l"), F.nth_value("o_orderkey", 2).over(whole).alias("n2"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 4) AS a, min(o_totalprice) OVER w AS mi, max(o_totalprice) OVER w AS ma FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def win_frame_rows(t):
    w = _customer().rowsBetween(-2, 1)
    x = "o_totalprice"
    return t.orders.select("o_orderkey", F.round(F.sum(x).over(w), 2).alias("s"), F.count("*").over(w).alias("n"), F.round(F.avg(x).over(w), 4).alias("a"), F.min(x).over(w).alias("mi"), F.max(x).over(w).alias("ma"))


@query("SELECT p_partkey, count(*) OVER w AS n, round(sum(p_retailprice) OVER w, 2) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win_frame_range(t):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)
    return t.part.select("p_partkey", F.count("*").over(w).alias("n"), F.round(F.sum("p_retailprice").over(w), 2).alias("s"))


@query("SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size), 2) AS running, count(*) OVER (PARTITION BY p_brand) AS total FROM part")
def win_default_frame(t):
    return t.part.select("p_partkey", F.round(F.sum("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_size")), 2).alias("running"), F.count("*").over(Window.partitionBy("p_brand")).alias("total"))


def _parts(frame: str, excluded: str, agg: str = "sum", where: str = "") -> str:
    call = f"{agg}(p_retailprice)" if agg != "count" else "count(p_retailprice)"
    return f"SELECT p_partkey, round({call}{f' FILTER (WHERE {where})' if where else ''} OVER (PARTITION BY p_brand ORDER BY p_size {frame} {excluded}), 6) AS v FROM part"


def _window(t, agg, frame, exclude=None, where=None):
    made = window_aggregate(t.part, "v", agg, F.col("p_retailprice"), ["p_brand"], [F.asc("p_size")], frame, exclude, where)
    return made.select("p_partkey", F.round("v", 6).alias("v"))


@query(_parts("GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING", ""))
def win_frame_groups(t):
    return _window(t, "sum", ("groups", -2, 1))


@query(_parts("GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING", "", "avg"))
def win_frame_groups_unbounded(t):
    return _window(t, "avg", ("groups", None, 1))


@query(_parts("RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING", "EXCLUDE CURRENT ROW"))
def win_exclude_current(t):
    return _window(t, "sum", ("range", -5, 5), "current row")


@query(_parts("RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING", "EXCLUDE GROUP", "avg"))
def win_exclude_group(t):
    return _window(t, "avg", ("range", -5, 5), "group")


@query(_parts("GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", "EXCLUDE TIES", "count"))
def win_exclude_ties(t):
    return _window(t, "count", ("groups", -1, 1), "ties")


@query(_parts("GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", "EXCLUDE GROUP", "max"))
def win_exclude_group_max(t):
    return _window(t, "max", ("groups", -1, 1), "group")


@query(_parts("RANGE BETWEEN 4 PRECEDING AND CURRENT ROW", "EXCLUDE NO OTHERS", "sum", "p_partkey % 2 = 0"))
def win_filter(t):
    return _window(t, "sum", ("range", -4, 0), "no others", F.col("p_partkey") % 2 == 0)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def win_qualify(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, round(sum(value) OVER w, 3) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_named(t):
    return t.sql("SELECT user_id, event_id, round(sum(value) OVER w, 3) AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
