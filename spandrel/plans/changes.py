"""Queries that show a table's rows after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from spandrel.operators import dml
from spandrel.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _accounts(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


def _news(t):
    """Suppliers as customers: some keys exist, others are new."""
    top = F.lit(10**6)
    return t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + top).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


NEWS = "(SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1000000 END AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier)"
ACCOUNTS = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"


@query(f"SELECT * FROM {ACCOUNTS} UNION ALL SELECT * FROM {NEWS}")
def dml_insert_select(t):
    return dml.insert(_accounts(t), _news(t))


@query(f"SELECT * FROM {ACCOUNTS} UNION ALL SELECT * FROM {NEWS} n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_insert_do_nothing(t):
    return dml.insert_on_conflict(_accounts(t), _news(t), ["c_custkey"])


@query(f"SELECT c_custkey, coalesce(a.c_name, n.c_name) AS c_name, CASE WHEN a.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN round(a.c_acctbal + n.c_acctbal, 2) ELSE round(coalesce(a.c_acctbal, n.c_acctbal), 2) END AS c_acctbal FROM {ACCOUNTS} a FULL JOIN {NEWS} n USING (c_custkey)")
def dml_insert_do_update(t):
    out = dml.insert_on_conflict(_accounts(t), _news(t), ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t):
    return dml.update(t.customer, {"c_acctbal": F.lit(0.0)}, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT c_custkey, coalesce(n.c_name, a.c_name) AS c_name, a.c_acctbal AS c_acctbal FROM {ACCOUNTS} a LEFT JOIN {NEWS} n USING (c_custkey)")
def dml_update_from(t):
    return dml.update_from(_accounts(t), _news(t), F.col("t.c_custkey") == F.col("s.c_custkey"), {"c_name": F.col("s.c_name")})


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def dml_delete(t):
    return dml.delete(t.customer, F.col("c_acctbal") < 0).select("c_custkey")


@query(f"SELECT * FROM {ACCOUNTS} WHERE c_custkey NOT IN (SELECT c_custkey FROM {NEWS})")
def dml_delete_using(t):
    return dml.delete_using(_accounts(t), _news(t), F.col("t.c_custkey") == F.col("s.c_custkey"))


@query(f"""SELECT c_custkey, coalesce(a.c_name, n.c_name) AS c_name, CASE WHEN a.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN CASE WHEN a.c_acctbal < 0 THEN 0 ELSE a.c_acctbal END ELSE n.c_acctbal END AS c_acctbal FROM {ACCOUNTS} a FULL JOIN {NEWS} n USING (c_custkey)
WHERE NOT (a.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND n.c_acctbal < 0) AND NOT (a.c_custkey IS NULL AND n.c_acctbal < 1000)""")
def dml_merge(t):
    on = F.col("t.c_custkey") == F.col("s.c_custkey")
    new = {c: F.col(f"s.{c}") for c in ("c_custkey", "c_name", "c_acctbal")}
    return dml.merge(_accounts(t), _news(t), on, [dml.Matched(None, F.col("s.c_acctbal") < 0), dml.Matched({"c_acctbal": F.col("s.c_acctbal")})], [dml.NotMatched(new, F.col("s.c_acctbal") >= 1000)], [dml.NotMatchedBySource({"c_acctbal": F.lit(0.0)}, F.col("t.c_acctbal") < 0)])


@query("SELECT c_custkey FROM customer WHERE false")
def dml_truncate(t):
    return dml.truncate(t.customer.select("c_custkey"))


@query("""SELECT 'check positive' AS "rule", count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'unique c_nationkey', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def ddl_constraints(t):
    return dml.violations(t.customer, ["c_custkey"], [["c_custkey"], ["c_nationkey"]], {"positive": F.col("c_acctbal") >= 0}, {"c_nationkey": (t.nation, "n_nationkey")})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def materialized_view(t):
    from spandrel.session import shared_dir

    t.orders.createOrReplaceTempView("mv_orders")
    views = dml.MaterializedViews(t.spark, f"{shared_dir(t.spark)}/views")
    views.create("order_counts", "SELECT o_custkey, count(*) AS n FROM mv_orders GROUP BY o_custkey")
    views.refresh("order_counts")
    return views.read("order_counts")
