"""Relational coverage over the star schema: joins, sets, grouping sets, top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.keep import best
from lodestone.session import table


def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    total = lambda c: F.round(F.sum(c), 2)
    return lines.groupBy("l_returnflag", "l_linestatus").agg(total(F.col("l_quantity")).alias("sum_qty"), total(F.col("l_extendedprice")).alias("sum_base"), total(net).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def revenue_by_region(spark, sf_dir):
    """Facts meet customers by key; nations and regions, 25 and 5 rows, are left to the optimizer to broadcast."""
    orders, customers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum("net").alias("net"))  # before the joins: a row for each order
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum("net"), 1).alias("revenue"), F.count("*").alias("orders"))


def customers_without_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


def customers_with_urgent(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def left_join_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


def full_join(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey").groupBy("nation").agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).groupBy("nation").agg(F.count("*").alias("customers"))
    return a.join(b, "nation", "full")


def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_orderpriority like '2%'").select("o_custkey")


def intersect(spark, sf_dir):
    a, b = keys(spark, sf_dir)
    return a.intersect(b)


def except_(spark, sf_dir):
    a, b = keys(spark, sf_dir)
    return a.subtract(b)


def grouping_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def dearest_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return best(orders, ["o_custkey"], [F.col("o_totalprice"), -F.col("o_orderkey")])


def pivot_days(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return events.groupBy("day").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


QUERIES = {
    "pricing_summary": pricing_summary, "revenue_by_region": revenue_by_region, "customers_without_orders": customers_without_orders, "customers_with_urgent": customers_with_urgent, "left_join_counts": left_join_counts,
    "full_join": full_join, "union_all": union_all, "intersect": intersect, "except": except_, "grouping_sets": grouping_sets, "cube": cube, "top_orders": top_orders, "dearest_order": dearest_order, "pivot_days": pivot_days,
}

ORACLE_SQL = {
    "pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net, round(avg(l_discount), 6) as avg_disc, count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    "revenue_by_region": """with l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as net from lineitem group by 1)
        select r_name, round(sum(net), 1) as revenue, count(*) as orders from l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
    "customers_without_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "customers_with_urgent": "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderpriority like '1%')",
    "left_join_counts": "select c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1",
    "full_join": "with a as (select s_nationkey as nation, count(*) as suppliers from supplier group by 1), b as (select c_nationkey as nation, count(*) as customers from customer where c_acctbal > 9000 group by 1) select nation, suppliers, customers from a full join b using (nation)",
    "union_all": "with u as (select s_name as name, 'supplier' as kind from supplier union all select c_name, 'customer' from customer) select kind, count(*) as n, min(name) as first from u group by 1",
    "intersect": "select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderpriority like '2%'",
    "except": "select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderpriority like '2%'",
    "grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus, o_orderpriority)::bigint as level from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "cube": "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus, o_orderpriority)::bigint as level from orders group by cube (o_orderstatus, o_orderpriority)",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100",
    "dearest_order": "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1",
    "pivot_days": "select strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
}
