"""A property graph made of the relational tables' keys, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import table


def graph_nodes(spark: SparkSession, sf: str, kinds: tuple[str, ...] = ("Region", "Nation", "Customer", "Supplier", "Part", "Order")) -> DataFrame:
    spec = {
        "Region": ("region", "reg:", "r_regionkey", "r_name"), "Nation": ("nation", "nat:", "n_nationkey", "n_name"), "Customer": ("customer", "cust:", "c_custkey", "c_name"),
        "Supplier": ("supplier", "sup:", "s_suppkey", "s_name"), "Part": ("part", "part:", "p_partkey", "p_name"), "Order": ("orders", "ord:", "o_orderkey", "o_orderstatus"),
    }
    out = None
    for kind in kinds:
        name, prefix, key, label = spec[kind]
        one = table(spark, sf, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def graph_edges(spark: SparkSession, sf: str, types: tuple[str, ...] = ("LOCATED_IN", "PART_OF", "PLACED_BY", "CONTAINS_PART", "SUPPLIED_BY")) -> DataFrame:
    spec = {
        "LOCATED_IN": [("customer", "cust:", "c_custkey", "nat:", "c_nationkey"), ("supplier", "sup:", "s_suppkey", "nat:", "s_nationkey")],
        "PART_OF": [("nation", "nat:", "n_nationkey", "reg:", "n_regionkey")], "PLACED_BY": [("orders", "ord:", "o_orderkey", "cust:", "o_custkey")],
        "CONTAINS_PART": [("lineitem", "ord:", "l_orderkey", "part:", "l_partkey")], "SUPPLIED_BY": [("lineitem", "part:", "l_partkey", "sup:", "l_suppkey")],
    }
    out = None
    for kind in types:
        for name, a, x, b, y in spec[kind]:
            ends = table(spark, sf, name).select(x, y)
            ends = ends.distinct() if name == "lineitem" else ends
            one = ends.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("efrom"), F.lit(kind).alias("edge_type"), F.concat(F.lit(b), F.col(y).cast("string")).alias("eto"))
            out = one if out is None else out.unionByName(one)
    return out


SQL_NODES = """
SELECT 'reg:' || r_regionkey AS id, 'Region' AS node_type, r_name AS label FROM region
UNION ALL SELECT 'nat:' || n_nationkey, 'Nation', n_name FROM nation
UNION ALL SELECT 'cust:' || c_custkey, 'Customer', c_name FROM customer
UNION ALL SELECT 'sup:' || s_suppkey, 'Supplier', s_name FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name FROM part
UNION ALL SELECT 'ord:' || o_orderkey, 'Order', o_orderstatus FROM orders"""
SQL_EDGES = """
SELECT 'cust:' || c_custkey AS efrom, 'LOCATED_IN' AS edge_type, 'nat:' || c_nationkey AS eto FROM customer
UNION ALL SELECT 'sup:' || s_suppkey, 'LOCATED_IN', 'nat:' || s_nationkey FROM supplier
UNION ALL SELECT 'nat:' || n_nationkey, 'PART_OF', 'reg:' || n_regionkey FROM nation
UNION ALL SELECT 'ord:' || o_orderkey, 'PLACED_BY', 'cust:' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'ord:' || l_orderkey, 'CONTAINS_PART', 'part:' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'SUPPLIED_BY', 'sup:' || l_suppkey FROM lineitem"""
WITH_GRAPH = f"gn AS MATERIALIZED ({SQL_NODES}), ge AS MATERIALIZED ({SQL_EDGES})"
