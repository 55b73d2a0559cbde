"""Relational, guarded-SQL, constraint-table, evaluation and event-time queries with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators import constraints as C
from loam.operators import evals as E
from loam.operators import graph as G
from loam.operators import sqlsurface as Q
from loam.operators.incremental import canonical_path
from loam.plans.fk_graph import WITH_GRAPH, graph_edges, graph_nodes
from loam.session import cut_lineage, table
from loam.sources.chunkers import TABLE_ROWS, delimited
from loam.sources.corpus import window_chunks
from loam.streaming import windows as W


def _t(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, n) for n in names]


# --- SQL over the graph's relations -------------------------------------------------------------------------------------


def _relations(s: SparkSession, d: str) -> dict[str, DataFrame]:
    nodes, edges = graph_nodes(s, d), graph_edges(s, d)
    return {"nodes": nodes, "edges": edges, "edges_labeled": G.edges_labeled(nodes, edges)}


def _sql(text: str, limit: int | None = None):
    def query(s: SparkSession, d: str) -> DataFrame:
        return Q.run(s, text, _relations(s, d), limit)

    return query


SQL_GROUPED = "SELECT dst_label, edge_type, count(*) AS n FROM edges_labeled GROUP BY dst_label, edge_type HAVING count(*) > 3"
SQL_FUZZY = "SELECT efrom, eto FROM edges_labeled WHERE edge_type = 'located at' AND dst_label = 'nation_1'"
SQL_SELF = "SELECT a.efrom AS x, b.eto AS y FROM edges a JOIN edges b ON a.eto = b.efrom WHERE a.edge_type = 'LOCATED_IN' AND b.edge_type = 'PART_OF'"
SQL_WINDOW = "SELECT id, label, row_number() OVER (PARTITION BY node_type ORDER BY label DESC, id) AS k FROM nodes"
SQL_SETS = "SELECT id FROM nodes WHERE node_type = 'Nation' EXCEPT SELECT efrom AS id FROM edges WHERE eto = 'reg:1'"
SQL_NESTED = "SELECT id FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.efrom = n.id AND e.eto IN (SELECT id FROM nodes WHERE label LIKE 'NATION_2%'))"
SQL_TOP = "SELECT id, label FROM nodes ORDER BY label, id"


def relation_candidates(s: SparkSession, d: str) -> DataFrame:
    return Q.relation_similarity(s, "placed in", graph_edges(s, d)).select("edge_type", F.round("score", 6).alias("score"))


# --- relations ------------------------------------------------------------------------------------------------------------


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    (li,) = _t(s, d, "lineitem")
    price, disc = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.where(F.col("l_shipdate") <= "1998-09-02").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n")
    )


def join_region_revenue(s: SparkSession, d: str) -> DataFrame:
    li, o, c, n, r = _t(s, d, "lineitem", "orders", "customer", "nation", "region")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def left_join_idle_customers(s: SparkSession, d: str) -> DataFrame:
    c, o = _t(s, d, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


def semi_anti(s: SparkSession, d: str) -> DataFrame:
    c, o = _t(s, d, "customer", "orders")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    with_, without = c.join(urgent, "c_custkey", "left_semi"), c.join(urgent, "c_custkey", "left_anti")
    return with_.select(F.lit("with").alias("side"), "c_custkey").unionByName(without.select(F.lit("without").alias("side"), "c_custkey"))


def cube_orders(s: SparkSession, d: str) -> DataFrame:
    (o,) = _t(s, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


def pivot_status(s: SparkSession, d: str) -> DataFrame:
    (o,) = _t(s, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def running_totals(s: SparkSession, d: str) -> DataFrame:
    (o,) = _t(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).alias("k"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


def top_parts_per_brand(s: SparkSession, d: str) -> DataFrame:
    li, p = _t(s, d, "lineitem", "part")
    sold = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("q"), "p_partkey")
    return sold.withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey", F.round("q", 2).alias("q"), "k")


def set_operations(s: SparkSession, d: str) -> DataFrame:
    c, su = _t(s, d, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), su.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").unionByName(a.exceptAll(a.intersect(b)).distinct().select(F.lit("customers only").alias("part"), "k")).unionByName(a.union(b).distinct().select(F.lit("any").alias("part"), "k"))


def argmax_episode(s: SparkSession, d: str) -> DataFrame:
    (e,) = _t(s, d, "episode_outcomes")
    last = F.max(F.struct("finished_at", "episode_id"))
    return e.where(F.col("case_id").isNotNull()).groupBy("case_id").agg(last.alias("b")).select("case_id", F.col("b.episode_id").alias("episode_id"), F.col("b.finished_at").alias("finished_at"))


def json_props(s: SparkSession, d: str) -> DataFrame:
    (e,) = _t(s, d, "events")
    return e.select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# --- constraint tables ------------------------------------------------------------------------------------------------------


def _cells(s: SparkSession, d: str) -> DataFrame:
    (p,) = _t(s, d, "part")
    return C.long_form(p.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("parity")), "p_partkey", ["brand", "type", "parity"])


def csp_triggers(s: SparkSession, d: str) -> DataFrame:
    return C.choose_triggers(_cells(s, d))


def csp_enums(s: SparkSession, d: str) -> DataFrame:
    return C.compile_enums(_cells(s, d)).select("field", "trigger", "trigger_value", F.array_join("options", "|").alias("options"))


def _constraints(s: SparkSession) -> DataFrame:
    rows = [
        (1, "status", "enum", None, None, None, ["F", "O"], None, None), (2, "price", "range", 1000.0, 400000.0, None, None, None, None), (3, "priority", "regex", None, None, "[1-4]-.*", None, None, None),
        (4, "priority", "enum", None, None, None, ["1-URGENT", "2-HIGH", "3-MEDIUM"], "status", "o"), (5, "clerk", "required", None, None, None, None, "status", "P"), (6, "comment", "forbidden", None, None, None, None, None, None), (7, "price", "range", 5000.0, None, None, None, "status", "F"),
    ]
    return s.createDataFrame(rows, C.CONSTRAINT)


def _assignments(s: SparkSession, d: str) -> DataFrame:
    (o,) = _t(s, d, "orders")
    own = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 0).cast("bigint").alias("price"), F.col("o_orderpriority").alias("priority"))
    return C.long_form(own, "o_orderkey", ["status", "price", "priority"])


def csp_validate(s: SparkSession, d: str) -> DataFrame:
    return C.validate(_assignments(s, d), _constraints(s))


def csp_infer(s: SparkSession, d: str) -> DataFrame:
    out = C.infer_domains(_assignments(s, d), _constraints(s))
    return out.select("row_id", "field", "lo", "hi", F.array_join("options", "|").alias("options"), "empty")


def column_union(s: SparkSession, d: str) -> DataFrame:
    n, r = _t(s, d, "nation", "region")
    text = lambda df: df.select(*[F.col(x).cast("string").alias(x) for x in df.columns])
    return C.column_union(text(n), text(r))


def lattice_cover(s: SparkSession, d: str) -> DataFrame:
    (p,) = _t(s, d, "part")
    pieces = p.select(F.col("p_brand").alias("key"), F.concat(F.col("p_size").cast("string"), F.lit("–"), (F.col("p_size") + 4).cast("string")).alias("piece")).distinct()
    gold = p.select(F.col("p_brand").alias("key")).distinct().select("key", F.explode(F.array(F.lit("1-54"), F.lit("20 — 30"), F.lit("7"), F.lit("x"))).alias("value"))
    return C.lattice_cover(gold, pieces)


# --- evaluation ---------------------------------------------------------------------------------------------------------------


def _judged(s: SparkSession, d: str) -> DataFrame:
    t, e = _t(s, d, "train_cases", "episode_outcomes")
    gold = t.groupBy("_id").agg(F.max("answer").alias("gold"))
    rows = e.select("episode_id", "case_id", "answer", "surfaced_titles", "rounds").distinct()
    return rows.join(gold, F.col("case_id") == F.col("_id")).where(F.col("gold").isNotNull() & F.col("answer").isNotNull())


def answer_scores(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).select("episode_id", E.exact_match(F.col("answer"), F.col("gold")).alias("em"), F.round(E.token_f1(F.col("answer"), F.col("gold")), 6).alias("f1"))


def mean_scores(s: SparkSession, d: str) -> DataFrame:
    scored = _judged(s, d).select(E.exact_match(F.col("answer"), F.col("gold")).alias("em"), E.token_f1(F.col("answer"), F.col("gold")).alias("f1"))
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))


def recall_and_rank(s: SparkSession, d: str) -> DataFrame:
    """Titles found by an episode against those that any episode of its case found first."""
    e = table(s, d, "episode_outcomes").where(F.col("case_id").isNotNull() & (F.size("surfaced_titles") > 0)).select("episode_id", "case_id", "surfaced_titles").distinct()
    wanted = e.groupBy("case_id").agg(F.array_sort(F.collect_set(F.col("surfaced_titles")[0])).alias("wanted"))
    rows = e.join(wanted, "case_id")
    found = F.col("surfaced_titles")
    return rows.select("episode_id", F.round(E.recall_at(found, F.col("wanted"), 2), 6).alias("recall2"), F.round(E.reciprocal_rank(found, F.col("wanted")), 6).alias("rr"))


def leak_scan(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).where(E.contains_run(F.col("answer"), F.col("gold"))).select("episode_id")


def pareto_suppliers(s: SparkSession, d: str) -> DataFrame:
    """Nations that no other beats in customers' and suppliers' numbers and balances alike."""
    c, su = _t(s, d, "customer", "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("x"), F.round(F.avg("c_acctbal"), 2).alias("y"))
    b = su.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("z"))
    rows = a.join(b, "k").select("k", F.array("x", "y", "z").alias("v"))
    return E.pareto_frontier(rows, "k", "v")


def pool_allocation(s: SparkSession, d: str) -> DataFrame:
    (c,) = _t(s, d, "customer")
    pools = c.groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("w"))
    return E.largest_remainder(pools, "c_mktsegment", "w", 37)


def latency_histogram(s: SparkSession, d: str) -> DataFrame:
    (e,) = _t(s, d, "events")
    return E.cumulative_histogram(e.withColumn("sec", F.col("value") / 10), "sec", "event_type")


def window_counts(s: SparkSession, d: str) -> DataFrame:
    """Line windows of every document: how many, and their characters. The cut is a fold; tests check it."""
    w = window_chunks(table(s, d, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def csv_windows(s: SparkSession, d: str) -> DataFrame:
    """``location, chunk``: orders as lines of a table in key order, chunked by position with the table chunker."""
    (o,) = _t(s, d, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    lines = o.orderBy(*names).select(F.to_csv(F.struct(*names)).alias("line"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    lines = cut_lineage(lines)
    # A row's position from the sizes of the range partitions before its own; runs of chunks go to the chunker together.
    before, sizes = 0, []
    for r in lines.groupBy("task").count().orderBy("task").collect():
        sizes.append((r.task, before))
        before += r["count"]
    offsets = F.broadcast(s.createDataFrame(sizes, "task INT, before BIGINT"))
    placed = lines.join(offsets, "task").select("line", (F.col("row") + F.col("before")).alias("position"))
    run = TABLE_ROWS * 100
    header = ",".join(names)

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        text = "".join(f"{x}\n" for x in (header, *pdf["line"]))
        return pd.DataFrame(delimited(text, start=int(pdf["position"].iloc[0]) + 1), columns=["location", "chunk"])

    return placed.groupBy(F.floor(F.col("position") / run).alias("run")).applyInPandas(chunk, "location string, chunk string")


# --- event time ---------------------------------------------------------------------------------------------------------------


def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    return W.tumbling(table(s, d, "events"), "ts", "1 hour", ["event_type"])


def sliding_values(s: SparkSession, d: str) -> DataFrame:
    return W.sliding(table(s, d, "events"), "ts", "2 hours", "1 hour", "value")


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return W.sessions(table(s, d, "events"), "ts", "30 minutes", "user_id")


def change_bursts(s: SparkSession, d: str) -> DataFrame:
    """Bursts of observations in each top folder."""
    seen = table(s, d, "file_listing").where(F.col("seen_at").isNotNull()).select("seen_at", F.regexp_extract(canonical_path(F.col("doc_path")), "^[^/]+", 0).alias("folder"))
    return W.debounce(seen, "seen_at", "5 seconds", keys=["folder"])


def distinct_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id")
    return W.deduplicate(e.unionByName(e), ["event_id"], "ts")


QUERIES = {f.__name__: f for f in (
    relation_candidates, pricing_summary, join_region_revenue, left_join_idle_customers, semi_anti, cube_orders, pivot_status, running_totals, top_parts_per_brand, set_operations, argmax_episode, json_props,
    csp_triggers, csp_enums, csp_validate, csp_infer, column_union, lattice_cover, answer_scores, mean_scores, recall_and_rank, leak_scan, pareto_suppliers, pool_allocation, latency_histogram, window_counts, csv_windows,
    tumbling_counts, sliding_values, user_sessions, change_bursts, distinct_events,
)} | {
    "sql_grouped": _sql(SQL_GROUPED), "sql_fuzzy": _sql(SQL_FUZZY), "sql_self_join": _sql(SQL_SELF), "sql_window": _sql(SQL_WINDOW), "sql_sets": _sql(SQL_SETS), "sql_nested": _sql(SQL_NESTED), "sql_top": _sql(SQL_TOP, Q.ROWS),
}

_W = f"WITH {WITH_GRAPH}, g_edges_labeled AS (SELECT efrom, edge_type, eto, a.label AS src_label, b.label AS dst_label FROM ge JOIN gn a ON a.id = efrom JOIN gn b ON b.id = eto) "


def _over_graph(sql: str) -> str:
    import re

    return _W + re.sub(r"\b(edges_labeled|edges|nodes)\b", lambda m: {"edges_labeled": "g_edges_labeled", "edges": "ge", "nodes": "gn"}[m.group()], sql)


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_JUDGED = "g AS (SELECT _id, max(answer) AS gold FROM train_cases GROUP BY _id), j AS (SELECT DISTINCT episode_id, case_id, answer, gold FROM episode_outcomes JOIN g ON _id = case_id WHERE gold IS NOT NULL AND answer IS NOT NULL), n AS (SELECT *, " + _NORM.format("answer") + " AS p, " + _NORM.format("gold") + " AS q FROM j)"
_F1 = (
    "tk AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(q, ' '), lambda x: x <> '') AS qt FROM n), sc AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(pt, qt)), "
    "lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(qt, lambda x: x = t))))), 0) AS sh FROM tk), fs AS (SELECT episode_id, (p = q)::INT AS em, CASE WHEN len(pt) + len(qt) = 0 THEN 1.0 WHEN sh = 0 THEN 0.0 ELSE 2.0 * sh / (len(pt) + len(qt)) END AS f1 FROM sc)"
)
_CELLS = "cl AS (SELECT p_partkey AS row_id, unnest(['brand', 'type', 'parity']) AS field, unnest([p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END]) AS value FROM part), tr AS (SELECT * FROM (SELECT a.field, b.field AS trigger, count(DISTINCT b.value) AS n, row_number() OVER (PARTITION BY a.field ORDER BY count(DISTINCT b.value), b.field) AS k FROM cl a JOIN cl b ON a.row_id = b.row_id AND a.field <> b.field GROUP BY 1, 2 HAVING count(DISTINCT b.value) > 1) WHERE k = 1)"
_AS = "o AS (SELECT o_orderkey AS row_id, o_orderstatus AS s, round(o_totalprice, 0)::BIGINT AS p, o_orderpriority AS r FROM orders)"
_LE = ", ".join(f"count(*) FILTER (sec <= {b}) AS le_{k}" for k, b in enumerate(E.BUCKETS))

SQL = {
    "sql_grouped": _over_graph(SQL_GROUPED),
    "sql_fuzzy": _over_graph("SELECT efrom, eto FROM edges_labeled WHERE edge_type = 'LOCATED_IN' AND dst_label ILIKE '%nation_1%'"),
    "sql_self_join": _over_graph(SQL_SELF), "sql_window": _over_graph(SQL_WINDOW), "sql_sets": _over_graph(SQL_SETS), "sql_nested": _over_graph(SQL_NESTED), "sql_top": _over_graph(SQL_TOP) + " LIMIT 50",
    "relation_candidates": "WITH v AS (SELECT unnest(['LOCATED_IN', 'PART_OF', 'PLACED_BY', 'CONTAINS_PART', 'SUPPLIED_BY']) AS edge_type), t AS (SELECT *, string_split(lower(replace(edge_type, '_', ' ')), ' ') AS w, ['placed', 'in'] AS q FROM v) "
    "SELECT edge_type, round(CASE WHEN contains('placed in', lower(edge_type)) OR contains(lower(edge_type), 'placed in') THEN 1.0 ELSE greatest(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))), 1 - levenshtein('placed in', lower(edge_type)) / greatest(9, length(edge_type))) END, 6) AS score FROM t",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "join_region_revenue": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "left_join_idle_customers": "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "semi_anti": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'with' ELSE 'without' END AS side, c_custkey FROM customer",
    "cube_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "running_totals": "SELECT o_orderkey, row_number() OVER w AS k, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "top_parts_per_brand": "SELECT p_brand, p_partkey, round(q, 2) AS q, k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, p_partkey) AS k FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey) WHERE k <= 3",
    "set_operations": "SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) GROUP BY k UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "argmax_episode": "SELECT case_id, episode_id, finished_at FROM (SELECT DISTINCT case_id, episode_id, finished_at FROM episode_outcomes WHERE case_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY finished_at DESC NULLS LAST, episode_id DESC) = 1",
    "json_props": "SELECT event_type, count(*) AS n, sum(k) AS total FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY 1",
    "csp_triggers": f"WITH {_CELLS} SELECT field, trigger, n FROM tr",
    "csp_enums": f"WITH {_CELLS} SELECT a.field, trigger, b.value AS trigger_value, string_agg(DISTINCT a.value, '|' ORDER BY a.value) AS options FROM cl a JOIN tr ON tr.field = a.field JOIN cl b ON b.row_id = a.row_id AND b.field = tr.trigger GROUP BY 1, 2, 3",
    "csp_validate": f"WITH {_AS} SELECT row_id, 1 AS constraint_id, 'status' AS field, 'enum' AS kind FROM o WHERE s NOT IN ('F', 'O') UNION ALL SELECT row_id, 2, 'price', 'range' FROM o WHERE p < 1000 OR p > 400000 UNION ALL SELECT row_id, 3, 'priority', 'regex' FROM o WHERE NOT regexp_full_match(r, '[1-4]-.*') "
    "UNION ALL SELECT row_id, 4, 'priority', 'enum' FROM o WHERE s = 'O' AND r NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL SELECT row_id, 5, 'clerk', 'required' FROM o WHERE s = 'P' UNION ALL SELECT row_id, 7, 'price', 'range' FROM o WHERE s = 'F' AND p < 5000",
    "csp_infer": f"WITH {_AS} SELECT row_id, 'status' AS field, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, 'F|O' AS options, false AS empty FROM o UNION ALL SELECT row_id, 'price', CASE WHEN s = 'F' THEN 5000.0 ELSE 1000.0 END, 400000.0, NULL, false FROM o UNION ALL SELECT row_id, 'priority', NULL, NULL, '1-URGENT|2-HIGH|3-MEDIUM', false FROM o WHERE s = 'O'",
    "column_union": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, '' AS r_regionkey, '' AS r_name FROM nation UNION ALL SELECT '', '', '', r_regionkey::VARCHAR, r_name FROM region",
    "lattice_cover": "WITH k AS (SELECT DISTINCT p_brand AS key FROM part), s AS (SELECT DISTINCT p_brand AS key, p_size AS lo, p_size + 4 AS hi FROM part), v AS (SELECT key, unnest(['1-54', '20 — 30', '7', 'x']) AS value, unnest([1, 20, 7, NULL]) AS a, unnest([54, 30, 7, NULL]) AS b FROM k), "
    "i AS (SELECT v.key, value, a, b, min(lo) AS l, max(hi) AS h FROM v JOIN s ON s.key = v.key AND lo >= a AND hi <= b GROUP BY 1, 2, 3, 4), x AS (SELECT key, bool_and(lo % 2 = 0) AS ev, bool_and(lo % 2 = 1) AS od FROM s GROUP BY 1), "
    "pt AS (SELECT i.*, unnest(range(a, b + 1, CASE WHEN (ev AND a % 2 = 0 AND b % 2 = 0) OR (od AND a % 2 = 1 AND b % 2 = 1) THEN 2 ELSE 1 END)) AS y FROM i JOIN x USING (key) WHERE l = a AND h = b), "
    "bad AS (SELECT DISTINCT key, value FROM pt WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = pt.key AND lo >= a AND hi <= b AND lo <= y AND y <= hi)) "
    "SELECT key, value, CASE WHEN a IS NULL THEN false WHEN a = b THEN EXISTS (SELECT 1 FROM s WHERE s.key = v.key AND lo <= a AND a <= hi) ELSE EXISTS (SELECT 1 FROM pt WHERE pt.key = v.key AND pt.value = v.value) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = v.key AND bad.value = v.value) END AS covered FROM v",
    "answer_scores": f"WITH {_JUDGED}, {_F1} SELECT episode_id, em, round(f1, 6) AS f1 FROM fs",
    "mean_scores": f"WITH {_JUDGED}, {_F1} SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM fs",
    "recall_and_rank": "WITH e AS (SELECT DISTINCT episode_id, case_id, surfaced_titles AS t FROM episode_outcomes WHERE case_id IS NOT NULL AND len(surfaced_titles) > 0), w AS (SELECT case_id, list_sort(list_distinct(list(t[1]))) AS w FROM e GROUP BY 1) "
    "SELECT episode_id, round(len(list_intersect(list_distinct(t[1:2]), w)) / len(w), 6) AS recall2, round(coalesce(1.0 / list_min(list_filter(list_transform(t, lambda x, i: CASE WHEN list_contains(w, x) THEN i END), lambda y: y IS NOT NULL)), 0), 6) AS rr FROM e JOIN w USING (case_id)",
    "leak_scan": f"WITH {_JUDGED} SELECT episode_id FROM n WHERE length(q) >= 4 AND contains(' ' || p || ' ', ' ' || q || ' ')",
    "pareto_suppliers": "WITH r AS (SELECT a.k, x, y, z FROM (SELECT c_nationkey AS k, count(*) AS x, round(avg(c_acctbal), 2) AS y FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS z FROM supplier GROUP BY 1) b ON a.k = b.k) SELECT k FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.x >= r.x AND o.y >= r.y AND o.z >= r.z AND (o.x > r.x OR o.y > r.y OR o.z > r.z))",
    "pool_allocation": "WITH p AS (SELECT c_mktsegment, count(*)::DOUBLE AS w FROM customer GROUP BY 1), s AS (SELECT *, w / sum(w) OVER () * greatest(37 - count(*) OVER (), 0) AS x, count(*) OVER () AS c FROM p), f AS (SELECT *, floor(x) AS b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, c_mktsegment) AS k, sum(floor(x)) OVER () AS t FROM s) SELECT c_mktsegment, (1 + b + CASE WHEN k <= 37 - c - t THEN 1 ELSE 0 END)::BIGINT AS n FROM f",
    "latency_histogram": f"SELECT event_type, {_LE}, count(sec) AS n, round(sum(sec), 4) AS total FROM (SELECT event_type, value / 10 AS sec FROM events) GROUP BY 1",
    "tumbling_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_values": "SELECT w AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1",
    "user_sessions": "WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM k GROUP BY user_id, k",
    "change_bursts": r"WITH f AS (SELECT seen_at, regexp_extract(regexp_replace(regexp_replace(trim(doc_path), '[\\/]+', '/', 'g'), '^(?:\./|/)+', ''), '^[^/]+') AS folder FROM file_listing WHERE seen_at IS NOT NULL), g AS (SELECT *, coalesce(seen_at >= lag(seen_at) OVER w + INTERVAL 5 SECOND, true)::INT AS b FROM f WINDOW w AS (PARTITION BY folder ORDER BY seen_at)), "
    "k AS (SELECT *, sum(b) OVER (PARTITION BY folder ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT folder, min(seen_at) AS started, max(seen_at) AS \"last\", count(*) AS n FROM k GROUP BY folder, k",
    "distinct_events": "SELECT DISTINCT event_id, user_id FROM events",
}
