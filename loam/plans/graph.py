"""Graph queries over the key graph and over the corpus graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.temporal import as_of, earliest_valid, normalize_instant, status
from loam.operators import graph as G
from loam.operators.incremental import latest_listing
from loam.plans.fk_graph import WITH_GRAPH, graph_edges, graph_nodes
from loam.session import table

RULES = [("LOCATED_IN", "PART_OF", "IN_REGION")]
SPINE = [("Order", "PLACED_BY", "Customer"), ("Customer", "LOCATED_IN", "Nation"), ("Nation", "PART_OF", "Region")]
AT = "1996-06-30T00:00:00Z"


def edges_labeled(s: SparkSession, d: str) -> DataFrame:
    return G.edges_labeled(graph_nodes(s, d), graph_edges(s, d)).select("efrom", "edge_type", "eto", "src_label", "dst_label")


def node_type_counts(s: SparkSession, d: str) -> DataFrame:
    return G.type_counts(graph_nodes(s, d), "node_type")


def edge_type_counts(s: SparkSession, d: str) -> DataFrame:
    return G.type_counts(graph_edges(s, d), "edge_type")


def edge_exists(s: SparkSession, d: str) -> DataFrame:
    return G.edge_exists(G.edges_labeled(graph_nodes(s, d), graph_edges(s, d)), None, "PART_OF", "asia").select("efrom", "edge_type", "eto")


def neighbors_1hop(s: SparkSession, d: str) -> DataFrame:
    start = graph_nodes(s, d, ("Nation",)).select("id")
    return G.neighbors(graph_edges(s, d), start, 1, "both")


def neighbors_depth2(s: SparkSession, d: str) -> DataFrame:
    start = graph_nodes(s, d, ("Region",)).where(F.col("label") == "ASIA").select("id")
    return G.neighbors(graph_edges(s, d), start, 2, "in")


def reach_relation(s: SparkSession, d: str) -> DataFrame:
    start = graph_nodes(s, d, ("Supplier",)).select("id")
    out = G.reach(graph_edges(s, d), start, "located in", 3)
    return out.select("id", "depth", F.array_join("path", ">").alias("path"))


def salient_labels(s: SparkSession, d: str) -> DataFrame:
    return G.salient_labels(table(s, d, "nodes").select("id", "label"))


def degree(s: SparkSession, d: str) -> DataFrame:
    return G.degree(graph_nodes(s, d), graph_edges(s, d))


def communities(s: SparkSession, d: str) -> DataFrame:
    return G.communities(graph_nodes(s, d), graph_edges(s, d))


def community_sizes(s: SparkSession, d: str) -> DataFrame:
    return communities(s, d).groupBy("community").agg(F.count("*").alias("n"))


def pagerank(s: SparkSession, d: str) -> DataFrame:
    return G.pagerank(graph_nodes(s, d), graph_edges(s, d)).select("id", F.round("rank", 8).alias("pr"))


def ppr(s: SparkSession, d: str) -> DataFrame:
    seeds = graph_nodes(s, d, ("Nation",)).where(F.col("label").endswith("1")).select("id", F.lit(1.0).alias("w"))
    return G.personalized_pagerank(graph_nodes(s, d), graph_edges(s, d), seeds, epsilon=-1.0).select("id", F.round("rank", 8).alias("pr"))


def community_top(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_nodes(s, d), graph_edges(s, d)
    ranks = G.pagerank(nodes, edges).select("id", F.round("rank", 8).alias("pagerank"))
    return G.community_top(G.communities(nodes, edges).join(ranks, "id"), 3)


def closure_region(s: SparkSession, d: str) -> DataFrame:
    return G.closure(graph_edges(s, d), RULES)


def jaccard_links(s: SparkSession, d: str) -> DataFrame:
    return G.jaccard_links(graph_edges(s, d, ("CONTAINS_PART",)), 0.3).select("a", "b", F.round("score", 6).alias("score"))


def adamic_adar(s: SparkSession, d: str) -> DataFrame:
    return G.adamic_adar(graph_edges(s, d, ("CONTAINS_PART",)), 0.55).select("a", "b", F.round("score", 6).alias("score"))


def shared_evidence(s: SparkSession, d: str) -> DataFrame:
    return G.shared_evidence(graph_edges(s, d, ("PLACED_BY",)), "PLACED_BY")


def label_jaccard(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "nodes").where(~F.col("node_type").isin("Document"))
    return G.label_jaccard(nodes, 0.6).select("a", "b", F.round("score", 6).alias("score"))


def merge_groups(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    pairs = docs.join(least, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return G.merge_groups(pairs, docs.select(F.col("doc_id").alias("id")))


def _validity(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph_nodes(s, d, ("Order",))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(s, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    validity = rows.select(F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("node_id"), stamp("o_orderdate").alias("valid_from"), stamp("last").alias("valid_to"), "o_custkey")
    return nodes, validity


def as_of_orders(s: SparkSession, d: str) -> DataFrame:
    nodes, validity = _validity(s, d)
    return as_of(nodes, validity, AT).select("id")


def temporal_status(s: SparkSession, d: str) -> DataFrame:
    _, validity = _validity(s, d)
    later = Window.partitionBy("o_custkey").orderBy("valid_from", "node_id")
    marked = validity.withColumn("superseded", F.lead("node_id").over(later).isNotNull() & (F.col("valid_to") < "1995-01-01"))
    return marked.select("node_id", status(F.col("valid_from"), F.col("valid_to"), F.col("superseded"), AT).alias("status"))


def earliest_per_status(s: SparkSession, d: str) -> DataFrame:
    nodes, validity = _validity(s, d)
    return earliest_valid(nodes, validity, "label")


def upsert_validity(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "node_upserts")
    return rows.select("upsert_id", normalize_instant(F.col("valid_from")).alias("valid_from"), normalize_instant(F.col("valid_to"), end=True).alias("valid_to")).distinct()


def incomplete_nodes(s: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(s, d, ("Order", "Customer", "Nation", "Region"))
    return G.incomplete_nodes(nodes, graph_edges(s, d, ("PLACED_BY", "LOCATED_IN", "PART_OF")), [SPINE])


def ungrounded(s: SparkSession, d: str) -> DataFrame:
    return G.ungrounded(graph_nodes(s, d), graph_edges(s, d), ["Customer", "Part"], "PLACED_BY")


def stale(s: SparkSession, d: str) -> DataFrame:
    now = latest_listing(table(s, d, "file_listing")).where("there").select("doc_path", F.col("seen_sig").alias("file_sig"))
    return G.stale(table(s, d, "nodes"), now)


def related(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_nodes(s, d), graph_edges(s, d)
    ranks = G.pagerank(nodes, edges).select("id", F.round("rank", 8).alias("pagerank"))
    return G.related(nodes, edges, G.communities(nodes, edges).join(ranks, "id"), "nat:1")


def merged_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and type folded into their least."""
    part = table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_brand", "p_type")
    least = part.groupBy("p_brand", "p_type").agg(F.min("id").alias("canonical"))
    mapping = part.join(least, ["p_brand", "p_type"]).select("id", "canonical")
    nodes = graph_nodes(s, d, ("Part",)).withColumn("aliases", F.array().cast("array<string>"))
    return G.merge_nodes(nodes, graph_edges(s, d, ("CONTAINS_PART",)), mapping)[1].select("efrom", "eto")


_W = "WITH RECURSIVE " + WITH_GRAPH
_RANKS = 30


def _pagerank_sql(personal: bool) -> str:
    """All rounds unrolled as materialized common table expressions."""
    if personal:
        links = "lk AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS w FROM (SELECT efrom a, eto b FROM ge UNION ALL SELECT eto, efrom FROM ge) GROUP BY a, b)"
        start = "st AS MATERIALIZED (SELECT id, (CASE WHEN node_type = 'Nation' AND label LIKE '%1' THEN 1.0 ELSE 0.0 END) / (SELECT count(*) FROM gn WHERE node_type = 'Nation' AND label LIKE '%1') AS w FROM gn)"
        first, damping = "SELECT id, w AS r FROM st", 1 - G.ALPHA
    else:
        links = "lk AS MATERIALIZED (SELECT DISTINCT efrom a, eto b, 1.0::DOUBLE AS w FROM ge WHERE efrom <> eto)"
        start = "st AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM gn) AS w FROM gn)"
        first, damping = "SELECT id, w AS r FROM st", G.DAMPING
    out = [WITH_GRAPH, links, start, "od AS MATERIALIZED (SELECT a, sum(w) AS o FROM lk GROUP BY a)", f"r0 AS MATERIALIZED ({first})"]
    for k in range(1, _RANKS + 1):
        p = f"r{k - 1}"
        out.append(
            f"r{k} AS MATERIALIZED (SELECT st.id, (1 - {damping}) * st.w + {damping} * (coalesce(f.x, 0) + (SELECT coalesce(sum(r), 0) FROM {p} WHERE id NOT IN (SELECT a FROM od)) * st.w) AS r "
            f"FROM st LEFT JOIN (SELECT lk.b, sum({p}.r * lk.w / od.o) AS x FROM {p} JOIN lk ON lk.a = {p}.id JOIN od ON od.a = lk.a GROUP BY lk.b) f ON f.b = st.id)"
        )
    return "WITH " + ", ".join(out)


#: Least names passed on along edges so many times; the key graph's nodes are fewer steps apart.
_STEPS = 14


def _components_sql() -> str:
    steps = ["bo AS MATERIALIZED (SELECT efrom a, eto b FROM ge UNION SELECT eto, efrom FROM ge)", "c0 AS MATERIALIZED (SELECT id, id AS c FROM gn)"]
    for k in range(1, _STEPS + 1):
        steps.append(f"c{k} AS MATERIALIZED (SELECT id, least(any_value(x.c), coalesce(min(y.c), any_value(x.c))) AS c FROM c{k - 1} x LEFT JOIN (SELECT bo.a, z.c FROM bo JOIN c{k - 1} z ON z.id = bo.b) y ON y.a = x.id GROUP BY id)")
    return ", ".join([*steps, f"co AS MATERIALIZED (SELECT id, c AS community FROM c{_STEPS})"])


_COMPONENTS = _W + ", " + _components_sql()
_VALID = "va AS (SELECT 'ord:' || o_orderkey AS node_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS valid_from, strftime(l, '%Y-%m-%dT%H:%M:%SZ') AS valid_to, o_custkey, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower(label), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"
_SHAPE = r"'^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?Z?)?)?)?$'"


def _instant_sql(col: str, end: bool) -> str:
    g = lambda k: f"regexp_extract(trim({col}), {_SHAPE}, {k})"
    month = f"CASE WHEN {g(2)} = '' THEN '{'12' if end else '01'}' ELSE {g(2)} END"
    day = f"CASE WHEN {g(3)} <> '' THEN {g(3)} ELSE " + (f"strftime(last_day(try_cast({g(1)} || '-' || ({month}) || '-01' AS DATE)), '%d')" if end else "'01'") + " END"
    clock = f"CASE WHEN {g(4)} <> '' THEN {g(4)} || ':' || {g(5)} || ':' || CASE WHEN {g(6)} = '' THEN '00' ELSE {g(6)} END ELSE '{'23:59:59' if end else '00:00:00'}' END"
    made = f"({g(1)} || '-' || ({month}) || '-' || ({day}) || 'T' || ({clock}) || 'Z')"
    return f"CASE WHEN regexp_full_match(trim({col}), {_SHAPE}) AND try_cast(replace(replace({made}, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL THEN {made} END"


QUERIES = {f.__name__: f for f in (
    edges_labeled, node_type_counts, edge_type_counts, edge_exists, neighbors_1hop, neighbors_depth2, reach_relation, salient_labels, degree, communities, community_sizes, pagerank, ppr, community_top,
    closure_region, jaccard_links, adamic_adar, shared_evidence, label_jaccard, merge_groups, as_of_orders, temporal_status, earliest_per_status, upsert_validity, incomplete_nodes, ungrounded, stale, related, merged_parts,
)}
SQL = {
    "edges_labeled": f"{_W} SELECT efrom, edge_type, eto, a.label AS src_label, b.label AS dst_label FROM ge JOIN gn a ON a.id = efrom JOIN gn b ON b.id = eto",
    "node_type_counts": f"{_W} SELECT node_type, count(*) AS n FROM gn GROUP BY 1",
    "edge_type_counts": f"{_W} SELECT edge_type, count(*) AS n FROM ge GROUP BY 1",
    "edge_exists": f"{_W} SELECT efrom, edge_type, eto FROM ge JOIN gn a ON a.id = efrom JOIN gn b ON b.id = eto WHERE edge_type = 'PART_OF' AND b.label ILIKE '%asia%'",
    "neighbors_1hop": f"{_W} SELECT DISTINCT id, 1 AS depth FROM (SELECT eto AS id FROM ge WHERE efrom LIKE 'nat:%' UNION SELECT efrom FROM ge WHERE eto LIKE 'nat:%') WHERE id NOT LIKE 'nat:%'",
    "neighbors_depth2": f"{_W}, r AS (SELECT id FROM gn WHERE node_type = 'Region' AND label = 'ASIA'), x AS (SELECT DISTINCT efrom AS id FROM ge JOIN r ON eto = r.id) SELECT id, 1 AS depth FROM x UNION ALL SELECT DISTINCT efrom, 2 FROM ge JOIN x ON eto = x.id",
    "reach_relation": f"{_W} SELECT eto AS id, 1 AS depth, array_to_string(min([efrom, 'LOCATED_IN', eto]), '>') AS path FROM ge WHERE efrom LIKE 'sup:%' GROUP BY eto",
    "salient_labels": f"WITH b AS (SELECT id, label, {_WORDS} AS w FROM nodes WHERE label IS NOT NULL), k AS (SELECT DISTINCT label, list_sort(w) AS w FROM b WHERE len(w) > 0), u AS (SELECT DISTINCT w FROM k), "
    "e AS (SELECT id, unnest(w) AS t, len(w) AS n FROM b), v AS (SELECT w, unnest(w) AS t, len(w) AS n FROM u), m AS (SELECT v.w, e.id FROM v JOIN e USING (t) GROUP BY v.w, e.id, v.n HAVING count(*) = v.n), "
    "d AS (SELECT w, count(*) AS df FROM m GROUP BY w) SELECT k.label, d.df FROM k JOIN d USING (w) WHERE df <= 25 AND df < 0.1 * (SELECT count(*) FROM nodes)",
    "degree": f"{_W} SELECT gn.id, coalesce(n, 0) AS degree FROM gn LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT efrom AS id FROM ge WHERE efrom <> eto UNION ALL SELECT eto FROM ge WHERE efrom <> eto) GROUP BY id) USING (id)",
    "communities": _COMPONENTS + " SELECT id, community FROM co",
    "community_sizes": _COMPONENTS + " SELECT community, count(*) AS n FROM co GROUP BY 1",
    "pagerank": _pagerank_sql(False) + f" SELECT id, round(r, 8) AS pr FROM r{_RANKS}",
    "ppr": _pagerank_sql(True) + f" SELECT id, round(r, 8) AS pr FROM r{_RANKS}",
    "community_top": "WITH RECURSIVE " + _pagerank_sql(False)[5:] + ", " + _COMPONENTS[len(_W) + 2 :] + f" SELECT community, id, pagerank, place FROM (SELECT community, co.id, round(r, 8) AS pagerank, row_number() OVER (PARTITION BY community ORDER BY round(r, 8) DESC, co.id) AS place FROM co JOIN r{_RANKS} x ON x.id = co.id) WHERE place <= 3",
    "closure_region": f"{_W} SELECT DISTINCT x.efrom, 'IN_REGION' AS edge_type, y.eto FROM ge x JOIN ge y ON x.eto = y.efrom WHERE x.edge_type = 'LOCATED_IN' AND y.edge_type = 'PART_OF' AND x.efrom <> y.eto",
    "jaccard_links": f"{_W}, nb AS (SELECT efrom n, eto m FROM ge WHERE edge_type = 'CONTAINS_PART' UNION SELECT eto, efrom FROM ge WHERE edge_type = 'CONTAINS_PART'), dg AS (SELECT n, count(*) d FROM nb GROUP BY n), pr AS (SELECT x.n a, y.n b, count(*) c FROM nb x JOIN nb y ON x.m = y.m AND x.n < y.n GROUP BY 1, 2) "
    "SELECT a, b, round(c / (p.d + q.d - c), 6) AS score FROM pr JOIN dg p ON p.n = a JOIN dg q ON q.n = b WHERE c / (p.d + q.d - c) >= 0.3 AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.n = a AND nb.m = b)",
    "adamic_adar": f"{_W}, nb AS (SELECT efrom n, eto m FROM ge WHERE edge_type = 'CONTAINS_PART' UNION SELECT eto, efrom FROM ge WHERE edge_type = 'CONTAINS_PART'), dg AS (SELECT n, count(*) d FROM nb GROUP BY n) "
    "SELECT a, b, round(s, 6) AS score FROM (SELECT x.n a, y.n b, sum(1 / ln(d)) s FROM nb x JOIN nb y ON x.m = y.m AND x.n < y.n JOIN dg ON dg.n = x.m WHERE d > 1 GROUP BY 1, 2) p WHERE s > 0.55 AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.n = a AND nb.m = b)",
    "shared_evidence": f"{_W} SELECT x.efrom AS a, y.efrom AS b, count(*) AS shared FROM ge x JOIN ge y ON x.eto = y.eto AND x.efrom < y.efrom WHERE x.edge_type = 'PLACED_BY' AND y.edge_type = 'PLACED_BY' GROUP BY 1, 2",
    "label_jaccard": f"WITH l AS (SELECT id, list_sort({_WORDS}) AS w FROM nodes WHERE label IS NOT NULL AND node_type <> 'Document'), b AS (SELECT min(id) AS id, w FROM l WHERE len(w) > 0 GROUP BY w), e AS (SELECT id, unnest(w) AS t, len(w) AS n FROM b), "
    "p AS (SELECT x.id a, y.id b, count(*) c, x.n n, y.n m FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2, 4, 5) SELECT a, b, round(c / (n + m - c), 6) AS score FROM p WHERE c / (n + m - c) >= 0.6",
    "merge_groups": "SELECT min(doc_id) OVER (PARTITION BY text) AS \"group\", doc_id AS id FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1",
    "as_of_orders": f"WITH {_VALID} SELECT node_id AS id FROM va WHERE coalesce(valid_from <= '{AT}', true) AND coalesce(valid_to >= '{AT}', true)",
    "temporal_status": f"WITH {_VALID} SELECT node_id, CASE WHEN s THEN 'superseded' WHEN valid_from > '{AT}' THEN 'future' WHEN valid_to < '{AT}' THEN 'expired' ELSE 'current' END AS status FROM (SELECT *, lead(node_id) OVER (PARTITION BY o_custkey ORDER BY valid_from, node_id) IS NOT NULL AND valid_to < '1995-01-01' AS s FROM va)",
    "earliest_per_status": f"WITH {_VALID} SELECT label, id, valid_from FROM (SELECT o_orderstatus AS label, node_id AS id, valid_from, row_number() OVER (PARTITION BY o_orderstatus ORDER BY valid_from NULLS LAST, node_id) AS k FROM va) WHERE k = 1",
    "upsert_validity": f"SELECT DISTINCT upsert_id, {_instant_sql('valid_from', False)} AS valid_from, {_instant_sql('valid_to', True)} AS valid_to FROM node_upserts",
    "incomplete_nodes": f"{_W}, fc AS (SELECT DISTINCT eto AS id FROM ge WHERE edge_type = 'PLACED_BY'), fn AS (SELECT DISTINCT eto AS id FROM ge JOIN fc ON efrom = fc.id WHERE edge_type = 'LOCATED_IN'), fr AS (SELECT DISTINCT eto AS id FROM ge JOIN fn ON efrom = fn.id WHERE edge_type = 'PART_OF') "
    "SELECT id FROM gn WHERE (node_type = 'Customer' AND id NOT IN (SELECT id FROM fc)) OR (node_type = 'Nation' AND id NOT IN (SELECT id FROM fn)) OR (node_type = 'Region' AND id NOT IN (SELECT id FROM fr))",
    "ungrounded": f"{_W} SELECT id FROM gn WHERE node_type IN ('Customer', 'Part') AND id NOT IN (SELECT efrom FROM ge WHERE edge_type = 'PLACED_BY')",
    "stale": r"WITH s AS (SELECT regexp_replace(regexp_replace(trim(doc_path), '[\\/]+', '/', 'g'), '^(?:\./|/)+', '') AS p, file_sig, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(trim(doc_path), '[\\/]+', '/', 'g'), '^(?:\./|/)+', '') ORDER BY seen_at DESC, (file_sig IS NOT NULL) DESC, file_sig.mtime_secs DESC) AS k FROM file_listing) "
    "SELECT DISTINCT id FROM nodes JOIN s ON s.p = prov.source_path AND k = 1 WHERE prov.file_sig IS NOT NULL AND s.file_sig IS NOT NULL AND (prov.file_sig.mtime_secs <> s.file_sig.mtime_secs OR prov.file_sig.size <> s.file_sig.size)",
    "related": "WITH RECURSIVE " + _pagerank_sql(False)[5:] + ", " + _COMPONENTS[len(_W) + 2 :] + f" SELECT x.id, 'community' AS how, row_number() OVER (ORDER BY round(r, 8) DESC, x.id) AS place FROM co JOIN r{_RANKS} x ON x.id = co.id WHERE community = (SELECT community FROM co WHERE id = 'nat:1') AND x.id <> 'nat:1' ORDER BY place LIMIT 8",
    "merged_parts": "WITH m AS (SELECT 'part:' || p_partkey AS id, min('part:' || p_partkey) OVER (PARTITION BY p_brand, p_type) AS c FROM part) SELECT DISTINCT 'ord:' || l_orderkey AS efrom, c AS eto FROM lineitem JOIN m ON m.id = 'part:' || l_partkey",
}
