"""Queries of paths, conditions, ontologies, graph files, evaluation sets, carried links and writing by reference, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import normalize_label
from loam.operators import evals as E
from loam.operators import evalsets as V
from loam.operators import graph as G
from loam.operators import graphio as X
from loam.operators import paths as P
from loam.operators import search as S
from loam.operators import store as W
from loam.operators.conditions import condition, fits_schema, formula
from loam.operators.ontology import Ontology, check_edges, oriented
from loam.plans.fk_graph import WITH_GRAPH, graph_edges, graph_nodes
from loam.session import table
from loam.streaming.windows import append_rows, retry_unresolved, settled

SPINES = [[("Supplier", "LOCATED_IN", "Nation"), ("Nation", "PART_OF", "Region")]]
RELATIONS = {"LOCATED_IN": {"from": ["Customer", "Supplier"], "to": ["Nation"]}, "PART_OF": {"from": ["Region"], "to": ["Nation"]}, "PLACED_BY": {"from": ["Order"], "to": ["Customer"]}, "CONTAINS_PART": {"from": ["Order"], "to": ["Part"]}}


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("doc_path").distinct()


def path_hints(s: SparkSession, d: str) -> DataFrame:
    return P.path_hints(_paths(s, d), "panel notes review", 5)


def resolved_paths(s: SparkSession, d: str) -> DataFrame:
    """Every document's path as people type it: with a place, with other separators, below another folder."""
    typed = F.array(F.concat("doc_path", F.lit("#3")), F.concat(F.lit("@"), F.replace("doc_path", F.lit("/"), F.lit("\\"))), F.concat(F.lit("home/me/"), F.col("doc_path")), F.concat("doc_path", F.lit(".bak")))
    inputs = _paths(s, d).select(F.explode(typed).alias("input"))
    return P.resolve_paths(inputs, _paths(s, d))


def note_owners(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "chunks").select(F.concat("doc_path", F.lit("/n/"), F.col("ord").cast("string")).alias("note_path"))
    lost = _paths(s, d).select(F.concat(F.lit("lost/"), "doc_path").alias("note_path"))
    return P.note_owners(notes.unionByName(lost), _paths(s, d))


def folder_links(s: SparkSession, d: str) -> DataFrame:
    """Links of each document to the first one of its folder, through the folder above."""
    docs = _paths(s, d).withColumn("folder", F.regexp_extract("doc_path", r"([^/]+)/[^/]+$", 1)).withColumn("dir", F.regexp_replace("doc_path", "[^/]*$", ""))
    first = docs.groupBy("dir").agg(F.min("doc_path").alias("first"))
    links = docs.where("folder <> ''").join(first, "dir").select(F.col("doc_path").alias("src"), F.concat(F.lit("../"), "folder", F.lit("/./"), F.regexp_extract("first", r"[^/]+$", 0)).alias("target"))
    return P.reference_edges(links, _paths(s, d))[0]


def carried_links(s: SparkSession, d: str) -> DataFrame:
    """Links to listed files that the corpus still lacks: carried on to the next pass."""
    links = table(s, d, "manifest_entries").where("outcome = 'error'").select(F.lit("x").alias("src"), F.col("doc_path").alias("target"))
    older = table(s, d, "nodes").select("id", F.col("prov.source_path").alias("target")).where("target is not null").select(F.col("id").alias("src"), "target")
    return retry_unresolved(links, older, _paths(s, d))[1]


def settled_files(s: SparkSession, d: str) -> DataFrame:
    return settled(table(s, d, "file_listing").where("seen_at is not null"), "seen_at", "2026-02-13 12:00:00", "10 hours").select("doc_path", "seen_at").distinct()


def payload_conditions(s: SparkSession, d: str) -> DataFrame:
    paid = table(s, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_totalprice").alias("total")).alias("pay"), F.col("o_orderstatus").alias("state"))).alias("p"))
    return paid.where(condition("$.pay.total >= 150000", F.col("p")) & condition("$.state != 'F'", F.col("p"))).select("o_orderkey")


def formula_rows(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem")
    return items.where(formula("(l_quantity + 1) * l_discount > 2 / 1.25", {c: F.col(c) for c in ("l_quantity", "l_discount")})).select("l_orderkey", "l_linenumber")


def schema_fits(s: SparkSession, d: str) -> DataFrame:
    """Documents whose title and size make a record of the schema."""
    schema = {"type": "object", "required": ["title", "n_chars"], "properties": {"title": {"type": "string"}, "n_chars": {"type": "integer"}}}
    return table(s, d, "documents").where(fits_schema(F.to_json(F.struct("title", "n_chars")), schema)).select("doc_id")


def _ontology() -> Ontology:
    return Ontology(entities={}, relations=RELATIONS, strict=True)


def edge_verdicts(s: SparkSession, d: str) -> DataFrame:
    return check_edges(graph_nodes(s, d), graph_edges(s, d), _ontology()).groupBy("edge_type", "verdict").agg(F.count("*").alias("n"))


def oriented_edges(s: SparkSession, d: str) -> DataFrame:
    return oriented(graph_nodes(s, d), graph_edges(s, d, ("PART_OF", "SUPPLIED_BY", "LOCATED_IN")), _ontology())


def glossary(s: SparkSession, d: str) -> DataFrame:
    return X.glossary(graph_nodes(s, d), graph_edges(s, d), "nation_3", SPINES)


def doctor(s: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(s, d, ("Order", "Customer", "Supplier", "Nation", "Region"))
    return X.doctor(nodes, G.delete_where(nodes, graph_edges(s, d), nodes.where("label = 'NATION_3'"))[1].withColumn("edge_type", F.when(F.col("edge_type") == "PLACED_BY", "MENTIONS").otherwise(F.col("edge_type"))), ["Order", "Customer"], SPINES)


def imported_layer(s: SparkSession, d: str) -> DataFrame:
    """Nodes after a layer of suppliers replaces the one that is there."""
    nodes, edges = graph_nodes(s, d), graph_edges(s, d)
    new = nodes.where("node_type = 'Supplier'").where(F.col("id").endswith("1"))
    return X.import_layer(nodes, edges, new, edges.join(new.withColumnRenamed("id", "efrom"), "efrom", "left_semi"), replace=True)[1].groupBy("edge_type").agg(F.count("*").alias("n"))


def mutated_regions(s: SparkSession, d: str) -> DataFrame:
    return V.mutated_cases(table(s, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


def trap_scores(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "episode_outcomes").distinct()
    return V.trap_scores(rows.select(F.when(F.col("rounds") > 5, "long").otherwise("short").alias("trap_type"), F.coalesce("done", F.lit(False)).alias("correct")))


def value_recall(s: SparkSession, d: str) -> DataFrame:
    """Sizes of each brand's parts, as found among its economy parts."""
    part = table(s, d, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("value"))
    return V.value_recall(part.select("p_brand", "value"), part.where("p_type = 'ECONOMY'").select("p_brand", "value"), "p_brand")


def list_coverage(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    reference = part.select(F.col("p_type").alias("field"), F.col("p_name").alias("value"))
    return V.coverage(reference, part.select(F.col("p_brand").alias("list_id"), F.col("p_name").alias("value")))


def tool_calls(s: SparkSession, d: str) -> DataFrame:
    """Each user's clicks with the next event of the same kind number as its result."""
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").alias("call_id"))
    body = F.concat_ws(":", F.col("event_type"), F.col("seq").cast("string"))
    kind = F.when(F.col("event_type") == "click", "call").otherwise("result")
    return E.pair_tool_calls(e.select("episode_id", "seq", kind.alias("kind"), "call_id", body.alias("body")))


def matched_columns(s: SparkSession, d: str) -> DataFrame:
    """The size of a largest matching of types to their own brands' last digits, per first letter of the type."""
    part = table(s, d, "part").select(F.substring("p_type", 1, 1).alias("t"), F.col("p_type").alias("l"), F.substring("p_type", -1, 1).alias("r")).distinct()
    return E.match_columns(part, "t", "l", "r").groupBy("t").agg(F.count("*").alias("n"))


def snippets(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where(F.col("text").isNotNull())
    return docs.where(F.contains(F.lower("text"), F.lit("pressure"))).select("doc_id", S.snippet(F.col("text"), ["pressure"], 80).alias("snippet"))


def nearest_names(s: SparkSession, d: str) -> DataFrame:
    return S.nearest_names(table(s, d, "node_upserts"), "node_type", "vendr", 5)


def bridges(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "nodes").select("id", "node_type", "label", "aliases", F.col("prov.source_path").alias("source_path"))
    return G.bridge_pairs(nodes).select("a", "b", F.round("confidence", 6).alias("confidence"))


def appended_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of one region's nations that a table of the others lacks, twice sent, with a row of placeholders."""
    nation = table(s, d, "nation").select("n_name", "n_regionkey")
    new = nation.unionByName(nation).unionByName(s.createDataFrame([("...", 0)], "n_name STRING, n_regionkey BIGINT").select("n_name", F.col("n_regionkey").cast(nation.schema["n_regionkey"].dataType)))
    return append_rows(nation.where("n_regionkey <> 1"), new)


# --- writing by reference -------------------------------------------------------------------------------------------------------


def _proposed(s: SparkSession, d: str) -> DataFrame:
    up = table(s, d, "node_upserts").dropDuplicates(["upsert_id"])
    kind = F.trim(F.regexp_replace("node_type", r"\s+", " "))
    return up.select(F.concat(F.lit("up:"), F.col("upsert_id").cast("string")).alias("id"), F.initcap(kind).alias("node_type"), "label", "aliases")


def _stored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes").select("id", "node_type", "label", "aliases")


def resolved_refs(s: SparkSession, d: str) -> DataFrame:
    """What the labels of all proposals and all node ids mean in the graph."""
    nodes = _stored(s, d)
    return W.resolve_refs(nodes, _proposed(s, d).select(F.col("label").alias("ref")).unionByName(nodes.select(F.col("id").alias("ref"))))


def upserted_nodes(s: SparkSession, d: str) -> DataFrame:
    """Numbers of nodes by type after all proposals are written."""
    nodes, edges = _stored(s, d), graph_edges(s, d, ("PART_OF",))
    return W.upsert_graph(nodes, edges.limit(0), _proposed(s, d), edges.limit(0))[0].groupBy("node_type").agg(F.count("*").alias("n"))


def upserted_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges between consecutive proposals of a type, moved to the nodes that these become."""
    up = _proposed(s, d).where(F.coalesce(F.trim("label"), F.lit("")) != "")
    edges = up.select("id", F.lead("id").over(Window.partitionBy("node_type").orderBy("id")).alias("eto")).where("eto is not null").select(F.col("id").alias("efrom"), F.lit("NEAR").alias("edge_type"), "eto")
    return W.upsert_graph(_stored(s, d), edges.limit(0), up, edges)[1].select("efrom", "edge_type", "eto")


def deleted_refs(s: SparkSession, d: str) -> DataFrame:
    """What is left of the graph's nodes, by type, without those that proposals name."""
    nodes = _stored(s, d)
    gone = W.delete_refs(nodes, graph_edges(s, d, ("PART_OF",)).limit(0), _proposed(s, d).select(F.col("label").alias("ref")))
    return gone[0].groupBy("node_type").agg(F.count("*").alias("n"))


def structural_nodes(s: SparkSession, d: str) -> DataFrame:
    return W.matching(table(s, d, "nodes"), "Document", "auto-structural")


QUERIES = {f.__name__: f for f in (
    path_hints, resolved_paths, note_owners, folder_links, carried_links, settled_files, payload_conditions, formula_rows, schema_fits, edge_verdicts, oriented_edges, glossary, doctor, imported_layer,
    mutated_regions, trap_scores, value_recall, list_coverage, tool_calls, matched_columns, snippets, nearest_names, bridges, appended_rows, resolved_refs, upserted_nodes, upserted_edges, deleted_refs, structural_nodes,
)}
_W = f"WITH {WITH_GRAPH}"
_PATHS = "p AS (SELECT DISTINCT doc_path FROM chunks)"
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_PROPOSED = r"u AS (SELECT DISTINCT ON (upsert_id) 'up:' || upsert_id AS id, lower(trim(regexp_replace(node_type, '\s+', ' ', 'g'))) AS t, label, aliases FROM node_upserts)"
_REFS = (
    f"{_PROPOSED}, r AS (SELECT label AS ref FROM u WHERE label IS NOT NULL UNION SELECT id FROM nodes), k AS (SELECT ref, {_NORM.format('ref')} AS key FROM r), "
    f"f AS (SELECT ref, id, 0 AS step, 'id' AS how FROM r JOIN nodes ON id = ref UNION SELECT ref, id, 1, 'label' FROM k JOIN nodes ON {_NORM.format('label')} = key WHERE key <> '' "
    f"UNION SELECT ref, id, 2, 'alias' FROM k JOIN (SELECT id, unnest(aliases) AS a FROM nodes) ON {_NORM.format('a')} = key WHERE key <> ''), "
    "g AS (SELECT ref, step, how, min(id) AS id, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ref ORDER BY step) = 1)"
)
_UPSERT = (
    f"{_PROPOSED}, v AS (SELECT id, t, {_NORM.format('label')} AS l FROM u WHERE coalesce(trim(label), '') <> ''), o AS (SELECT lower(node_type) AS t, {_NORM.format('label')} AS l, min(id) AS old FROM nodes GROUP BY 1, 2), "
    "m AS (SELECT v.id, v.t, coalesce(o.old, min(v.id) OVER (PARTITION BY v.t, v.l)) AS target, o.old FROM v LEFT JOIN o USING (t, l))"
)
SQL = {
    "path_hints": r"WITH p AS (SELECT DISTINCT doc_path FROM chunks) SELECT doc_path, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(doc_path), '[^\p{L}\p{N}]+'), lambda x: x <> '')), ['panel', 'notes', 'review'])) AS overlap FROM p WHERE overlap >= 2 ORDER BY overlap DESC, doc_path LIMIT 5",
    "note_owners": f"WITH {_PATHS} SELECT DISTINCT doc_path || '/n/' || ord AS note_path, doc_path FROM chunks UNION ALL SELECT 'lost/' || doc_path, NULL FROM p",
    "folder_links": rf"WITH {_PATHS} SELECT doc_path AS efrom, f AS eto FROM (SELECT doc_path, min(doc_path) OVER (PARTITION BY regexp_replace(doc_path, '[^/]*$', '')) AS f FROM p WHERE contains(doc_path, '/')) WHERE doc_path <> f",
    "carried_links": f"WITH {_PATHS}, l AS (SELECT 'x' AS src, doc_path AS target FROM manifest_entries WHERE outcome = 'error' UNION SELECT id, prov.source_path FROM nodes WHERE prov.source_path IS NOT NULL) SELECT src, target FROM l WHERE src <> target AND target NOT IN (SELECT doc_path FROM p)",
    "settled_files": "SELECT DISTINCT doc_path, seen_at FROM file_listing WHERE seen_at <= TIMESTAMP '2026-02-13 02:00:00'",
    "payload_conditions": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'F'",
    "formula_rows": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity + 1) * l_discount > 2 / 1.25",
    "schema_fits": "SELECT doc_id FROM documents WHERE title IS NOT NULL AND n_chars IS NOT NULL",
    "edge_verdicts": f"{_W} SELECT edge_type, CASE edge_type WHEN 'PART_OF' THEN 'flip' WHEN 'SUPPLIED_BY' THEN 'type' ELSE 'ok' END AS verdict, count(*) AS n FROM ge JOIN gn a ON a.id = efrom JOIN gn b ON b.id = eto GROUP BY 1, 2",
    "oriented_edges": f"{_W} SELECT CASE WHEN edge_type = 'PART_OF' THEN eto ELSE efrom END AS efrom, edge_type, CASE WHEN edge_type = 'PART_OF' THEN efrom ELSE eto END AS eto FROM ge WHERE edge_type IN ('PART_OF', 'LOCATED_IN')",
    "glossary": f"{_W}, n AS (SELECT id FROM gn WHERE lower(label) = 'nation_3') SELECT n.id AS entry, 0 AS depth, NULL AS relation, n.id AS id, label FROM n JOIN gn USING (id) UNION ALL SELECT n.id, 1, 'PART_OF', eto, gn.label FROM n JOIN ge ON efrom = n.id AND edge_type = 'PART_OF' JOIN gn ON gn.id = eto",
    "mutated_regions": "SELECT n_nationkey AS row_id, v AS variant, f AS field, CASE f WHEN 'n_name' THEN n_name ELSE n_regionkey::VARCHAR END || CASE WHEN (v = 1 AND f = 'n_name') OR (v = 2 AND f = 'n_regionkey') THEN '~' ELSE '' END AS value, v = 0 AS valid FROM nation, (SELECT unnest([0, 1, 2]) AS v), (SELECT unnest(['n_name', 'n_regionkey']) AS f)",
    "trap_scores": "SELECT CASE WHEN rounds > 5 THEN 'long' ELSE 'short' END AS trap_type, count(*) AS n, count(*) FILTER (done) AS hits, round(count(*) FILTER (done) / count(*), 6) AS rate FROM (SELECT DISTINCT * FROM episode_outcomes) GROUP BY 1",
    "value_recall": "SELECT p_brand, round(avg(h::INT), 6) AS recall FROM (SELECT p_brand, p_size, bool_or(p_type = 'ECONOMY') AS h FROM part GROUP BY 1, 2) GROUP BY 1",
    "list_coverage": "WITH r AS (SELECT DISTINCT p_type AS field, p_name AS value FROM part), m AS (SELECT DISTINCT p_brand, p_name AS value FROM part), s AS (SELECT field, p_brand, count(*) AS s FROM r JOIN m USING (value) GROUP BY 1, 2) SELECT field, max(s) / n >= 0.5 AS covered, round(max(s) / n, 6) AS share FROM s JOIN (SELECT field, count(*) AS n FROM r GROUP BY 1) USING (field) GROUP BY field, n",
    "tool_calls": "WITH e AS (SELECT user_id::VARCHAR AS episode_id, json_extract_string(props, '$.k') AS call_id, event_id AS seq, event_type || ':' || event_id AS body, event_type = 'click' AS c FROM events) SELECT x.episode_id, x.call_id, x.seq, x.body AS call, arg_min(y.body, y.seq) AS result FROM e x LEFT JOIN e y ON y.episode_id = x.episode_id AND y.call_id = x.call_id AND NOT y.c AND y.seq > x.seq WHERE x.c GROUP BY ALL",
    "snippets": r"WITH f AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents WHERE contains(lower(text), 'pressure')) SELECT doc_id, trim(substring(t, greatest(instr(lower(t), 'pressure') - 20, 1), 80)) AS snippet FROM f",
    "nearest_names": "SELECT node_type, d AS distance FROM (SELECT DISTINCT node_type, levenshtein(lower(node_type), 'vendr') AS d FROM node_upserts WHERE node_type IS NOT NULL) WHERE d <= greatest(1, length(node_type) / 2) ORDER BY d, node_type LIMIT 5",
    "appended_rows": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1",
    "imported_layer": f"{_W} SELECT edge_type, count(*) AS n FROM ge WHERE NOT (edge_type = 'LOCATED_IN' AND efrom LIKE 'sup:%' AND efrom NOT LIKE 'sup:%1') AND edge_type <> 'SUPPLIED_BY' GROUP BY 1",
    "resolved_refs": f"WITH {_REFS} SELECT r.ref, CASE WHEN n = 1 THEN b.id END AS id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN how ELSE 'several' END AS how FROM r LEFT JOIN b USING (ref)",
    "deleted_refs": f"WITH {_REFS} SELECT node_type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT b.id FROM b JOIN u ON u.label = b.ref WHERE n = 1) GROUP BY 1",
    "upserted_edges": f"WITH {_UPSERT}, e AS (SELECT target AS efrom, lead(target) OVER (PARTITION BY t ORDER BY id) AS eto FROM m) SELECT DISTINCT efrom, 'NEAR' AS edge_type, eto FROM e WHERE eto IS NOT NULL AND efrom <> eto",
    "upserted_nodes": f"WITH {_UPSERT} SELECT node_type, count(*) AS n FROM (SELECT node_type, id FROM nodes UNION ALL SELECT DISTINCT upper(t[1]) || t[2:], target FROM m WHERE old IS NULL) GROUP BY 1",
    "structural_nodes": "SELECT id FROM nodes WHERE node_type = 'Document' AND prov.origin = 'auto-structural'",
}
