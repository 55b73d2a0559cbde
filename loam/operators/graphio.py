"""Graphs out to JSON, DOT and GraphML and in again; reports on a graph's health; an entity's glossary."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import normalize_label
from loam.operators import graph as G

#: Entries, depth and lines of a glossary.
ENTRIES, DEPTH, LINES = 6, 5, 12


def export_layer(nodes: DataFrame, edges: DataFrame, node_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes that are not structural (of one type, if given) and every edge that touches one."""
    own = nodes.where(~F.col("node_type").isin(*G.STRUCTURAL))
    if node_type is not None:
        own = own.where(F.col("node_type") == node_type)
    ids = own.select("id")
    touching = edges.join(ids.withColumnRenamed("id", "efrom"), "efrom", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "eto"), "eto", "left_semi"))
    return own, touching.dropDuplicates(["efrom", "edge_type", "eto"])


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line``: the statements of a DOT graph, to be written as text between ``digraph {`` and ``}``."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    a = nodes.select(F.concat(F.lit("  "), q(F.col("id")), F.lit(" [label="), q(F.coalesce("label", F.lit(""))), F.lit("];")).alias("line"))
    return a.unionByName(edges.select(F.concat(F.lit("  "), q(F.col("efrom")), F.lit(" -> "), q(F.col("eto")), F.lit(" [label="), q(F.col("edge_type")), F.lit("];")).alias("line")))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line``: the elements of a GraphML graph; ends that are not exported stand as sections."""

    def esc(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    known = nodes.select("id", "node_type", F.coalesce("label", F.lit("")).alias("label"))
    ends = edges.select(F.explode(F.array("efrom", "eto")).alias("id")).distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit("Section").alias("node_type"), F.col("id").alias("label"))
    node = F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="type">'), esc(F.col("node_type")), F.lit('</data><data key="label">'), esc(F.col("label")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), esc(F.col("efrom")), F.lit('" target="'), esc(F.col("eto")), F.lit('"><data key="type">'), esc(F.col("edge_type")), F.lit("</data></edge>"))
    return known.unionByName(ends).select(node.alias("line")).unionByName(edges.select(edge.alias("line")))


def graphml_header(name: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph id={quoteattr(name)} edgedefault="directed">'


def import_layer(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """A graph with an exported layer in it: merged by id and triple, the new one winning; with ``replace`` the types that
    the layer has are emptied first, with their edges."""
    if replace:
        kinds = new_nodes.select("node_type").distinct()
        nodes, edges = G.delete_where(nodes, edges, nodes.join(kinds, "node_type", "left_semi").select("id"))
    kept = nodes.join(new_nodes.select("id"), "id", "left_anti")
    old = edges.join(new_edges.select("efrom", "edge_type", "eto"), ["efrom", "edge_type", "eto"], "left_anti")
    return kept.unionByName(new_nodes, allowMissingColumns=True), old.unionByName(new_edges, allowMissingColumns=True)


def doctor(nodes: DataFrame, edges: DataFrame, required: list[str], spines: list[list[tuple[str, str, str]]], current: DataFrame | None = None) -> DataFrame:
    """``id, finding``: nodes that are ``ungrounded``, ``incomplete`` or ``stale`` (against current file signatures)."""
    out = G.ungrounded(nodes, edges, required).select("id", F.lit("ungrounded").alias("finding")) if required else nodes.select("id", F.lit("").alias("finding")).limit(0)
    out = out.unionByName(G.incomplete_nodes(nodes, edges, spines).select("id", F.lit("incomplete").alias("finding")))
    if current is not None:
        out = out.unionByName(G.stale(nodes, current).select("id", F.lit("stale").alias("finding")))
    return out


def prune(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without its ungrounded and incomplete nodes; stale ones stay."""
    return G.delete_where(nodes, edges, findings.where("finding <> 'stale'").select("id"))


def glossary(nodes: DataFrame, edges: DataFrame, name: str, spines: list[list[tuple[str, str, str]]], entries: int = ENTRIES, depth: int = DEPTH, lines: int = LINES) -> DataFrame:
    """``entry, depth, relation, id, label``: nodes of a name and what they lead to along the spines' relations, a bounded
    number of entries, steps and lines each (the limits are the feature)."""
    start = nodes.where(normalize_label("label") == normalize_label(F.lit(name))).select("id").orderBy("id").limit(entries)
    relations = sorted({step[1] for spine in spines for step in spine})
    steps = edges.where(F.col("edge_type").isin(*relations)).select(F.col("efrom").alias("id"), "edge_type", "eto")
    out = start.select(F.col("id").alias("entry"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation"), "id")
    level = out
    for d in range(1, depth):
        level = level.select("entry", "id").join(steps, "id").select("entry", F.lit(d).alias("depth"), F.col("edge_type").alias("relation"), F.col("eto").alias("id")).distinct()
        out = out.unionByName(level)
    first = out.groupBy("entry", "id").agg(F.min(F.struct("depth", "relation")).alias("b"))
    ordered = first.groupBy("entry").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("b.depth").alias("depth"), F.col("b.relation").alias("relation"), "id"))), 1, lines).alias("x"))
    rows = ordered.select("entry", F.explode("x").alias("x")).select("entry", "x.depth", "x.relation", "x.id")
    return rows.join(nodes.select("id", "label"), "id", "left").select("entry", "depth", "relation", "id", "label")


def evidence(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, node: str) -> DataFrame:
    """``doc_path, ord, location, via``: chunks that a node or a neighbour mentions, by ``path#ord`` or ``path#location``."""
    near = G.neighbors(edges.where(~F.col("edge_type").isin(*G.GROUNDING)), nodes.where(F.col("id") == node).select("id"), 1, "both").select("id", F.lit("neighbour").alias("via"))
    who = near.unionByName(nodes.where(F.col("id") == node).select("id", F.lit("node").alias("via")))
    said = edges.where(F.col("edge_type") == "MENTIONS").join(who.withColumnRenamed("id", "efrom"), "efrom").select("eto", "via")
    places = chunks.select("doc_path", "ord", "location", F.explode(F.array_distinct(F.array(F.concat("doc_path", F.lit("#"), F.col("ord").cast("string")), F.concat("doc_path", F.lit("#"), F.coalesce("location", F.lit("")))))).alias("eto"))
    return places.join(said, "eto").groupBy("doc_path", "ord", "location").agg(F.max("via").alias("via"))
