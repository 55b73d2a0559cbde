"""Writing to a graph by reference: endpoints found by id, label or alias, upserts with their edges, updates, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import normalize_label
from loam.operators.graph import delete_where


def resolve_refs(nodes: DataFrame, refs: DataFrame, column: str = "ref") -> DataFrame:
    """``ref, id, how``: the node that each reference means: the one of that ``id``, else the only one of that ``label``, else
    the only one with that ``alias``, labels and aliases in any case and spacing. Null where none or several fit
    (``how`` is then ``none`` or ``several``, by the first step that any fits). Each distinct reference has one row; a
    null reference has none."""
    asked = refs.where(F.col(column).isNotNull()).select(F.col(column).alias("ref")).distinct().withColumn("key", normalize_label("ref"))
    by = lambda step, how, key: nodes.select(key.alias("key"), "id", F.lit(step).alias("step"), F.lit(how).alias("how")).where(F.col("key").isNotNull())
    ids = asked.join(nodes.select(F.col("id").alias("ref"), "id"), "ref").select("ref", "id", F.lit(0).alias("step"), F.lit("id").alias("how"))
    named = by(1, "label", normalize_label("label"))
    if "aliases" in nodes.columns:
        named = named.unionByName(by(2, "alias", F.explode(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_label))))
    found = ids.unionByName(asked.join(named.where("key <> ''").distinct(), "key").select("ref", "id", "step", "how"))
    # Per step a partial count and minimum, so a label that a third of all nodes bear gathers nothing.
    steps = found.distinct().groupBy("ref", "step", "how").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    best = steps.groupBy("ref").agg(F.min(F.struct("step", "how", "id", "n")).alias("b"))
    alone = F.col("b.n") == 1
    how = F.when(F.col("b").isNull(), "none").when(alone, F.col("b.how")).otherwise("several")
    return asked.join(best, "ref", "left").select("ref", F.when(alone, F.col("b.id")).alias("id"), how.alias("how"))


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejected edges after an upsert of ``id, node_type, label, aliases`` and ``efrom, edge_type, eto``.

    A proposal is the existing node of its type and label (any case and spacing), else the proposal with the least id; its
    aliases join that node's, and edges to its id move there. Proposals without an id, a type or a label are left out.
    Ends of edges are references (see ``resolve_refs``); an edge with an end that is not found, or that ends where it
    begins, is rejected. Edges that are there already are not written again.
    """
    good = new_nodes.where(F.col("id").isNotNull() & (F.coalesce(F.trim("label"), F.lit("")) != "") & (F.coalesce(F.trim("node_type"), F.lit("")) != ""))
    good = good.select("id", F.trim("node_type").alias("node_type"), "label", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    key = [F.lower("node_type").alias("_t"), normalize_label("label").alias("_l")]
    old = nodes.groupBy(*key).agg(F.min("id").alias("_old"))
    placed = good.join(good.groupBy(*key).agg(F.min("id").alias("_new")), (F.lower(good["node_type"]) == F.col("_t")) & (normalize_label(good["label"]) == F.col("_l")))
    placed = placed.join(old, ["_t", "_l"], "left").withColumn("target", F.coalesce("_old", "_new"))
    names = placed.groupBy("target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("_names"))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    kept = nodes.join(names.withColumnRenamed("target", "id"), "id", "left").withColumn("aliases", F.when(F.col("_names").isNull(), F.col("aliases")).otherwise(F.array_union(own, "_names"))).drop("_names")
    fresh = placed.where(F.col("_old").isNull() & (F.col("id") == F.col("_new"))).select("id", "node_type", "label").join(names.select(F.col("target").alias("id"), F.col("_names").alias("aliases")), "id")
    written = kept.unionByName(fresh, allowMissingColumns=True)
    moved = placed.select(F.col("id").alias("ref"), "target").distinct()
    ends = new_edges.select(F.col("efrom").alias("ref")).unionByName(new_edges.select(F.col("eto").alias("ref"))).distinct()
    found = resolve_refs(written, ends).join(moved, "ref", "left").select("ref", F.coalesce("target", "id").alias("id"))
    joined = new_edges.select("efrom", "edge_type", "eto").distinct()
    for end in ("efrom", "eto"):
        joined = joined.join(found.select(F.col("ref").alias(end), F.col("id").alias(f"_{end}")), end, "left")
    fits = F.col("_efrom").isNotNull() & F.col("_eto").isNotNull() & (F.col("_efrom") != F.col("_eto"))
    made = joined.where(fits).select(F.col("_efrom").alias("efrom"), "edge_type", F.col("_eto").alias("eto")).distinct()
    added = made.join(edges.select("efrom", "edge_type", "eto"), ["efrom", "edge_type", "eto"], "left_anti")
    return written, edges.unionByName(added, allowMissingColumns=True), joined.where(~F.coalesce(fits, F.lit(False))).select("efrom", "edge_type", "eto")


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after changes ``ref, label, aliases``: a null field stays as it is; of several changes to one node the greatest
    label and the union of the aliases count; references that mean no single node change nothing."""
    found = changes.join(resolve_refs(nodes, changes).where(F.col("id").isNotNull()).select("ref", "id"), "ref")
    each = found.groupBy("id").agg(F.max("label").alias("_label"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("_aliases"))
    joined = nodes.join(each, "id", "left")
    named = F.when(F.coalesce(F.size("_aliases"), F.lit(0)) > 0, F.col("_aliases")).otherwise(F.col("aliases"))
    return joined.withColumn("label", F.coalesce("_label", "label")).withColumn("aliases", named).select(*nodes.columns)


def delete_refs(nodes: DataFrame, edges: DataFrame, refs: DataFrame, column: str = "ref") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the nodes that references mean, and the references that mean none or several."""
    found = resolve_refs(nodes, refs, column)
    left, kept = delete_where(nodes, edges, found.where(F.col("id").isNotNull()).select("id"))
    return left, kept, found.where(F.col("id").isNull()).select("ref", "how")


def matching(nodes: DataFrame, node_type: str | None = None, origin: str | None = None, source: str | None = None) -> DataFrame:
    """``id`` of the nodes of a type, an origin and a source path (None fits all), for ``delete_where``."""
    def fits(column: Column, value: str | None) -> Column:
        return F.lit(True) if value is None else F.coalesce(column == value, F.lit(False))

    return nodes.where(fits(F.col("node_type"), node_type) & fits(F.col("prov.origin"), origin) & fits(F.col("prov.source_path"), source)).select("id")
