"""Ontologies: which types and relations a graph may have, read from TOML, and what breaks them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types and relations that every ontology has.
CORE_NODES, CORE_EDGES = ("Document", "Section", "Term", "Topic"), ("CONTAINS", "MENTIONS", "CO_OCCURS", "NEXT", "PREV", "SIMILAR")


@dataclass
class Ontology:
    entities: dict[str, dict] = field(default_factory=dict)
    relations: dict[str, dict] = field(default_factory=dict)
    strict: bool = False
    spines: list[list[tuple[str, str, str]]] = field(default_factory=list)
    closure: list[tuple[str, str, str]] = field(default_factory=list)
    structural: tuple[str, ...] = CORE_NODES

    @classmethod
    def parse(cls, text: str) -> Ontology:
        """From TOML with ``entities``, ``relations`` (from, to, role), ``validation.strict`` and ``reasoning`` (spines as
        alternating types and relations, closure as triples, structural types)."""
        raw = tomllib.loads(text)
        reasoning = raw.get("reasoning", {})
        spines = [[(s[k], s[k + 1], s[k + 2]) for k in range(0, len(s) - 2, 2)] for s in reasoning.get("spines", [])]
        return cls(
            raw.get("entities", {}), raw.get("relations", {}), bool(raw.get("validation", {}).get("strict", False)), spines,
            [tuple(c) for c in reasoning.get("closure", [])], tuple(reasoning.get("structural", CORE_NODES)),
        )

    def role(self, relation: str) -> str:
        """chaining, grounding or attribute; core relations ground unless declared."""
        declared = str(self.relations.get(relation, {}).get("role", "")).lower()
        return declared if declared in ("chaining", "grounding", "attribute") else ("grounding" if relation in CORE_EDGES and relation not in self.relations else "chaining")

    def grounding(self) -> tuple[str, ...]:
        return tuple(sorted(r for r in {*self.relations, *CORE_EDGES} if self.role(r) == "grounding"))

    def requires(self, what: str) -> list[str]:
        return sorted(k for k, v in self.entities.items() if v.get(f"requires_{what}"))


def invalid_nodes(nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """``id, node_type``: nodes of types that a strict ontology does not know."""
    if not ontology.strict:
        return nodes.select("id", "node_type").limit(0)
    return nodes.where(~F.col("node_type").isin(*ontology.entities, *CORE_NODES)).select("id", "node_type")


def check_edges(nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """``efrom, edge_type, eto, verdict``: ``ok``; ``flip`` where only the reverse is allowed; ``type`` for an unknown relation
    of a strict ontology; ``ends`` where neither way fits the declared types; ``missing`` where an end does not exist."""
    spark = edges.sparkSession
    as_list = lambda v: v if isinstance(v, list) else [v] if v else ["*"]
    rules = [(r, a, b) for r, spec in ontology.relations.items() for a in as_list(spec.get("from")) for b in as_list(spec.get("to"))]
    allowed = F.broadcast(spark.createDataFrame(rules or [("", "", "")], "edge_type string, a string, b string").groupBy("edge_type").agg(F.collect_set(F.struct("a", "b")).alias("pairs")))
    kinds = nodes.select("id", "node_type")
    typed = edges.select("efrom", "edge_type", "eto").join(kinds.select(F.col("id").alias("efrom"), F.col("node_type").alias("x")), "efrom", "left").join(kinds.select(F.col("id").alias("eto"), F.col("node_type").alias("y")), "eto", "left").join(allowed, "edge_type", "left")
    fits = lambda x, y: F.exists("pairs", lambda p: ((p["a"] == "*") | (p["a"] == x)) & ((p["b"] == "*") | (p["b"] == y)))
    verdict = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "missing")
        .when(F.col("pairs").isNull(), F.when(F.col("edge_type").isin(*CORE_EDGES) | F.lit(not ontology.strict), "ok").otherwise("type"))
        .when(fits(F.col("x"), F.col("y")), "ok")
        .when(fits(F.col("y"), F.col("x")), "flip")
        .otherwise("ends")
    )
    return typed.select("efrom", "edge_type", "eto", verdict.alias("verdict"))


def oriented(nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """Edges as they may be written: those that fit, and those that fit reversed, reversed; the last of equal ones."""
    judged = check_edges(nodes, edges, ontology).where(F.col("verdict").isin("ok", "flip"))
    flip = F.col("verdict") == "flip"
    return judged.select(F.when(flip, F.col("eto")).otherwise(F.col("efrom")).alias("efrom"), "edge_type", F.when(flip, F.col("efrom")).otherwise(F.col("eto")).alias("eto")).distinct()
