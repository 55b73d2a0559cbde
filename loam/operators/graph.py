"""Property-graph operators over ``nodes(id, node_type, label, ...)`` and ``edges(efrom, edge_type, eto, ...)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import words
from loam.operators import vectors
from loam.operators.components import connected_components
from loam.session import cut_lineage

#: Types of the structural layer, and of relations that only ground a node in a text.
STRUCTURAL, GROUNDING = ("Document", "Section", "Term", "Topic"), ("MENTIONS", "CONTAINS", "CO_OCCURS", "NEXT", "PREV", "SIMILAR")
#: Damping and rounds of PageRank; restart, rounds and tolerance of the personalized one.
DAMPING, ROUNDS, ALPHA, EPSILON = 0.85, 30, 0.15, 1e-6
#: Members of a key that one part of its pairs has.
KEY_ROWS = 2_000
#: Steps that a walk has at most.
DEEPEST = 12
#: Edges up to which an iterative ranking runs in one task; the count is checked, larger graphs take the distributed loop.
ONE_TASK_EDGES = 2_000_000
#: Nodes up to which a larger graph's ranking keeps its state in one vector of eight bytes a node, which is read by all tasks.
VECTOR_NODES = 20_000_000


def edges_labeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; an edge without one of its nodes has no row."""
    ends = nodes.select("id", "label")
    src = ends.select(F.col("id").alias("efrom"), F.col("label").alias("src_label"))
    dst = ends.select(F.col("id").alias("eto"), F.col("label").alias("dst_label"))
    return edges.join(src, "efrom").join(dst, "eto")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def edge_exists(labeled: DataFrame, src: str | None, edge_type: str | None, dst: str | None) -> DataFrame:
    """Edges that fit parts of their ends' labels (any case, unescaped wildcards) and a type; None fits everything."""
    out = labeled
    for column, part in (("src_label", src), ("dst_label", dst)):
        if part is not None:
            out = out.where(F.col(column).ilike(f"%{part}%"))
    return out if edge_type is None else out.where(F.col("edge_type") == edge_type)


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "out", edge_types: list[str] | None = None) -> DataFrame:
    """``id, depth``: nodes within ``depth`` steps of the start nodes (column ``id``), with the least number of steps,
    the start nodes left out. Level by level; what was reached before is taken out by an anti-join."""
    use = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    out = use.select(F.col("efrom").alias("a"), F.col("eto").alias("b"))
    back = use.select(F.col("eto").alias("a"), F.col("efrom").alias("b"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction].where("a <> b").distinct()
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        reached = frontier.withColumnRenamed("id", "a").join(steps, "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        if d < depth:
            reached = cut_lineage(reached)
            if reached.isEmpty():
                break
        seen = seen.unionByName(reached.select("id", F.lit(d).alias("depth")))
        frontier = reached
    return seen.where("depth > 0")


def reach(edges: DataFrame, start: DataFrame, relation: str | None = None, max_depth: int = 6, max_visited: int | None = None, grounding: tuple[str, ...] = GROUNDING, bridges: DataFrame | None = None) -> DataFrame:
    """``id, depth, path``: nodes that a walk reaches, with the least first path (ids and relations in turn).

    Grounding relations are never walked. With a relation only edges whose type shares a word with it are, and forward;
    without, all and either way. ``max_visited`` ends the walk after the level on which it is passed. ``bridges`` (``a, b``,
    see ``bridge_pairs``) are walked from dead ends only, as ``BRIDGE``. Depths are 1 to ``DEEPEST``; others are an error.
    """
    if not 1 <= max_depth <= DEEPEST:
        raise ValueError(f"max_depth must be 1 to {DEEPEST}")
    use = edges.where(~F.col("edge_type").isin(*grounding)).select("efrom", "edge_type", "eto")
    if relation is not None:
        use = use.where(F.arrays_overlap(words("edge_type"), words(F.lit(relation))))
        steps = use.select(F.col("efrom").alias("a"), F.col("edge_type").alias("via"), F.col("eto").alias("b"))
    else:
        steps = use.select(F.col("efrom").alias("a"), F.col("edge_type").alias("via"), F.col("eto").alias("b")).unionByName(
            use.select(F.col("eto").alias("a"), F.concat(F.lit("~"), "edge_type").alias("via"), F.col("efrom").alias("b"))
        )
    steps = steps.where("a <> b").distinct()
    if bridges is not None:
        dead = bridges.select("a", "b").join(steps.select("a"), "a", "left_anti")
        steps = steps.unionByName(dead.select("a", F.lit("BRIDGE").alias("via"), "b").distinct())
    seen = start.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")).dropDuplicates(["id"])
    frontier = seen
    for d in range(1, max_depth + 1):
        found = frontier.select(F.col("id").alias("a"), "path").join(steps, "a").select(F.col("b").alias("id"), F.concat("path", F.array("via", "b")).alias("path"))
        reached = found.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "path")
        reached = cut_lineage(reached)
        size = reached.count()
        if not size:
            break
        seen = cut_lineage(seen.unionByName(reached))
        frontier = reached
        if max_visited is not None and seen.count() >= max_visited:
            break
    return seen.where("depth > 0")


def bridge_confidence(exact: Column, candidates: Column, same_community: Column) -> Column:
    """How far a salient label may lead into another document: sure if exact and alone, less the more nodes share it."""
    base = F.when(exact, 0.9).otherwise(0.5) / candidates
    factor = F.when(same_community.isNull(), 1.0).when(same_community, 1.25).otherwise(0.5)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), base * factor))


def salient_labels(nodes: DataFrame, most: int = 25, share: float = 0.1) -> DataFrame:
    """``label, df``: labels all of whose words few nodes hold together: at most ``most``, and less than a share of all."""
    bag = nodes.where(F.col("label").isNotNull()).select("id", F.array_distinct(words("label")).alias("w")).where(F.size("w") > 0)
    keys = bag.select(F.array_sort("w").alias("w")).distinct().withColumn("rare_id", F.xxhash64("w"))
    # Nodes are met by their rarest word, so a common word joins nothing.
    df = bag.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    rarest = keys.select("rare_id", "w", F.explode("w").alias("t")).join(df, "t").groupBy("rare_id").agg(F.min(F.struct("n", "t")).alias("r"), F.first("w").alias("w"))
    met = rarest.select("rare_id", F.col("w").alias("need"), F.col("r.t").alias("t")).join(bag.select("id", "w", F.explode("w").alias("t")), "t")
    count = met.where(F.size(F.array_except("need", "w")) == 0).groupBy("rare_id").agg(F.count("*").alias("df"))
    total = nodes.agg(F.count("*").alias("total"))
    named = nodes.where(F.col("label").isNotNull()).select("label", F.xxhash64(F.array_sort(F.array_distinct(words("label")))).alias("rare_id")).distinct()
    out = named.join(count, "rare_id").crossJoin(F.broadcast(total))
    return out.where((F.col("df") <= most) & (F.col("df") < share * F.col("total"))).select("label", "df")


def bridge_pairs(nodes: DataFrame, communities: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``a, b, confidence``: nodes of different documents (``source_path``) that bear the same salient label, both ways, with
    the confidence of crossing there. Salient labels are borne by few nodes, so a label has few pairs."""
    own = nodes.where(F.col("source_path").isNotNull()).join(salient_labels(nodes).select("label"), "label").select("id", "source_path", F.lower(F.trim("label")).alias("k"))
    if communities is not None:
        own = own.join(communities.select("id", "community"), "id", "left")
    else:
        own = own.withColumn("community", F.lit(None).cast("string"))
    other = own.select(F.col("id").alias("b"), F.col("source_path").alias("p"), "k", F.col("community").alias("c"))
    pairs = own.withColumnRenamed("id", "a").join(other, "k").where(F.col("source_path") != F.col("p"))
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return pairs.join(count, "a").select("a", "b", bridge_confidence(F.lit(True), F.col("n"), F.col("community") == F.col("c")).alias("confidence")).where(F.col("confidence") >= least)


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree``: edges in and out; loops and unknown nodes do not count; 0 for nodes without any."""
    real = edges.where("efrom <> eto").join(nodes.select(F.col("id").alias("efrom")), "efrom", "left_semi").join(nodes.select(F.col("id").alias("eto")), "eto", "left_semi")
    ends = real.select(F.explode(F.array("efrom", "eto")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def _rank_in_one_task(ids: DataFrame, links: DataFrame, restart: DataFrame | None, damping: float, rounds: int, epsilon: float) -> DataFrame:
    """The iteration in numpy over all rows at once: rows tagged 0 are nodes with their restart weight, 1 are links."""
    nodes = ids.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1.0).alias("w"))
    if restart is not None:
        nodes = ids.join(restart, "id", "left").select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.coalesce("w", F.lit(0.0)).alias("w"))
    rows = nodes.unionByName(links.select(F.lit(1).alias("kind"), "a", "b", F.col("w").cast("double").alias("w"))).withColumn("one", F.lit(True))
    personal = restart is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 0].sort_values("a")
        names = np.array(own["a"].tolist(), dtype=object)
        start = own["w"].to_numpy(float)
        if not len(names) or start.sum() <= 0:
            return pd.DataFrame({"id": np.array([], dtype=object), "rank": np.array([], dtype=float)})
        start = start / start.sum()
        link = pdf[pdf["kind"] == 1]
        index = pd.Index(names)
        a, b, w = index.get_indexer(link["a"]), index.get_indexer(link["b"]), link["w"].to_numpy(float)
        out = np.bincount(a, w, len(names))
        rank = start.copy() if personal else np.full(len(names), 1.0 / len(names))
        for _ in range(rounds):
            share = np.divide(rank, out, out=np.zeros_like(rank), where=out > 0)
            dangling = rank[out == 0].sum()
            new = (1 - damping) * start + damping * (np.bincount(b, share[a] * w, len(names)) + dangling * start)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < epsilon:
                break
        return pd.DataFrame({"id": names, "rank": rank})

    return rows.groupBy("one").applyInPandas(run, "id string, rank double")


def _rank_distributed(ids: DataFrame, links: DataFrame, restart: DataFrame | None, damping: float, rounds: int, epsilon: float) -> DataFrame:
    """The iteration as joins and partial sums; the state is cut from its lineage every fifth round, or
    every round where each is tested for having settled."""
    n = ids.count()
    if restart is None:
        start = ids.select("id", F.lit(1.0 / max(1, n)).alias("w"))
    else:
        total = restart.join(ids, "id", "left_semi").agg(F.sum("w")).first()[0]
        if not total or total <= 0:
            return ids.limit(0).select("id", F.lit(0.0).alias("rank"))
        start = ids.join(restart, "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / F.lit(float(total))).alias("w"))
    out = links.groupBy("a").agg(F.sum("w").alias("out"))
    share = cut_lineage(links.join(out, "a").select("a", "b", (F.col("w") / F.col("out")).alias("share")))
    start = cut_lineage(start.join(out.withColumnRenamed("a", "id"), "id", "left").select("id", "w", F.col("out").isNull().alias("dangling")))
    rank = start.select("id", F.col("w").alias("rank"))
    for k in range(1, rounds + 1):
        lost = rank.join(start.where("dangling").select("id"), "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        flow = rank.join(share, F.col("id") == F.col("a")).groupBy("b").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        joined = start.join(flow, F.col("id") == F.col("b"), "left").crossJoin(F.broadcast(lost))
        new = joined.select("id", ((1 - damping) * F.col("w") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("w"))).alias("rank"))
        judged = restart is not None and epsilon > 0
        if k % 5 == 0 or k == rounds or judged:
            new = cut_lineage(new)
        if judged:
            moved = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is not None and moved < epsilon:
                return new
        rank = new
    return rank


def _ranked(nodes: DataFrame, one: DataFrame, seeds: DataFrame | None, damping: float, rounds: int, epsilon: float, one_task_edges: int, vector_nodes: int) -> DataFrame:
    """The ranking in the way that fits the counted size. Links ``a, b`` are all edges without loops."""
    size = nodes.count()
    small = size <= one_task_edges and one.count() + size <= one_task_edges
    if not small and (graph := vectors.NodeVector.of(nodes, size, vector_nodes)) is not None:
        return vectors.ranks(graph, one, seeds, damping, rounds, epsilon)
    ids = nodes.select("id").distinct()
    links = one.distinct() if seeds is None else one
    links = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", F.lit(1.0).alias("w"))
    if seeds is not None:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return (_rank_in_one_task if small else _rank_distributed)(ids, links, seeds, damping, rounds, epsilon)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, one_task_edges: int = ONE_TASK_EDGES, vector_nodes: int = VECTOR_NODES) -> DataFrame:
    """``id, rank``: directed, parallel edges once, no loops, unknown ends left out, a fixed number of rounds; what dangling
    nodes hold is spread over all. Sums to 1."""
    links = edges.where("efrom <> eto").select(F.col("efrom").alias("a"), F.col("eto").alias("b"))
    return _ranked(nodes, links, None, damping, rounds, -1.0, one_task_edges, vector_nodes)


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, epsilon: float = EPSILON, one_task_edges: int = ONE_TASK_EDGES, vector_nodes: int = VECTOR_NODES) -> DataFrame:
    """``id, rank`` from seeds ``id, w``: either way along every edge, parallel ones counted, no loops, unknown ends left
    out; a walk starts again with probability alpha and from dangling nodes. No seeds give no rows."""
    links = edges.where("efrom <> eto").select(F.col("efrom").alias("a"), F.col("eto").alias("b"))
    start = seeds.groupBy("id").agg(F.sum("w").alias("w"))
    return _ranked(nodes, links, start, 1 - alpha, rounds, epsilon, one_task_edges, vector_nodes)


def communities(nodes: DataFrame, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES, vector_nodes: int = VECTOR_NODES) -> DataFrame:
    """``id, community``: connected components, named by their least node; a node without edges is its own."""
    size = nodes.count()
    numbered = None
    if size > one_task_edges and (graph := vectors.NodeVector.of(nodes, size, vector_nodes)) is not None:
        links = edges.where("efrom <> eto").select(F.col("efrom").alias("a"), F.col("eto").alias("b"))
        numbered = vectors.components(graph, links)
    if numbered is not None:
        return numbered.join(numbered.groupBy("component").agg(F.min("id").alias("community")), "component").select("id", "community")
    found = connected_components(edges.where("efrom <> eto"), "efrom", "eto")
    return nodes.select("id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("community"))


def _neighbor_sets(edges: DataFrame) -> DataFrame:
    both = edges.where("efrom <> eto").select(F.col("efrom").alias("n"), F.col("eto").alias("m"))
    return both.unionByName(both.select(F.col("m").alias("n"), F.col("n").alias("m"))).distinct()


def jaccard_links(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``a, b, score``: pairs that are not adjacent whose neighbour sets have Jaccard similarity of at least the threshold.

    Exact by prefix filtering: of its neighbours, rarest first, a node shows only as many as a similar node must share at
    least one of; hubs come last, so they seldom join anything. Candidates are then compared in full.
    """
    pairs = _neighbor_sets(edges)
    rarity = pairs.groupBy("m").agg(F.count("*").alias("d"))
    sets = pairs.join(rarity, "m").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("s"))
    sets = sets.select("n", F.transform("s", lambda x: x["m"]).alias("s"))
    size = F.size("s")
    shown = sets.select("n", F.explode(F.slice("s", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)).alias("m"), size.alias("k"))
    left, right = shown.select(F.col("n").alias("a"), "m", F.col("k").alias("ka")), shown.select(F.col("n").alias("b"), "m", F.col("k").alias("kb"))
    fits = (F.col("a") < F.col("b")) & (F.least("ka", "kb") >= threshold * F.greatest("ka", "kb") - 1e-9)
    candidates = left.join(right, "m").where(fits).select("a", "b").distinct()
    apart = candidates.join(pairs.select(F.col("n").alias("a"), F.col("m").alias("b")), ["a", "b"], "left_anti")
    both = apart.join(sets.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("score")).where(F.col("score") >= threshold)


def adamic_adar(edges: DataFrame, threshold: float = 0.0, max_degree: int | None = None) -> DataFrame:
    """``a, b, score``: pairs that are not adjacent by the sum of 1 / ln(degree) over common neighbours of degree above 1, more
    than the threshold.

    Exact by prefix: of its neighbours, weightiest first, a node shows only those without which the rest cannot pass the
    threshold; hubs weigh least and come last, so above 0 they join few pairs. ``max_degree`` leaves out common neighbours
    beyond it; None keeps them all.
    """
    pairs = _neighbor_sets(edges)
    d = pairs.groupBy("m").agg(F.count("*").alias("d")).where("d > 1")
    if max_degree is not None:
        d = d.where(F.col("d") <= max_degree)
    weighted = cut_lineage(pairs.join(d, "m").select("n", "m", (1 / F.log("d")).alias("w")))
    # Sum of the weights from a neighbour on, the weightiest first.
    rest = F.sum("w").over(Window.partitionBy("n").orderBy("w", F.desc("m")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shown = weighted.withColumn("rest", rest).where(F.col("rest") > threshold - 1e-9).select("n", "m")
    candidates = pairs_within(shown, "n", "m").select("a", "b").distinct()
    candidates = candidates.join(pairs.select(F.col("n").alias("a"), F.col("m").alias("b")), ["a", "b"], "left_anti")
    if threshold <= 0:  # every common neighbour is shown
        score = pairs_within(weighted, "n", "m", "w").groupBy("a", "b").agg(F.sum("w").alias("score"))
        return score.where(F.col("score") > threshold).join(candidates, ["a", "b"], "left_semi")
    half = candidates.join(weighted.select(F.col("n").alias("a"), "m", "w"), "a")
    score = half.join(weighted.select(F.col("n").alias("b"), "m"), ["b", "m"]).groupBy("a", "b").agg(F.sum("w").alias("score"))
    return score.where(F.col("score") > threshold)


def pairs_within(members: DataFrame, node: str, key: str, *carried: str) -> DataFrame:
    """``a, b`` (a < b) and the carried columns of a: pairs of nodes that share a key.

    The members of a key of more than ``KEY_ROWS`` are dealt to so many parts that its pairs are spread over tasks.
    """
    parts = members.groupBy(key).agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("parts")).where(F.col("parts") > 0)
    dealt = members.join(parts, key)
    left = dealt.select(F.col(node).alias("a"), key, *carried, F.pmod(F.xxhash64(node), F.col("parts")).cast("int").alias("part"))
    right = dealt.select(F.col(node).alias("b"), key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [key, "part"]).where("a < b").drop("part")


def shared_evidence(edges: DataFrame, edge_type: str = "MENTIONS", least: int = 1) -> DataFrame:
    """``a, b, shared``: pairs of nodes with at least ``least`` common anchors, and how many. Above 1 a node's commonest
    ``least - 1`` anchors need not be met to find its pairs."""
    own = edges.where(F.col("edge_type") == edge_type).select(F.col("efrom").alias("n"), F.col("eto").alias("anchor")).distinct()
    if least <= 1:
        return pairs_within(own, "n", "anchor").groupBy("a", "b").agg(F.count("*").alias("shared"))
    own = cut_lineage(own)
    common = own.join(own.groupBy("anchor").agg(F.count("*").alias("d")), "anchor")
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("d"), "anchor"))
    candidates = pairs_within(common.withColumn("place", place).where(F.col("place") >= least).select("n", "anchor"), "n", "anchor").select("a", "b").distinct()
    half = candidates.join(own.select(F.col("n").alias("a"), "anchor"), "a")
    met = half.join(own.select(F.col("n").alias("b"), "anchor"), ["b", "anchor"])
    return met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def label_jaccard(nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``a, b, score``: pairs of label classes by Jaccard similarity of their words, by the same prefix filter.

    Nodes whose labels have the same words are one class, named by its least node; so a label that a third of all nodes
    bear is compared once.
    """
    bags = nodes.where(F.col("label").isNotNull()).select("id", F.array_sort(F.array_distinct(words("label"))).alias("w")).where(F.size("w") > 0)
    classes = bags.groupBy("w").agg(F.min("id").alias("n"))
    terms = classes.select("n", F.explode("w").alias("m"))
    rarity = terms.groupBy("m").agg(F.count("*").alias("d"))
    sets = terms.join(rarity, "m").groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("s"))
    size = F.size("s")
    shown = sets.select("n", F.explode(F.slice("s", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)).alias("m"))
    candidates = shown.select(F.col("n").alias("a"), "m").join(shown.select(F.col("n").alias("b"), "m"), "m").where("a < b").select("a", "b").distinct()
    both = candidates.join(sets.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("score")).where(F.col("score") >= threshold)


def closure(edges: DataFrame, rules: list[tuple[str, str, str]], fixpoint: bool = False, max_rounds: int = 100) -> DataFrame:
    """``efrom, edge_type, eto`` of new edges: a rule (p, q, r) makes x-r->z of x-p->y and y-q->z, x not z, unless it is
    there. One composition; with ``fixpoint`` until nothing is new; more than ``max_rounds`` rounds of it are an error."""
    spark = edges.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "p string, q string, edge_type string"))
    have = edges.select("efrom", "edge_type", "eto").distinct()
    made = None
    for _ in range(max_rounds if fixpoint else 1):
        first = have.select(F.col("efrom").alias("x"), F.col("edge_type").alias("p"), F.col("eto").alias("y")).join(table, "p")
        second = have.select(F.col("efrom").alias("y"), F.col("edge_type").alias("q"), F.col("eto").alias("z"))
        new = first.join(second, ["y", "q"]).where("x <> z").select(F.col("x").alias("efrom"), "edge_type", F.col("z").alias("eto")).distinct()
        new = new.join(have, ["efrom", "edge_type", "eto"], "left_anti")
        if not fixpoint:
            return new
        new = cut_lineage(new)
        if new.isEmpty():
            break
        if _ + 1 == max_rounds:
            raise RuntimeError(f"the closure still grows after {max_rounds} rounds")
        made = new if made is None else made.unionByName(new)
        have = cut_lineage(have.unionByName(new))
    return made if made is not None else have.limit(0)


def merge_groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``group, id``: nodes that pairs (a, b) tie together, groups of two and more; unknown ids are left out."""
    known = pairs.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").where("a <> b")
    return connected_components(known, "a", "b").select(F.col("component").alias("group"), F.col("node").alias("id"))


def merge_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after folding duplicates (``id`` -> ``canonical``): labels and aliases join the canonical node's
    aliases (without its own label), edges move, loops and repeats vanish."""
    to = mapping.select("id", "canonical").where("id <> canonical").dropDuplicates(["id"])
    joined = nodes.join(to, "id", "left").withColumn("target", F.coalesce("canonical", "id"))
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    gathered = joined.groupBy("target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias("names"))
    kept = joined.where(F.col("canonical").isNull()).drop("canonical", "target", "aliases").join(gathered.withColumnRenamed("target", "id"), "id")
    own = F.lower(F.trim("label"))
    merged = kept.withColumn("aliases", F.filter("names", lambda x: x.isNotNull() & (F.lower(F.trim(x)) != own))).drop("names")
    moved = edges
    for end in ("efrom", "eto"):
        moved = moved.join(to.select(F.col("id").alias(end), F.col("canonical").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return merged, moved.where("efrom <> eto").dropDuplicates(["efrom", "edge_type", "eto"])


def spine_survivors(nodes: DataFrame, edges: DataFrame, spine: list[tuple[str, str, str]]) -> DataFrame:
    """``id``: nodes on a complete chain of the spine's steps (node type, relation, node type); backward semi-joins find who
    can finish, forward ones who was begun."""
    typed = edges.select("efrom", "edge_type", "eto")
    kinds = [spine[0][0], *[s[2] for s in spine]]
    of = lambda k: nodes.where(F.col("node_type") == kinds[k]).select("id")
    can = {len(spine): of(len(spine))}
    for k in range(len(spine) - 1, -1, -1):
        step = typed.where(F.col("edge_type") == spine[k][1]).join(can[k + 1].withColumnRenamed("id", "eto"), "eto", "left_semi")
        # Each level is used twice below: written once, or the plan would double with every step.
        can[k] = cut_lineage(of(k).join(step.select(F.col("efrom").alias("id")), "id", "left_semi"))
    kept, now = [can[0]], can[0]
    for k in range(len(spine)):
        step = typed.where(F.col("edge_type") == spine[k][1]).join(now.withColumnRenamed("id", "efrom"), "efrom", "left_semi")
        now = cut_lineage(can[k + 1].join(step.select(F.col("eto").alias("id")), "id", "left_semi"))
        kept.append(now)
    return reduce(lambda a, b: a.unionByName(b), kept).distinct()


def incomplete_nodes(nodes: DataFrame, edges: DataFrame, spines: list[list[tuple[str, str, str]]]) -> DataFrame:
    """``id``: nodes of a spine's types that lie on no complete chain of any spine. No spines: none."""
    if not spines:
        return nodes.select("id").limit(0)
    kinds = {k for s in spines for step in s for k in (step[0], step[2])}
    alive = reduce(lambda a, b: a.unionByName(b), [spine_survivors(nodes, edges, s) for s in spines]).distinct()
    return nodes.where(F.col("node_type").isin(*sorted(kinds))).select("id").join(alive, "id", "left_anti")


def ungrounded(nodes: DataFrame, edges: DataFrame, required: list[str], edge_type: str = "MENTIONS") -> DataFrame:
    """``id``: nodes of the required types without an edge to an existing node that grounds them."""
    real = edges.where(F.col("edge_type") == edge_type).join(nodes.select(F.col("id").alias("eto")), "eto", "left_semi").select(F.col("efrom").alias("id"))
    return nodes.where(F.col("node_type").isin(*required)).select("id").join(real, "id", "left_anti")


def stale(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """``id``: nodes whose stored file signature differs from the current one of their source (``doc_path, file_sig``)."""
    now = current.select(F.col("doc_path").alias("source_path"), F.col("file_sig").alias("now"))
    own = nodes.where(F.col("prov.file_sig").isNotNull()).select("id", F.col("prov.source_path").alias("source_path"), F.col("prov.file_sig").alias("sig"))
    return own.join(now, "source_path").where(F.col("now").isNotNull() & ((F.col("sig.mtime_secs") != F.col("now.mtime_secs")) | (F.col("sig.size") != F.col("now.size")))).select("id").distinct()


def related(nodes: DataFrame, edges: DataFrame, meta: DataFrame, node: str, siblings: int = 8) -> DataFrame:
    """``id, how, place``: similar nodes (out, then in), then the best of the node's community by PageRank; each once."""
    out = edges.where((F.col("edge_type") == "SIMILAR") & (F.col("efrom") == node)).select(F.col("eto").alias("id"), F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    back = edges.where((F.col("edge_type") == "SIMILAR") & (F.col("eto") == node)).select(F.col("efrom").alias("id"), F.lit(1).alias("tier"), F.lit(0.0).alias("score"))
    own = meta.where(F.col("id") == node).select("community")
    near = meta.where(F.col("id") != node).join(F.broadcast(own), "community").orderBy(F.desc("pagerank"), "id").limit(siblings).select("id", F.lit(2).alias("tier"), (-F.col("pagerank")).alias("score"))
    first = out.unionByName(back).unionByName(near).groupBy("id").agg(F.min(F.struct("tier", "score")).alias("b"))
    known = first.join(nodes.select("id"), "id", "left_semi").where(F.col("id") != node)
    order = Window.orderBy("b.tier", "b.score", "id")
    return known.select("id", F.element_at(F.array(F.lit("similar"), F.lit("similar"), F.lit("community")), F.col("b.tier") + 1).alias("how"), F.row_number().over(order).alias("place"))


def community_top(meta: DataFrame, k: int = 8) -> DataFrame:
    """``community, id, pagerank, place``: the best k of each community by PageRank, then id."""
    order = Window.partitionBy("community").orderBy(F.desc("pagerank"), "id")
    return meta.where(F.col("community").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("community", "id", "pagerank", "place")


def delete_where(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the doomed ids and every edge that touches one."""
    gone = doomed.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "efrom"), "efrom", "left_anti").join(gone.withColumnRenamed("id", "eto"), "eto", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept


def upsert(nodes: DataFrame, proposed: DataFrame, required: tuple[str, ...] = ("id", "node_type", "label")) -> DataFrame:
    """Nodes after an upsert: the first proposal of a label and type wins within a batch; an existing node of that label and
    type keeps its id; proposals without a required field are rejected; empty aliases keep the old ones."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    good = reduce(lambda a, b: a & b, [F.col(x).isNotNull() & (F.trim(F.col(x)) != "") for x in required])
    new = proposed.where(good).withColumn("_l", norm(F.col("label"))).groupBy("node_type", "_l").agg(F.min_by(F.struct("id", "label", "aliases"), "id").alias("p"))
    old = nodes.withColumn("_l", norm(F.col("label"))).groupBy("node_type", "_l").agg(F.min_by(F.struct("id", "aliases"), "id").alias("o"))
    joined = new.join(old, ["node_type", "_l"], "left")
    empty = F.coalesce(F.size("p.aliases"), F.lit(0)) <= 0
    written = joined.select(F.coalesce("o.id", "p.id").alias("id"), "node_type", F.col("p.label").alias("label"), F.when(empty, F.col("o.aliases")).otherwise(F.col("p.aliases")).alias("aliases"))
    rest = nodes.select("id", "node_type", "label", "aliases").join(written.select("id"), "id", "left_anti")
    return rest.unionByName(written)


def generalize(nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]], link_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The derived layer: new closure edges and SIMILAR links, and ``id, community, degree, pagerank`` of every node.

    Computed from edges that no earlier pass derived (``origin`` null or other than ``auto-generalized``), so a second pass
    over its own result gives the same.
    """
    base = edges.where(F.coalesce(F.col("origin"), F.lit("")) != "auto-generalized").select("efrom", "edge_type", "eto") if "origin" in edges.columns else edges.select("efrom", "edge_type", "eto")
    base = cut_lineage(base)
    reasoning = base.where(~F.col("edge_type").isin(*GROUNDING))
    inferred = closure(reasoning, rules) if rules else reasoning.limit(0)
    similar = jaccard_links(reasoning, link_threshold).select(F.col("a").alias("efrom"), F.lit("SIMILAR").alias("edge_type"), F.col("b").alias("eto"))
    derived = cut_lineage(inferred.unionByName(similar)).withColumn("origin", F.lit("auto-generalized"))
    whole = reasoning.unionByName(derived.where("edge_type <> 'SIMILAR'").select("efrom", "edge_type", "eto"))
    meta = communities(nodes, whole).join(degree(nodes, whole), "id").join(pagerank(nodes, whole).withColumnRenamed("rank", "pagerank"), "id")
    return derived, meta
