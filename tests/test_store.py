from loam.operators import store as W

NODES = "id STRING, node_type STRING, label STRING, aliases ARRAY<STRING>, kept STRING"
EDGES = "efrom STRING, edge_type STRING, eto STRING"
OLD = [("a", "Pump", "Main Pump", ["P1"], "x"), ("b", "Valve", "Relief valve", None, "y"), ("c", "Valve", "Relief  Valve", ["rv"], None), ("d", "Seal", None, [], None)]


def graph(spark, edges=()):
    return spark.createDataFrame(OLD, NODES), spark.createDataFrame(list(edges), EDGES)


def test_references(spark):
    nodes, _ = graph(spark)
    refs = spark.createDataFrame([(x, 1) for x in ("a", "main  PUMP", "p1", "relief valve", "RV", "nothing", "", None, "a")], "ref STRING, id INT")
    got = {r.ref: (r.id, r.how) for r in W.resolve_refs(nodes, refs).collect()}
    assert got == {"a": ("a", "id"), "main  PUMP": ("a", "label"), "p1": ("a", "alias"), "relief valve": (None, "several"), "RV": ("c", "alias"), "nothing": (None, "none"), "": (None, "none")}
    assert W.resolve_refs(nodes.limit(0), refs).where("how <> 'none'").isEmpty() and W.resolve_refs(nodes, refs.limit(0)).isEmpty()


def test_upsert_with_edges(spark):
    nodes, edges = graph(spark, [("a", "FEEDS", "b")])
    new = [("n1", "pump", "main pump", ["P2"], 1), ("n2", "Motor", "Drive", None, 1), ("n3", "Motor", " drive ", ["D"], 1), (None, "Motor", "Lost", None, 1), ("n4", "Motor", " ", None, 1), ("n5", None, "No type", None, 1)]
    links = [("n1", "FEEDS", "n3"), ("n2", "FEEDS", "Main Pump"), ("n3", "SAME", "n2"), ("n2", "FEEDS", "relief valve"), ("a", "FEEDS", "b"), ("gone", "FEEDS", "a"), (None, "FEEDS", "a"), ("n1", "FEEDS", "n3")]
    made, kept, lost = W.upsert_graph(nodes, edges, spark.createDataFrame(new, "id STRING, node_type STRING, label STRING, aliases ARRAY<STRING>, kept INT"), spark.createDataFrame(links, EDGES))
    rows = {r.id: (r.node_type, r.label, r.aliases, r.kept) for r in made.collect()}
    assert rows == {"a": ("Pump", "Main Pump", ["P1", "P2"], "x"), "b": ("Valve", "Relief valve", None, "y"), "c": ("Valve", "Relief  Valve", ["rv"], None), "d": ("Seal", None, [], None), "n2": ("Motor", "Drive", ["D"], None)}
    assert sorted(tuple(r) for r in kept.collect()) == [("a", "FEEDS", "b"), ("a", "FEEDS", "n2"), ("n2", "FEEDS", "a")]
    assert {tuple(r) for r in lost.collect()} == {("n3", "SAME", "n2"), ("n2", "FEEDS", "relief valve"), ("gone", "FEEDS", "a"), (None, "FEEDS", "a")}
    again = W.upsert_graph(made, kept, spark.createDataFrame(new, "id STRING, node_type STRING, label STRING, aliases ARRAY<STRING>, kept INT"), spark.createDataFrame(links[:2], EDGES))
    assert {r.id: r.aliases for r in again[0].collect()} == {k: v[2] for k, v in rows.items()} and again[1].count() == 3


def test_update_and_delete(spark):
    nodes, edges = graph(spark, [("a", "FEEDS", "b"), ("b", "FEEDS", "c")])
    changes = spark.createDataFrame([("p1", "Big Pump", None), ("a", None, ["x", "y"]), ("relief valve", "Nope", ["z"]), ("d", "Shaft seal", [])], "ref STRING, label STRING, aliases ARRAY<STRING>")
    got = {r.id: (r.label, r.aliases) for r in W.update_nodes(nodes, changes).collect()}
    assert got == {"a": ("Big Pump", ["x", "y"]), "b": ("Relief valve", None), "c": ("Relief  Valve", ["rv"]), "d": ("Shaft seal", [])}
    left, kept, lost = W.delete_refs(nodes, edges, spark.createDataFrame([("main pump",), ("relief valve",), ("zzz",)], "ref STRING"))
    assert {r.id for r in left.collect()} == {"b", "c", "d"} and [tuple(r) for r in kept.select("efrom", "edge_type", "eto").collect()] == [("b", "FEEDS", "c")]
    assert {tuple(r) for r in lost.collect()} == {("relief valve", "several"), ("zzz", "none")}
