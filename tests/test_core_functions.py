import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.stemming import stem_english, stem_russian, stemmed_words
from loam.functions.temporal import as_of, normalize_instant, status
from loam.operators import constraints as C
from loam.operators import evals as E
from loam.operators import grep as R
from loam.operators import search as S
from loam.operators import sqlsurface as Q


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_expressions(spark):
    assert one(spark, T.words(F.lit("Größe-12 des Ärø, Насос!"))) == ["größe", "12", "des", "ärø", "насос"]
    assert one(spark, T.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, T.lines(F.lit(None).cast("string"))) == []
    assert one(spark, T.trigrams(F.lit("Abcab"))) == ["abc", "bca", "cab"] and one(spark, T.trigrams(F.lit("ab"))) == []
    assert one(spark, T.fnv1a32(F.lit("foobar"))) == "bf9cf968" and one(spark, T.fnv1a32(F.lit(""))) == "811c9dc5"
    assert one(spark, T.canonical_scalar(F.lit(" 41 — 43 "))) == "41-43" and one(spark, T.canonical_scalar(F.lit("3,50"))) == "3.5"
    assert one(spark, T.normalize_answer(F.lit("The Big-Apple!"))) == "big apple"
    assert one(spark, T.links(F.lit("[a](b.md#x) ![i](c.png) <a href='d.html'> [w](https://e) [t](#top)"))) == ["b.md", "d.html"]
    assert one(spark, T.number_span(F.lit("25–49"))) == (25.0, 49.0) and one(spark, T.number_span(F.lit("x"))) is None


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.md", ["a.md", "x/y.md"], ["a.txt"]), ("**", ["any/thing"], []), ("{a,b}/*.t?t", ["a/x.txt", "b/y/z.tst"], ["c/x.txt"]), ("x\\[1]", [], ["x"]), ("**/q.md", ["q.md", "a/b/q.md"], ["q.mdx"]), ("a[!b]c", ["axc"], ["abc"])])
def test_globs(glob, yes, no):
    rx = re.compile(T.glob_regex(glob))
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


def test_stems(spark):
    want = {"running": "run", "ponies": "poni", "relational": "relat", "happily": "happili", "knees": "knee", "generously": "generous", "hopping": "hop", "hoping": "hope", "sky": "sky", "consistency": "consist", "controlling": "control"}
    assert {w: stem_english(w) for w in want} == want
    russian = {"насосы": "насос", "проверка": "проверк", "важнейшие": "важн", "бежавший": "бежа", "книгами": "книг", "ёлка": "елк"}
    assert {w: stem_russian(w) for w in russian} == russian
    df = spark.createDataFrame([("Pumps, running",), ("Насосы работали",), (None,), ("",)], "t STRING")
    assert [r.s for r in df.select(stemmed_words("t").alias("s")).collect()] == [["pump", "run"], ["насос", "работа"], [], []]


def test_dates(spark):
    rows = {"2024": ("2024-01-01T00:00:00Z", "2024-12-31T23:59:59Z"), "2024-02": ("2024-02-01T00:00:00Z", "2024-02-29T23:59:59Z"), "2023-02-03": ("2023-02-03T00:00:00Z", "2023-02-03T23:59:59Z"), "2019-03-15T08:00:00Z": ("2019-03-15T08:00:00Z",) * 2, "2024-13": (None, None), "20xx": (None, None), "2024-02-30": (None, None), "": (None, None)}
    df = spark.createDataFrame([(k,) for k in rows], "t STRING")
    got = {r.t: (r.a, r.b) for r in df.select("t", normalize_instant(F.col("t")).alias("a"), normalize_instant(F.col("t"), end=True).alias("b")).collect()}
    assert got == rows
    assert one(spark, status(F.lit("2020"), F.lit("2021"), F.lit(False), "2022")) == "expired"


def test_as_of(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id STRING")
    validity = spark.createDataFrame([("a", "2020", "2023"), ("b", "2025", None)], "node_id STRING, valid_from STRING, valid_to STRING")
    assert {r.id for r in as_of(nodes, validity, "2023").collect()} == {"a", "c"}


def test_grep_equals_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join("".join(rng.choice("abXY ") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9)))) for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    for pattern in ("ab", "X", "a b", "ab|xyz", "(ab)+x", "^a", "bbb|aaaa"):
        rx = re.compile(R.prepare(pattern))
        want, near = set(), set()
        for i, t in rows:
            lines = (t or "").split("\n")
            lines = lines[:-1] if lines[-1] == "" else lines
            hit = [bool(rx.search(x)) for x in lines]
            for k, x in enumerate(lines):
                if hit[k] and t:
                    want.add((i, k + 1, x.strip(" ")))
                if t and any(hit[max(0, k - 2) : k + 2]):
                    near.add((i, k + 1))
        assert {(r.id, r.line_no, r.line) for r in R.grep(df, ["id"], "text", pattern).collect()} == want, pattern
        assert {(r.id, r.line_no) for r in R.grep(df, ["id"], "text", pattern, before=1, after=2).collect()} == near, pattern
        assert {(r.id, r.n) for r in R.grep_count(df, ["id"], "text", pattern).collect()} == set(Counter(i for i, _, _ in want).items())


def test_trigram_plan_is_sound():
    assert R.trigram_plan("ab|cdef") is None
    assert R.trigram_plan("abc.*def") == ("and", ["abc", "def"])
    assert R.trigram_plan("(abcd|efgh)x?") == ("and", [("and", [("or", [("and", ["abcd"]), ("and", ["efgh"])])])])
    assert R.trigram_plan("a?bcd*") is None or R.trigram_plan("a?bcd*") == ("and", [])
    with pytest.raises(ValueError):
        R.prepare("(?=x)")


def test_multiline(spark):
    df = spark.createDataFrame([(1, "a\nstart\nmid\nend\nstart end"), (2, None)], "id BIGINT, text STRING")
    got = [(r.line_no, r.found) for r in R.grep_multiline(df, ["id"], "text", "start.*?end").orderBy("line_no").collect()]
    assert got == [(2, "start\nmid\nend"), (5, "start end")]


def test_search_with_stems_and_postings(spark):
    df = spark.createDataFrame([(1, "the pumps were running"), (2, "a valve"), (3, "pump pump pump"), (4, None)], "id BIGINT, text STRING")
    assert [r.id for r in S.bm25_search(df, "id", "text", "pump running", 5, analyzer=stemmed_words).collect()] == [1, 3]
    plain = {r.id: round(r.score, 6) for r in S.bm25_search(df, "id", "text", "pump valve", 5, analyzer=T.words).collect()}
    index = S.postings(df, "id", "text")
    stats = df.agg(F.count("*"), F.avg(F.size(T.words("text")))).first()
    assert {r.id: round(r.score, 6) for r in S.search_postings(index, "id", ["pump", "valve"], stats[0], stats[1], 5).collect()} == plain
    assert S.bm25_search(df.limit(0), "id", "text", "pump", 5).count() == 0


def test_default_search_is_stemmed(spark):
    rows = [(1, "the pumps were running"), (2, "a valve"), (3, "pump pump pump"), (4, None), (5, "насосы pump"), (6, "без pumps насоса"), (7, "Ёлки у насоса")]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    for query in ("pump running", "насос", "елка", "pumps pump", "..", "valves насосами"):
        slow = {r.id: round(r.score, 9) for r in S.bm25_search(df, "id", "text", query, 9, analyzer=stemmed_words).collect()}
        assert {r.id: round(r.score, 9) for r in S.bm25_search(df, "id", "text", query, 9).collect()} == slow, query


def test_label_similarity_of_equal_labels(spark):
    from collections import defaultdict

    rng = random.Random(4)
    labels = [" ".join(rng.choice("pump valve seal motor filter".split()) for _ in range(rng.randrange(1, 4))) for _ in range(40)] + ["pump seal"] * 20
    ids = [f"n{k:03}" for k in range(len(labels))]
    df = spark.createDataFrame(list(zip(ids, labels)), "id STRING, label STRING")
    bags = [Counter(x.split()) for x in labels]
    n, average = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    d = Counter(w for b in bags for w in b)
    import math

    weight = lambda w, b: math.log(1 + (n - d[w] + 0.5) / (d[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average))
    want = defaultdict(float)
    for q, bag in enumerate(bags):
        score = [sum(weight(w, other) for w in bag if w in other) for other in bags]
        best = sorted((k for k in range(n) if score[k] > 0), key=lambda k: (-round(score[k], 9), ids[k]))[:6]
        if q in best:
            for k in best:
                if k != q and score[k] / score[q] >= 0.3:
                    pair = tuple(sorted((ids[q], ids[k])))
                    want[pair] = max(want[pair], score[k] / score[q])
    got = {(r.a, r.b): r.ratio for r in S.label_similarity(df, "id", "label").collect()}
    assert got == pytest.approx(dict(want))


def test_places_of_matches_over_lines(spark):
    rows = [(1, "concat\ncat"), (2, "\n\nx\nab\nab"), (3, "aaa\nb")]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    found = lambda pattern: sorted((r.id, r.line_no, r.found) for r in R.grep_multiline(df, ["id"], "text", pattern).collect())
    assert found(r"\bcat\b") == [(1, 2, "cat")]
    assert found("ab") == [(2, 4, "ab"), (2, 5, "ab")]
    assert found(r"a\nb") == [(3, 1, "a\nb")]


def test_csp():
    header, rows = C.parse_csp('a\tb\n"x ""q"" y"\t1\n\nz\n2\t3\t\t\n')
    assert (header, rows) == (["a", "b"], [['x "q" y', "1"], ["z", ""], ["2", "3"]])
    with pytest.raises(ValueError):
        C.parse_csp("a\n1\t2")


def test_inconsistent(spark):
    rows = [(1, "f", "range", 5.0, 1.0, None, None, None, None), (2, "g", "enum", None, None, None, [], None, None), (3, "h", "required", None, None, None, None, None, None), (4, "h", "forbidden", None, None, None, None, None, None)]
    assert {(r.field, r.reason) for r in C.inconsistent(spark.createDataFrame(rows, C.CONSTRAINT)).collect()} == {("f", "empty range"), ("g", "empty list"), ("h", "required and forbidden")}


def test_evals(spark):
    assert round(one(spark, E.token_f1(F.lit("quick brown"), F.lit("the quick brown fox"))), 6) == 0.8
    edges = spark.createDataFrame([("t", "a", "x"), ("t", "a", "y"), ("t", "b", "x"), ("u", "c", "z")], "tab STRING, l STRING, r STRING")
    assert {(r.tab, r.l, r.r) for r in E.match_columns(edges, "tab", "l", "r").collect()} == {("t", "a", "y"), ("t", "b", "x"), ("u", "c", "z")}
    calls = spark.createDataFrame([("e", 1, "call", "k", "q"), ("e", 3, "result", "k", "r"), ("e", 0, "result", "k", "early"), ("e", 4, "call", "m", "q2")], "episode_id STRING, seq INT, kind STRING, call_id STRING, body STRING")
    assert {(r.call_id, r.result) for r in E.pair_tool_calls(calls).collect()} == {("k", "r"), ("m", None)}


@pytest.fixture(scope="module")
def relations(spark):
    nodes = spark.createDataFrame([("a", "Person", "Ann Lee"), ("b", "Place", "Oslo")], "id STRING, node_type STRING, label STRING")
    edges = spark.createDataFrame([("a", "LIVES_IN", "b")], "efrom STRING, edge_type STRING, eto STRING")
    from loam.operators.graph import edges_labeled

    return {"nodes": nodes, "edges": edges, "edges_labeled": edges_labeled(nodes, edges)}


@pytest.mark.parametrize("sql", ["DROP TABLE nodes", "SELECT * FROM secrets", "SELECT * FROM nodes; SELECT 1", "WITH nodes AS (SELECT * FROM secrets) SELECT * FROM nodes", "SELECT (SELECT max(x) FROM secrets) FROM nodes", "INSERT INTO nodes SELECT * FROM nodes", "SELECT * FROM nodes WHERE id IN (SELECT id FROM other)", "SELECT * FROM nodes UNION SELECT * FROM other", "CACHE TABLE nodes", "SELECT * FROM range(5)", "nonsense"])
def test_gate_rejects(spark, sql):
    with pytest.raises(Q.Rejected):
        Q.check(spark, sql)


def test_fuzzy_sql(spark, relations):
    got = Q.run(spark, "SELECT efrom FROM edges_labeled WHERE edge_type = 'living in' AND src_label = 'lee'", relations).collect()
    assert [r.efrom for r in got] == ["a"]
    assert Q.literals("SELECT 1 FROM nodes WHERE NOT (label = 'x') AND id IN (SELECT id FROM nodes WHERE label = 'y')") == []
    assert [v for *_, v in Q.literals("SELECT 1 FROM nodes n JOIN edges e ON e.edge_type = 'it''s' WHERE n.label = 'b' GROUP BY 1 HAVING label = 'c'")] == ["it's", "b"]


def test_null_and_empty_inputs(spark):
    df = spark.createDataFrame([(None, None)], "id BIGINT, text STRING")
    assert R.grep(df, ["id"], "text", "x").count() == 0
    assert S.document_frequency(df, "text").count() == 0
    assert S.label_similarity(df.limit(0), "id", "text").count() == 0
    assert datetime(2024, 1, 1)


def test_snippets_names_and_walks(spark):
    df = spark.createDataFrame([(1, "x " * 100 + "the seal\npressure is low " + "y " * 100), (2, None), (3, "nothing here")], "id BIGINT, text STRING")
    got = {r.id: r.s for r in df.select("id", S.snippet(F.col("text"), ["Seal"], 40).alias("s")).collect()}
    assert "the seal pressure is low" in got[1] and len(got[1]) <= 40 and got[2] == "" and got[3] == "nothing here"
    names = spark.createDataFrame([("support",), ("transport",), (None,), ("legal",)], "n STRING")
    assert [r.n for r in S.nearest_names(names, "n", "Suport").collect()] == ["support"]
    nodes = spark.createDataFrame([("a", "T", "seal leak", None), ("b", "T", "gasket", []), ("c", "T", "other", []), ("d", "Section", "seal page", [])], "id STRING, node_type STRING, label STRING, aliases ARRAY<STRING>")
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "M", "d")], "efrom STRING, edge_type STRING, eto STRING")
    assert [r.id for r in S.compose_ranked(nodes, edges, "leak", ["seal leak"]).collect()] == ["b"]
