import pytest

from __spark_entry__ import queries

TABLES = {
    "region": ("r_regionkey INT, r_name STRING", [(0, "ASIA"), (1, "EUROPE")]),
    "nation": ("n_nationkey INT, n_name STRING, n_regionkey INT", [(0, "NATION_0", 0), (1, "NATION_1", 1)]),
    "customer": ("c_custkey INT, c_name STRING, c_nationkey INT", [(1, "c1", 0), (2, "c2", 0)]),
    "supplier": ("s_suppkey INT, s_name STRING, s_nationkey INT", [(1, "s1", 1)]),
    "part": ("p_partkey INT, p_name STRING", [(1, "p1"), (2, "p2"), (3, "p3")]),
    "orders": ("o_orderkey INT, o_custkey INT, o_orderstatus STRING", [(1, 1, "F"), (2, 2, "O"), (3, 2, "O")]),
    "lineitem": ("l_orderkey INT, l_partkey INT, l_suppkey INT", [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1)]),
}
IDS = {"reg:0", "reg:1", "nat:0", "nat:1", "cust:1", "cust:2", "sup:1", "part:1", "part:2", "part:3", "ord:1", "ord:2", "ord:3"}
EDGES = {
    ("nat:0", "reg:0"), ("nat:1", "reg:1"), ("cust:1", "nat:0"), ("cust:2", "nat:0"), ("sup:1", "nat:1"), ("ord:1", "cust:1"), ("ord:2", "cust:2"), ("ord:3", "cust:2"),
    ("ord:1", "part:1"), ("ord:2", "part:2"), ("ord:3", "part:2"), ("part:1", "sup:1"), ("part:2", "sup:1"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def ranks(links, start, first, damping):
    out, rank = {}, dict(first)
    for a, _ in links:
        out[a] = out.get(a, 0) + 1
    for _ in range(30):
        lost = sum(rank[x] for x in IDS if x not in out)
        new = {x: (1 - damping + damping * lost) * start[x] for x in IDS}
        for a, b in links:
            new[b] += damping * rank[a] / out[a]
        rank = new
    return rank


def test_ranks_and_communities(spark, folder):
    from loam.operators.graph import ALPHA, DAMPING

    q = queries()
    even = {x: 1 / len(IDS) for x in IDS}
    want = ranks(sorted(EDGES), even, even, DAMPING)
    got = {r.id: r.pr for r in q["pagerank"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-7)
    seed = {x: float(x == "nat:1") for x in IDS}
    both = sorted(EDGES) + [(b, a) for a, b in sorted(EDGES)]
    assert {r.id: r.pr for r in q["ppr"](spark, folder).collect()} == pytest.approx(ranks(both, seed, seed, 1 - ALPHA), abs=1e-7)
    least = {x: "cust:1" for x in IDS} | {"part:3": "part:3"}
    assert {r.id: r.community for r in q["communities"](spark, folder).collect()} == least
    assert {r.community: r.n for r in q["community_sizes"](spark, folder).collect()} == {"cust:1": 12, "part:3": 1}
    best = sorted(IDS - {"part:3"}, key=lambda x: (-round(want[x], 8), x))
    top = {(r.community, r.place): r.id for r in q["community_top"](spark, folder).collect()}
    assert top == {("cust:1", k + 1): best[k] for k in range(3)} | {("part:3", 1): "part:3"}
    assert [r.id for r in q["related"](spark, folder).orderBy("place").collect()] == [x for x in best if x != "nat:1"][:8]


def test_sql(spark, folder):
    q = queries()
    rows = lambda name: {tuple(r) for r in q[name](spark, folder).collect()}
    assert {r[0] for r in rows("sql_window")} == IDS
    assert {r[0] for r in rows("sql_top")} == IDS
    assert rows("sql_grouped") == set()
    assert rows("sql_fuzzy") == {("sup:1", "nat:1")}
    assert rows("sql_self_join") == {("cust:1", "reg:0"), ("cust:2", "reg:0"), ("sup:1", "reg:1")}
    assert rows("sql_sets") == {("nat:0",)}
    assert rows("sql_nested") == set()
