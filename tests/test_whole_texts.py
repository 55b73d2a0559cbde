from __spark_entry__ import queries
from loam.sources.chunkers import delimited


def test_pages_of_whole_texts(spark, tmp_path):
    rows = [(1, "A & B", "web", "one <b> &amp; two\n\n\n\nsee [x](deep/y.md#z) and [w](https://x.org)\n  end"), (2, None, "web", None), (3, "T", None, 'a <a href="k.html">k</a>')]
    spark.createDataFrame(rows, "doc_id BIGINT, title STRING, source STRING, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {r.doc_id: r.plain for r in queries()["html_text"](spark, str(tmp_path)).collect()}
    assert plain == {1: "A & B\none <b> &amp; two\n\nsee [x](deep/y.md#z) and [w](https://x.org)\nend", 2: "", 3: 'T\na <a href="k.html">k</a>'}
    found = sorted((r.doc_id, r.target) for r in queries()["link_targets"](spark, str(tmp_path)).collect())
    assert found == [(1, "../b/web.html"), (1, "deep/y.md"), (1, "docs/1.md"), (2, "../b/web.html"), (2, "docs/2.md"), (3, "k.html")]


def test_table_chunks_by_position(spark, tmp_path):
    rows = [(7 * k + k % 3, k % 5, "F", 1.5 * k, "1995-01-01") for k in range(25_321)]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    df = spark.createDataFrame(rows[::-1], "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate STRING")
    df.repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    want = delimited("".join(f"{x}\n" for x in (",".join(names), *(",".join(map(str, r)) for r in rows))))
    got = {r.location: r.chunk for r in queries()["csv_windows"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and len(got) == 254
