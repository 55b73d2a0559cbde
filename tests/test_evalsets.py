from loam.operators.evalsets import coverage, mutated_cases, sample_rows, trap_scores, value_recall


def test_all(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id BIGINT, a STRING")
    once, twice = ([r.id for r in sample_rows(df, 5).collect()] for _ in range(2))
    assert once == twice and len(set(once)) == 5 and sample_rows(df, 50).count() == 20
    cases = {(r.row_id, r.variant, r.field): (r.value, r.valid) for r in mutated_cases(spark.createDataFrame([(1, "x", None)], "id BIGINT, a STRING, b STRING"), "id", ["a", "b"]).collect()}
    assert cases == {(1, 0, "a"): ("x", True), (1, 0, "b"): (None, True), (1, 1, "a"): ("x~", False), (1, 1, "b"): (None, False), (1, 2, "a"): ("x", False), (1, 2, "b"): ("~", False)}
    gold = spark.createDataFrame([("k", "5"), ("k", "x"), ("m", "1")], "key STRING, value STRING")
    found = spark.createDataFrame([("k", "1-9"), ("k", "y")], "key STRING, value STRING")
    assert {r.key: r.recall for r in value_recall(gold, found, "key").collect()} == {"k": 0.5, "m": 0.0}
    probes = spark.createDataFrame([("t", True), ("t", False), ("u", True)], "trap_type STRING, correct BOOLEAN")
    assert {r.trap_type: (r.n, r.hits, r.rate) for r in trap_scores(probes).collect()} == {"t": (2, 1, 0.5), "u": (1, 1, 1.0)}
    reference = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "c")], "field STRING, value STRING")
    made = spark.createDataFrame([(1, "a"), (2, "z")], "list_id INT, value STRING")
    assert {r.field: (r.covered, r.share) for r in coverage(reference, made).collect()} == {"f": (True, 0.5), "g": (False, 0.0)}
