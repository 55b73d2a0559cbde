from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loam.operators.incremental import Ledger
from loam.streaming import windows as W

T0 = datetime(2026, 1, 1)


def write(spark, path, offsets, key=1):
    spark.createDataFrame([(i, key, T0 + timedelta(seconds=s), 0.02 * i) for i, s in enumerate(offsets)], "event_id BIGINT, user_id BIGINT, ts TIMESTAMP, value DOUBLE").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("event_id BIGINT, user_id BIGINT, ts TIMESTAMP, value DOUBLE").parquet(path)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [0, 1, 2, 100, 101, 4000, 9000])
    for name, make in (
        ("tumble", lambda e: W.tumbling(e, "ts", "1 minute", ["user_id"])),
        ("slide", lambda e: W.sliding(e, "ts", "2 minutes", "1 minute", "value")),
        ("lat", lambda e: W.latency(e, "value")),
    ):
        drain(make(stream(spark, path)), name, "complete")
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == {tuple(r) for r in make(spark.read.parquet(path)).collect()} and got


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [0, 60, 120, 4000])
    write(spark, path, [40_000])
    drain(W.sessions(stream(spark, path), "ts", "5 minutes", "user_id", "1 minute"), "sess", "append")
    closed = {(r.started, r.ended, r.n) for r in spark.table("sess").collect()}
    whole = {(r.started, r.ended, r.n) for r in W.sessions(spark.read.parquet(path), "ts", "5 minutes", "user_id").collect()}
    assert closed <= whole and len(closed) == 2


def test_deduplicate(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [0, 1])
    write(spark, path, [0, 1])
    drain(W.deduplicate(stream(spark, path), ["event_id"], "ts"), "dedup", "append")
    assert spark.table("dedup").count() == 2 == W.deduplicate(spark.read.parquet(path), ["event_id"], "ts").count()


def test_bursts_and_settled(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), "a") for s in (0, 1, 3, 60)], "ts TIMESTAMP_NTZ, k STRING")
    assert sorted(r.n for r in W.debounce(df, "ts").collect()) == [1, 3]
    assert sorted(r.n for r in W.debounce(df, "ts", keys=["k"]).collect()) == [1, 3]
    assert W.settled(df, "ts", "2026-01-01 00:00:04").count() == 2


def test_links_are_carried_until_resolved(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "src STRING, target STRING")
    none = links.limit(0)
    docs = spark.createDataFrame([("a",), ("b",)], "doc_path STRING")
    done, carried = W.retry_unresolved(links, none, docs)
    assert [tuple(r) for r in done.collect()] == [("a", "b")] and [tuple(r) for r in carried.collect()] == [("a", "c")]
    done, carried = W.retry_unresolved(none, carried, docs.unionByName(spark.createDataFrame([("c",)], "doc_path STRING")))
    assert [tuple(r) for r in done.collect()] == [("a", "c")] and carried.isEmpty()


def test_stream_feeds_the_ledger_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    schema = "doc_path STRING, file_sig STRUCT<mtime_secs: BIGINT, size: BIGINT>, seen_at TIMESTAMP_NTZ"
    listing = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def take(batch, _number):
        ledger.take(spark.read.schema(schema).parquet(source), lambda df: df.select("doc_path", "change"), out)

    for rows in ([("a", (1, 1), T0)], [("b", (1, 1), T0), ("a", (2, 1), T0 + timedelta(days=1))]):
        listing(rows)
        W.upsert_batches(spark.readStream.schema(schema).parquet(source), take, str(tmp_path / "ckpt")).awaitTermination()
    assert {(r.batch_id, r.doc_path, r.change) for r in spark.read.parquet(out).collect()} == {(1, "a", "new"), (2, "b", "new"), (2, "a", "changed")}
    assert spark.read.parquet(out).where(F.col("change") == "new").count() == 2


def test_metric_lines_and_appends(spark):
    df = spark.createDataFrame([("GET", 0.02), ("GET", 3.0)], "m STRING, s DOUBLE")
    got = [r.line for r in W.metric_lines(W.latency(df, "s", "m"), "http_seconds", "m").collect()]
    assert 'http_seconds_bucket{m="GET",le="0.025"} 1' in got and 'http_seconds_bucket{m="GET",le="+Inf"} 2' in got and 'http_seconds_count{m="GET"} 2' in got
    table = spark.createDataFrame([("1", "a")], "k STRING, v STRING")
    new = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b"), ("...", "..."), ("", None)], "k STRING, v STRING")
    assert [tuple(r) for r in W.append_rows(table, new).collect()] == [("2", "b")]
