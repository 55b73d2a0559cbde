from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loam.operators.incremental import Ledger, pending_changes, pending_chunks

SIG = "STRUCT<mtime_secs: BIGINT, size: BIGINT>"
LIST = f"doc_path STRING, file_sig {SIG}, seen_at TIMESTAMP_NTZ, extra STRING"
MAN = f"run_id BIGINT, doc_path STRING, file_sig {SIG}, outcome STRING, written_at TIMESTAMP_NTZ"
RUNS = "run_id BIGINT, status STRING"
T = [datetime(2026, 1, d) for d in range(1, 20)]


def changes(spark, listing, manifest, runs):
    got = pending_changes(spark.createDataFrame(listing, LIST), spark.createDataFrame(manifest, MAN), spark.createDataFrame(runs, RUNS))
    return {(r.doc_path, r.change) for r in got.collect()}


def test_changes(spark):
    listing = [
        ("./a.md", (1, 1), T[0], "x"),
        ("b\\c.md", (2, 2), T[0], None),
        ("b/c.md", (3, 2), T[1], None),
        ("b/c.md", (3, 2), T[1], None),
        ("gone.md", (1, 1), T[0], None),
        ("gone.md", None, T[2], None),
        ("failed.md", (1, 1), T[0], None),
        ("back.md", (1, 1), T[0], None),
        ("never.md", None, T[0], None),
        (None, (1, 1), T[0], None),
    ]
    manifest = [
        (1, "a.md", (1, 1), "indexed", T[0]),
        (1, "b/c.md", (2, 2), "indexed", T[0]),
        (1, "gone.md", (1, 1), "indexed", T[0]),
        (2, "failed.md", (1, 1), "indexed", T[0]),
        (3, "failed.md", (1, 1), "error", T[0]),
        (1, "back.md", (1, 1), "indexed", T[0]),
        (3, "back.md", None, "removed", T[1]),
        (1, "unlisted.md", (1, 1), "indexed", T[0]),
    ]
    runs = [(1, "ok"), (2, "failed"), (3, "ok"), (3, "ok")]
    want = {("b/c.md", "changed"), ("gone.md", "removed"), ("failed.md", "new"), ("back.md", "new"), ("unlisted.md", "removed")}
    assert changes(spark, listing, manifest, runs) == want


def test_empty_tables(spark):
    assert changes(spark, [], [], []) == set()
    assert changes(spark, [("a", (1, 1), T[0], None)], [], []) == {("a", "new")}
    assert changes(spark, [], [(1, "a", (1, 1), "indexed", T[0])], [(1, "ok")]) == {("a", "removed")}


def test_pending_chunks_once_each(spark):
    todo = spark.createDataFrame([("a.md", "new"), ("b.md", "removed")], "doc_path STRING, change STRING")
    rows = [(1, "a.md", "old", T[0]), (1, "a.md", "new", T[1]), (2, "b.md", "x", T[0]), (3, "c.md", "y", None)]
    chunks = spark.createDataFrame(rows, "chunk_id BIGINT, doc_path STRING, text STRING, indexed_at TIMESTAMP_NTZ")
    assert [(r.chunk_id, r.text, r.change) for r in pending_chunks(chunks, todo).collect()] == [(1, "new", "new")]


def test_ledger_survives_a_crash_and_repeats_nothing(spark, tmp_path):
    root, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    first = spark.createDataFrame([("a", (1, 1), T[0], None), ("b", (1, 1), T[0], None)], LIST)
    ledger = Ledger(spark, root)

    def crash(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.take(first, crash, out)
    keep = lambda df: df.select("doc_path", "change")
    assert ledger.take(first, keep, out) == 1
    assert ledger.take(first, keep, out) is None
    second = spark.createDataFrame([("a", (2, 1), T[1], None)], LIST)
    assert ledger.take(second, keep, out) == 2
    got = spark.read.parquet(out).orderBy("batch_id", "doc_path").select("batch_id", "doc_path", "change").collect()
    assert [tuple(r) for r in got] == [(1, "a", "new"), (1, "b", "new"), (2, "a", "changed"), (2, "b", "removed")]
    assert spark.read.parquet(out).groupBy("batch_id", "doc_path").count().where(F.col("count") > 1).isEmpty()


def test_ledger_compacts_its_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Ledger, "COMPACT", 3)
    root, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    ledger, keep = Ledger(spark, root), lambda df: df.select("doc_path", "change")
    for k in range(1, 8):
        now = [("a", (k, 1), T[k], None), ("b", (1, 1), T[0], None)] + ([("c", (1, 1), T[0], None)] if k < 5 else [])
        listing = spark.createDataFrame(now, LIST)
        assert Ledger(spark, root).take(listing, keep, out) == k
        assert ledger.take(listing, keep, out) is None
    assert ledger._state() == 6 and ledger._done() == [6, 7] and len(ledger.manifest().inputFiles()) < 12
    got = {(r.batch_id, r.doc_path, r.change) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a", "new"), (1, "b", "new"), (1, "c", "new"), (5, "c", "removed"), *((k, "a", "changed") for k in range(2, 8))}


def test_checksums_tell_files_of_one_second_and_size_apart(spark, tmp_path):
    from loam.operators.incremental import with_checksums

    folder, out = tmp_path / "corpus", str(tmp_path / "out")
    (folder / "sub").mkdir(parents=True)
    ledger, keep = Ledger(spark, str(tmp_path / "ledger")), lambda df: df.select("doc_path", "change")
    listing = spark.createDataFrame([("sub/a.md", (1, 3), T[0], None), ("./b.md", (1, 3), T[0], None)], LIST)
    for text, want in (("one", 1), ("one", None), ("two", 2)):
        (folder / "sub" / "a.md").write_text(text)
        (folder / "b.md").write_text("same")
        assert ledger.take(with_checksums(listing, str(folder)), keep, out) == want
    assert [tuple(r) for r in spark.read.parquet(f"{out}/batch_id=2").collect()] == [("sub/a.md", "changed")]
    assert ledger.take(listing, keep, out) is None  # a listing without checksums goes by time and size
