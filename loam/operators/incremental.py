"""Incremental runs: which files to take in next, and a manifest committed after an idempotent write.

The manifest holds, per run, the signature of every file the run took in. Only entries of committed runs count, so a
run that failed half-way leaves nothing behind that a later run would trust, and a file it did finish comes again.
Every step is a partial aggregation keyed by path (``max_by``), then one join on the path: no window, no sort of a
file's whole history, and nothing that a path with very many observations could overload.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DONE = ("indexed", "removed")


def _sum(df: DataFrame) -> Column:
    """The checksum of a signature where it has one."""
    kind = df.schema["file_sig"].dataType
    return F.col("file_sig.checksum") if isinstance(kind, StructType) and "checksum" in kind.names else F.lit(None).cast("string")


def same_signature(seen: Column, taken: Column) -> Column:
    """Equal times and sizes, nulls included, and equal checksums where both sides have one."""
    sums = F.coalesce(seen["checksum"] == taken["checksum"], F.lit(True))
    return seen["mtime_secs"].eqNullSafe(taken["mtime_secs"]) & seen["size"].eqNullSafe(taken["size"]) & sums


def with_checksums(listing: DataFrame, root: str) -> DataFrame:
    """A listing (``doc_path, file_sig, ...``) whose signatures also have the SHA-256 of each file below a folder, so that a
    file rewritten within a second under its old size is seen to differ. Reads every file; gone files have none."""
    files = listing.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/*", "/")
    own = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 1, F.lit(1 << 30))
    sums = files.select(canonical_path(own).alias("_p"), F.sha2("content", 256).alias("_c"))
    sig = F.struct(F.col("file_sig.mtime_secs").alias("mtime_secs"), F.col("file_sig.size").alias("size"), F.col("_c").alias("checksum"))
    joined = listing.withColumn("_p", canonical_path(F.col("doc_path"))).join(sums, "_p", "left")
    return joined.withColumn("file_sig", F.when(F.col("file_sig").isNotNull(), sig)).drop("_p", "_c")


def canonical_path(path: Column) -> Column:
    """A path in one spelling: forward slashes, none doubled, no leading ``./`` or ``/``, no surrounding blanks."""
    slashed = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    dotless = F.regexp_replace(slashed, r"/(?:\./)+", "/")
    return F.regexp_replace(dotless, r"^(?:\./|/)+", "")


def latest_listing(listing: DataFrame) -> DataFrame:
    """Per canonical path the latest observation: ``doc_path, seen_sig`` (null signature: seen to be gone).

    Two observations at the same moment: a present file wins over a gone one, then the larger signature. Rows without
    a path are no observation; a row without ``seen_at`` is older than every other.
    """
    order = F.struct(
        F.coalesce(F.col("seen_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
        F.col("file_sig").isNotNull().alias("there"),
        F.col("file_sig.mtime_secs").alias("mtime"),
        F.col("file_sig.size").alias("size"),
        _sum(listing).alias("checksum"),
    )
    return (
        listing.where(F.col("doc_path").isNotNull())
        .select(canonical_path(F.col("doc_path")).alias("doc_path"), order.alias("o"))
        .groupBy("doc_path")
        .agg(F.max("o").alias("o"))
        .select(
            "doc_path",
            F.col("o.there").alias("there"),
            F.struct(F.col("o.mtime").alias("mtime_secs"), F.col("o.size").alias("size"), F.col("o.checksum").alias("checksum")).alias("seen_sig"),
        )
    )


def committed_state(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Per canonical path what the last committed run left: ``doc_path, taken, taken_sig``.

    Only entries of runs with status ``ok`` and outcome ``indexed`` or ``removed`` count. The later run wins; within a
    run the later ``written_at``, and at one moment ``indexed`` over ``removed``. ``taken`` is false after a removal.
    """
    ok = runs.where(F.col("status") == "ok").select("run_id").distinct()
    order = F.struct(
        "run_id",
        F.coalesce(F.col("written_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
        ((F.col("outcome") == "indexed") & F.col("file_sig").isNotNull()).alias("taken"),
        F.col("file_sig.mtime_secs").alias("mtime"),
        F.col("file_sig.size").alias("size"),
        _sum(manifest).alias("checksum"),
    )
    return (
        manifest.where(F.col("outcome").isin(*DONE) & F.col("doc_path").isNotNull())
        .join(ok, "run_id", "left_semi")
        .select(canonical_path(F.col("doc_path")).alias("doc_path"), order.alias("o"))
        .groupBy("doc_path")
        .agg(F.max("o").alias("o"))
        .select(
            "doc_path",
            F.col("o.taken").alias("taken"),
            F.struct(F.col("o.mtime").alias("mtime_secs"), F.col("o.size").alias("size"), F.col("o.checksum").alias("checksum")).alias("taken_sig"),
        )
    )


def pending_changes(listing: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """The files the next run must handle: ``doc_path, change, file_sig``.

    ``new``: present, nothing committed or last committed as removed. ``changed``: present under another signature
    (a signature with a null part differs from one without; checksums, where both have one, must agree as well). ``removed``: committed as present, but last seen to be
    gone or not listed. An empty listing makes every committed file ``removed``; an empty manifest every present file
    ``new``. Repeated rows change nothing. Extra columns are ignored.
    """
    seen, taken = latest_listing(listing), committed_state(manifest, runs)
    present, held = F.coalesce("there", F.lit(False)), F.coalesce("taken", F.lit(False))
    change = (
        F.when(present & ~held, "new")
        .when(present & held & ~same_signature(F.col("seen_sig"), F.col("taken_sig")), "changed")
        .when(~present & held, "removed")
    )
    return (
        seen.join(taken, "doc_path", "full_outer")
        .select("doc_path", change.alias("change"), F.when(present, F.col("seen_sig")).alias("file_sig"))
        .where(F.col("change").isNotNull())
    )


def pending_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunk rows of new and changed files, each chunk once (the latest ``indexed_at``), with their ``change``."""
    todo = changes.where(F.col("change") != "removed").select("doc_path", "change")
    newest = F.max_by(
        F.struct(*[F.col(c) for c in chunks.columns if c != "chunk_id"]),
        F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")),
    )
    rows = chunks.withColumn("doc_path", canonical_path(F.col("doc_path"))).join(todo.select("doc_path"), "doc_path", "left_semi")
    return rows.groupBy("chunk_id").agg(newest.alias("row")).select("chunk_id", "row.*").join(todo, "doc_path")


def stale_nodes(nodes: DataFrame, listing: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Graph nodes that no committed state backs: ``id, doc_path, reason``.

    ``unfinished``: the node's signature is not the committed one, so a run that never committed wrote it, or its file
    has been committed again since; ``outdated``: it is, but the file has changed or gone since. Nodes without a
    signature or source path are not judged.
    """
    state = committed_state(manifest, runs).select("doc_path", "taken", "taken_sig")
    changes = pending_changes(listing, manifest, runs).select("doc_path", "change")
    own = nodes.where(F.col("prov.file_sig").isNotNull() & F.col("prov.source_path").isNotNull()).select(
        "id", canonical_path(F.col("prov.source_path")).alias("doc_path"), F.col("prov.file_sig.mtime_secs").alias("node_mtime"), F.col("prov.file_sig.size").alias("node_size")
    )
    same = F.col("node_mtime").eqNullSafe(F.col("taken_sig.mtime_secs")) & F.col("node_size").eqNullSafe(F.col("taken_sig.size"))
    backed = F.coalesce(F.col("taken") & same, F.lit(False))
    return (
        own.distinct()
        .join(state, "doc_path", "left")
        .join(changes, "doc_path", "left")
        .select("id", "doc_path", F.when(~backed, "unfinished").when(F.col("change").isNotNull(), "outdated").alias("reason"))
        .where(F.col("reason").isNotNull())
    )


class Ledger:
    """A manifest on shared storage: one folder a batch, and a commit file written last.

    ``take`` hands ``process`` the pending files, writes its result to ``out/batch_id=N`` (overwriting what a failed
    attempt at the same batch left), then the manifest part of that batch, then the run record that makes both count.
    A crash before the last step leaves the batch uncommitted: the next call does the same files again under the same
    number and overwrites. A crash after it repeats nothing.
    """

    SIGNATURE = "STRUCT<mtime_secs: BIGINT, size: BIGINT, checksum: STRING>"
    MANIFEST = f"run_id BIGINT, doc_path STRING, file_sig {SIGNATURE}, outcome STRING, written_at TIMESTAMP"
    RUNS = "run_id BIGINT, attempt STRING, status STRING"
    #: Batches after which the latest entry of every file is written as a state, and earlier parts need not be read again.
    COMPACT = 32

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _numbers(self, folder: str, mark: str = "") -> list[int]:
        """The numbers in the names of a folder's subfolders that hold a file of the mark's name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        system = path.getFileSystem(conf)
        if not system.exists(path):
            return []
        found = [s.getPath() for s in system.listStatus(path) if "=" in s.getPath().getName()]
        return sorted(int(p.getName().split("=")[1]) for p in found if not mark or system.exists(jvm.org.apache.hadoop.fs.Path(p, mark)))

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _state(self) -> int:
        """The last batch that a whole state was written after; 0 for none."""
        return max([n for n in self._numbers("state", "_SUCCESS") if n <= max(self._done(), default=0)], default=0)

    def _done(self) -> list[int]:
        """Committed batches; those before the last state are removed as they are compacted."""
        return self._numbers("runs", "_SUCCESS")

    def runs(self) -> DataFrame:
        """A row ``run_id, attempt, status`` for each batch that counts: the committed ones since the last state, and those
        whose entries the state holds."""
        done, state = self._done(), self._state()
        own = self.spark.read.schema(self.RUNS).parquet(*[f"{self.root}/runs/batch={b}" for b in done]) if done else self.spark.createDataFrame([], self.RUNS)
        if not state:
            return own
        held = self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/state/batch={state}").select("run_id").distinct()
        return own.unionByName(held.select("run_id", F.lit(None).cast("string").alias("attempt"), F.lit("ok").alias("status"))).dropDuplicates(["run_id"])

    def manifest(self) -> DataFrame:
        """Entries of committed batches: the last state and the parts since. What a failed attempt left is not even read, and
        no more than ``COMPACT`` parts are open at once, however many batches there were."""
        state = self._state()
        parts = [f"{self.root}/manifest/batch={b}" for b in self._done() if b > state]
        if state:
            parts.insert(0, f"{self.root}/state/batch={state}")
        return self.spark.read.schema(self.MANIFEST).parquet(*parts) if parts else self.spark.createDataFrame([], self.MANIFEST)

    def _compact(self, batch: int) -> None:
        """Write the state after a batch, then drop what it holds. A crash between leaves both, which changes nothing."""
        latest = F.max_by(F.struct("run_id", "file_sig", "outcome", "written_at"), F.struct("run_id", "written_at"))
        rows = self.manifest().groupBy("doc_path").agg(latest.alias("e")).select("e.run_id", "doc_path", "e.file_sig", "e.outcome", "e.written_at")
        rows.write.mode("overwrite").parquet(f"{self.root}/state/batch={batch}")
        for old in [b for b in self._done() if b < batch]:
            self._drop(f"runs/batch={old}")
            self._drop(f"manifest/batch={old}")
        for old in [b for b in self._numbers("state") if b < batch]:
            self._drop(f"state/batch={old}")

    def take(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame], out: str) -> int | None:
        """Handle what is pending; the batch's number, or None where nothing is, and then nothing is left behind."""
        batch = max(self._done(), default=0) + 1
        changes = pending_changes(listing, self.manifest(), self.runs())
        part = f"{self.root}/manifest/batch={batch}"
        (
            changes.select(
                F.lit(batch).cast("bigint").alias("run_id"),
                "doc_path",
                "file_sig",
                F.when(F.col("change") == "removed", "removed").otherwise("indexed").alias("outcome"),
                F.current_timestamp().alias("written_at"),
                "change",
            ).write.mode("overwrite").parquet(part)
        )
        fixed = self.spark.read.parquet(part)
        if fixed.isEmpty():
            self._drop(f"manifest/batch={batch}")
            return None
        process(fixed.select("doc_path", "change", "file_sig")).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")
        record = self.spark.createDataFrame([(batch, uuid.uuid4().hex, "ok")], self.RUNS)
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/batch={batch}")
        if batch % self.COMPACT == 0:
            self._compact(batch)
        return batch
