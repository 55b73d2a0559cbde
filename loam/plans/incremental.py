"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.incremental import pending_changes, pending_chunks, stale_nodes
from loam.session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return pending_changes(t("file_listing"), t("manifest_entries"), t("index_runs")).select("doc_path", "change")


def p4_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    changes = pending_changes(t("file_listing"), t("manifest_entries"), t("index_runs"))
    return pending_chunks(t("chunks"), changes).select("chunk_id", "doc_path", "ord", "change", F.length("text").alias("n_chars"))


def p4_stale_nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return stale_nodes(t("nodes"), t("file_listing"), t("manifest_entries"), t("index_runs"))


_CANON = r"regexp_replace(regexp_replace(regexp_replace(trim({0}), '[\\/]+', '/', 'g'), '/(?:\./)+', '/', 'g'), '^(?:\./|/)+', '')"
_STATE = f"""
WITH seen AS (
  SELECT {_CANON.format("doc_path")} AS doc_path, file_sig, row_number() OVER (
    PARTITION BY {_CANON.format("doc_path")}
    ORDER BY seen_at DESC NULLS LAST, (file_sig IS NOT NULL) DESC, file_sig.mtime_secs DESC NULLS LAST, file_sig.size DESC NULLS LAST) AS k
  FROM file_listing WHERE doc_path IS NOT NULL),
taken AS (
  SELECT {_CANON.format("doc_path")} AS doc_path, file_sig, outcome, row_number() OVER (
    PARTITION BY {_CANON.format("doc_path")}
    ORDER BY run_id DESC, written_at DESC NULLS LAST, (outcome = 'indexed' AND file_sig IS NOT NULL) DESC,
      file_sig.mtime_secs DESC NULLS LAST, file_sig.size DESC NULLS LAST) AS k
  FROM manifest_entries WHERE outcome IN ('indexed', 'removed') AND doc_path IS NOT NULL
    AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok')),
s AS (SELECT * FROM seen WHERE k = 1),
m AS (SELECT *, outcome = 'indexed' AND file_sig IS NOT NULL AS held FROM taken WHERE k = 1),
changes AS (
  SELECT * FROM (
    SELECT coalesce(s.doc_path, m.doc_path) AS doc_path,
      CASE WHEN s.file_sig IS NOT NULL AND NOT coalesce(m.held, false) THEN 'new'
           WHEN s.file_sig IS NOT NULL AND (s.file_sig.mtime_secs IS DISTINCT FROM m.file_sig.mtime_secs
             OR s.file_sig.size IS DISTINCT FROM m.file_sig.size) THEN 'changed'
           WHEN s.file_sig IS NULL AND coalesce(m.held, false) THEN 'removed' END AS change
    FROM s FULL OUTER JOIN m ON s.doc_path = m.doc_path)
  WHERE change IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_chunks": p4_chunks, "p4_stale_nodes": p4_stale_nodes}
SQL = {
    "p4_found": _STATE + "SELECT doc_path, change FROM changes",
    "p4_chunks": _STATE
    + f"""SELECT chunk_id, p AS doc_path, ord, change, length(text) AS n_chars FROM (
      SELECT *, {_CANON.format("doc_path")} AS p, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) AS k FROM chunks) c
      JOIN changes d ON d.doc_path = c.p WHERE k = 1 AND change <> 'removed'""",
    "p4_stale_nodes": _STATE
    + f"""SELECT id, doc_path, reason FROM (
      SELECT n.id, n.p AS doc_path, CASE WHEN NOT coalesce(m.held AND n.sig.mtime_secs IS NOT DISTINCT FROM m.file_sig.mtime_secs
        AND n.sig.size IS NOT DISTINCT FROM m.file_sig.size, false) THEN 'unfinished' WHEN d.change IS NOT NULL THEN 'outdated' END AS reason
      FROM (SELECT DISTINCT id, {_CANON.format("prov.source_path")} AS p, prov.file_sig AS sig FROM nodes
            WHERE prov.file_sig IS NOT NULL AND prov.source_path IS NOT NULL) n
      LEFT JOIN m ON m.doc_path = n.p LEFT JOIN changes d ON d.doc_path = n.p) WHERE reason IS NOT NULL""",
}
