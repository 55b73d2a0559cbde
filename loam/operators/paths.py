"""Document paths as people and tools write them, resolved to the ones that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import words


def plain_path(path: Column) -> Column:
    """One separator, blanks and underscores in runs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"[\s_]+", " "))


def resolve_paths(inputs: DataFrame, documents: DataFrame, column: str = "input") -> DataFrame:
    """``input, doc_path, how``: each input with the one document it means, null where none or several fit.

    In turn: the exact path without a ``#n`` at its end (``exact``); the same but for separators, blanks and underscores
    (``spelling``); that of the input without its first folders, the fewest first (``folder``); all again without an ``@``.
    """
    docs = documents.select("doc_path").distinct()
    spelled = docs.groupBy(plain_path(F.col("doc_path")).alias("key")).agg(F.min("doc_path").alias("doc_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    base = F.regexp_replace(F.col(column), r"#\d+$", "")
    tried = inputs.select(column).distinct().select(column, F.posexplode(F.array_distinct(F.array(base, F.regexp_replace(base, "^@", "")))).alias("turn", "text"))
    exact = tried.join(docs.withColumn("text", F.col("doc_path")), "text").select(column, "doc_path", F.struct("turn", F.lit(0).alias("step"), F.lit(0).alias("cut")).alias("rank"), F.lit("exact").alias("how"))
    parts = F.split(plain_path(F.col("text")), "/")
    tails = tried.select(column, "turn", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))).alias("cut", "key"))
    loose = tails.join(spelled, "key").select(column, "doc_path", F.struct("turn", F.lit(1).alias("step"), "cut").alias("rank"), F.when(F.col("cut") == 0, "spelling").otherwise("folder").alias("how"))
    best = exact.unionByName(loose).groupBy(column).agg(F.min(F.struct("rank", "doc_path", "how")).alias("b"))
    return inputs.select(column).distinct().join(best, column, "left").select(column, "b.doc_path", "b.how")


def path_hints(documents: DataFrame, text: str, k: int = 3) -> DataFrame:
    """``doc_path, overlap``: the documents whose paths share most words with a text, at least two (or all, if it has
    fewer), most first, then by path."""
    want = F.array_distinct(words(F.lit(text)))
    overlap = F.size(F.array_intersect(F.array_distinct(words("doc_path")), want))
    rows = documents.select("doc_path").distinct().select("doc_path", overlap.alias("overlap"))
    return rows.where(F.col("overlap") >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(want)))).orderBy(F.desc("overlap"), "doc_path").limit(k)


def note_owners(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """``note_path, doc_path``: the longest beginning of a note's path that is a document; null for orphans."""
    parts = F.split(F.col("note_path"), "/")
    tails = notes.select("note_path").distinct().select("note_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("doc_path"))
    owned = tails.join(documents.select("doc_path").distinct(), "doc_path").groupBy("note_path").agg(F.max_by("doc_path", F.length("doc_path")).alias("doc_path"))
    return notes.select("note_path").distinct().join(owned, "note_path", "left")


def reference_edges(links: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``src, target`` between documents, targets taken relative to their source's folder: edges ``efrom, eto`` to
    documents that exist, and the links that lead nowhere. Links to themselves are dropped."""
    folder = F.regexp_replace(F.col("src"), "[^/]*$", "")
    joined = F.when(F.col("target").startswith("/"), F.regexp_replace("target", "^/+", "")).otherwise(F.concat(folder, F.col("target")))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    resolved = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    rows = links.select("src", "target", resolved.alias("eto")).distinct()
    known = rows.join(documents.select(F.col("doc_path").alias("eto")).distinct(), "eto", "left_semi")
    lost = rows.join(documents.select(F.col("doc_path").alias("eto")).distinct(), "eto", "left_anti")
    return known.where("src <> eto").select(F.col("src").alias("efrom"), "eto").distinct(), lost.select("src", "target")
