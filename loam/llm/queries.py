"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import abuse
from loam.llm.bpe import token_ids
from loam.llm.langid import Identifier, chunk_languages, fit_cut, fit_on, passage_languages
from loam.llm.models import fitted
from loam.llm.mojibake import Repairer, restore_encoding
from loam.llm.mojibake import fit_on as fit_repairer_on
from loam.llm.pack import pack
from loam.llm.names import entity_of, same_entity_pairs
from loam.llm.pairs import defective_pairs
from loam.llm.split import split_oversized
from loam.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "chunks"), table(spark, sf, "split_limits"))
    return pieces.where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunks"), table(spark, sf, "split_limits"))


def p1_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of each chunk that is split, whether its pieces keep to the limit and leave no gap."""
    chunks, limits = table(spark, sf, "chunks"), table(spark, sf, "split_limits")
    pieces = split_oversized(chunks, limits).groupBy("chunk_id").agg(
        F.max(F.length("text")).alias("longest"), F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.length("text")).alias("end")))).alias("spans")
    )
    whole = chunks.join(F.broadcast(limits), "file_type").groupBy("chunk_id").agg(F.max("max_chars").alias("most"), F.max(F.length("text")).alias("size"))
    follows = F.forall(F.sequence(F.lit(1), F.size("spans") - 1), lambda i: F.col("spans")[i]["start"] <= F.col("spans")[i - 1]["end"])
    covers = (F.col("spans")[0]["start"] == 0) & (F.element_at("spans", -1)["end"] == F.col("size")) & F.when(F.size("spans") > 1, follows).otherwise(True)
    return pieces.join(whole, "chunk_id").select("chunk_id", (F.col("longest") <= F.col("most")).alias("within"), covers.alias("covers"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_entity_pairs(table(spark, sf, "node_upserts"))


def p6_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entity_of(table(spark, sf, "node_upserts"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), table(spark, sf, "container_sizes"))


def _identifier(chunks: DataFrame) -> Identifier:
    return fitted("languages", fit_on, chunks)


def _repairer(chunks: DataFrame) -> Repairer:
    return fitted("encodings", fit_repairer_on, chunks)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_languages(spark, sf).where("is_case").select("chunk_id", "langs")


def p2_languages(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    cut: list[DataFrame] = []  # the texts as cut, where the model is not one that was kept

    def fit(chunks: DataFrame) -> Identifier:
        identifier, pieces = fit_cut(chunks)
        cut.append(pieces)
        return identifier

    return chunk_languages(chunks, fitted("languages", fit, chunks), *cut)


def p2_passages(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    return passage_languages(chunks, _identifier(chunks))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return defective_pairs(table(spark, sf, "train_cases"), table(spark, sf, "episode_outcomes"), _identifier(table(spark, sf, "chunks")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    return restore_encoding(chunks, _repairer(chunks), keep_text=False).select("chunk_id")


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    return restore_encoding(chunks, _repairer(chunks)).select("chunk_id", "chain", "recoverable", "restored")


def _content_scores(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return abuse.content_scores(documents, fitted("content", abuse.fit_on, documents, table(spark, sf, "doc_reviews")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _content_scores(spark, sf).where("abusive").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _content_scores(spark, sf)


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.source_rates(_content_scores(spark, sf))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind the containers, those over capacity, the tokens in them, and the share of the capacity that they fill."""
    packed = pack(table(spark, sf, "documents"), table(spark, sf, "container_sizes"))
    each = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    sizes = table(spark, sf, "container_sizes").dropDuplicates(["container_kind"])
    return each.join(F.broadcast(sizes), "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum((F.col("tokens") > F.col("capacity_tokens")).cast("bigint")).alias("over"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("capacity_tokens")).alias("filled"),
    )


QUERIES = {
    "p1_found": p1_found, "p1_kept": p1_kept, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_languages": p2_languages, "p2_passages": p2_passages, "p3_found": p3_found,
    "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}
SQL = {
    "p1_found": "SELECT DISTINCT chunk_id FROM chunks JOIN split_limits USING (file_type) WHERE length(text) > max_chars",
    "p1_kept": "SELECT DISTINCT chunk_id, true AS within, true AS covers FROM chunks JOIN split_limits USING (file_type) WHERE length(text) > max_chars",
}
