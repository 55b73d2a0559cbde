"""Evaluation sets: samples, mutated cases, recall over values, and probes that lay traps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.constraints import covers


def sample_rows(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k rows without replacement, the same for the same seed and key order; all where there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(k)


def mutated_cases(rows: DataFrame, row_id: str, columns: list[str], mutations: int = 3, mark: str = "~") -> DataFrame:
    """``row_id, variant, field, value, valid``: each row as it is and with single cells spoiled, in long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    kinds = F.sequence(F.lit(0), F.lit(min(mutations, len(columns))))
    out = rows.select(F.col(row_id).alias("row_id"), F.explode(kinds).alias("variant"), cells.alias("cells"))
    spoiled = out.select("row_id", "variant", F.posexplode("cells").alias("at", "cell"))
    value = F.when(F.col("at") + 1 == F.col("variant"), F.concat(F.coalesce("cell.value", F.lit("")), F.lit(mark))).otherwise(F.col("cell.value"))
    return spoiled.select("row_id", "variant", "cell.field", value.alias("value"), (F.col("variant") == 0).alias("valid"))


def value_recall(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, recall``: share of a key's gold values (``value``) that its found cells (``value``) cover; 1 without gold."""
    lists = found.groupBy(key).agg(F.collect_set("value").alias("options"))
    rows = gold.select(key, "value").distinct().join(lists, key, "left")
    hit = F.coalesce(covers(F.coalesce("options", F.array().cast("array<string>")), F.col("value")), F.lit(False))
    return rows.groupBy(key).agg(F.round(F.avg(hit.cast("double")), 6).alias("recall"))


def trap_scores(probes: DataFrame) -> DataFrame:
    """``trap_type, n, hits, rate``: right answers (``correct``) by kind of probe."""
    return probes.groupBy("trap_type").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("hits"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("rate"))


def coverage(reference: DataFrame, made: DataFrame) -> DataFrame:
    """``field, covered, share``: of each reference field's values (``field, value``) the share that the best list of the made
    graph (``list_id, value``) holds; covered from a half on. An empty reference gives no rows."""
    sizes = reference.select("field", "value").distinct().groupBy("field").agg(F.count("*").alias("n"))
    shared = reference.select("field", "value").distinct().join(made.select("list_id", "value").distinct(), "value").groupBy("field", "list_id").agg(F.count("*").alias("s"))
    best = shared.groupBy("field").agg(F.max("s").alias("s"))
    share = F.coalesce("s", F.lit(0)) / F.col("n")
    return sizes.join(best, "field", "left").select("field", (share >= 0.5).alias("covered"), F.round(share, 6).alias("share"))
