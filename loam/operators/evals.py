"""Measures of answers and rankings, and the small allocations evaluations need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import normalize_answer
from loam.session import cut_lineage

#: Upper bounds (seconds) of the latency histogram.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normalize_answer(predicted) == normalize_answer(gold)).cast("int")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 over words with their numbers; 1 where both are empty, 0 where one is."""
    tokens = lambda x: F.filter(F.split(normalize_answer(x), " "), lambda t: t != "")
    p, g = tokens(predicted), tokens(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))
    both = F.size(p) + F.size(g)
    return F.when(both == 0, 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / both)


def recall_at(found: Column, wanted: Column, k: int) -> Column:
    """Share of the distinct wanted titles among the first k found; 1 where nothing is wanted."""
    want = F.array_distinct(wanted)
    return F.when(F.size(want) <= 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), want)) / F.size(want))


def reciprocal_rank(found: Column, wanted: Column) -> Column:
    """One over the place of the first found title that is wanted; 0 if none is."""
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(wanted, x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def cumulative_histogram(df: DataFrame, value: str, group: str | None = None, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Counts at or below each bound (``le_0`` and so on), of all (``n``), and their sum: one pass, one row a group."""
    sums = [F.sum((F.col(value) <= b).cast("bigint")).alias(f"le_{k}") for k, b in enumerate(bounds)]
    keys = [group] if group else []
    return df.groupBy(*keys).agg(*sums, F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))


def pareto_frontier(scores: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys that no other dominates (at least as good everywhere, better somewhere). Equal vectors are compared once, so the
    comparison is between distinct vectors, and of each part of these only its own frontier meets the others'. Vectors
    must be of one length and without nulls."""
    distinct = scores.select(vector).distinct()

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            new = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
            kept = new if kept is None else np.concatenate([kept, new])
            rest, front = kept[np.argsort(-kept.sum(axis=1), kind="stable")], []
            while len(rest):  # a vector can be dominated only by one of a greater sum
                front.append(rest[0])
                rest = rest[~(rest[0] >= rest).all(axis=1)]
            kept = np.array(front).reshape(len(front), -1)
        if kept is not None and len(kept):
            yield pd.DataFrame({"v": list(kept)})

    local = cut_lineage(distinct.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(own, "v array<double>"))
    ge = F.forall(F.zip_with("w", "v", lambda a, b: a >= b), lambda x: x)
    beaten = local.crossJoin(local.withColumnRenamed("v", "w")).where(ge & (F.col("w") != F.col("v"))).select("v").distinct()
    front = local.join(beaten, "v", "left_anti")
    return scores.withColumn("v", F.col(vector).cast("array<double>")).join(front, "v", "left_semi").select(key)


def largest_remainder(pools: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``key, n``: a total split over pools by weight, one each at least, the rest by the largest fractions, ties by key.
    The pools are few: they are ranked in one task."""
    size = pools.agg(F.sum(weight).alias("_w"), F.count("*").alias("_c"))
    share = F.col(weight) / F.col("_w") * F.greatest(F.lit(total) - F.col("_c"), F.lit(0))
    rows = pools.crossJoin(F.broadcast(size)).select(key, F.floor(share).alias("_b"), (share - F.floor(share)).alias("_f"), "_c")
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct((-F.round("_f", 9)).alias("f"), F.col(key).alias("k"), F.col("_b").alias("b")))).alias("a"), F.max("_c").alias("c"), F.sum("_b").alias("s"))
    left = F.greatest(F.lit(total) - F.col("c") - F.col("s"), F.lit(0))
    out = gathered.select(F.explode(F.transform("a", lambda x, i: F.struct(x["k"].alias(key), (1 + x["b"] + F.when(i < left, 1).otherwise(0)).alias("n")))).alias("x"))
    return out.select(f"x.{key}", "x.n")


def weighted_accuracy(pools: DataFrame, accuracy: str, weight: str) -> DataFrame:
    return pools.where(F.col(accuracy).isNotNull()).agg((F.sum(F.col(accuracy) * F.col(weight)) / F.sum(weight)).alias("accuracy"))


def contains_run(text: Column, needle: Column, least_chars: int = 4) -> Column:
    """Whether the words of a text hold those of another in a row; a single word needs some length."""
    hay, want = F.concat(F.lit(" "), normalize_answer(text), F.lit(" ")), normalize_answer(needle)
    enough = (F.length(want) >= least_chars) & (want != "")
    return enough & hay.contains(F.concat(F.lit(" "), want, F.lit(" ")))


def match_columns(edges: DataFrame, table: str, left: str, right: str) -> DataFrame:
    """A largest one-to-one matching of left to right columns per table, by augmenting paths; a table's columns are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacent = pdf.sort_values([left, right]).groupby(left)[right].apply(list).to_dict()
        owner: dict = {}

        def place(a, seen: set) -> bool:
            for b in adjacent.get(a, ()):
                if b not in seen:
                    seen.add(b)
                    if b not in owner or place(owner[b], seen):
                        owner[b] = a
                        return True
            return False

        for a in sorted(adjacent):
            place(a, set())
        return pd.DataFrame({table: [pdf[table].iloc[0]] * len(owner), left: list(owner.values()), right: list(owner.keys())})

    kind = {c: edges.schema[c].dataType.simpleString() for c in (table, left, right)}
    return edges.select(table, left, right).distinct().groupBy(table).applyInPandas(run, ", ".join(f"`{c}` {k}" for c, k in kind.items()))


def pair_tool_calls(messages: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Tool calls with their results: rows ``episode, seq, kind (call or result), call_id, body`` to
    ``episode, call_id, seq, call, result``; the first result after the call counts, a call without one keeps null."""
    calls = messages.where("kind = 'call'").select(episode, "call_id", "seq", F.col("body").alias("call"))
    results = messages.where("kind = 'result'").select(episode, "call_id", F.col("seq").alias("r_seq"), F.col("body").alias("result"))
    joined = calls.join(results, [episode, "call_id"], "left").groupBy(episode, "call_id", "seq", "call").agg(F.min_by("result", F.when(F.col("r_seq") > F.col("seq"), F.col("r_seq"))).alias("result"))
    return joined.select(episode, "call_id", "seq", "call", "result")
