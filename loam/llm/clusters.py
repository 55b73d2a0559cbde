"""Groups of near-equal short texts: MinHash over five-word shingles, banded, every link verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.components import connected_components
from loam.session import cut_lineage

#: Words a shingle has, least Jaccard similarity of a link, and the hash functions by band: 12 bands of 2 find a pair of
#: similarity 0.8 but for 5 in a million.
SHINGLE_WORDS, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 12, 2


def shingles(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of the runs of ``size`` words; a text with fewer words is one shingle."""
    last = F.greatest(F.size(words) - F.lit(size - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, size)))))


def similar_groups(df: DataFrame, key: str, sets: str, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``key, group``: rows whose sets of hashes are linked by Jaccard similarity of ``SIMILARITY`` or more.

    ``key`` must be unique. Each row of a bucket is compared with the bucket's least key; of two rows that both match it
    no more is asked, all other pairs of the bucket are compared as well. So the groups are those of all pairs that share
    a bucket, and near-equal rows cost a comparison each.
    """
    rows = df.select(F.col(key).alias("k"), F.col(sets).alias("s")).where(F.size("s") > 0)
    least = lambda seed: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(seed))))
    banded = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * band_rows + r) for r in range(band_rows)]).alias("value")) for b in range(bands)])
    bucketed = cut_lineage(rows.select("k", F.explode(banded).alias("b")).select("k", "b.*"))
    leader = bucketed.groupBy("band", "value").agg(F.min("k").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    led = bucketed.join(leader, ["band", "value"])

    def verified(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(rows, "k").join(rows.select(F.col("k").alias("lead"), F.col("s").alias("t")), "lead")
        shared = F.size(F.array_intersect("s", "t"))
        return with_sets.where(shared >= SIMILARITY * (F.size("s") + F.size("t") - shared)).select("k", "lead")

    first = cut_lineage(verified(led.where("k <> lead").select("k", "lead").distinct()))
    marked = led.join(first.withColumn("matched", F.lit(True)), ["k", "lead"], "left").select("band", "value", "k", "lead", F.coalesce("matched", F.lit(False)).alias("matched"))
    members = marked.where("k <> lead")
    others = members.where("not matched").select("band", "value", F.col("k").alias("x"))
    rest = members.join(others, ["band", "value"]).where("k <> x").select(F.greatest("k", "x").alias("k"), F.least("k", "x").alias("lead")).distinct()
    found = connected_components(first.unionByName(verified(rest)), "k", "lead")
    return rows.select("k").join(found.select(F.col("node").alias("k"), "component"), "k", "left").select(F.col("k").alias(key), F.coalesce("component", "k").alias("group"))
