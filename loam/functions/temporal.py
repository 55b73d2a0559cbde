"""Dates of four granularities as fixed-width instants, which compare as strings, and what they say about validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?Z?)?)?)?$"


def normalize_instant(text: Column, end: bool = False) -> Column:
    """``YYYY-MM-DDThh:mm:ssZ`` of a year, month, day or instant; its first second, or with ``end`` its last.

    Null for anything that is no such date, uncertainty marks included.
    """
    s = F.trim(text)
    part = lambda k: F.regexp_extract(s, _SHAPE, k)
    month = F.when(part(2) == "", F.lit("12" if end else "01")).otherwise(part(2))
    first = F.try_to_date(F.concat_ws("-", part(1), month, F.lit("01")), "yyyy-MM-dd")
    day = F.when(part(3) != "", part(3)).otherwise(F.date_format(F.last_day(first), "dd") if end else F.lit("01"))
    clock = F.when(part(4) != "", F.concat_ws(":", part(4), part(5), F.when(part(6) == "", F.lit("00")).otherwise(part(6)))).otherwise(F.lit("23:59:59" if end else "00:00:00"))
    made = F.concat(part(1), F.lit("-"), month, F.lit("-"), day, F.lit("T"), clock, F.lit("Z"))
    valid = s.rlike(_SHAPE) & F.try_to_timestamp(made, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    return F.when(valid, made)


def visible(valid_from: Column, valid_to: Column, at: str | Column) -> Column:
    """Whether an interval, closed at both ends and open where null, holds the instant."""
    at = F.lit(at) if isinstance(at, str) else at
    return F.coalesce(valid_from <= at, F.lit(True)) & F.coalesce(valid_to >= at, F.lit(True))


def status(valid_from: Column, valid_to: Column, superseded: Column, at: str) -> Column:
    """superseded, future, expired or current, in this order."""
    return F.when(superseded, "superseded").when(valid_from > at, "future").when(valid_to < at, "expired").otherwise("current")


def as_of(nodes: DataFrame, validity: DataFrame, at: str, key: str = "id") -> DataFrame:
    """Nodes visible at an instant; a node without a validity row always is."""
    hidden = validity.where(~visible(F.col("valid_from"), F.col("valid_to"), at)).select(F.col("node_id").alias(key))
    return nodes.join(hidden, key, "left_anti")


def earliest_valid(nodes: DataFrame, validity: DataFrame, group: str, key: str = "id") -> DataFrame:
    """Per group the node whose validity begins first, ties by id; nodes without a beginning come last."""
    first = F.min(F.struct(F.col("valid_from").isNull().alias("open"), "valid_from", F.col(key).alias("first_id")))
    joined = nodes.join(validity.select(F.col("node_id").alias(key), "valid_from"), key, "left")
    return joined.groupBy(group).agg(first.alias("f")).select(group, F.col("f.first_id").alias(key), F.col("f.valid_from").alias("valid_from"))
