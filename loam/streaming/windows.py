"""Event-time operators that take a stream or a table alike: windows, sessions, bursts, deduplication, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.evals import BUCKETS, cumulative_histogram


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    return events.withWatermark(time, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """``window_start, keys..., n`` per window of a fixed size."""
    grouped = _watermarked(events, time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, time: str, size: str, step: str, value: str, late: str | None = "10 minutes") -> DataFrame:
    """``window_start, n, total`` per window of a fixed size every step."""
    grouped = _watermarked(events, time, late).groupBy(F.window(time, size, step)).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = "10 minutes") -> DataFrame:
    """``key, started, ended, n``: runs of a key's events with no gap of that length; ``ended`` is the last event's time."""
    grouped = _watermarked(events, time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), F.max(time).alias("ended"))
    return grouped.select(key, F.col("session_window.start").alias("started"), "ended", "n")


def debounce(changes: DataFrame, time: str, quiet: str = "5 seconds", keys: list[str] | None = None, late: str | None = "1 minute") -> DataFrame:
    """``keys..., started, last, n``: bursts of changes, each over once nothing has changed for the quiet time.

    Without keys all changes are one sequence, which suits the changes of a single pass; a large history wants keys.
    """
    by = keys or ["_all"]
    base = changes if keys else changes.withColumn("_all", F.lit(1))
    grouped = _watermarked(base, time, late).groupBy(F.session_window(time, quiet), *by).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return grouped.select(*(keys or []), F.col("session_window.start").alias("started"), "last", "n")


def deduplicate(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """One event of each key; a stream forgets keys that are later than the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def settled(files: DataFrame, mtime: str, now: str, age: str = "2 seconds") -> DataFrame:
    """Files whose last change is old enough to be read; the others wait for the next pass."""
    return files.where(F.col(mtime) <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age}"))


def latency(requests: DataFrame, seconds: str, group: str | None = None) -> DataFrame:
    """The cumulative latency histogram, for a stream to be written in complete or update mode."""
    return cumulative_histogram(requests, seconds, group, BUCKETS)


def retry_unresolved(links: DataFrame, carried: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (``src, target``) of this pass and those carried from earlier ones: resolved against documents, and what is
    carried on. Links to their own source are dropped."""
    every = links.select("src", "target").unionByName(carried.select("src", "target")).where("src <> target").distinct()
    known = documents.select(F.col("doc_path").alias("target")).distinct()
    return every.join(known, "target", "left_semi").select("src", "target"), every.join(known, "target", "left_anti").select("src", "target")


def upsert_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands each micro-batch and its number to ``handle``, which must be idempotent by that number."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def metric_lines(histogram: DataFrame, name: str, group: str | None = None, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """``line``: a cumulative histogram (see ``latency``) in the text form that metric collectors read."""
    label = F.concat(F.lit(f'{group}="'), F.coalesce(F.col(group), F.lit("")), F.lit('",')) if group else F.lit("")
    bucket = lambda le, n: F.concat(F.lit(name + "_bucket{"), label, F.lit(f'le="{le}"}} '), n.cast("string"))
    tail = F.concat(F.lit("{"), F.rtrim(label, F.lit(",")), F.lit("} ")) if group else F.lit(" ")
    rows = [bucket(f"{b:g}", F.col(f"le_{k}")) for k, b in enumerate(bounds)] + [bucket("+Inf", F.col("n"))]
    rows += [F.concat(F.lit(name + "_sum"), tail, F.col("total").cast("string")), F.concat(F.lit(name + "_count"), tail, F.col("n").cast("string"))]
    return histogram.select(F.explode(F.array(*rows)).alias("line"))


def append_rows(table: DataFrame, new: DataFrame, placeholders: tuple[str, ...] = ("...", "…", "etc")) -> DataFrame:
    """Rows of a note's table that an append adds: not there yet, each once, none of placeholders alone. All columns count."""
    cells = F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in new.columns])
    real = new.where(F.exists(cells, lambda x: (x != "") & ~x.isin(*placeholders)) & ~F.exists(cells, lambda x: x.isin(*placeholders)))
    return real.distinct().exceptAll(table.select(*new.columns).distinct())
