"""Constraint tables: relations of strings compiled into allowed values, and assignments checked against constraints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import canonical_scalar, number_span

CONSTRAINT = "constraint_id bigint, field string, kind string, lo double, hi double, pattern string, options array<string>, cond_field string, cond_value string"


def parse_csp(text: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a tab-separated text: quoted cells may hold tabs and doubled quotes, blank lines are skipped, short
    rows are padded, empty cells beyond the header forgiven. A row with more values than columns is an error."""
    header: list[str] | None = None
    rows: list[list[str]] = []
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip():
            continue
        cells = [m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2) for m in re.finditer(r'(?:^|\t)(?:"((?:[^"]|"")*)"(?=\t|$)|([^\t]*))', line)]
        if header is None:
            header = [c.strip() for c in cells]
            continue
        if any(c.strip() for c in cells[len(header) :]):
            raise ValueError(f"line {number} has {len(cells)} cells for {len(header)} columns: {', '.join(header)}")
        rows.append((cells + [""] * len(header))[: len(header)])
    return header or [], rows


def column_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables under all columns; what a table lacks is empty."""
    return left.unionByName(right, allowMissingColumns=True).na.fill("")


def long_form(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``row_id, field, value``: the cells that are not empty."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("x")).select("row_id", "x.field", "x.value").where(F.coalesce(F.trim("value"), F.lit("")) != "")


def choose_triggers(cells: DataFrame) -> DataFrame:
    """``field, trigger, n``: for each field the other field with the fewest, but more than one, distinct values in rows
    where the field has a value; ties by name. A field without such a one has no row."""
    pairs = cells.select("row_id", "field").distinct().join(cells.select("row_id", F.col("field").alias("trigger"), F.col("value").alias("t")), "row_id").where("field <> trigger")
    counted = pairs.select("field", "trigger", "t").distinct().groupBy("field", "trigger").agg(F.count("*").alias("n")).where("n > 1")
    return counted.groupBy("field").agg(F.min(F.struct("n", "trigger")).alias("b")).select("field", F.col("b.trigger").alias("trigger"), F.col("b.n").alias("n"))


def compile_enums(cells: DataFrame) -> DataFrame:
    """``field, trigger, trigger_value, options``: allowed values of each field, per value of its trigger, or for all rows
    where it has none."""
    triggers = choose_triggers(cells)
    alone = cells.join(triggers.select("field"), "field", "left_anti").groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("options"))
    given = cells.select("row_id", F.col("field").alias("trigger"), F.col("value").alias("trigger_value"))
    bound = cells.join(F.broadcast(triggers.select("field", "trigger")), "field").join(given, ["row_id", "trigger"])
    conditional = bound.select("field", "trigger", "trigger_value", "value").distinct().groupBy("field", "trigger", "trigger_value").agg(F.array_sort(F.collect_set("value")).alias("options"))
    none = F.lit(None).cast("string")
    return conditional.unionByName(alone.select("field", none.alias("trigger"), none.alias("trigger_value"), "options"))


def covers(options: Column, value: Column) -> Column:
    """Whether a list of allowed values holds a value: equal in canonical form, or a number inside one of its ranges."""
    same = F.exists(options, lambda o: canonical_scalar(o) == canonical_scalar(value))
    number = number_span(value)["lo"]
    inside = F.exists(options, lambda o: F.coalesce((number_span(o)["lo"] <= number) & (number <= number_span(o)["hi"]), F.lit(False)))
    return F.coalesce(same, F.lit(False)) | F.coalesce(inside, F.lit(False))


def _bound(assignments: DataFrame, constraints: DataFrame) -> DataFrame:
    """``row_id`` and the conditional constraints whose condition holds for it, met by field and value of the condition."""
    given = assignments.select("row_id", F.col("field").alias("cond_field"), canonical_scalar("value").alias("_c")).distinct()
    conditional = constraints.where(F.col("cond_field").isNotNull()).withColumn("_c", canonical_scalar("cond_value"))
    return given.join(conditional, ["cond_field", "_c"]).select("row_id", *constraints.columns)


def validate(assignments: DataFrame, constraints: DataFrame) -> DataFrame:
    """``row_id, constraint_id, field, kind``: violations of assignments ``row_id, field, value``.

    Required and forbidden fields, ranges over plain numbers, anchored patterns and value lists; a field without a value
    violates only its being required.
    """
    cells = assignments.select("row_id", "field", "value")
    free = constraints.where(F.col("cond_field").isNull())
    # A free constraint meets the rows that have its field; only what is required concerns the others.
    met = free.where("kind <> 'required'").join(cells, "field").select("row_id", *free.columns, "value")
    needed = free.where("kind = 'required'")
    there = cells.where(F.coalesce(F.trim("value"), F.lit("")) != "").join(needed.select("field").distinct(), "field", "left_semi")
    have = cells.select("row_id").distinct().join(there.groupBy("row_id").agg(F.collect_set("field").alias("have")), "row_id", "left")
    lists = needed.groupBy().agg(F.collect_set("field").alias("need"))
    lacking = have.crossJoin(F.broadcast(lists)).select("row_id", F.explode(F.array_except("need", F.coalesce("have", F.array().cast("array<string>")))).alias("field"))
    missing = lacking.join(needed, "field").select("row_id", *free.columns, F.lit(None).cast("string").alias("value"))
    bound = _bound(assignments, constraints).join(cells, ["row_id", "field"], "left").select("row_id", *free.columns, "value")
    joined = met.unionByName(missing).unionByName(bound)
    has = F.coalesce(F.trim("value"), F.lit("")) != ""
    number = F.col("value").try_cast("double")
    broken = (
        F.when(F.col("kind") == "required", ~has)
        .when(F.col("kind") == "forbidden", has)
        .when(~has, F.lit(False))
        .when(F.col("kind") == "range", ~F.coalesce(F.coalesce(number >= F.col("lo"), number.isNotNull()) & F.coalesce(number <= F.col("hi"), number.isNotNull()), F.lit(False)))
        .when(F.col("kind") == "regex", ~F.expr("coalesce(regexp_like(value, concat('^(?:', pattern, ')$')), false)"))
        .when(F.col("kind") == "enum", ~covers(F.col("options"), F.col("value")))
        .otherwise(F.lit(False))
    )
    return joined.where(broken).select("row_id", "constraint_id", "field", "kind").distinct()


def infer_domains(assignments: DataFrame, constraints: DataFrame) -> DataFrame:
    """``row_id, field, lo, hi, options, empty``: what active ranges and value lists leave of each constrained field: the
    narrowest range, and the values that are in every list (and inside the range, if they are numbers)."""
    wanted = constraints.where(F.col("kind").isin("range", "enum"))
    # The result has a row for each row and field that a free constraint names, so here they do meet.
    free = assignments.select("row_id").distinct().crossJoin(wanted.where(F.col("cond_field").isNull())).select("row_id", *constraints.columns)
    live = free.unionByName(_bound(assignments, wanted))
    lists = F.col("kind") == "enum"
    grouped = live.groupBy("row_id", "field").agg(
        F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count(F.when(lists, 1)).alias("n"), F.flatten(F.collect_list(F.when(lists, F.array_distinct("options")))).alias("every")
    )
    common = F.array_sort(F.array_distinct(F.filter("every", lambda x: F.size(F.filter("every", lambda y: y == x)) == F.col("n"))))
    fits = lambda x: F.coalesce(x.try_cast("double") >= F.col("lo"), F.lit(True)) & F.coalesce(x.try_cast("double") <= F.col("hi"), F.lit(True))
    out = grouped.select("row_id", "field", "lo", "hi", F.when(F.col("n") > 0, F.filter(common, fits)).alias("options"))
    return out.withColumn("empty", F.coalesce(F.col("lo") > F.col("hi"), F.lit(False)) | F.coalesce(F.size("options") == 0, F.lit(False)))


def inconsistent(constraints: DataFrame) -> DataFrame:
    """``field, reason``: constraints no assignment can meet: an empty range or list, a field required and forbidden."""
    own = constraints.where((F.col("kind") == "range") & (F.col("lo") > F.col("hi"))).select("field", F.lit("empty range").alias("reason"))
    none = constraints.where((F.col("kind") == "enum") & (F.coalesce(F.size("options"), F.lit(0)) <= 0)).select("field", F.lit("empty list").alias("reason"))
    free = constraints.where(F.col("cond_field").isNull())
    both = free.groupBy("field").agg(F.max(F.col("kind") == "required").alias("r"), F.max(F.col("kind") == "forbidden").alias("f")).where("r and f").select("field", F.lit("required and forbidden").alias("reason"))
    return own.unionByName(none).unionByName(both).distinct()


def lattice_cover(gold: DataFrame, pieces: DataFrame) -> DataFrame:
    """``key, value, covered``: whether a key's pieces cover its value: an equal one; for a number a span that holds it; for a
    range of whole numbers spans inside it with its ends and every lattice point between (every second one where all ends
    are odd or all even)."""
    span = lambda c: number_span(F.col(c))
    collected = pieces.select("key", canonical_scalar("piece").alias("c"), span("piece").alias("s")).groupBy("key").agg(F.collect_set("c").alias("cs"), F.collect_set("s").alias("ss"))
    rows = gold.select("key", "value", canonical_scalar("value").alias("g"), span("value").alias("gs")).join(collected, "key", "left")
    inside = F.filter("ss", lambda p: (p["lo"] >= F.col("gs.lo")) & (p["hi"] <= F.col("gs.hi")))
    ends = F.flatten(F.array(F.array(F.col("gs.lo"), F.col("gs.hi")), F.flatten(F.transform("ss", lambda p: F.array(p["lo"], p["hi"])))))
    step = F.when(F.forall(ends, lambda x: F.pmod(x, F.lit(2)) == 0) | F.forall(ends, lambda x: F.pmod(x, F.lit(2)) == 1), 2).otherwise(1)
    points = F.sequence(F.col("gs.lo").cast("bigint"), F.col("gs.hi").cast("bigint"), step)
    whole = (F.array_min(F.transform(inside, lambda p: p["lo"])) == F.col("gs.lo")) & (F.array_max(F.transform(inside, lambda p: p["hi"])) == F.col("gs.hi")) & F.forall(
        points, lambda x: F.exists(inside, lambda p: (p["lo"] <= x) & (x <= p["hi"]))
    )
    covered = (
        F.when(F.array_contains("cs", F.col("g")), True)
        .when(F.col("gs").isNull() | F.col("ss").isNull(), False)
        .when(F.col("gs.lo") == F.col("gs.hi"), F.exists("ss", lambda p: (p["lo"] <= F.col("gs.lo")) & (F.col("gs.lo") <= p["hi"])))
        .otherwise(whole)
    )
    return rows.select("key", "value", F.coalesce(covered, F.lit(False)).alias("covered"))
