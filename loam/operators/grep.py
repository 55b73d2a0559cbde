"""Line search by regular expression with context, counts and matches, and a sound trigram prefilter.

A text's lines stay in one array of one row, so context is a matter of array positions: nothing is shuffled.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import any_of, lines

#: Most characters of a shown line, and the context a tool call has by default.
LINE_CAP, DEFAULT_CONTEXT = 500, 8
#: Parts of an alternation or sequence beyond which the prefilter gives up.
MOST_PARTS = 8


def prepare(pattern: str, fixed: bool = False, word: bool = False, ignore_case: bool | None = None, multiline: bool = False) -> str:
    """The Java regular expression of a search: smart case by default (an upper-case letter makes it exact), runs of blanks
    outside classes match any white space."""
    if fixed and not re.search(r"[.*+?()|\[\]{}^$\\]", pattern):
        body = re.sub(r" +", r"\\s+", re.escape(pattern).replace(r"\ ", " "))
    else:
        body = re.sub(r"(\[[^\]]*\])| +", lambda m: m.group(1) or r"\s+", pattern)
    if re.search(r"\(\?<?[=!]|\\[1-9]", body):
        raise ValueError("look-around and back-references are not supported")
    if word:
        body = rf"\b(?:{body})\b"
    insensitive = not any(ch.isupper() for ch in pattern) if ignore_case is None else ignore_case
    return ("(?i)" if insensitive else "") + ("(?s)" if multiline else "") + body


def trigram_plan(pattern: str) -> tuple | None:
    """What any matching text must contain: ``("and", [...])`` and ``("or", [...])`` over lower-case literals of three
    characters or more; None where nothing is sure. An alternative that is not sure makes the whole alternation unsure."""

    def walk(nodes) -> tuple | None:
        parts, literal = [], ""

        def close() -> None:
            nonlocal literal
            if len(literal) >= 3:
                parts.append(literal.lower())
            literal = ""

        for op, arg in nodes:
            if op is sre.LITERAL:
                literal += chr(arg)
                continue
            close()
            if op is sre.SUBPATTERN:
                inner = walk(arg[3])
                if inner:
                    parts.append(inner)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                inner = walk(arg[2])
                if inner:
                    parts.append(inner)
            elif op is sre.BRANCH:
                options = [walk(x) for x in arg[1]]
                if all(options) and len(options) <= MOST_PARTS:
                    parts.append(("or", options))
        close()
        return ("and", parts[:MOST_PARTS]) if parts else None

    try:
        return walk(list(_parser.parse(pattern)))
    except re.error:
        return None


def plan_filter(plan: tuple | str | None, text: Column) -> Column:
    """The plan as a condition on a text; true where the plan is not sure."""
    if plan is None:
        return F.lit(True)
    low = F.lower(text)
    if isinstance(plan, str):
        return low.contains(plan)
    conditions = [plan_filter(p, text) for p in plan[1]]
    if plan[0] == "or":
        return any_of(conditions)
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def _candidates(chunks: DataFrame, text: str, pattern: str) -> DataFrame:
    """Chunks that can match. Letters whose lower case is no plain ASCII keep out of the prefilter's way."""
    plan = trigram_plan(re.sub(r"^\(\?[is]+\)", "", re.sub(r"^(\(\?[is]+\))+", "", pattern)))
    sure = plan if plan is None or str(plan).isascii() else None
    return chunks.where(F.col(text).isNotNull() & plan_filter(sure, F.col(text)) & F.col(text).rlike("(?m)" + pattern))


def grep(chunks: DataFrame, key: list[str], text: str, pattern: str, before: int = 0, after: int = 0, max_count: int | None = None, **flags) -> DataFrame:
    """``key..., line_no, line, kind``: matching lines (trimmed, numbered from 1) and, with context, the lines around them,
    each once, as ``match`` or ``context``. ``max_count`` keeps the first matches of each chunk before context."""
    regex = prepare(pattern, **flags)
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), x.rlike(regex).alias("hit")))
    rows = _candidates(chunks, text, regex).select(*key, numbered.alias("l"))
    hits = F.transform(F.filter("l", lambda x: x["hit"]), lambda x: x["line_no"])
    rows = rows.select(*key, "l", (F.slice(hits, 1, max_count) if max_count is not None else hits).alias("h")).where(F.size("h") > 0)
    kept = F.filter("l", lambda x: F.exists("h", lambda n: (n >= x["line_no"] - after) & (n <= x["line_no"] + before)))
    out = rows.select(*key, "h", F.explode(kept).alias("x"))
    return out.select(*key, "x.line_no", F.trim("x.line").alias("line"), F.when(F.array_contains("h", F.col("x.line_no")), "match").otherwise("context").alias("kind"))


def grep_count(chunks: DataFrame, key: list[str], text: str, pattern: str, **flags) -> DataFrame:
    """``key..., n``: matching lines of each chunk that has any."""
    regex = prepare(pattern, **flags)
    n = F.size(F.filter(lines(text), lambda x: x.rlike(regex)))
    return _candidates(chunks, text, regex).select(*key, n.alias("n")).where("n > 0")


def grep_only(chunks: DataFrame, key: list[str], text: str, pattern: str, **flags) -> DataFrame:
    """``key..., line_no, found``: every match that does not overlap another, trimmed."""
    regex = prepare(pattern, **flags)
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_extract_all(x, F.lit(regex), F.lit(0)).alias("m")))
    rows = _candidates(chunks, text, regex).select(*key, F.explode(numbered).alias("x"))
    return rows.select(*key, "x.line_no", F.explode("x.m").alias("found")).select(*key, "line_no", F.trim("found").alias("found"))


def grep_files(chunks: DataFrame, path: str, text: str, pattern: str, **flags) -> DataFrame:
    """``path, n_chunks``: documents with a matching chunk."""
    return _candidates(chunks, text, prepare(pattern, **flags)).groupBy(path).agg(F.count("*").alias("n_chunks"))


def grep_multiline(chunks: DataFrame, key: list[str], text: str, pattern: str, **flags) -> DataFrame:
    """``key..., line_no, found``: matches that may cross lines, with the line each begins on."""
    regex = prepare(pattern, multiline=True, **flags)
    between = F.call_function("split", F.col(text), F.lit(regex), F.lit(-1))
    rows = chunks.where(F.col(text).rlike(regex)).select(*key, F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), between.alias("b"))
    # What lies before the n-th match: the pieces between matches and the matches before it. A match of no characters at the
    # beginning has no piece before it.
    rows = rows.withColumn("b", F.when(F.size("b") <= F.size("m"), F.concat(F.array(F.lit("")), "b")).otherwise(F.col("b")))
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    step = F.aggregate(
        F.arrays_zip("m", F.slice("b", F.lit(1), F.size("m")).alias("b")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line_no:int,found:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["line"] + ends(x["b"]) + ends(x["m"])).alias("line"),
            F.concat(acc["out"], F.array(F.struct((acc["line"] + ends(x["b"])).alias("line_no"), x["m"].alias("found")))).alias("out"),
        ),
    )
    return rows.select(*key, F.explode(step["out"]).alias("x")).select(*key, "x.line_no", F.trim("x.found").alias("found")).distinct()


def cap_line(line: Column, cap: int = LINE_CAP) -> Column:
    """A line for display: whole up to the cap, else its head and how many characters are left out."""
    return F.when(F.length(line) <= cap, line).otherwise(F.concat(F.substring(line, 1, cap), F.lit("… [+"), (F.length(line) - cap).cast("string"), F.lit(" chars]")))
