"""Guarded read-only SQL over four relations, with literals resolved to what the graph holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import words

#: Relations a query may read, rows it returns, candidates a relation name has.
RELATIONS, ROWS, CANDIDATES = ("nodes", "edges", "node_validity", "edges_labeled"), 50, 5
_QUERY_ROOTS = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "UnresolvedWith", "UnresolvedHaving", "SubqueryAlias", "WithWindowDefinition", "UnresolvedInlineTable", "Join"}
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w.]*|<>|!=|<=|>=|[=()<>,;*+\-/]|\S", re.S)


class Rejected(ValueError):
    """A query that is not a single read-only SELECT over the allowed relations."""


def check(spark: SparkSession, sql: str) -> None:
    """Raise ``Rejected`` unless the text is one query whose every table, in joins, subqueries and common table expressions
    alike, is an allowed relation. A name that a common table expression introduces is a table like any other."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own error  # noqa: BLE001
        raise Rejected(f"not a query: {str(e).splitlines()[0]}") from None
    if plan.getClass().getSimpleName() not in _QUERY_ROOTS:
        raise Rejected("only a single read-only SELECT is allowed")
    shown = plan.toString()
    if re.search(r"UnresolvedTableValuedFunction|UnresolvedTVF|ScriptInputOutput|InsertInto", shown):
        raise Rejected("table functions and writes are not allowed")
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shown):
        if name.strip().lower() not in RELATIONS:
            raise Rejected(f"table {name} is not queryable; allowed: {', '.join(RELATIONS)}")


def relation_similarity(spark: SparkSession, query: str, vocabulary: DataFrame, column: str = "edge_type", k: int = CANDIDATES) -> DataFrame:
    """``column, score``: the vocabulary's entries most like a name: 1 if one holds the other, else the greater of word
    overlap and one minus the edit distance over the longer length; ties by name."""
    q = F.lit(query.lower())
    c = F.lower(F.col(column))
    a, b = F.array_distinct(words(F.lit(query))), F.array_distinct(words(column))
    jaccard = F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
    edit = 1 - F.levenshtein(q, c) / F.greatest(F.length(q), F.length(c), F.lit(1))
    score = F.when(q.contains(c) | c.contains(q), 1.0).otherwise(F.greatest(jaccard, edit, F.lit(0.0)))
    return vocabulary.select(column).distinct().select(column, score.alias("score")).orderBy(F.desc("score"), column).limit(k)


def literals(sql: str) -> list[tuple[int, int, str, str]]:
    """``start, end, column, value`` of the equalities ``column = 'text'`` in the outer query's WHERE and ON clauses that
    name a relation or an entity; not under NOT or IN, nor in subqueries, set operations or HAVING."""
    tokens = [(m.start(), m.end(), m.group()) for m in _LITERAL.finditer(sql) if not m.group().startswith(("--", "/*"))]
    upper = [t.upper() for _, _, t in tokens]
    if any(t in ("UNION", "INTERSECT", "EXCEPT", "WITH") for t in upper):
        return []
    out, depth, inside, nested, negated = [], 0, False, [], []
    for k, (_, _, token) in enumerate(tokens):
        word = upper[k]
        if token == "(":
            depth += 1
            if k + 1 < len(tokens) and upper[k + 1] == "SELECT":
                nested.append(depth)
            if k and upper[k - 1] == "NOT":
                negated.append(depth)
        elif token == ")":
            nested = [d for d in nested if d != depth]
            negated = [d for d in negated if d != depth]
            depth -= 1
        elif not nested and word in ("WHERE", "ON"):
            inside = True
        elif not nested and word in ("GROUP", "HAVING", "ORDER", "LIMIT", "SELECT"):
            inside = False
        elif token == "=" and inside and not nested and not negated and 0 < k < len(tokens) - 1 and tokens[k + 1][2].startswith("'"):
            column = tokens[k - 1][2].split(".")[-1].lower()
            before = upper[k - 2] if k > 1 else ""
            if column in ("edge_type", "label", "src_label", "dst_label") and before != "NOT":
                out.append((tokens[k - 1][0], tokens[k + 1][1], tokens[k - 1][2], tokens[k + 1][2][1:-1].replace("''", "'")))
    return out


def resolve(spark: SparkSession, sql: str, labeled: DataFrame) -> str:
    """The query with each relation literal as the most similar relation that real edges between the named entities bear
    (else the most similar), and each entity literal as a match of any part in any case."""
    found = literals(sql)
    entities = [(c.split(".")[-1].lower(), v) for _, _, c, v in found if not c.lower().endswith("edge_type")]
    out, shift = sql, 0
    for start, end, column, value in found:
        quoted = value.replace("'", "''")
        if column.lower().endswith("edge_type"):
            ranked = [r[0] for r in relation_similarity(spark, value, labeled).collect()]
            backed = labeled
            for name, text in entities:
                backed = backed.where(F.col("src_label").ilike(f"%{text}%") | F.col("dst_label").ilike(f"%{text}%") if name == "label" else F.col(name).ilike(f"%{text}%"))
            real = {r[0] for r in backed.where(F.col("edge_type").isin(*ranked)).select("edge_type").distinct().collect()} if ranked else set()
            best = next((r for r in ranked if r in real), ranked[0] if ranked else value)
            new = f"{column} = '{best}'"
        else:
            new = f"{column} ILIKE '%{quoted}%'"
        out = out[: start + shift] + new + out[end + shift :]
        shift += len(new) - (end - start)
    return out


def run(spark: SparkSession, sql: str, relations: dict[str, DataFrame], limit: int | None = ROWS, fuzzy: bool = True) -> DataFrame:
    """The rows of a checked query over the given relations, at most ``limit`` (the tool's answer has fifty)."""
    check(spark, sql)
    if fuzzy and "edges_labeled" in relations:
        sql = resolve(spark, sql, relations["edges_labeled"])
    # The relations are the session's only while the query is analyzed; views of the caller's by these names come back.
    known = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    given = {name: df for name, df in relations.items() if name in RELATIONS}
    kept = {name: spark.table(name) for name in given if name in known}
    try:
        for name, df in given.items():
            df.createOrReplaceTempView(name)
        out = spark.sql(sql)
    finally:
        for name in given:
            spark.catalog.dropTempView(name)
            if name in kept:
                kept[name].createOrReplaceTempView(name)
    return out if limit is None else out.limit(limit)
