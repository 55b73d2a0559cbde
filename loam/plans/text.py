"""Search, line-scan, chunk and path queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import grep as R
from loam.operators import search as S
from loam.session import table

QUERY = "pressure sensor alarm"
ANCHORS, ASKED = ["maintenance"], "maintenance of the gear unit or the pump"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """The newest row of each chunk."""
    c = table(s, d, "chunks")
    rest = [x for x in c.columns if x != "chunk_id"]
    return c.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("indexed_at", "ord")).alias("r")).select("chunk_id", "r.*")


def bm25_search(s: SparkSession, d: str) -> DataFrame:
    return S.bm25_search(_docs(s, d), "doc_id", "text", QUERY, analyzer=T.words).select("doc_id", F.round("score", 6).alias("score"))


STEMMED = "sensors alarms"


def bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    """The default search, by stems."""
    return S.bm25_search(_docs(s, d), "doc_id", "text", STEMMED).select("doc_id", F.round("score", 6).alias("score"))


def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    """The same ranking as ``bm25_search`` from an inverted index, of which only the query's terms are read."""
    docs = _docs(s, d)
    sizes = docs.agg(F.count("*").alias("n"), F.avg(F.size(T.words("text"))).alias("average")).first()
    index = S.postings(docs, "doc_id", "text")
    return S.search_postings(index, "doc_id", QUERY.split(), sizes.n, sizes.average, 20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    return S.bm25_search(_docs(s, d), "doc_id", "text", QUERY, analyzer=T.words, keep=F.col("source").rlike(T.glob_regex("manual*")) & (F.col("file_type") == "docx")).select("doc_id", F.round("score", 6).alias("score"))


def postings_size(s: SparkSession, d: str) -> DataFrame:
    p = S.postings(_docs(s, d), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 5")


def doc_stats(s: SparkSession, d: str) -> DataFrame:
    n = F.size(T.words("text"))
    return _docs(s, d).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("average"))


def rrf_fuse(s: SparkSession, d: str) -> DataFrame:
    def ranked(q: str) -> DataFrame:
        top = S.bm25_search(_docs(s, d), "doc_id", "text", q, 50, analyzer=T.words)
        return top.select("doc_id", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "doc_id")) - 1).alias("rank"))

    return S.reciprocal_rank_fusion(ranked("pressure sensor"), ranked("sensor alarm"), "doc_id", both=1.5).select("doc_id", F.round("score", 6).alias("score"))


def resolve_entity(s: SparkSession, d: str) -> DataFrame:
    return S.resolve_entity(table(s, d, "nodes"), " spare  PARTS ").select("id", F.round("score", 6).alias("score"))


def compose(s: SparkSession, d: str) -> DataFrame:
    return S.compose(table(s, d, "nodes"), ANCHORS, ASKED).select("id", F.round("score", 6).alias("score"))


def label_bm25(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "node_upserts").where(F.col("label").isNotNull()).groupBy("label").agg(F.min("upsert_id").alias("id"))
    return S.label_similarity(nodes, "id", "label").select("a", "b", F.round("ratio", 6).alias("ratio"))


def grep_lines(s: SparkSession, d: str) -> DataFrame:
    return R.grep(_docs(s, d), ["doc_id"], "text", "pressure sensor").select("doc_id", "line_no", "line")


def grep_smart_case(s: SparkSession, d: str) -> DataFrame:
    return R.grep(_docs(s, d), ["doc_id"], "text", r"Alarm [0-9]+").select("doc_id", "line_no", "line")


def grep_word(s: SparkSession, d: str) -> DataFrame:
    return R.grep(_docs(s, d), ["doc_id"], "text", "pump", word=True).select("doc_id", "line_no", "line")


def grep_context(s: SparkSession, d: str) -> DataFrame:
    return R.grep(_docs(s, d), ["doc_id"], "text", "ERR_[0-9]+", before=1, after=2)


def grep_max_count(s: SparkSession, d: str) -> DataFrame:
    return R.grep(_docs(s, d), ["doc_id"], "text", "the", max_count=2).select("doc_id", "line_no", "line")


def grep_count(s: SparkSession, d: str) -> DataFrame:
    return R.grep_count(_docs(s, d), ["doc_id"], "text", "ab")


def grep_only(s: SparkSession, d: str) -> DataFrame:
    return R.grep_only(_docs(s, d), ["doc_id"], "text", "ERR_[0-9]+")


def grep_files(s: SparkSession, d: str) -> DataFrame:
    return R.grep_files(_chunks(s, d), "doc_path", "text", "gear unit|ab")


def grep_multiline(s: SparkSession, d: str) -> DataFrame:
    return R.grep_multiline(_docs(s, d), ["doc_id"], "text", r"What happens[^?]*\?\nThe unit raises")


def glob_docs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").where(F.col("doc_path").rlike(T.glob_regex("{manuals,qa}/*-0000*.{md,pdf}")))
    return c.groupBy("doc_path").agg(F.max("ord").alias("n_chunks"))


def doc_chunk_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").groupBy("doc_path").agg(F.max("ord").alias("n_chunks"))


def chunk_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Previous and next order number of each chunk where it is within fifty."""
    rows = table(s, d, "chunks").select("doc_path", "ord").distinct()
    w = Window.partitionBy("doc_path").orderBy("ord")
    near = lambda x: F.when(F.abs(x - F.col("ord")) <= 50, x)
    return rows.select("doc_path", "ord", near(F.lag("ord").over(w)).alias("prev"), near(F.lead("ord").over(w)).alias("next"))


def read_region(s: SparkSession, d: str) -> DataFrame:
    """Chunks at a location of each document: the exact one in any case, else where it is a part, else all."""
    want = "notes on velmar 30"
    loc = F.lower(F.coalesce("location", F.lit("")))
    rank = F.when(loc == want, 2).when(loc.contains(want), 1).otherwise(0)
    rows = table(s, d, "chunks").select("doc_path", "ord", rank.alias("r")).distinct()
    best = rows.groupBy("doc_path").agg(F.max("r").alias("best"))
    return rows.join(best, "doc_path").where("r = best").select("doc_path", "ord", "best")


def whole_documents(s: SparkSession, d: str) -> DataFrame:
    """Each document read whole: its chunks in order; only the length and a digest are shown."""
    rows = table(s, d, "chunks").select("doc_path", "ord", F.coalesce("text", F.lit("")).alias("text")).distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("doc_path").agg(joined.alias("t")).select("doc_path", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def structural_edges(s: SparkSession, d: str) -> DataFrame:
    """CONTAINS of documents and chunks, NEXT of neighbouring chunks."""
    rows = table(s, d, "chunks").select("doc_path", "ord").distinct()
    section = F.concat("doc_path", F.lit("#"), F.col("ord").cast("string"))
    after = F.lead("ord").over(Window.partitionBy("doc_path").orderBy("ord"))
    contains = rows.select(F.col("doc_path").alias("efrom"), F.lit("CONTAINS").alias("edge_type"), section.alias("eto"))
    nxt = rows.select(section.alias("efrom"), F.lit("NEXT").alias("edge_type"), F.concat("doc_path", F.lit("#"), after.cast("string")).alias("eto")).where(F.col("eto").isNotNull())
    return contains.unionByName(nxt)


def parent_edges(s: SparkSession, d: str) -> DataFrame:
    """PARENT of a chunk: the latest earlier chunk of the file at the nearest existing prefix of its breadcrumb."""
    rows = table(s, d, "chunks").where(F.col("location").contains(" > ")).select("doc_path", "ord", F.split("location", " > ").alias("crumb")).distinct()
    up = rows.select("doc_path", "ord", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("crumb") - 1), lambda k: F.array_join(F.slice("crumb", F.lit(1), k), " > "))).alias("depth", "prefix"))
    places = table(s, d, "chunks").select("doc_path", F.col("ord").alias("p_ord"), F.col("location").alias("prefix")).distinct()
    found = up.join(places, ["doc_path", "prefix"]).where("p_ord < ord").groupBy("doc_path", "ord").agg(F.max(F.struct("depth", "p_ord")).alias("b"))
    section = lambda x: F.concat("doc_path", F.lit("#"), F.col(x).cast("string"))
    return found.select(section("ord").alias("efrom"), F.lit("PARENT").alias("edge_type"), section("b.p_ord").alias("eto"))


def text_hashes(s: SparkSession, d: str) -> DataFrame:
    """Node ids as the graph makes them: type prefix and FNV-1a of the normalized label. Checked by tests, not by SQL."""
    return table(s, d, "nodes").where(F.col("label").isNotNull()).select("label", F.concat(F.lower(F.substring("node_type", 1, 3)), F.lit(":"), T.fnv1a32(T.normalize_label("label"))).alias("node_id")).distinct()


def normalized_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes").where(F.col("label").isNotNull()).select(T.normalize_label("label").alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))


def trigram_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "node_upserts").where(F.col("label").isNotNull()).select("label").distinct().select(F.explode(T.trigrams("label")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def _escaped(x: str):
    out = F.coalesce(F.col(x), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def html_text(s: SparkSession, d: str) -> DataFrame:
    """Markup made of each document's title and whole text, and its text again."""
    page = F.concat(F.lit("<html><head><style>p {x}</style><script>var a = '<b>';</script></head><body><h1>"), _escaped("title"), F.lit("</h1>\n<p class=\"x\">"), _escaped("text"), F.lit("</p></body></html>"))
    return _docs(s, d).select("doc_id", T.strip_html(page).alias("plain"))


def _link_line():
    return F.concat(F.lit("see [a](docs/"), F.col("doc_id").cast("string"), F.lit(".md#part) ![i](no.png) [w](https://x.org) <a href=\"../b/"), F.col("source"), F.lit(".html\">b</a> [s](#top)"))


def link_targets(s: SparkSession, d: str) -> DataFrame:
    """Links of a line made for each document and of its whole text."""
    return _docs(s, d).select("doc_id", F.explode(T.links(F.concat(F.coalesce(_link_line(), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))).alias("target"))



_W = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Forms of the words of ``STEMMED`` by stem, in texts stemmed as English and as Russian, which leaves Latin words alone.
_FORMS = tuple((tuple(x + end for end in ("", "s", "e", "es", "ed", "ing")), (x,)) for x in ("sensor", "alarm"))


def _stemmed_sql() -> str:
    forms = lambda words: ", ".join(f"'{w}'" for w in words)
    counts = ", ".join(f"len(list_filter(w, lambda x: (NOT r AND x IN ({forms(en)})) OR (r AND x IN ({forms(ru)})))) AS t{i}" for i, (en, ru) in enumerate(_FORMS))
    part = " + ".join(f"(SELECT ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) FROM st) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / (SELECT av FROM st)))" for i in range(len(_FORMS)))
    return (
        f"w AS (SELECT doc_id, {_W.format('text')} AS w, coalesce(regexp_matches(text, '[\u0400-\u04FF]'), false) AS r FROM documents), c AS (SELECT doc_id, len(w) AS len, {counts} FROM w), "
        "st AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c), "
        f"b AS (SELECT doc_id, {part} AS score FROM c WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, doc_id LIMIT 20)"
    )


_LINES = r"l AS (SELECT doc_id, i AS line_no, trim(regexp_replace(ls[i], '\r$', ''), ' ') AS line, regexp_replace(ls[i], '\r$', '') AS raw FROM (SELECT doc_id, ls, unnest(range(1, (CASE WHEN ls[-1] = '' THEN len(ls) - 1 ELSE len(ls) END) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))"


def _bm25_sql(text: str, table_sql: str, key: str, terms: list[str], keep: str = "true", limit: int = 20) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    part = " + ".join(f"(SELECT ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) FROM st) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / (SELECT av FROM st)))" for i in range(len(terms)))
    return (
        f"w AS (SELECT {key}, {_W.format(text)} AS w, {keep} AS k FROM {table_sql}), c AS (SELECT {key}, k, len(w) AS len, {counts} FROM w), "
        f"st AS (SELECT count(*) AS n, avg(len) AS av, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(terms)))} FROM c), "
        f"b AS (SELECT {key}, {part} AS score FROM c WHERE k AND ({' OR '.join(f't{i} > 0' for i in range(len(terms)))}) ORDER BY score DESC, {key} LIMIT {limit})"
    )


def _renamed(sql: str, suffix: str) -> str:
    for name in ("w", "c", "st", "b"):
        sql = sql.replace(f" {name} AS (", f" {name}{suffix} AS (").replace(f"FROM {name})", f"FROM {name}{suffix})").replace(f"FROM {name} WHERE", f"FROM {name}{suffix} WHERE")
        if sql.startswith(f"{name} AS ("):
            sql = f"{name}{suffix} AS (" + sql[len(name) + 5 :]
    return sql.replace("FROM st)", f"FROM st{suffix})")


_LABELS = "lb AS (SELECT label, min(upsert_id) AS id FROM node_upserts WHERE label IS NOT NULL GROUP BY label)"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_CW = f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})))"
_SPLIT_ASKED = "['gear', 'unit', 'pump']"

QUERIES = {f.__name__: f for f in (
    bm25_search, bm25_stemmed, bm25_postings, bm25_filtered, postings_size, doc_stats, rrf_fuse, resolve_entity, compose, label_bm25, grep_lines, grep_smart_case, grep_word, grep_context, grep_max_count, grep_count, grep_only, grep_files, grep_multiline,
    glob_docs, doc_chunk_counts, chunk_neighbours, read_region, whole_documents, structural_edges, parent_edges, text_hashes, normalized_labels, trigram_counts, html_text, link_targets,
)}
SQL = {
    "bm25_search": "WITH " + _bm25_sql("text", "documents", "doc_id", QUERY.split()) + " SELECT doc_id, round(score, 6) AS score FROM b",
    "bm25_postings": "WITH " + _bm25_sql("text", "documents", "doc_id", QUERY.split()) + " SELECT doc_id, round(score, 6) AS score FROM b",
    "bm25_stemmed": "WITH " + _stemmed_sql() + " SELECT doc_id, round(score, 6) AS score FROM b",
    "bm25_filtered": "WITH " + _bm25_sql("text", "documents", "doc_id", QUERY.split(), "coalesce(source LIKE 'manual%' AND file_type = 'docx', false)") + " SELECT doc_id, round(score, 6) AS score FROM b",
    "postings_size": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_W.format('text')}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 5",
    "doc_stats": f"SELECT count(*) AS n_docs, sum(n) AS n_tokens, max(n) AS longest, round(avg(n), 6) AS average FROM (SELECT len({_W.format('text')}) AS n FROM documents)",
    "rrf_fuse": "WITH " + _renamed(_bm25_sql("text", "documents", "doc_id", ["pressure", "sensor"], limit=50), "1") + ", " + _renamed(_bm25_sql("text", "documents", "doc_id", ["sensor", "alarm"], limit=50), "2")
    + ", r1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM b1), r2 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM b2) "
    "SELECT coalesce(r1.doc_id, r2.doc_id) AS doc_id, round((coalesce(1 / (10 + r1.r), 0) + coalesce(1 / (10 + r2.r), 0)) * CASE WHEN r1.r IS NOT NULL AND r2.r IS NOT NULL THEN 1.5 ELSE 1 END, 6) AS score FROM r1 FULL JOIN r2 ON r1.doc_id = r2.doc_id",
    "resolve_entity": r"SELECT id, 1.0::DOUBLE AS score FROM nodes WHERE trim(regexp_replace(lower(label), '\s+', ' ', 'g')) = 'spare parts'",
    "compose": f"WITH g AS (SELECT id, {_CW.format(chr(34) + 'full' + chr(34))} AS w FROM (SELECT id, concat_ws(' ', label, array_to_string(aliases, ' ')) AS \"full\" FROM nodes)), m AS (SELECT *, list_contains(w, 'maintenance')::INT AS h FROM g), "
    f"x AS (SELECT id, w FROM m WHERE h > 0), d AS (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM g) WHERE list_contains({_SPLIT_ASKED}, t) GROUP BY t) "
    "SELECT id, round(sum(ln(1 + (SELECT count(*) FROM g) / (1 + df))), 6) AS score FROM (SELECT id, unnest(w) AS t FROM x) JOIN d USING (t) GROUP BY id ORDER BY sum(ln(1 + (SELECT count(*) FROM g) / (1 + df))) DESC, id LIMIT 20",
    "label_bm25": f"WITH {_LABELS}, wl AS (SELECT id AS k, {_W.format('label')} AS w FROM lb), ix AS (SELECT k, len(w) AS len, unnest(w) AS t FROM wl), tf AS (SELECT k, len, t, count(*) AS tf FROM ix GROUP BY 1, 2, 3), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM wl WHERE len(w) > 0), "
    "we AS (SELECT t, k, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) AS x FROM tf JOIN df USING (t), st), sc AS (SELECT a.k AS q, b.k AS k, sum(b.x) AS s FROM tf a JOIN we b USING (t) GROUP BY 1, 2), ow AS (SELECT q, s AS own FROM sc WHERE q = k), "
    "tp AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, k) AS r FROM sc), ok AS (SELECT * FROM tp WHERE r <= 6), sf AS (SELECT q FROM ok WHERE q = k) "
    "SELECT least(ok.q, k) AS a, greatest(ok.q, k) AS b, round(max(s / own), 6) AS ratio FROM ok JOIN ow ON ow.q = ok.q JOIN sf ON sf.q = ok.q WHERE ok.q <> k AND s / own >= 0.3 GROUP BY 1, 2",
    "grep_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(raw, '(?i)pressure\\s+sensor')",
    "grep_smart_case": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(raw, 'Alarm\\s+[0-9]+')",
    "grep_word": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(raw, '(?i)(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])pump($|[^\\p{{L}}\\p{{N}}_\\p{{M}}])')",
    "grep_context": f"WITH {_LINES}, h AS (SELECT *, regexp_matches(raw, 'ERR_[0-9]+') AS hit FROM l) SELECT doc_id, line_no, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind FROM (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near",
    "grep_max_count": f"WITH {_LINES} SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(raw, '(?i)the')) WHERE k <= 2",
    "grep_count": f"WITH {_LINES} SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(raw, '(?i)ab') GROUP BY doc_id",
    "grep_only": f"WITH {_LINES} SELECT doc_id, line_no, unnest(regexp_extract_all(raw, 'ERR_[0-9]+')) AS found FROM l",
    "grep_files": r"SELECT doc_path, count(*) AS n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, ord DESC) AS k FROM chunks) WHERE k = 1 AND regexp_matches(text, '(?i)(gear\s+unit|ab)') GROUP BY doc_path",
    "glob_docs": r"SELECT doc_path, max(ord) AS n_chunks FROM chunks WHERE regexp_full_match(doc_path, '(manuals|qa)/.*-0000.*\.(md|pdf)') GROUP BY doc_path",
    "doc_chunk_counts": "SELECT doc_path, max(ord) AS n_chunks FROM chunks GROUP BY doc_path",
    "chunk_neighbours": "SELECT doc_path, ord, CASE WHEN ord - p <= 50 THEN p END AS prev, CASE WHEN n - ord <= 50 THEN n END AS next FROM (SELECT *, lag(ord) OVER w AS p, lead(ord) OVER w AS n FROM (SELECT DISTINCT doc_path, ord FROM chunks) WINDOW w AS (PARTITION BY doc_path ORDER BY ord))",
    "read_region": "WITH r AS (SELECT DISTINCT doc_path, ord, CASE WHEN lower(coalesce(location, '')) = 'notes on velmar 30' THEN 2 WHEN contains(lower(coalesce(location, '')), 'notes on velmar 30') THEN 1 ELSE 0 END AS r FROM chunks) SELECT doc_path, ord, best FROM (SELECT *, max(r) OVER (PARTITION BY doc_path) AS best FROM r) WHERE r = best",
    "whole_documents": "SELECT doc_path, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_path, string_agg(text, chr(10) ORDER BY ord, text) AS t FROM (SELECT DISTINCT doc_path, ord, coalesce(text, '') AS text FROM chunks) GROUP BY doc_path)",
    "structural_edges": "WITH c AS (SELECT DISTINCT doc_path, ord FROM chunks), n AS (SELECT *, lead(ord) OVER (PARTITION BY doc_path ORDER BY ord) AS x FROM c) SELECT doc_path AS efrom, 'CONTAINS' AS edge_type, doc_path || '#' || ord AS eto FROM c UNION ALL SELECT doc_path || '#' || ord, 'NEXT', doc_path || '#' || x FROM n WHERE x IS NOT NULL",
    "parent_edges": "WITH c AS (SELECT DISTINCT doc_path, ord, location FROM chunks), u AS (SELECT doc_path, ord, unnest(range(1, len(string_split(location, ' > ')))) AS k, string_split(location, ' > ') AS s FROM c WHERE contains(location, ' > ')), "
    "f AS (SELECT u.doc_path, u.ord, c.ord AS p, row_number() OVER (PARTITION BY u.doc_path, u.ord ORDER BY k DESC, c.ord DESC) AS r FROM u JOIN c ON c.doc_path = u.doc_path AND c.location = array_to_string(s[1:k], ' > ') AND c.ord < u.ord) SELECT doc_path || '#' || ord AS efrom, 'PARENT' AS edge_type, doc_path || '#' || p AS eto FROM f WHERE r = 1",
    "normalized_labels": r"SELECT trim(regexp_replace(lower(label), '\s+', ' ', 'g')) AS norm, count(*) AS n FROM nodes WHERE label IS NOT NULL GROUP BY 1",
    "trigram_counts": "SELECT gram, count(*) AS n FROM (SELECT DISTINCT label, substring(lower(label), i, 3) AS gram FROM (SELECT label, unnest(range(1, length(lower(label)) - 1)) AS i FROM (SELECT DISTINCT label FROM node_upserts WHERE label IS NOT NULL AND length(label) >= 3))) GROUP BY gram",
}
