"""Column expressions over text, all inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of composed queries.
STOP_WORDS = tuple(
    "the a an of in on to is was were are for and or that which who what when where by with at as from into does did do part named after held over it its his her their he she".split()
)
#: Cyrillic letters that look like Latin ones, and the Latin ones.
HOMOGLYPHS = ("авекмнорстух", "abekmhopctyx")
DASHES = "—–−‐"


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalize_label(label: Column | str) -> Column:
    """Trimmed, lower case, each run of blanks one blank."""
    return F.trim(F.regexp_replace(F.lower(c(label)), r"\s+", " "))


def compose_words(text: Column | str) -> Column:
    """Distinct ASCII words of two characters or more that are no stop words."""
    raw = F.split(F.trim(F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def lines(text: Column | str) -> Column:
    """The lines of a text without their ends; a closing line end makes no further line; null has none."""
    parts = F.split(F.coalesce(c(text), F.lit("")), r"\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r$", ""))


def trigrams(text: Column | str) -> Column:
    """Distinct runs of three characters of the lower-case text."""
    low = F.lower(c(text))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def links(text: Column | str) -> Column:
    """Targets of markdown links (no images) and of href attributes inside the corpus, without fragments, in order."""
    md = F.regexp_extract_all(c(text), F.lit(r"(?:^|[^!])\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    href = F.regexp_extract_all(c(text), F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    found = F.concat(F.coalesce(md, F.array().cast("array<string>")), F.coalesce(href, F.array().cast("array<string>")))
    inside = F.filter(found, lambda x: ~F.lower(x).rlike(r"^(https?:|mailto:|//|#)"))
    return F.filter(F.transform(inside, lambda x: F.split_part(x, F.lit("#"), F.lit(1))), lambda x: x != "")


def fnv1a32(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as eight hexadecimal digits."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(c(text), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    mixed = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda acc, b: (acc.bitwiseXOR(b) * F.lit(16777619)) % F.lit(4294967296))
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def canonical_scalar(value: Column | str) -> Column:
    """A cell for comparison: lower case, Latin letters for their Cyrillic doubles, one dash without blanks around it,
    numbers in one spelling (comma or point)."""
    low = F.translate(F.translate(F.lower(F.trim(c(value))), HOMOGLYPHS[0], HOMOGLYPHS[1]), DASHES, "-" * len(DASHES))
    dashed = F.regexp_replace(low, r"\s*-\s*", "-")
    plain = F.replace(dashed, F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(plain.cast("double").cast("string"), r"\.0$", "")).otherwise(dashed)


def number_span(value: Column | str) -> Column:
    """``lo, hi`` of a range label (``25-49``) or a plain number; null for anything else."""
    plain = F.replace(canonical_scalar(value), F.lit(","), F.lit("."))
    one, two = r"^([+-]?\d+(?:\.\d+)?)$", r"^(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)$"
    a, b = F.regexp_extract(plain, two, 1).try_cast("double"), F.regexp_extract(plain, two, 2).try_cast("double")
    single = F.regexp_extract(plain, one, 1).try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))).when(single.isNotNull(), F.struct(single.alias("lo"), single.alias("hi")))


def normalize_answer(text: Column | str) -> Column:
    """Answer text for scoring: lower case, punctuation as blanks, no articles, single blanks."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c(text), F.lit(""))), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"\b(a|an|the)\b", " "), r"\s+", " "))


def strip_html(html: Column | str) -> Column:
    """Text of markup: scripts and styles out, tags as blanks, the common entities decoded once, lines trimmed, runs of
    blank lines made one."""
    out = F.regexp_replace(c(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    trimmed = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob: ``*`` and ``**`` cross separators, ``?`` is one character,
    ``[...]`` a class, ``{a,b}`` alternatives; backslashes are separators; no pattern matches everything."""
    text = pattern.replace("\\", "/")
    if text in ("", "**", "**/*"):
        return "(?s)^.*$"
    out, depth, i = [], 0, 0
    while i < len(text):
        ch = text[i]
        if ch == "*":
            while text[i : i + 1] == "*":
                i += 1
            if text[i : i + 1] == "/" and "".join(out).endswith(("", "/")) and text[i - 2 : i] == "**":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
            continue
        if ch == "?":
            out.append(".")
        elif ch == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            body = text[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]")
            i = end
        elif ch == "{":
            out.append("(?:")
            depth += 1
        elif ch == "}" and depth:
            out.append(")")
            depth -= 1
        elif ch == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + ")" * depth + "$"


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags) if flags else F.lit(False)
