"""Office documents: zipped XML of both families into paragraphs and tables, charts into tables, then chunks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from loam.sources.chunkers import WINDOW_CHARS

#: Bounds of repeated cells and of a table.
MOST_REPEATS, MOST_CELLS = 4096, 1_000_000
#: Fixed value: columns that the format allows a sheet.
MOST_COLUMNS = 16_384


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        kind = _local(x.tag)
        if kind in ("tab", "s"):
            out.append(" ")
        elif kind in ("br", "line-break", "cr"):
            out.append("\n")
        if x.text and kind in ("t", "p", "span", "a", "h", "v"):
            out.append(x.text)
        if x.tail and kind in ("span", "a", "s", "tab", "line-break"):
            out.append(x.tail)
    return "".join(out).strip()


def to_markdown(rows: list[list[str]]) -> str:
    """A pipe table: the first row is its header, short rows are padded to the widest."""
    if not rows:
        return ""
    width = max(map(len, rows))
    clean = [[re.sub(r"\s*\n\s*", " ", c).replace("|", r"\|") for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(clean[0]), line(["---"] * width), *map(line, clean[1:])])


def densify(cells: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of ``(text, row span, column span)`` with each merged cell's text in all its places."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(cells):
        col = 0
        for text, down, right in row:
            while (r, col) in grid:
                col += 1
            for a in range(r, min(r + max(1, down), len(cells))):
                for b in range(col, col + max(1, right)):
                    if len(grid) < MOST_CELLS:
                        grid[a, b] = text
            col += max(1, right)
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(cells))]


def _docx(z: zipfile.ZipFile) -> list[tuple[str, object]]:
    body = next(ElementTree.fromstring(z.read("word/document.xml")).iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}body"))
    out: list[tuple[str, object]] = []
    for node in body:
        if _local(node.tag) == "p":
            style = next((_attr(x, "val") or "" for x in node.iter() if _local(x.tag) == "pStyle"), "")
            level = re.search(r"(?i)heading\s*([1-6])", style)
            if text := _text(node):
                out.append((f"h{level.group(1)}", text) if level else ("p", text))
        elif _local(node.tag) == "tbl":
            rows = []
            above: dict[int, int] = {}
            for tr in (x for x in node if _local(x.tag) == "tr"):
                row, col = [], 0
                for tc in (x for x in tr if _local(x.tag) == "tc"):
                    span = int(next((_attr(x, "val") or 1 for x in tc.iter() if _local(x.tag) == "gridSpan"), 1))
                    merge = next((x for x in tc.iter() if _local(x.tag) == "vMerge"), None)
                    goes_on = merge is not None and (_attr(merge, "val") or "continue") == "continue"
                    text = rows[-1][above[col]][0] if goes_on and rows and col in above and above[col] < len(rows[-1]) else _text(tc)
                    above[col] = len(row)
                    row.append((text, 1, span))
                    col += span
                rows.append(row)
            out.append(("table", densify(rows)))
    return out


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, object]]:
    names = set(z.namelist())
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [_attr(x, "name") or "" for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"] if "xl/workbook.xml" in names else []
    out: list[tuple[str, object]] = []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for k, name in enumerate(sheets):
        rows = []
        for row in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
            cells: dict[int, str] = {}
            for c in (x for x in row if _local(x.tag) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                col = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1 if letters else len(cells)
                value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _text(c)
                if col >= MOST_COLUMNS:
                    raise ValueError(f"a cell in column {col + 1}; a sheet has {MOST_COLUMNS} at most")
                cells[col] = value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        out.append(("h1", titles[k] if k < len(titles) else f"Sheet{k + 1}"))
        out.append(("table", [r for r in rows if any(r)]))
    return out


def _pptx(z: zipfile.ZipFile) -> list[tuple[str, object]]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: list[tuple[str, object]] = []
    for k, name in enumerate(slides, 1):
        root = ElementTree.fromstring(z.read(name))
        texts = [t for p in root.iter() if _local(p.tag) == "p" and (t := "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip())]
        out.append(("h1", f"Slide {k}"))
        out.extend(("p", t) for t in texts)
    return out


def _odf(z: zipfile.ZipFile) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []

    def walk(node: ElementTree.Element) -> None:
        for x in node:
            kind = _local(x.tag)
            if kind == "h" and (t := _text(x)):
                out.append((f"h{min(6, int(_attr(x, 'outline-level') or 1))}", t))
            elif kind == "p" and (t := _text(x)):
                out.append(("p", t))
            elif kind == "table":
                if name := _attr(x, "name"):
                    out.append(("h1", name))
                rows = []
                for tr in (y for y in x.iter() if _local(y.tag) == "table-row"):
                    row: list[tuple[str, int, int]] = []
                    for tc in (y for y in tr if _local(y.tag) in ("table-cell", "covered-table-cell")):
                        times = min(int(_attr(tc, "number-columns-repeated") or 1), MOST_REPEATS)
                        text = "\n".join(t for p in tc if (t := _text(p)))
                        if _local(tc.tag) == "table-cell":
                            row.extend([(text, int(_attr(tc, "number-rows-spanned") or 1), int(_attr(tc, "number-columns-spanned") or 1))] * times)
                    while row and not row[-1][0]:
                        row.pop()
                    rows.extend([row] * (min(int(_attr(tr, "number-rows-repeated") or 1), MOST_REPEATS) if row else 1))
                while rows and not rows[-1]:
                    rows.pop()
                out.append(("table", densify(rows)))
            else:
                walk(x)

    walk(ElementTree.fromstring(z.read("content.xml")))
    return out


def ooxml_charts(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    """Charts as ``(title, table)``: a header of series names, a row a category, missing values empty."""
    out = []
    for name in sorted(n for n in z.namelist() if re.search(r"/charts/chart\d+\.xml$", n)):
        root = ElementTree.fromstring(z.read(name))
        title = next((_text(x) for x in root.iter() if _local(x.tag) == "title"), "") or posixpath.basename(name)[:-4]
        series, rows = [], {}
        for k, ser in enumerate(x for x in root.iter() if _local(x.tag) == "ser"):
            part = {_local(x.tag): x for x in ser}
            points = lambda key: {int(p.get("idx") or 0): next((v.text or "" for v in p if _local(v.tag) == "v"), "") for p in (part[key].iter() if key in part else ()) if _local(p.tag) == "pt"}  # noqa: B023, E731
            label = points("tx").get(0) or f"Series {k + 1}"
            series.append(label)
            categories = points("cat") or points("xVal")
            for i, v in (points("val") or points("yVal")).items():
                rows.setdefault(categories.get(i, str(i + 1)), {})[k] = v
        if series:
            out.append((title, [["", *series], *[[c, *[vals.get(k, "") for k in range(len(series))]] for c, vals in rows.items()]]))
    return out


def assemble(parts: list[tuple[str, object]], limit: int = WINDOW_CHARS) -> list[tuple[str, str]]:
    """Chunks under heading breadcrumbs; a new one begins where the next part would pass the limit, but a caption stays
    with the table that follows it."""
    out: list[tuple[str, str]] = []
    path: list[str] = []
    body: list[str] = []

    def close() -> None:
        if any(b.strip() for b in body):
            out.append((" > ".join(path), "\n\n".join(body)))
        body.clear()

    for k, (kind, value) in enumerate(parts):
        if kind[0] == "h" and kind[1:].isdigit():
            close()
            path = [*path[: int(kind[1:]) - 1], str(value)]
            continue
        text = to_markdown(value) if kind == "table" else str(value)
        before_table = kind == "p" and k + 1 < len(parts) and parts[k + 1][0] == "table"
        extra = len(to_markdown(parts[k + 1][1])) if before_table else 0
        if body and sum(map(len, body)) + len(text) + extra > limit and not (kind == "table" and len(body) == 1):
            close()
        body.append(text)
    close()
    return out


def office(data: bytes, file_type: str) -> list[tuple[str, str]]:
    """Chunks of a document of a zipped office format; a file that cannot be read has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            read = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "odt": _odf, "ods": _odf, "odp": _odf}[file_type]
            charts = [] if file_type.startswith("od") else ooxml_charts(z)
            return assemble(read(z)) + [(title, to_markdown(rows)) for title, rows in charts]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, ValueError):
        return []
