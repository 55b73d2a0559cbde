"""Texts into ordered chunks ``(location, text)``, one function a format."""

from __future__ import annotations

import re
from itertools import accumulate

#: A window's lines and characters, a table chunk's rows.
WINDOW_LINES, WINDOW_CHARS, TABLE_ROWS = 100, 4000, 100
#: Character entities decoded in markup.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def decode_text(data: bytes) -> str | None:
    """Text of a file's bytes: by its byte-order mark, as UTF-8, or as the single-byte encoding its letters fit best; None
    for binary data (a zero byte, or a tenth of control characters)."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    head = data[:65536]
    if b"\0" in head or sum(b < 9 or 13 < b < 32 for b in head) * 10 > len(head) > 0:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        high = [b for b in head if b > 127]
        cyrillic = sum(b >= 0xC0 for b in high) > 0.8 * len(high) and len(high) > sum(b < 128 and chr(b).isalpha() for b in head)
        return data.decode("cp1251" if cyrillic else "cp1252", "replace")


def text_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def windows(text: str, max_lines: int = WINDOW_LINES, max_chars: int = WINDOW_CHARS) -> list[tuple[str, str]]:
    """Runs of lines that end once they hold enough lines or characters; a single one has no location, others are
    ``part.N``; blank ones are left out. A line beyond the limit is cut."""
    rows = [line[k : k + max_chars] for line in text_lines(text) for k in range(0, max(1, len(line)), max_chars)]
    total = list(accumulate((len(r) + 1 for r in rows), initial=0))
    cuts, start = [], 0
    for k in range(1, len(rows) + 1):
        if k - start >= max_lines or total[k] - total[start] >= max_chars or k == len(rows):
            cuts.append((start, k))
            start = k
    bodies = ["".join(f"{r}\n" for r in rows[a:b]) for a, b in cuts]
    bodies = [b for b in bodies if b.strip()]
    return [("", bodies[0])] if len(bodies) == 1 else [(f"part.{k}", b) for k, b in enumerate(bodies, 1)]


def heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    return (len(m.group(1)), m.group(2).strip()) if m and m.group(2).strip() else None


def markdown(text: str) -> list[tuple[str, str]]:
    """Bodies between headings under their breadcrumb; text before the first heading has none; a text of headings alone is
    one chunk of them."""
    path: list[str] = []
    titles: list[str] = []
    groups: list[tuple[str, list[str]]] = [("", [])]
    for line in text_lines(text):
        found = heading(line)
        if found is None:
            groups[-1][1].append(line)
            continue
        level, title = found
        path = [*path[: level - 1], title]
        titles.append(title)
        groups.append((" > ".join(path), []))
    out = [(where, "".join(f"{x}\n" for x in body)) for where, body in groups if any(x.strip() for x in body)]
    return out or ([(" > ".join(path), "\n".join(titles))] if titles else [])


def delimited(text: str, rows: int = TABLE_ROWS, start: int = 1) -> list[tuple[str, str]]:
    """A table's data rows in groups, each under the header again, located by the numbers of its rows, from ``start`` on."""
    head, *body = text_lines(text) or [""]
    groups = [(k + start, body[k : k + rows]) for k in range(0, len(body), rows)]
    made = [(f"rows {first}-{first + len(part) - 1}", "".join(f"{x}\n" for x in (head, *part))) for first, part in groups]
    return [(where, chunk) for where, chunk in made if chunk.strip()]


def html_to_text(markup: str) -> str:
    out = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", markup)
    out = re.sub(r"(?s)<[^>]*>", " ", out)
    out = re.sub("|".join(map(re.escape, ENTITIES)), lambda m: ENTITIES[m.group()], out)
    rows = [re.sub(r"[ \t\r]+", " ", r).strip() for r in out.split("\n")]
    kept = [r for k, r in enumerate(rows) if r or (k and rows[k - 1])]
    return "\n".join(kept).strip("\n")


def html(markup: str) -> list[tuple[str, str]]:
    return windows(html_to_text(markup))


def image_name(path: str) -> list[tuple[str, str]]:
    """An image stands for its name: its folder and stem with separators as blanks."""
    parts = path.replace("\\", "/").split("/")
    stem = parts[-1].rsplit(".", 1)[0]
    return [("(image)", " ".join(re.sub(r"[_\-.]", " ", f"{parts[-2] if len(parts) > 1 else ''} {stem}").split()))]
