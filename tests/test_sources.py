import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from loam.sources import chunkers, office
from loam.sources.corpus import extract, list_files, read_corpus, read_hotpot, read_trace, window_chunks


def test_windows():
    assert chunkers.windows("a\nb\n") == [("", "a\nb\n")]
    assert [w for w, _ in chunkers.windows("x\n" * 250)] == ["part.1", "part.2", "part.3"]
    assert [len(t) for _, t in chunkers.windows("y" * 9000)] == [4001, 4001, 1001]
    assert chunkers.windows(" \n\n") == [] and chunkers.windows("") == []


@given(st.lists(st.text(alphabet="ab \t", max_size=30), max_size=300))
@settings(max_examples=50, deadline=None)
def test_windows_keep_every_line(rows):
    text = "\n".join(rows)
    joined = "".join(t for _, t in chunkers.windows(text))
    assert [x for x in joined.split("\n") if x.strip()] == [x for x in rows if x.strip()]


def test_markdown():
    text = "intro\n# A\nbody a\n## B\nbody b\n# C\n### D\nbody d\n"
    assert chunkers.markdown(text) == [("", "intro\n"), ("A", "body a\n"), ("A > B", "body b\n"), ("C > D", "body d\n")]
    assert chunkers.markdown("# Only\n## Titles") == [("Only > Titles", "Only\nTitles")]
    assert chunkers.markdown("") == []


def test_delimited():
    text = "h\n" + "\n".join(map(str, range(1, 251)))
    got = chunkers.delimited(text)
    assert [w for w, _ in got] == ["rows 1-100", "rows 101-200", "rows 201-250"]
    assert all(t.startswith("h\n") for _, t in got)
    assert chunkers.delimited("h\n") == []


def test_decoding_and_markup():
    assert chunkers.decode_text("é".encode("utf-8-sig")) == "é" and chunkers.decode_text("é".encode("utf-16")) == "é"
    assert chunkers.decode_text("Größe über".encode("cp1252")) == "Größe über"
    assert chunkers.decode_text("насос в работе".encode("cp1251")) == "насос в работе"
    assert chunkers.decode_text(b"\x00\x01") is None
    assert chunkers.html_to_text("<script>x</script><p>a &amp;lt; b</p>\n\n\n<p>c</p>") == "a &lt; b\n\nc"
    assert chunkers.image_name("photos/pump_seal-2.png") == [("(image)", "photos pump seal 2")]


def test_office_tables():
    assert office.densify([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 1, 1)]]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert office.to_markdown([["x", "y"], ["1"]]) == "| x | y |\n| --- | --- |\n| 1 |  |"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, pr="": f"<w:tc>{pr}{p(t)}</w:tc>"
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("Title", "Heading1")}{p("Caption")}<w:tbl><w:tr>{cell("k")}{cell("v")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert extract("a.docx", buf.getvalue()) == [("Title", "Caption\n\n| k | v |\n| --- | --- |\n| 1 | 2 |")]
    assert extract("b.docx", b"no zip") == []
    odf = '<o xmlns:t="t" xmlns:x="x"><x:h x:outline-level="1">H</x:h><x:p>one <x:span>two</x:span></x:p><t:table t:name="S"><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>z</x:p></t:table-cell></t:table-row></t:table></o>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("content.xml", odf)
    assert extract("a.odt", buf.getvalue()) == [("H", "one two"), ("S", "| z | z |\n| --- | --- |")]


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\nbody\n")
    (tmp_path / "sub" / "b.csv").write_text("h\n1\n2\n")
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    root = str(tmp_path)
    got = {(r.doc_path, r.location, r.ord, r.text) for r in read_corpus(spark, root).collect()}
    assert got == {("a.md", "T", 1, "body\n"), ("sub/b.csv", "rows 1-2", 1, "h\n1\n2\n"), ("sub/d.pdf", "(no-text)", 1, "d")}
    assert {r.doc_path for r in list_files(spark, root, "sub/*").collect()} == {"sub/b.csv", "sub/d.pdf"}
    assert {r.doc_path for r in list_files(spark, root, ignored=("*.pdf", "*.docx")).collect()} == {"a.md", "sub/b.csv"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"_id": "1", "question": "q", "answer": "a", "context": [["T", ["s1", "s2"]]], "supporting_facts": [["T", 0], ["T", 1]]}]')
    row = read_hotpot(spark, str(tmp_path / "h.json")).first()
    assert (row.id, row.paragraphs[0].title, row.paragraphs[0].sentences, row.supporting_titles) == ("1", "T", ["s1", "s2"], ["T"])
    (tmp_path / "t.jsonl").write_text('{"ts_ms": 5, "tool": "grep", "args": {"p": 1}}\nbroken\n{"ts_ms": 2, "tool": "search"}\n')
    assert [r.ts_ms for r in read_trace(spark, str(tmp_path / "t.jsonl"), first_ms=1).collect()] == [2, 5]


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, "a\n" * 150, 0), (2, None, 0), (3, "", 0)], "doc_id BIGINT, text STRING, ord INT")
    assert [(r.doc_id, r.ord, r.location) for r in window_chunks(df, "doc_id", "text").orderBy("ord").collect()] == [(1, 1, "part.1"), (1, 2, "part.2")]
