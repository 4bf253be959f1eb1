"""Parsing, components and the stream against small fixtures and plain formulations."""

from tidemark.operators import components, parse

PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body><p style="display: none">hidden</p>
<h1>One</h1><p>First&nbsp;text.<p>Second <b>text</b>.</p><h3>Deep</h3><ul><li>a</li><li>b</li></ul>
<table><tr><td>x</td><td></td><td>1</td></tr><tr><td>y|z</td><td></td><td>(2.5)%</td></tr></table><h2>Two</h2>tail"""


def test_blocks():
    assert [b[:3] for b in parse.page_blocks(PAGE)] == [
        ("heading", 1, "One"), ("paragraph", 0, "First text."), ("paragraph", 0, "Second text."), ("heading", 3, "Deep"), ("list_item", 0, "a"), ("list_item", 0, "b"),
        ("table", 0, "| x |  | 1 |\n| --- | --- | --- |\n| y\\|z |  | (2.5)% |"), ("heading", 2, "Two"), ("paragraph", 0, "tail"),
    ]
    assert parse.section_paths(parse.page_blocks(PAGE))[-3:] == [("One", "Deep"), ("One", "Two"), ("One", "Two")]
    assert parse.page_blocks(None) == parse.page_blocks("") == []


def test_passages_keep_all_text():
    found = parse.page_blocks("<h1>H</h1>" + "".join(f"<p>{'word ' * n}end. more.</p>" for n in (10, 200, 300, 50, 2000)))
    made = parse.page_passages(found)
    assert " ".join(" ".join(p[4] for p in made).split()) == " ".join(b[2] for b in found if b[0] != "heading")
    assert all(p[1] == ("H",) for p in made)
    assert [p[0] for p in parse.page_passages(parse.page_blocks(PAGE))] == ["narrative", "narrative", "table", "narrative"]


def test_frames(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (3, "", "z"), (None, PAGE, "w")], "page_id long, html string, text string")
    rows = parse.blocks(pages)
    assert rows.where("page_id = 1").count() == rows.where("page_id IS NULL").count() == 9 and rows.count() == 18
    kind, sure = parse.table_kind("cells")
    assert [tuple(r) for r in rows.where("kind = 'table' AND page_id = 1").select(kind, sure).collect()] == [("data", 0.95)]
    assert parse.passages(pages).where("page_id = 1").count() == 4


def test_components(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n)] + [(None,), (3,)], "id long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i not in (9, 25)] + [(5, 5), (7, 999), (None, 2)], "a long, b long")
    found = dict(tuple(r) for r in components.connected(nodes, links).collect())
    assert found == {i: 0 if i < 10 else 10 if i < 26 else 26 for i in range(n)}
    assert components.connected(nodes.limit(0), links).count() == 0
