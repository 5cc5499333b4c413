"""Page trees: every part of a page at its place, found again by patterns."""

import re

from conftest import DATA

from lumenweir.plans import linked_queries
from lumenweir.sources import tree

PAGE = """<html><head><title> The  page </title><style>p{}</style></head><body><p>before</p><h1>A &amp; <b>B</b></h1>one<br>two<div>three <ul><li>item 1</li><li>item 2</li></ul></div>
<h3>C</h3><table><tr><th>담당자</th><th>x|y</th></tr><tr><td>k</td></tr><tr><td>t <table><tr><td>in</td></tr></table></td><td>2</td><td>3</td></tr></table>
<h2>D</h2><pre><code class="hl language-sql">select 1
 from t</code></pre><p>ask @김철수 or <a class="user-mention" data-username="u7">@Eve</a></p><h1></h1><script>no()</script><h1>E<p>unclosed <table><tr><td>last"""


def test_page():
    title, sections, chunks = tree.parsed(PAGE)
    assert title == "The page" and [(s["level"], s["parent"], s["path"]) for s in sections] == [(0, None, ""), (1, 0, "A & B"), (3, 1, "A & B > C"), (2, 1, "A & B > D"), (1, 0, "Eunclosed last")]
    by_path = {s["path"]: [(b["kind"], b["text"]) for b in s["blocks"]] for s in sections}
    assert by_path[""] == [("paragraph", "before")] and sections[0]["title"] == "The page"
    assert by_path["A & B"] == [("paragraph", x) for x in ("one", "two", "three")] + [("list_item", "item 1"), ("list_item", "item 2")]
    assert by_path["A & B > C"] == [("table", "| 담당자 | x|y |\n|---|---|\n| k |  |\n| t in | 2 |")] and sections[2]["blocks"][0]["table_type"] == "owner_table"
    assert by_path["A & B > D"][0] == ("code", "select 1\n from t") and sections[3]["blocks"][0]["language"] == "sql"
    assert sections[3]["mentions"] == [{"user_id": None, "display_name": "김철수", "context": "ask @김철수 or "}, {"user_id": "u7", "display_name": "Eve", "context": "@Eve"}]
    places = [b["place"] for s in sections for b in s["blocks"]]
    assert sorted(places) == list(range(1, len(places) + 1))
    assert [c["chunk_id"] for c in chunks[:5]] == ["sec-0001", "sec-0002", "sec-0003", "sec-0004", "tbl-0005"]


def test_long_paragraphs():
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    chunks = tree.parsed(f"<p>{text}</p><p>short</p>")[2]
    assert " ".join(c["content"] for c in chunks) == text and all(50 < len(c["content"]) <= 830 for c in chunks) and len(chunks) > 2
    assert tree.parsed(None) == tree.parsed("") and len(tree.parsed(None)[1]) == 1


def test_query(spark):
    """Each heading, table, code block and mention of the edited pages, found by patterns, is in the tree below the headings before it."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r["page_id"]: r["h"] for r in pages.select("page_id", linked_queries.edited_page(pages.html).alias("h")).collect()}
    rows = {}
    for r in linked_queries.page_trees(spark, DATA).collect():
        rows.setdefault(r["page_id"], []).append(r)
    kinds = set()
    for i, h in html.items():
        above, want = {}, []
        for m in re.finditer(r"<h([1-6])>([^<]*)</h\1>|<table><tr><th>([^<]*)</th><th>([^<]*)</th></tr><tr><td>([^<]*)</td><td>x</td></tr></table>|<pre><code class=\"language-sql\">([^<]*)</code></pre>", h):
            path = " > ".join(above[k] for k in sorted(above))
            if m[1]:
                above = {k: v for k, v in above.items() if k < int(m[1])} | {int(m[1]): " ".join(m[2].split())}
            elif m[3]:
                want.append((path, "table", f"| {m[3]} | {m[4]} |\n|---|---|\n| {m[5]} | x |", "owner_table", None))
            else:
                want.append((path, "code", m[6], None, "sql"))
        got = sorted(rows.get(i, []), key=lambda r: r["place"])
        assert [(r["path"], r["kind"], r["text"], r["table_type"], r["language"]) for r in got if r["kind"] in ("table", "code")] == want
        kinds |= {r["kind"] for r in got}
        plain = re.sub(r"(?s)<(script|style|title)>.*?</\1>|<!--.*?-->", " ", h)
        paragraphs = [" ".join(x.split()) for x in re.findall(r"<p>([^<]+)</p>", plain)]
        texts = [r["text"] for r in got]
        import html as lib

        assert all(lib.unescape(p) in texts for p in paragraphs if p)
    assert kinds == {"paragraph", "list_item", "table", "code"}
