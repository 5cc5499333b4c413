"""The structure of web pages: sections in sections, and in each its paragraphs, tables, code, lists and mentions, in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<place:int,kind:string,text:string,rows:array<array<string>>,table_type:string,language:string>"
SECTION = f"struct<id:int,parent:int,level:int,title:string,path:string,blocks:array<{BLOCK}>,mentions:array<struct<user_id:string,display_name:string,context:string>>>"
CHUNK = "struct<chunk_id:string,type:string,content:string,section:int>"
TREE = f"title string, sections array<{SECTION}>, chunks array<{CHUNK}>"
# What tables are by their headers' words, the least paragraph, and where a long one is cut.
TABLE_TYPES = (("owner_table", ("담당자", "담당", "pm", "tl")), ("system_table", ("시스템", "서비스", "api", "url")), ("schedule_table", ("일정", "마감", "주기")), ("status_table", ("상태", "진행")))
LEAST_PARAGRAPH, MOST_PARAGRAPH, CONTEXT = 50, 800, 100
MENTION = re.compile(r"@([가-힣]+(?:\s[가-힣]+)?)")
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BREAKS = {"p", "div", "li", "br", "tr", "ul", "ol", "article", "section", "nav", "footer", "header", "main", "body", "blockquote", *_HEADINGS}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.place = "", 0
        self.sections: list[dict] = [self._section(0, None, 0, "", "")]
        self.above: list[int] = [0]  # the sections that what comes next is in
        self.skipped = self.in_title = 0
        self.heading: list[str] | None = None
        self.level = 0
        self.words: list[str] = []
        self.kind = "paragraph"
        self.tables: list[dict] = []
        self.code: list[str] | None = None
        self.language: str | None = None
        self.user: dict | None = None

    @staticmethod
    def _section(i, parent, level, title, path) -> dict:
        return {"id": i, "parent": parent, "level": level, "title": title, "path": path, "blocks": [], "mentions": []}

    @property
    def now(self) -> dict:
        return self.sections[self.above[-1]]

    def block(self, kind: str, text: str, **more) -> None:
        self.place += 1
        self.now["blocks"].append({"place": self.place, "kind": kind, "text": text, "rows": None, "table_type": None, "language": None} | more)

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.block(self.kind, text)

    def handle_starttag(self, tag, attrs) -> None:
        at = dict(attrs)
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag == "title":
            self.in_title += 1
        elif tag in _HEADINGS and not self.tables:
            self.flush()
            self.heading, self.level = [], _HEADINGS[tag]
        elif tag == "table":
            self.flush()
            self.tables.append({"rows": [], "cell": None, "head": False})
        elif self.tables and tag == "tr":
            self.tables[-1]["rows"].append([])
        elif self.tables and tag in ("td", "th"):
            t = self.tables[-1]
            t["rows"] = t["rows"] or [[]]
            t["cell"], t["head"] = [], t["head"] or tag == "th"
        elif tag in ("pre", "code") and self.code is None and not self.tables:
            if tag == "pre":
                self.flush()
                self.code = []
        if tag == "code" and self.code is not None:
            self.language = next((c.removeprefix("language-") for c in (at.get("class") or "").split() if c.startswith("language-")), self.language)
        if tag == "ri:user" or (tag == "a" and "user-mention" in (at.get("class") or "").split()):
            self.user = {"user_id": at.get("ri:account-id") or at.get("ri:userkey") or at.get("data-username"), "display_name": None, "context": ""}
            self.now["mentions"].append(self.user)
        if tag in _BREAKS and not self.tables and self.heading is None and self.code is None:
            self.flush()
            self.kind = "list_item" if tag == "li" else "paragraph"

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = max(0, self.in_title - 1)
        elif tag in _HEADINGS and self.heading is not None:
            self.open_section(" ".join("".join(self.heading).split()))
        elif self.tables and tag in ("td", "th") and self.tables[-1]["cell"] is not None:
            self.end_cell()
        elif self.tables and tag == "table":
            self.end_table()
        elif tag == "pre" and self.code is not None:
            self.end_code()
        elif tag in ("a", "ac:link"):
            self.user = None
        elif tag in _BREAKS and not self.tables and self.code is None and self.heading is None:
            self.flush()
            self.kind = "paragraph"

    def open_section(self, title: str) -> None:
        self.heading = None
        if title:
            while len(self.above) > 1 and self.now["level"] >= self.level:
                self.above.pop()
            path = f"{self.now['path']} > {title}" if self.now["path"] else title
            self.sections.append(self._section(len(self.sections), self.now["id"], self.level, title, path))
            self.above.append(len(self.sections) - 1)

    def end_cell(self) -> None:
        t = self.tables[-1]
        t["rows"][-1].append(" ".join("".join(t["cell"]).split()))
        t["cell"] = None

    def end_table(self) -> None:
        if self.tables[-1]["cell"] is not None:
            self.end_cell()
        t = self.tables.pop()
        rows = [r for r in t["rows"] if r]
        if self.tables and self.tables[-1]["cell"] is not None:  # a table in a cell is the cell's text
            self.tables[-1]["cell"].append(" ".join(c for r in rows for c in r))
        elif rows:
            named = " ".join(rows[0]).lower() if t["head"] else ""
            kind = next((k for k, words in TABLE_TYPES if any(w in named for w in words)), None)
            self.block("table", markdown(rows), rows=rows, table_type=kind)

    def end_code(self) -> None:
        text, self.code = "".join(self.code), None
        if text.strip():
            self.block("code", text, language=self.language)
        self.language = None

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        if self.skipped or self.in_title:
            return
        if self.user is not None and data.strip():
            self.user["display_name"], self.user["context"] = data.strip().removeprefix("@"), data[:CONTEXT]
        else:
            self.now["mentions"] += [{"user_id": None, "display_name": m[1], "context": data[:CONTEXT]} for m in MENTION.finditer(data)]
        to = self.heading if self.heading is not None else self.code if self.code is not None else self.tables[-1]["cell"] if self.tables else self.words
        if to is not None:
            to.append(data)

    def close(self) -> None:
        super().close()
        if self.heading is not None:
            self.open_section(" ".join("".join(self.heading).split()))
        if self.code is not None:
            self.end_code()
        while self.tables:
            self.end_table()
        self.flush()


def markdown(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table, the first as its head; shorter rows are filled up, longer ones cut."""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join(["---"] * width) + "|", *map(line, rows[1:])])


def _cut(text: str) -> list[str]:
    """A long paragraph in runs of whole sentences of some MOST_PARAGRAPH characters."""
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text) if len(text) > MOST_PARAGRAPH else [text]:
        if now and len(now) + len(s) > MOST_PARAGRAPH:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
    return [*out, now] if now else out


def _chunks(sections: list[dict]) -> list[dict]:
    """Headings, then tables, code and paragraphs of over LEAST_PARAGRAPH characters, each kind in order, numbered through."""
    named = [("sec", "section_header", s["title"], s["id"]) for s in sections[1:]]
    for short, kind in (("tbl", "table"), ("code", "code"), ("para", "paragraph")):
        for s in sections:
            for b in s["blocks"]:
                if b["kind"] == kind or (kind == "paragraph" and b["kind"] == "list_item"):
                    parts = [p for p in _cut(b["text"]) if len(p) > LEAST_PARAGRAPH] if kind == "paragraph" else [b["text"]]
                    named += [(short, "code_block" if kind == "code" else kind, p, s["id"]) for p in parts]
    return [{"chunk_id": f"{short}-{i:04d}", "type": kind, "content": text, "section": s} for i, (short, kind, text, s) in enumerate(named, 1)]


def parsed(html: str | None) -> tuple[str, list[dict], list[dict]]:
    """(title, sections, chunks) of a page. Section 0 is the page itself; a heading opens a section within the last one of a smaller
    level. place: blocks are numbered through the page. Of a null or empty page there is section 0 alone."""
    p = _Tree()
    p.feed(html or "")
    p.close()
    title = " ".join(p.title.split())
    p.sections[0]["title"] = title
    return title, p.sections, _chunks(p.sections)


def page_tree(html: Column) -> Column:
    """title, sections and chunks of pages, as `parsed` gives them."""
    return F.pandas_udf(_page_trees, TREE)(html)


#: Characters of pages that are parsed before their trees are given out, which are some times larger in Python.
MOST_CHARS = 1 << 20


def _page_trees(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for html in pages:
        made, n = [], 0
        for h in html:
            made.append(parsed(h))
            n += len(h or "")
            if n >= MOST_CHARS:
                yield pd.DataFrame(made, columns=["title", "sections", "chunks"])
                made, n = [], 0
        if made or not len(html):
            yield pd.DataFrame(made, columns=["title", "sections", "chunks"])
