"""Files as tables: directory scans and their changes, decoded text, JSON lines with checkpoints, front matter, HTML parts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = "doc_id string, filename string, content_hash string, text string, tables array<array<array<string>>>, ocr_text string, metadata map<string,string>"


def scan(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, length, sha256, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length") <= most_bytes) if most_bytes else files
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of two scans (path, sha256): new, changed or deleted."""
    both = now.select("path", F.col("sha256").alias("_now")).join(before.select("path", F.col("sha256").alias("_before")), "path", "full_outer")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_before"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as EUC-KR, else as UTF-8 with replacements."""
    return F.pandas_udf(_all_decoded, "string")(content)


def _all_decoded(content: pd.Series) -> pd.Series:
    return content.map(_decoded)


def _decoded(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for kind in ("utf-8-sig", "euc-kr"):
        try:
            return bytes(raw).decode(kind)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", "replace")


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of parsed documents; lines cut off midway are dropped, the last line of an id wins by its file order."""
    rows = spark.read.schema(PARSED + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    sound = rows.withColumn("_at", F.monotonically_increasing_id()).where("_broken is null and doc_id is not null").drop("_broken")
    rest = [c for c in sound.columns if c not in ("doc_id", "_at")]
    return sound.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select("doc_id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def not_yet_parsed(files: DataFrame, parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return files.join(parsed.select(key).distinct(), key, "left_anti")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def chat_lines(pairs: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """(value): a JSON line of messages for each pair, for a text sink."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return pairs.select(F.to_json(F.struct(F.array(message("user", question), message("assistant", answer)).alias("messages"))).alias("value"))


def front_matter(text: Column) -> Column:
    """(meta, body): a leading block between lines of three hyphens as a map of its `key: value` lines, and the rest."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\w[\w-]*\s*:"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    unique = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda s, e: F.when(F.exists(s, lambda y: y["key"] == e["key"]), s).otherwise(F.concat(s, F.array(e))))
    return F.struct(F.map_from_entries(unique).alias("meta"), F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


class _Parts(HTMLParser):
    """Plain text, headings, links, tables and code of a page."""

    SKIP = {"script", "style"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.headings, self.links, self.tables, self.code = [], [], [], [], []
        self._skip, self._heading, self._cell, self._code = 0, None, None, None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in self.SKIP:
            self._skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._heading = (int(tag[1]), [])
        elif tag == "a" and at.get("href"):
            self.links.append(at["href"])
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self._cell = []
        elif tag in ("pre", "code") and self._code is None:
            self._code = []
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self._skip = max(0, self._skip - 1)
        elif self._heading and tag == f"h{self._heading[0]}":
            self.headings.append({"level": self._heading[0], "title": " ".join("".join(self._heading[1]).split())})
            self._heading = None
        elif tag in ("td", "th") and self._cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag in ("pre", "code") and self._code is not None:
            self.code.append("".join(self._code))
            self._code = None

    def handle_data(self, data):
        if self._skip:
            return
        self.text.append(data)
        for part in (self._heading[1] if self._heading else None, self._cell, self._code):
            if part is not None:
                part.append(data)


HTML_PARTS = "text string, headings array<struct<level:int,title:string>>, links array<string>, tables array<array<array<string>>>, code array<string>"


def html_parts(html: Column) -> Column:
    """Text, headings, links, tables and code of pages; of a null page all are empty."""
    return F.pandas_udf(_html_parts, HTML_PARTS)(html)


def _html_parts(html: pd.Series) -> pd.DataFrame:
    out = []
    for page in html:
        p = _Parts()
        p.feed(page or "")
        p.close()
        text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.text).split("\n")) if x)
        out.append((text, p.headings, p.links, p.tables, p.code))
    return pd.DataFrame(out, columns=["text", "headings", "links", "tables", "code"])


def table_markdown(table: Column, most_rows: int = 50) -> Column:
    """Rows of cells as a Markdown table, the first as its head; rows beyond the most are counted."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.regexp_replace(c, r"\|", "\\\\|"), F.lit(""))), " | "), F.lit(" |"))
    head = F.get(table, F.lit(0))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(head, lambda _: F.lit("---")), "|"), F.lit("|"))
    body = F.transform(F.slice(table, 2, most_rows), line)
    more = F.when(F.size(table) > most_rows + 1, F.array(F.format_string("(%d more rows)", F.size(table) - most_rows - 1))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.array(line(head), rule), body, more), "\n")).otherwise("")
