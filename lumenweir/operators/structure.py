"""Chunking by paragraphs, headings and legal articles, cleaning of passages and OCR text, and document trees."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import line_source

from ..functions.text import SPACES
from .batches import slices

# Sizes, ends of sentences and patterns that results depend on.
CHUNK_CHARS, ARTICLE_CHARS = 2500, 6000
ENDS = ("다.", "요.", "음.", ".", "!", "?", "。")
OCR_TAG = re.compile(r"(\[(?:Page|Image|Slide)\s+\d+\s+OCR\])")
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def each_text(docs: DataFrame, f: Callable[[str], Iterable[tuple]], schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ...): the rows that f makes of each text, numbered from 0; a null text is an empty one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n int, {schema}"
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [list(f(t or "")) for t in b.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(made) for _ in x], pa.int64())
            flat = [y for x in made for y in x]
            columns = [pa.array([y[k] for y in flat], pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([n for x in made for n in range(len(x))], pa.int32()), *columns], ["doc_id", "n", *names])

    return rows.mapInArrow(run, shape)


def _finished(text: str) -> str:
    """Without a fragment after the last end of a sentence, if that is within the last hundred characters."""
    text = text.rstrip()
    if len(text) <= 15 or re.search(r"[.!?。다요음]\s*$", text[-15:]):
        return text
    for end in ENDS:
        at = text.rfind(end)
        if at > 0 and at > len(text) - 100:
            return text[: at + len(end)]
    return text


def clean_passage(text: str, least: int = 10) -> str:
    """White space squeezed, repeated lines (in any case) left out, blank ones kept, no unfinished end; shorter texts as they are."""
    if len(text.strip()) < least:
        return text
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+", " ", text)).strip()
    met: set[str] = set()
    kept = []
    for line in text.split("\n"):
        key = line.strip().lower()
        if not key or key not in met:
            kept.append(line)
        met.add(key)
    return _finished("\n".join(kept))


def clean_passages(docs: DataFrame, least: int = 10, **columns) -> DataFrame:
    """(doc_id, n, text): cleaned texts of `least` characters or more."""
    return each_text(docs, lambda t: [(clean_passage(t, least),)], "text string", **columns).where(F.length("text") >= least)


def paragraph_chunks(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Paragraphs joined while they fit, two characters between them counted; a longer one is cut at its sentences."""
    out, now = [], ""
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if len(now) + len(p) + 2 <= most:
            now = f"{now}\n\n{p}" if now else p
            continue
        out += [now] if now else []
        now = p
        if len(p) > most:
            *done, now = sentence_chunks(p, most)
            out += done
    return [*out, now] if now else out or [text.strip()]


def sentence_chunks(text: str, most: int = CHUNK_CHARS, overlap: int = 0) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    size = 0
    for s in (x for x in re.split(r"(?<=[.!?。])\s+|\n+", text) if x.strip()):
        if now and size + len(s) > most:
            out.append(" ".join(now))
            now = now[len(now) - overlap :] if overlap else []
            size = sum(map(len, now))
        now.append(s)
        size += len(s)
    return [*out, " ".join(now)] if now else out or [text]


def headed(text: str, by_place: bool = False) -> Iterator[tuple[list[str], str]]:
    """(headings above, body) of each run of lines between Markdown headings that has a line; text before the first heading has none.

    A heading takes the place of those of its level and below. by_place: headings count by their place in the path instead of
    their level, so that a heading that skips levels stays above a later one of its own level."""
    above: list[tuple[int, str]] = []
    body: list[str] = []
    for line in [*text.split("\n"), None]:
        m = None if line is None else HEADING.match(line)
        if line is not None and not m:
            body.append(line)
            continue
        if body:
            yield [title for _, title in above], "\n".join(body)
        if m:
            level, body = len(m[1]), []
            kept = above[: level - 1] if by_place else [x for x in above if x[0] < level]
            above = [*kept, (level, m[2].strip())]


def sections(text: str, by_place: bool = False) -> Iterator[tuple[str, str]]:
    """(heading path, body), as headed gives them."""
    return ((" > ".join(path), body) for path, body in headed(text, by_place))


def heading_chunks(text: str, most: int = CHUNK_CHARS) -> list[tuple[str, str]]:
    """(path, chunk) of each section, whose headings count by place, cut by paragraphs; without headings, of the text."""
    made = [(path, c) for path, body in sections(text, by_place=True) if body.strip() for c in paragraph_chunks(body, most)]
    return made or [("", c) for c in paragraph_chunks(text, most)]


def legal_chunks(text: str, most: int = CHUNK_CHARS, article: int = ARTICLE_CHARS) -> list[tuple[str, str]]:
    """(path, chunk): an article is whole up to so many characters; longer ones are cut by paragraphs."""
    made = [(path, c) for path, body in sections(text) if (b := body.strip()) for c in ([b] if len(b) <= article else paragraph_chunks(body, most))]
    return made or [("", c) for c in paragraph_chunks(text, most)]


def ocr_spacing(c: Column) -> Column:
    """Single Hangul syllables with spaces between them, three or more ahead, as one word."""
    return F.regexp_replace(c, r"(?<=[가-힣])\s(?=[가-힣](?:\s[가-힣]){2,})", "")


def ocr_numbers(c: Column) -> Column:
    """Without a digit too many after groups of three."""
    return F.regexp_replace(c, r"(\d{1,3}(?:,\d{3})+)\d(?!\d)", "$1")


def unrepeated_ocr(text: str) -> str:
    """Of tagged OCR sections with the same first 200 characters but for white space, the first; texts without an [OCR] mark as they are."""
    if "[OCR]" not in text:
        return text
    head, *rest = OCR_TAG.split(text)
    met: set[str] = set()
    out = [head]
    for tag, body in zip(rest[::2], rest[1::2], strict=True):
        key = re.sub(r"\s+", "", body)[:200]
        if not key or key not in met:
            out += [tag, body]
        met.add(key)
    return "".join(out)


def initial_consonants(c: Column) -> Column:
    """The initial consonants of Hangul syllables; other characters are left out."""
    place = lambda x: F.floor((F.ascii(x) - 0xAC00) / 588).cast("int")
    syllables = F.regexp_extract_all(c, F.lit("[가-힣]"), F.lit(0))
    return F.array_join(F.transform(syllables, lambda x: F.substring(F.lit("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"), place(x) + 1, F.lit(1))), "")


def ocr_noise(c: Column) -> Column:
    """From 0 to 1: stray letters, runs of one character and syllables that OCR makes up, by length."""
    n = 2 * F.regexp_count(c, F.lit("[ㄱ-ㅣᆨ-ᇿ]")) + 3 * F.regexp_count(c, F.lit(r"(.)\1{3,}")) + 5 * F.regexp_count(c, F.lit("[륙곰슨묻릉룬륨름륵몽룸뭬늘믄뉘녈][어은을룸름릉늙류늘는근]"))
    return F.when(F.length(c) > 0, F.least(F.lit(1.0), 10 * n / F.length(c))).otherwise(0.0)


def needs_correction(c: Column, least: float = 0.05) -> Column:
    return F.when(F.contains(c, F.lit("[OCR]")), ocr_noise(c) >= least).otherwise(ocr_noise(c) >= 2 * least)


def short_title(c: Column, most: int = 60) -> Column:
    """Without a numeric prefix of ten digits or more and the file's type."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^\d{10,}_", ""), r"(?i)\.(pptx?|pdf|docx?|xlsx?|csv)$", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


def context_prefix(title: Column, author: Column, path: Column, kind: Column, index: Column, total: Column, summary: Column, most: int = 150) -> Column:
    """What a chunk is embedded with: title, author and place, a short summary, the section, and its kind unless it is body."""
    place = F.when(total > 0, F.concat(F.lit("§"), index + 1, F.lit("/"), total))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    head = F.concat_ws(" | ", some(short_title(title)), some(author), place)
    lines = F.concat_ws(
        "\n", F.when(head != "", F.concat(F.lit("[Context] "), head)), F.when(F.length(some(summary)) <= 80, F.concat(F.lit("[Summary] "), summary)),
        F.when(some(path).isNotNull(), F.concat(F.lit("[섹션: "), path, F.lit("]"))), F.when(kind != "body", F.concat(F.lit("[유형: "), kind, F.lit("]"))),
    )
    whole = F.concat(lines, F.lit("\n\n"))
    return F.when(lines == "", "").when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("…\n\n"))).otherwise(whole)


def date_author_tokens(title: Column, author: Column) -> Column:
    """Tokens of a title's month, its week, and the author, to be added to a chunk's words."""
    a, b, w = r"(20\d{2})[_\-./](0[1-9]|1[0-2])", r"(20\d{2})년\s*(\d{1,2})월", r"(\d{1,2})월\s*(\d)주차"
    first = title.rlike(a)
    y, m = (F.when(first, F.regexp_extract(title, a, i)).otherwise(F.regexp_extract(title, b, i)) for i in (1, 2))
    plain = m.cast("int").cast("string")
    month = F.when(first | title.rlike(b), F.concat(F.lit(" "), y, F.lit(" "), y, F.lit("년 "), plain, F.lit("월 "), y, F.lit("_"), F.lpad(plain, 2, "0"))).otherwise("")
    week = F.when(title.rlike(w), F.concat(F.lit(" "), F.regexp_extract(title, w, 1), F.lit("월 "), F.regexp_extract(title, w, 2), F.lit("주차"))).otherwise("")
    return F.concat(month, week, F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" "), author)).otherwise(""))


def path_hash(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def path_levels(rows: DataFrame, path: str = "heading_path") -> DataFrame:
    """Each level of a heading path, from 1: (..., level, title, full_path, path_hash)."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")
    out = rows.withColumn("_p", parts).select(*rows.columns, "_p", F.posexplode("_p").alias("_k", "title"))
    full = F.array_join(F.slice("_p", F.lit(1), F.col("_k") + 1), " > ")
    return out.select(*rows.columns, (F.col("_k") + 1).alias("level"), "title", full.alias("full_path"), path_hash(full).alias("path_hash"))


def document_tree(chunks: DataFrame, kb: str) -> tuple[DataFrame, DataFrame]:
    """Sections and edges of documents' trees from chunks (doc_id, chunk_id, heading_path, chunk_index).

    A path gives a section for each level; chunks without one are put together in groups of pages, of all, 5, 10 or 20 by
    how many there are. Sections (doc_id, node_id, level, title, full_path, place) are in order of their first chunk; edges
    (doc_id, source, target, type) lead from the document to its root, on to sections and pages, and along siblings.
    """
    empty = F.size(F.filter(F.split(F.coalesce("heading_path", F.lit("")), ">"), lambda x: F.trim(x) != "")) == 0
    c = chunks.withColumn("_bare", empty)
    bare = c.groupBy("doc_id").agg(F.count_if("_bare").alias("_n"))
    size = F.when(F.col("_n") <= 5, F.greatest("_n", F.lit(1))).when(F.col("_n") <= 20, 5).when(F.col("_n") <= 100, 10).otherwise(20)
    c = c.join(bare, "doc_id").withColumn("_g", F.floor(F.col("chunk_index") / size)).withColumn("_size", size)
    node = lambda h: F.concat_ws(":", F.lit(kb), "doc_id", F.lit("section"), h)
    title = F.concat(F.lit("p."), F.col("_g") * F.col("_size") + 1, F.lit("-"), (F.col("_g") + 1) * F.col("_size"))
    grouped = c.where("_bare").select("doc_id", "chunk_id", "chunk_index", F.lit(1).alias("level"), title.alias("title"), title.alias("full_path"), path_hash(F.concat(F.lit("__page_group_"), "_g", F.lit("__"))).alias("path_hash"), F.lit(True).alias("leaf"))
    named = path_levels(c.where("not _bare").select("doc_id", "chunk_id", "chunk_index", "heading_path")).drop("heading_path")
    deepest = F.max("level").over(Window.partitionBy("doc_id", "chunk_index", "chunk_id"))
    levels = named.withColumn("leaf", F.col("level") == deepest).unionByName(grouped)
    first = levels.groupBy("doc_id", "path_hash").agg(F.min(F.struct("chunk_index", "level")).alias("_at"), F.first("level").alias("level"), F.first("title").alias("title"), F.first("full_path").alias("full_path"))
    parent = F.when(F.col("level") > 1, path_hash(F.array_join(F.slice(F.split("full_path", " > "), F.lit(1), F.col("level") - 1), " > ")))
    sections_ = first.select("doc_id", node(F.col("path_hash")).alias("node_id"), "level", "title", "full_path", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1).alias("place"), parent.alias("_parent"))
    pages = levels.where("leaf").select("doc_id", "chunk_index", node(F.col("path_hash")).alias("section"), F.concat_ws(":", F.lit(kb), "doc_id", F.lit("page"), "chunk_index").alias("page"))
    root = F.concat_ws(":", F.lit(kb), "doc_id")
    edge = lambda rows, a, b, kind: rows.select("doc_id", a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    after = lambda c, *by, order: F.lead(c).over(Window.partitionBy(*by).orderBy(order))
    page_next = pages.withColumn("_next", after("page", "doc_id", "section", order="chunk_index")).where("_next is not null")
    section_next = sections_.withColumn("_next", after("node_id", "doc_id", "_parent", order="place")).where("_next is not null")
    edges = (
        edge(c.select("doc_id").distinct(), F.col("doc_id").cast("string"), root, "HAS_TREE_ROOT")
        .unionByName(edge(sections_.where("level = 1"), root, F.col("node_id"), "HAS_TREE_SECTION"))
        .unionByName(edge(sections_.where("level > 1"), node(F.col("_parent")), F.col("node_id"), "HAS_TREE_SECTION"))
        .unionByName(edge(pages, F.col("section"), F.col("page"), "HAS_TREE_PAGE"))
        .unionByName(edge(page_next, F.col("page"), F.col("_next"), "TREE_NEXT_SIBLING"))
        .unionByName(edge(section_next, F.col("node_id"), F.col("_next"), "TREE_NEXT_SIBLING"))
    )
    return sections_.drop("_parent"), edges


def source_sections(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, section, source, content): an answer's lines in runs of one source. A line without a mark goes on with that of the one
    before; before the first mark it is the documents. An answer's lines are one group; null answers have none."""
    lines = answers.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("mark", line_source(F.col("line")))
    order = Window.partitionBy(*keys).orderBy("at")
    known = lines.withColumn("source", F.coalesce(F.last("mark", ignorenulls=True).over(order), F.lit("document")))
    changed = (F.col("source") != F.lag("source").over(order)).cast("int")
    runs = known.withColumn("section", F.sum(F.coalesce(changed, F.lit(0))).over(order) + 1)
    grouped = runs.groupBy(*keys, "section", "source").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return grouped.select(*keys, "section", "source", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
