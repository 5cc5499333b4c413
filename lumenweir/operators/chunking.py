"""Splitting texts into sentences, chunks with overlap, and heading sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .structure import sections

# Sizes that results depend on.
CHUNK_CHARS = 2500


def sentences(c: Column) -> Column:
    """Split after sentence ends and at line ends; none of an empty text."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


def grouped_sentences(parts: list[str], most: int = CHUNK_CHARS, overlap: int = 1) -> list[str]:
    """Sentences joined while their characters, spaces not counted, fit; the next chunk begins with the last `overlap` ones."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for s in parts:
        if now and size + len(s) > most:
            out.append(" ".join(now))
            now = now[-overlap:] if overlap else []
            size = sum(map(len, now))
        now.append(s)
        size += len(s)
    return [*out, " ".join(now)] if now else out


def chunks(docs: DataFrame, most: int = CHUNK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk, text, n_chunks). Texts are split by Spark; sentences are grouped in one pass over each text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [grouped_sentences(x or [], most) for x in b.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(made) for _ in x], pa.int64())
            columns = [pa.array([k for x in made for k in range(len(x))], pa.int32()), pa.array([c for x in made for c in x], pa.string()), pa.array([len(x) for x in made for _ in x], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *columns], ["doc_id", "chunk", "text", "n_chunks"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk int, text string, n_chunks int")


def heading_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, heading_path, body): the text under each heading, with the headings above it; a path keeps one
    heading of each level. Text before the first heading has an empty path."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section int, heading_path string, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, section, paths, bodies = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (path, body) in enumerate((p, x.strip()) for p, x in sections(t or "") if x.strip()):
                    at.append(i)
                    section.append(k)
                    paths.append(path)
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(section, pa.int32()), pa.array(paths, pa.string()), pa.array(bodies, pa.string())], ["doc_id", "section", "heading_path", "body"])

    return rows.mapInArrow(run, schema)
