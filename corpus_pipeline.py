"""A training corpus from raw documents: quality, line dedup, near dedup, decontamination, packing.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and gives a table, which is written as
Parquet and read again as the next one's docs. All but the last give the columns of documents, with n_chars that of the
text as it is then; further columns of documents pass unchanged, whatever their names. Null texts pass the filters as empty
ones; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.llm import common, decontamination, line_dedup, packing, quality, simhash

#: Quality scores below this are rejected.
LEAST_QUALITY = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ..., so that what the stages add clashes with nothing, and where id and text are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {x: names[common.place(docs.columns, x)] for x in ("doc_id", "text")}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on the labelled ones among them, rejects."""
    model = quality.fit(docs, common.labels(spark, sf_dir))
    plain, at = _plain(docs)
    kept = quality.score(plain, model, text=at["text"]).where(F.col("score") >= LEAST_QUALITY)
    return kept.select(*plain.columns).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the blocks of lines that an earlier document has; documents of which nothing is left go."""
    plain, at = _plain(docs)
    cut = line_dedup.deduplicated(plain, **at)
    left = cut.where((F.col("lines_deleted") == 0) | (F.trim(at["text"]) != ""))
    n = F.when(F.col("lines_deleted") > 0, F.char_length(at["text"]).cast("long")).otherwise(F.col(f"c{common.place(docs.columns, 'n_chars')}"))
    return left.withColumn(f"c{common.place(docs.columns, 'n_chars')}", n).select(*plain.columns).toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a Jaccard measure of 0.8 or more."""
    return simhash.deduplicated(docs, words=5, least=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of the benchmark."""
    plain, at = _plain(docs)
    return decontamination.decontaminate(plain, common.benchmark(spark, sf_dir), text=at["text"]).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.packed_documents(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
