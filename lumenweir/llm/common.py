"""What the training-data operators share: column picking, shared-folder tables, Arrow maps and word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored  # noqa: F401  used by the operators

#: Words a worker keeps hashes (or other results) of; later words are computed each time.
CACHE_WORDS = 250_000
#: Words, and bytes of a batch, that a worker treats at once: what bounds its memory.
CHUNK_WORDS = 200_000
SLICE_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, which is a small one, dealt out to all cores; others as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; other columns may have any names, also ones that differ in case only."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{place(df.columns, n)}").alias(n) for n in names))


def place(columns: list[str], name: str) -> int:
    """Where the column of that name is; if none has just that name, the first that differs from it in case only."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names in any case, so that results of these names can be added."""
    gone = {n.lower() for n in names}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    if len(keep) == len(df.columns):
        return df
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{i}") for i in keep)).toDF(*(df.columns[i] for i in keep))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES; a longer row is a slice of its own with others of average length."""
    n = max(1, batch.num_rows // (batch.nbytes // SLICE_BYTES + 1))
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str, whole: bool = False) -> DataFrame:
    """f of each Arrow batch, in slices unless it asks for the whole one: the columns of the result as a dict, in any order;
    None for no rows."""
    kinds = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in ([batch] if whole else slices(batch))):
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays([_array(out[k.name], k.type) for k in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class WordHashes(dict):
    """XXH64 of words, kept for the first CACHE_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def chunks(items: list[list], most: int = CHUNK_WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many words together; a longer document is a range of its own."""
    at, n = 0, 0
    for i, x in enumerate(items):
        if n and n + len(x) > most:
            yield at, i
            at, n = i, 0
        n += len(x)
    if at < len(items):
        yield at, len(items)


def crc32_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
