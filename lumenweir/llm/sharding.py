"""Contiguous balanced shards from global prefix sums of per-partition totals, by DataFrame functions alone.

Rows are put in the order of (doc_id, checksum, size), nulls first, by range partitions, whose number follows the rows.
The totals of the partitions give each one's base, and a running sum within it gives its rows' places in the whole.
Shard s takes the rows whose middle byte lies in the s-th of equal parts of all bytes: shards are contiguous and each
boundary is within half a row of its target. Only (id, size, checksum) rows are shuffled, never texts; an id with many
different texts is spread over partitions.

Null and empty texts have size 1 (no bytes, plus 1) and the checksum of nothing. Equal rows take neighbouring places,
either first. An empty table gives no rows; fewer rows than shards leave shards empty, and so may a row larger than a
shard's share. Columns other than the two that are named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pick, stored

#: Rows of a range partition, about.
PARTITION_ROWS = 1_000_000


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus 1, and the unsigned crc32 of the text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def byte_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; slot: its place in the shard."""
    rows = stored(sized(docs, doc_id, text))
    n = max(partitions(docs.sparkSession), rows.count() // PARTITION_ROWS + 1)
    key = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")]
    ranged = stored(rows.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id()))

    zero = F.lit(0).cast("long")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "part", F.coalesce(F.sum("part_bytes").over(before), zero).alias("base"), F.coalesce(F.sum("part_rows").over(before), zero).alias("first"), F.sum("part_bytes").over(whole).alias("total")
    )

    order = Window.partitionBy("part").orderBy(*key)
    ran = ranged.withColumns({"end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.row_number().over(order)})
    placed = ran.join(F.broadcast(bases), "part")  # n rows of five numbers
    middle = 2 * (F.col("base") + F.col("end")) - F.col("size")  # twice the place of the row's middle byte
    shard = F.least(F.floor(middle * shards / (2 * F.col("total"))), F.lit(shards - 1)).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("first") + F.col("n") - 1).alias("place")))

    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
