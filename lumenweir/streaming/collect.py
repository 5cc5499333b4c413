"""Log files that arrive in a folder, collected by a stream and merged into a table exactly once.

Files of JSON lines are read as a stream; what of a file has been read is in the checkpoint. Each micro-batch is written as the
part of its number in the table's folder: a batch that is run again after a failure replaces its own part, so that neither a
lost nor a doubled row comes of it. The table is what the whole parts hold, one row for each log id, of the latest time and of
equal times from the later part. Parts of a long history can be folded into one, by a part that takes the number of the last.
Broken lines are left out and counted; a line without an id is named by its file and text, so that a line that a file repeats
counts once; a missing store is `unknown`, a missing outcome a success; a time that can't be read is null, which is earliest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "id string, store_id string, query string, answer string, latency_ms long, success boolean, model_version string, ts string"
TABLE = "id string, profile_name string, store_id string, query string, answer string, latency_ms long, success boolean, model_version string, edge_timestamp timestamp"


def parsed(lines: DataFrame, profile: str) -> DataFrame:
    """Table rows of lines (value, file), with `broken` for lines that are no JSON object; blank lines are none."""
    e = F.from_json("value", ENTRY)
    rows = lines.where(F.trim("value") != "").select("value", "file", e.alias("e"), (F.get_json_object("value", "$").isNull() | ~F.ltrim("value").startswith("{")).alias("broken"))
    return rows.select(
        F.coalesce("e.id", F.sha2(F.concat_ws("\n", "file", "value").cast("binary"), 256)).alias("id"), F.lit(profile).alias("profile_name"), F.coalesce("e.store_id", F.lit("unknown")).alias("store_id"),
        F.coalesce("e.query", F.lit("")).alias("query"), F.coalesce("e.answer", F.lit("")).alias("answer"), "e.latency_ms", F.coalesce("e.success", F.lit(True)).alias("success"), "e.model_version",
        F.try_to_timestamp("e.ts").alias("edge_timestamp"), "broken",
    )


def latest(rows: DataFrame) -> DataFrame:
    """One row for each id: of the latest time, and of equal times from the last part."""
    best = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("edge_timestamp", "part", F.xxhash64("query", "answer"))).alias("r"))
    return best.select("id", "r.*")


def merge_into(target: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch as its part. after: called when the part is written, before the stream's own commit."""

    def each(batch: DataFrame, number: int) -> None:
        counted = batch.withColumn("part", F.lit(number).cast("long"))
        own = latest(counted.where("not broken").drop("broken")).withColumn("broken", F.lit(False))
        broken = counted.where("broken").select(*own.columns)
        own.unionByName(broken).write.mode("overwrite").parquet(f"{target}/part={number:010d}")
        if after:
            after(number)

    return each


def collect(spark: SparkSession, source: str, target: str, checkpoint: str, profile: str, files_per_batch: int = 1000, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """A query that reads what has arrived in the source since it last ran, and ends."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source).select("value", F.col("_metadata.file_path").alias("file"))
    return parsed(lines, profile).writeStream.foreachBatch(merge_into(target, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, target: str) -> DataFrame:
    """The table as the parts have it."""
    rows = spark.read.schema(f"{TABLE}, broken boolean").parquet(f"{target}/part=*").withColumn("part", F.regexp_extract(F.input_file_name(), r"part=(\d+)", 1).cast("long"))
    return latest(rows.where("not broken").drop("broken")).drop("part")
