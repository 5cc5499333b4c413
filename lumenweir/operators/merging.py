"""Writes as merges of tables: upserts, replaced sets, versioned edges, logs and counters. Each gives the table as it is after
the write, which the caller stores; a key that comes twice in one batch takes the later row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last in order; maxima are summed up by partition first."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep_null: bool = False) -> DataFrame:
    """The old rows, with those of the new rows' keys replaced; nulls in keys are equal. keep_null: columns that are null in a new
    row stay as they were."""
    new = last_of_key(new, keys, order).select(*(F.col(c).alias(f"_new_{c}") for c in new.columns), F.lit(True).alias("_is_new"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
    if not keep_null:
        return old.join(new, same, "left_anti").unionByName(new.select(*(F.col(f"_new_{c}").alias(c) for c in old.columns)))
    both = old.join(new, same, "full_outer")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) for c in old.columns))


def without_matching(old: DataFrame, condition: Column, keep: DataFrame, key: str) -> DataFrame:
    """Without the rows that meet a condition, but for those whose key is to be kept."""
    return old.where(~condition | condition.isNull()).unionByName(old.where(condition).join(keep.select(key).distinct(), key, "left_semi").select(*old.columns))


def storable_points(rows: DataFrame, vector: str, batch: int = 64) -> DataFrame:
    """Points with a vector, numbered in batches of about so many by a hash of the id; sources.points writes batches of so many at most."""
    sound = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    n = sound.count()
    return sound.withColumn("batch", F.pmod(F.xxhash64(*[c for c in sound.columns if c != vector]), F.lit(max(1, -(-n // batch)))))


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, type, updated_at, mentions) after a merge: the later type and time, mentions added up."""
    both = old.unionByName(new)
    return both.groupBy("id").agg(F.max_by("type", "updated_at").alias("type"), F.max("updated_at").alias("updated_at"), F.sum("mentions").alias("mentions"))


def merged_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, type, dst, weight) after a merge: one for each pair and type, the larger weight; new ones without both ends are left out."""
    known = nodes.select("id")
    sound = new.join(known, new.src == known.id, "left_semi").join(known, new.dst == known.id, "left_semi")
    return old.unionByName(sound).groupBy("src", "type", "dst").agg(F.max("weight").alias("weight"))


def archived(edges: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Edges (src, type, dst, created_at, archived_at) after newer ones: an edge of the same source and type to another end gets
    the type WAS_ and the time; unchanged ones stay. Of several new edges of one source and type the last one counts."""
    new = last_of_key(new, ["src", "type"], at)
    newer = new.select("src", "type", F.col("dst").alias("_dst"), F.col(at).alias("_at"))
    found = edges.join(newer, ["src", "type"], "left")
    gone = F.col("_dst").isNotNull() & (F.col("_dst") != F.col("dst")) & F.col("archived_at").isNull()
    kept = found.select("src", F.when(gone, F.concat(F.lit("WAS_"), "type")).otherwise(F.col("type")).alias("type"), "dst", "created_at", F.when(gone, F.col("_at")).otherwise(F.col("archived_at")).alias("archived_at"))
    known = edges.where("archived_at is null").select("src", "type", "dst")
    added = new.join(known, ["src", "type", "dst"], "left_anti").select("src", "type", "dst", F.col(at).alias("created_at"), F.lit(None).cast(edges.schema["archived_at"].dataType).alias("archived_at"))
    return kept.unionByName(added)
