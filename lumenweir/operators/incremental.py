"""Deduplication of documents as they arrive, against a stored index.

A document is compared with those that arrived before it, in stages. Exact: the same content hash; only the first of a content
is indexed. Near: of the indexed ones that share a band of its MinHash signature, the one with the largest agreement, if that
is NEAR or more (ties: the earliest). Meaning: a near duplicate of VERIFY agreement or more is looked up among the indexed
vectors, and becomes a semantic duplicate of the most alike one, if the cosine is SEMANTIC or more. Near and semantic
duplicates are indexed too, so that a third copy finds them.

The index is a folder of Parquet tables with a part for each batch, so that a batch reads the earlier parts and writes its own:
a batch that is added again, as a stream does after a failure, replaces its part and gives the same result. All comparisons
are by arrival, so that any split of the documents into batches, in order of arrival, gives the same results.

Documents that share a band meet in the group of the band's earliest one, so that near copies, which share many, meet once; only
keys and arrivals are grouped, and signatures are sent for members of groups alone. A large group is cut into blocks and each
new one is held against every block in a task; what is given out is a row for a new document and block, not the pairs. Null texts are as empty ones, which have a content
hash but no signature. Vectors that are null, of no length or of another size than the new one are no candidates. Arrivals
are distinct longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_duplicates import BANDS, HASHES, with_signatures

# Thresholds of the stages.
NEAR, VERIFY, SEMANTIC = 0.80, 0.85, 0.90
#: Members of a band that a new document is held against in one task; new documents whose vectors a task holds.
MOST = 4096
RESULT = "doc_id long, status string, duplicate_of long, similarity double, resolution string, stage int"


class DedupIndex:
    def __init__(self, spark: SparkSession, path: str, words: int = 5) -> None:
        self.spark, self.path, self.words = spark, path, words

    def _part(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch:010d}"

    def _write(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._part(table, batch))
        return self.spark.read.schema(rows.schema).parquet(self._part(table, batch))

    def _batches(self) -> list[int]:
        """The batches that are whole: their results are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/results")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = lambda p: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(x.getPath().getName().removeprefix("batch=")) for x in system.listStatus(path) if done(x.getPath()))

    def results(self) -> DataFrame | None:
        parts = [self._part("results", b) for b in self._batches()]
        return self.spark.read.schema(RESULT).parquet(*parts) if parts else None

    def add(self, docs: DataFrame, batch: int, vectors: DataFrame | None = None) -> DataFrame:
        """The results of a batch of documents (arrival, doc_id, text, vec), whose number is larger than those of all that arrived
        before them; the batch is in the index afterwards. Vectors may come as a table of their own (arrival, vec), one of an
        arrival at most, which is joined when texts have become signatures."""
        text = F.coalesce("text", F.lit(""))
        own = [] if vectors is not None else [F.col("vec").cast("array<double>").alias("vec")]
        hashed = docs.select("arrival", "doc_id", F.substring(F.sha2(F.lower(F.trim(text)).cast("binary"), 256), 1, 32).alias("hash"), *own, text.alias("text"))
        signed = with_signatures(hashed, self.words)
        if vectors is not None:
            signed = signed.join(vectors.select("arrival", F.col("vec").cast("array<double>").alias("vec")), "arrival", "left")
        rows = self._write(signed.select("arrival", "doc_id", "hash", "vec", "sig"), "rows", batch)
        schema, earlier = rows.schema, [b for b in self._batches() if b < batch]
        old = self.spark.read.schema(schema).parquet(*(self._part("index", b) for b in earlier)) if earlier else rows.limit(0)

        first = F.min(F.struct("arrival", "doc_id")).alias("first")
        firsts = old.select("hash", "arrival", "doc_id").unionByName(rows.select("hash", "arrival", "doc_id")).groupBy("hash").agg(first)
        known = rows.join(firsts, "hash").withColumn("again", F.col("first.arrival") < F.col("arrival"))
        new = self._write(known.where("not again").select(*schema.fieldNames()), "index", batch)
        index = old.unionByName(new)

        near = _nearest_signatures(new, index).where(F.col("agreement") >= NEAR)
        near = self._write(near, "near", batch)
        probes = new.join(near.where(F.col("agreement") >= VERIFY).select("arrival"), "arrival", "left_semi").select("arrival", "vec")
        alike = _most_alike(probes, index).where(F.col("cosine") >= SEMANTIC)
        exact = known.where("again").select("doc_id", F.lit("exact").alias("status"), F.col("first.doc_id").alias("duplicate_of"), F.lit(1.0).alias("similarity"), F.lit("delete").alias("resolution"), F.lit(1).alias("stage"))
        staged = new.select("arrival", "doc_id").join(near.select("arrival", "agreement", F.col("other").alias("near_of")), "arrival", "left").join(alike.select("arrival", "cosine", F.col("other").alias("like_of")), "arrival", "left")
        status = F.when(F.col("cosine").isNotNull(), "semantic").when(F.col("agreement").isNotNull(), "near").otherwise("unique")
        resolution = F.when(status == "semantic", "review").when(status == "near", F.when(F.col("agreement") < VERIFY, "review").otherwise("merge")).otherwise("keep")
        compared = staged.select(
            "doc_id", status.alias("status"), F.coalesce("like_of", "near_of").alias("duplicate_of"), F.coalesce("cosine", "agreement", F.lit(0.0)).alias("similarity"),
            resolution.alias("resolution"), F.when(F.col("agreement") >= VERIFY, 3).otherwise(2).alias("stage"),
        )
        return self._write(exact.unionByName(compared), "results", batch)


def _nearest_signatures(new: DataFrame, index: DataFrame) -> DataFrame:
    """(arrival, agreement, other): for each new row the indexed one before it that shares a band and agrees most."""
    size = 4 * HASHES // BANDS
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", F.lit(i * size + 1), F.lit(size)))
    keyed = lambda rows: rows.where("sig is not null").select("arrival", F.explode(F.array(*(band(i) for i in range(BANDS)))).alias("key"))
    members = keyed(index).join(keyed(new).select("key").distinct(), "key", "left_semi")
    least = members.groupBy("key").agg(F.min("arrival").alias("group"), F.max("arrival").alias("last")).where("group < last").select("key", "group")
    groups = members.join(least, "key").select("group", "arrival").distinct()
    cuts = groups.groupBy("group").agg(F.ceil(F.count("*") / MOST).cast("int").alias("blocks"))
    placed = groups.join(cuts, "group").join(new.select("arrival", F.lit(True).alias("new")), "arrival", "left")
    own = F.struct(F.pmod(F.xxhash64("arrival"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("asks")))
    meets = F.explode(F.when(F.col("new"), F.concat(F.array(own), all_blocks)).otherwise(F.array(own))).alias("m")
    sigs = index.select("arrival", "doc_id", "sig")
    dealt = placed.select("group", "arrival", meets).join(sigs, "arrival").select(F.col("group").alias("key"), "m.block", "m.asks", "arrival", "doc_id", "sig")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "asks", "arrival")
    best = dealt.mapInArrow(_best_of_block, "arrival long, agreement double, first long, other long")
    # the largest agreement; of equal ones the earliest
    return best.groupBy("arrival").agg(F.max(F.struct("agreement", (-F.col("first")).alias("_"), "other")).alias("b")).select("arrival", "b.agreement", "b.other")


def _best_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, block, asks, arrival, doc_id, sig), members of a block before those that ask: the best earlier member of each."""
    at, arrivals, ids, sigs, table = None, [], [], [], None
    for b in batches:
        out = []
        for key, block, asks, arrival, doc_id, sig in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, block) != at:
                at, arrivals, ids, sigs, table = (key, block), [], [], [], None
            if not asks:
                arrivals.append(arrival)
                ids.append(doc_id)
                sigs.append(sig)
                continue
            if table is None:
                table = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, HASHES)
            n = int(np.searchsorted(arrivals, arrival))
            if n:
                same = table[:n] == np.frombuffer(sig, "<u4")
                banded = np.flatnonzero(same.reshape(n, BANDS, -1).all(2).any(1))  # of a group, those that share a band
                if len(banded):
                    alike = same[banded].mean(1)
                    k = int(banded[alike.argmax()])
                    out.append((arrival, float(alike.max()), arrivals[k], ids[k]))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["arrival", "agreement", "first", "other"])


def _most_alike(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(arrival, cosine, other): for each probe the indexed vector before it of the largest cosine (of equal ones the earliest). The
    probes are dealt into blocks, which all rows of the index meet block by block."""
    sound = lambda rows: rows.where(F.coalesce(F.size("vec"), F.lit(0)) > 0)
    own = sound(probes)
    blocks = max(1, -(-own.count() // (4 * MOST)))
    held = sound(index).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("arrival"), F.lit(1 << 16)).alias("salt"), F.lit(1).alias("turn"), "arrival", "doc_id", "vec")
    # so many rows of a salt that probes, which meet each of them, are sent no more often than rows are
    salts = max(-(-sound(index).count() // (16 * MOST)), min(16, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = held.withColumn("salt", F.pmod("salt", F.lit(salts)))
    asking = own.select(F.pmod(F.xxhash64("arrival"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("turn"), "arrival", F.lit(None).cast("long").alias("doc_id"), "vec")
    dealt = held.select("block", "salt", "turn", "arrival", "doc_id", "vec").union(asking.select("block", F.col("salt").cast("long"), "turn", "arrival", "doc_id", "vec"))
    dealt = dealt.repartition("block", "salt").sortWithinPartitions("block", "salt", "turn", "arrival")
    best = dealt.mapInArrow(_best_vectors, "arrival long, cosine double, first long, other long")
    return best.groupBy("arrival").agg(F.max(F.struct("cosine", (-F.col("first")).alias("_"), "other")).alias("b")).select("arrival", "b.cosine", "b.other")


def _best_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (block, salt, turn, arrival, doc_id, vec), those that ask first: for each of these the best earlier row of the salt."""
    at, asking, best, held = None, {}, {}, []

    def unit(v) -> np.ndarray | None:
        x = np.array([np.nan if c is None else c for c in v])
        length = np.linalg.norm(x)
        return x / length if 0 < length < np.inf else None

    def compare() -> None:
        for size in {len(v) for _, _, v in held} & {len(v) for v in asking.values()}:
            names = [a for a, v in asking.items() if len(v) == size]
            rows = [r for r in held if len(r[2]) == size]
            arrivals = np.array([r[0] for r in rows])
            score = np.round(np.array([asking[a] for a in names]) @ np.array([r[2] for r in rows]).T, 9)
            score[arrivals[None, :] >= np.array(names)[:, None]] = -np.inf
            top = score.argmax(1)  # rows come by arrival: of equal scores the earliest
            for a, k, s in zip(names, top, score[np.arange(len(names)), top], strict=True):
                if s > -np.inf and (a not in best or s > best[a][0]):
                    best[a] = (float(s), int(arrivals[k]), rows[k][1])
        held.clear()

    def result() -> pa.RecordBatch:
        compare()
        rows = [(a, *b) for a, b in best.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["arrival", "cosine", "first", "other"])

    for b in batches:
        for block, salt, turn, arrival, doc_id, vec in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (block, salt) != at:
                yield result()
                at, asking, best, held = (block, salt), {}, {}, []
            if (x := unit(vec)) is None:
                continue
            if turn == 0:
                asking[arrival] = x
            elif asking:
                held.append((arrival, doc_id, x))
                if len(held) * max(len(asking), 1024) >= MOST * 1024:
                    compare()
    yield result()
