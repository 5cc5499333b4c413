"""Links within groups of alike members, enough to join all that belong together, without emitting a group's pairs.

A group's members are compared in tasks: each member is held against those that nothing joins to it yet, so that a group of
near copies takes about one pass, and only links that join two parts are given. A group of more than `most` members or
`most_bytes` is cut into salted cells. Each cell has LEADERS members of the whole group besides its own, through which the
near copies of a large group join. What isn't joined then meets the rest: the members of a large joined part, and all others,
are cut into blocks, and each two blocks that aren't of one joined part are compared in a task of their own. So no pair that
might be a link is left out, and no task holds more than two blocks. A group in which nothing is alike costs the square of
its blocks, in that many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .components import connected_components

#: Members that all cells of a large group have.
LEADERS = 8
#: From a list of members (bytes): a function of a member's place and other places that says which of those it is linked to.
Kernel = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def groups_of_keys(keys: DataFrame) -> DataFrame:
    """(group, rep) from (key, rep): members of a key are together in the group of the key's smallest member, so that the many
    keys that near copies share make one group. Keys of one member have none."""
    least = keys.groupBy("key").agg(F.min("rep").alias("group"), F.max("rep").alias("last")).where("group <> last").select("key", "group")
    return keys.join(least, "key").select("group", "rep").distinct()


class JaccardOfSets:
    """Kernel over sorted arrays of 64-bit hashes: a Jaccard measure of `least` or more. Empty ones have no links."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, members: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([len(m) // 8 for m in members])
        flat = np.unique(np.frombuffer(b"".join(members), "<u8"), return_inverse=True)[1].ravel()
        ends = np.cumsum(sizes)
        starts, marked = ends - sizes, np.zeros(int(flat.max(initial=-1)) + 1, bool)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            n, of = sizes[i], sizes[others]
            out = np.minimum(n, of) >= self.least * np.maximum(n, of) - 1e-9
            marked[flat[starts[i] : ends[i]]] = True
            for k in np.flatnonzero(out):
                j = others[k]
                common = np.count_nonzero(marked[flat[starts[j] : ends[j]]])
                out[k] = common and common >= self.least * (n + of[k] - common) - 1e-9
            marked[flat[starts[i] : ends[i]]] = False
            return out

        return linked


def _joined(linked, reps: np.ndarray, roots: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Pairs (rep, rep) that join what links join; roots: the parts that members are in; members of one side (over 0) don't meet.
    Where nothing was joined before, each member's pair is the smallest of its part."""
    parts, places = np.unique(roots, return_inverse=True)[1].ravel(), np.arange(len(roots))
    joins = []
    for i in places[:-1]:
        later = places[i + 1 :]
        open_ = later[(parts[later] != parts[i]) & ((sides[later] != sides[i]) | (sides[i] == 0))]
        if not len(open_):
            continue
        for j in open_[linked(int(i), open_)]:
            if parts[j] != parts[i]:
                joins.append((reps[i], reps[j]))
                parts[parts == parts[j]] = parts[i]
    if not joins or (roots != reps).any():
        return np.array(joins, np.int64).reshape(-1, 2)
    least = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(least, parts, reps)
    least = least[parts]
    return np.column_stack([reps, least])[reps != least]


def _cells(kernel: Kernel):
    """Over rows (cell, turn, side, rep, root, payload), sorted by cell, turn and rep: pairs (a, b). A repeated member counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides, reps, roots, members, out, seen = None, [], [], [], [], [], set()

        def close() -> None:
            if len(reps) > 1:
                out.append(_joined(kernel(members), np.array(reps), np.array(roots), np.array(sides)))

        def batch_of() -> pa.RecordBatch:
            pairs = np.concatenate([np.empty((0, 2), np.int64), *out])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for c, _, side, rep, root, payload in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    close()
                    cell, sides, reps, roots, members, seen = c, [], [], [], [], set()
                if rep not in seen:
                    seen.add(rep)
                    for column, v in zip((sides, reps, roots, members), (side, rep, root, payload), strict=True):
                        column.append(v)
            yield batch_of()
        close()
        yield batch_of()

    return run


def _compared(cells: DataFrame, payloads: DataFrame, kernel: Kernel) -> DataFrame:
    """Links within cells (cell, turn, side, rep, root)."""
    dealt = cells.join(payloads, "rep").select("cell", "turn", "side", "rep", "root", "payload").repartition("cell").sortWithinPartitions("cell", "turn", "rep")
    return dealt.mapInArrow(_cells(kernel), "a long, b long")


def spanning_links(groups: DataFrame, payloads: DataFrame, kernel: Kernel, most: int = 1024, most_bytes: int = 16_000_000) -> DataFrame:
    """Pairs (a, b) of members (group, rep), by the kernel over their payloads (rep, payload), which join, in each group, just what
    its links join: a member and the smallest that its links in a cell lead to, or two linked ones. Groups and members are named by longs; a member may be in several groups, and is once in payloads."""
    groups = stored(groups.join(payloads.select("rep", F.octet_length("payload").alias("bytes")), "rep").select("group", "rep", "bytes"))
    cuts = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where("n > 1")
    cuts = stored(cuts.select("group", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("b") / most_bytes)).cast("int").alias("salts")))
    cell, one, none = F.xxhash64("group", "salt").alias("cell"), F.lit(1).alias("turn"), F.lit(0).alias("side")
    salted = groups.join(cuts, "group").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int"))
    cells = salted.select(cell, one, none, "rep", F.col("rep").alias("root"))
    large = cuts.where("salts > 1")
    if large.isEmpty():
        return stored(_compared(cells, payloads, kernel))
    slot, order = F.pmod(F.xxhash64("rep", F.lit("slot")), F.lit(LEADERS)), F.struct(F.xxhash64("rep", F.lit("order")).alias("h"), "rep")
    leaders = groups.join(large, "group").groupBy("group", "salts", slot.alias("slot")).agg(F.min(order).alias("first"))
    leaders = leaders.select("group", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("first.rep").alias("rep"))
    cells = cells.union(leaders.select(cell, F.lit(0), none, "rep", "rep"))  # before the cell's own: the first that the others are held against
    found = stored(_compared(cells, payloads, kernel))
    roots = connected_components(found).toDF("rep", "root")
    placed = salted.where("salts > 1").join(roots, "rep", "left").select("group", "rep", "bytes", F.coalesce("root", "rep").alias("root"))
    return found.union(stored(_compared(_open_cells(stored(placed), most, most_bytes), payloads, kernel)))


def _open_cells(placed: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Cells of each two blocks of a group (group, rep, bytes, root) that aren't of one joined part."""
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    named = placed.join(sizes, ["group", "root"]).withColumn("part", F.when(F.col("n") * 4 >= most, F.col("root")))  # null: all small parts of the group
    key = ["group", F.col("part").isNull().alias("loose"), F.coalesce("part", F.lit(0)).alias("part")]
    named = stored(named.select(*key, "rep", "bytes", "root"))
    cuts = named.groupBy("group", "loose", "part").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("bytes") / most_bytes)).cast("int").alias("blocks"))
    names = F.xxhash64("group", "loose", "part", "block").alias("block")
    blocks = cuts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", "loose", "part", names)
    other = blocks.toDF("group", "loose2", "part2", "block2")
    pairs = blocks.join(other, "group").where("(loose and block = block2) or (block < block2 and (loose or loose2 or part <> part2))")
    meet = F.xxhash64("block", "block2").alias("cell")
    sides = F.when(F.col("block") == F.col("block2"), F.array(F.struct("block", F.lit(0).alias("side")))).otherwise(F.array(F.struct("block", F.lit(1).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(2).alias("side"))))
    dealt = pairs.select(meet, F.explode(sides).alias("s")).select("cell", "s.block", "s.side")
    members = named.join(cuts, ["group", "loose", "part"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), "blocks").cast("int")).select(names, "rep", "root")
    return members.join(dealt, "block").select("cell", F.lit(1).alias("turn"), "side", "rep", "root")
