"""All pairs of vectors with a cosine of a threshold or more, exactly, without a cross join.

Unit vectors with a cosine of t are r = sqrt(2 - 2 t) apart. Each vector is at home in the cell of its nearest reference, one
of a bounded sample. Two vectors within r of each other that are at home in different cells are both within r of the plane
halfway between the two references; so a vector is also a guest in each cell of a smaller number whose plane is that near,
and every pair within r meets in just one cell. Cells that follow each other make regions, so that a vector is sent to a region
once however many of its cells it is a guest of. A task holds two blocks of a region's members, and compares those of each cell
with the cell's guests, in order of their distance to the reference; parts whose distances differ by more than r are discarded
by the triangle inequality, the rest are multiplied. Blocks grow with the rows, so that a vector is sent to some PARTS tasks, up
to PARTS * WIDEST rows; from there on to more. No task gives pairs or holds a matrix of its members: each adds up its members'
links, and gives as many links as join them.

The number of references follows the rows up to MOST_REFERENCES. How much the bounds discard depends on the data: vectors in
groups meet near their own groups only; vectors that lie evenly in many dimensions are guests nearly everywhere below a
threshold of some 0.95, and cost the square of the blocks.

Equal vectors are one member. Rows whose vector is null, has null or non-finite entries or no length, or has another number of
entries than the most frequent one (ties: the larger), have no links. Rows of one id are rows of their own. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .components import connected_components

MOST_REFERENCES, SAMPLE = 1024, 4096
#: Members of a block that are multiplied with as many others at once.
TILE = 256
#: A block has one of so many parts of the members, and no more than WIDEST.
PARTS, WIDEST = 32, 32768


def _units(rows: DataFrame) -> DataFrame:
    """(id, key, size, unit): key of 128 bits of the unit vector, which is null where the row can have no links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, units = [], []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], np.float64)
                length = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                some = bool(0 < length < np.inf)
                size.append(len(x) if some else None)
                units.append((x / length + 0.0).astype("<f8").tobytes() if some else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(units, pa.binary())], ["id", "size", "unit"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, size int, unit binary")
    return found.select("id", F.struct(F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(1), "unit").alias("b")).alias("key"), "size", "unit")


def references(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample at most, each the farthest from those before."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def cells_of(units: np.ndarray, refs: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and of which cells it is a guest (rows x cells)."""
    near = units @ refs.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * refs @ refs.T, 0))
    to_plane = (near[np.arange(len(near)), home][:, None] - near) / np.maximum(apart[home], 1e-12)
    return home, to_plane <= radius + 1e-9


def _placed(members: DataFrame, refs: np.ndarray, radius: float, together: int) -> DataFrame:
    """(rep, cell, region, guest): each member in the region of its home cell, and as a guest once in each earlier region that has a
    cell it is a guest of. A region is so many cells that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                units = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f8").reshape(part.num_rows, -1)
                home, guest = cells_of(units, refs, radius)
                of_region = np.add.reduceat(guest, np.arange(0, len(refs), together), axis=1, dtype=np.int64) > 0
                rows, regions = np.nonzero(of_region & (np.arange(of_region.shape[1]) < (home // together)[:, None]))
                reps, home = part.column(0).to_numpy(), home.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[reps, reps[rows]]), pa.array(np.r_[home, home[rows]]), pa.array(np.r_[home // together, regions]), pa.array(np.r_[np.zeros(len(home), bool), np.ones(len(rows), bool)])], ["rep", "cell", "region", "guest"])

    return members.select("rep", "unit").mapInArrow(run, "rep long, cell long, region long, guest boolean")


def _block_pairs(placed: DataFrame, most: int) -> DataFrame:
    """(task, side, rep, cell, region): each two blocks of a region, of which one at least is of homes; a block with itself has side 0."""
    cuts = placed.groupBy("region", "guest").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    blocks = cuts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    own, other = blocks.where("not guest").select("region", F.col("block").alias("b1")), blocks.select("region", F.col("guest").alias("g2"), F.col("block").alias("b2"))
    pairs = own.join(other, "region").where("g2 or b1 <= b2").withColumn("task", F.xxhash64("region", "b1", "g2", "b2"))
    side = lambda g, b, n: F.struct(F.lit(g).alias("guest") if isinstance(g, bool) else g.alias("guest"), F.col(b).alias("block"), F.lit(n).alias("side"))
    same = ~F.col("g2") & (F.col("b1") == F.col("b2"))
    sides = F.when(same, F.array(side(False, "b1", 0))).otherwise(F.array(side(False, "b1", 1), side(F.col("g2"), "b2", 2)))
    dealt = pairs.select("task", "region", F.explode(sides).alias("s")).select("task", "region", "s.*")
    named = placed.join(cuts, ["region", "guest"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).drop("blocks")
    return named.join(dealt, ["region", "guest", "block"]).select("task", "side", "guest", "rep", "cell", "region")


class _Links:
    """What is found among the members (units, copies) of a task: links and comparisons of each, and as many links as join them."""

    def __init__(self, units: np.ndarray, copies: np.ndarray, least: float, radius: float) -> None:
        self.units, self.copies, self.least, self.radius = units, copies, least, radius
        self.n, self.compared, self.parts, self.joins = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.arange(len(units)), []

    def compare(self, to_ref: np.ndarray, some: np.ndarray, others: np.ndarray | None = None) -> None:
        """Members (places) against others, or each two of them; those whose distances to a reference differ too much are left out."""
        some = some[np.argsort(to_ref[some], kind="stable")]
        b = some if others is None else others[np.argsort(to_ref[others], kind="stable")]
        far = to_ref[b]
        for at in range(0, len(some), TILE):
            a = some[at : at + TILE]
            first = at if others is None else int(np.searchsorted(far, to_ref[a[0]] - self.radius - 1e-9))
            last = int(np.searchsorted(far, to_ref[a[-1]] + self.radius + 1e-9, "right"))
            for k in range(first, last, 8 * TILE):
                c = b[k : min(k + 8 * TILE, last)]
                meet = np.arange(len(c)) + k > np.arange(len(a))[:, None] + at if others is None and k < at + len(a) else None
                self.compared[a] += len(c) if meet is None else meet.sum(1)
                self.compared[c] += len(a) if meet is None else meet.sum(0)
                found = self.units[a] @ self.units[c].T >= self.least
                if meet is not None:
                    found &= meet
                if found.any():
                    self._add(a, c, found)

    def _add(self, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> None:
        i, j = np.nonzero(found)
        self.n[a] += np.bincount(i, self.copies[b[j]], len(a)).astype(np.int64)
        self.n[b] += np.bincount(j, self.copies[a[i]], len(b)).astype(np.int64)
        for k in np.unique(i[self.parts[a[i]] != self.parts[b[j]]]).tolist():
            to = b[found[k]]
            parts, at = np.unique(self.parts[to], return_index=True)
            new = parts != self.parts[a[k]]
            self.joins += [(a[k], x) for x in to[at[new]]]
            gone = np.zeros(len(self.parts), bool)
            gone[parts[new]] = True
            self.parts[gone[self.parts]] = self.parts[a[k]]


def _linked(units: np.ndarray, cells: np.ndarray, guests: np.ndarray, sides: np.ndarray, copies: np.ndarray, of_region: np.ndarray, refs: np.ndarray, least: float, radius: float) -> _Links:
    """Members at home in a cell of the region against each other and those of later cells that are guests of it. Members of one
    side (over 0) don't meet."""
    out = _Links(units, copies, least, radius)
    near_home = (units * refs[cells]).sum(1)
    for c in of_region:
        own = (cells == c) & ~guests
        if not own.any():
            continue
        near = units @ refs[c]
        apart = np.sqrt(np.maximum(2 - 2 * refs[cells] @ refs[c], 0))
        beyond = (cells > c) & ((near_home - near) / np.maximum(apart, 1e-12) <= radius + 1e-9)
        to_ref, of = np.sqrt(np.maximum(2 - 2 * near, 0)), lambda side, x: np.flatnonzero(x & (sides == side))
        out.compare(to_ref, of(0, own))
        out.compare(to_ref, of(0, own), of(0, beyond))
        for x, y in ((of(1, own), of(2, own)), (of(1, own), of(2, beyond)), (of(2, own), of(1, beyond))):
            out.compare(to_ref, x, y)
    return out


def _compared(refs: np.ndarray, least: float, radius: float, together: int):
    """Over rows (task, side, guest, rep, cell, region, copies, unit) sorted by task: (a, null, links, compared) of members, and links (a, b)."""

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        side, guest, rep, cell, region, copies = (rows[c].to_numpy() for c in ("side", "guest", "rep", "cell", "region", "copies"))
        units = np.concatenate([np.frombuffer(b"".join(x.to_pylist()), "<f8") for x in rows["unit"].chunks]).reshape(len(rep), -1)
        first = int(region[0]) * together
        found = _linked(units, cell, guest, side, copies, np.arange(first, min(first + together, len(refs))), refs, least, radius)
        met, joined = found.compared > 0, np.array(found.joins, np.int64).reshape(-1, 2)
        a, none = np.r_[rep[met], rep[joined[:, 0]]], np.zeros(len(joined), np.int64)
        b = pa.array(np.r_[np.zeros(met.sum(), np.int64), rep[joined[:, 1]]], mask=np.arange(len(a)) < met.sum())
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.r_[found.n[met], none]), pa.array(np.r_[found.compared[met], none])], ["a", "b", "n", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and tasks[i] != at:
                    if held:
                        yield from close(held)
                    at, held = tasks[i], []
                if i < j:
                    held.append(batch.slice(i, j - i))
        if held:
            yield from close(held)

    return run


def similar_vectors(rows: DataFrame, least: float, most: int = 1024) -> DataFrame:
    """(id, class_id, n_links, n_compared) of each row (id, vec): the smallest id that links of a cosine of `least` (over 0) or
    more lead to, itself included; how many other rows it is linked to; and with how many other vectors it was compared."""
    found = stored(_units(rows.select("id", F.col("vec").cast("array<double>").alias("vec"))))
    sizes = found.where("size is not null").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    zero = F.lit(0).cast("long")
    usable = F.coalesce(F.col("size") == (sizes["size"] if sizes else 0), F.lit(False))
    alone = found.where(~usable).select("id", F.col("id").alias("class_id"), zero.alias("n_links"), zero.alias("n_compared"))
    if sizes is None:
        return alone
    distinct = found.where(usable).groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    members = stored(distinct.withColumn("rep", F.monotonically_increasing_id()))
    sample = members.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").collect()  # SAMPLE rows at most
    n = members.count()
    refs = references(np.array([np.frombuffer(r["unit"], "<f8") for r in sample]), int(min(MOST_REFERENCES, n // most + 1)))
    wide = min(max(n // PARTS, most), WIDEST)
    together = max(1, len(refs) * wide // n)
    radius = float(np.sqrt(max(2 - 2 * least, 0.0)))
    tasks = _block_pairs(stored(_placed(members, refs, radius, together)), wide)
    dealt = tasks.join(members.select("rep", "copies", "unit"), "rep").select("task", "side", "guest", "rep", "cell", "region", "copies", "unit").repartition("task").sortWithinPartitions("task")
    results = stored(dealt.mapInArrow(_compared(refs, least, radius, together), "a long, b long, n long, compared long"))
    counts = results.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"), F.sum("compared").alias("n_compared"))
    roots = connected_components(results.where("b is not null").select("a", "b")).toDF("rep", "root")
    named = members.drop("unit").join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of_root = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(of_root, "root").select("key", "class_id", (F.coalesce("n", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_compared", zero).alias("n_compared"))
    return found.where(usable).select("id", "key").join(named, "key").drop("key").union(alone)
