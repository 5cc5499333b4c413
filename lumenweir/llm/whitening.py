"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are taken as whole numbers x = floor(scale * c) + shift, so that their sums are exact; a row is centred by taking the
whole part of the mean from x as a whole number and its fraction after that. With A the centred rows, steps alternate
u = A v and v = A' u: orthonormal vectors v and u that turn A into an upper bidiagonal matrix, whose small SVD gives the
components (v combined by its right singular vectors) and the deviations (its singular values over sqrt(n)).

A has a row for each vector and is nowhere held whole. All u lie in the range of A, u = A q, so that a task has its rows of
every u from its own rows of A and the few vectors q, which travel with the plan: no vector as long as the table is written
or shuffled, and a lost executor costs the repetition of its tasks. A step is two jobs: A v and its products with all u so
far, then the new u, once more orthogonalised against all of them, and A' u. Each task returns one row of some hundred
numbers, added up by the driver in order of the tasks; tasks are MOST_TASKS at most. v is orthogonalised twice against
all v. A step that finds nothing new starts again from a vector that is orthogonal to all before; so repeated eigenvalues
are found as well. Steps end when all dimensions are found, or earlier when the wanted components have converged and what
variance is left is less than the smallest of them, which proves that none is missing.

Rows whose vector is null, or holds null or non-finite entries, are dropped, and so are rows of another length than the
most frequent one (ties: the longer). Entries beyond 2^52 after scaling count as 2^52. Components of no variance (an
eigenvalue below 1e-12 of the first) are left out: equal rows, a single row, rows of no entries and an empty table give no
rows. Repeated rows and ids count each; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored

MOST_TASKS = 4096
#: Rows of A that a task holds as floating-point numbers at once, in numbers.
BLOCK = 1 << 20
#: Eigenvalues below this share of the first are none.
LEAST = 1e-12
_END = 1 << 52


def whole(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, size, x): the usable rows; x: the whole numbers, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            ids, size, xs = [], [], []
            lists = b.column(1)
            some = pc.fill_null(pc.is_valid(lists), False)
            ids_of, lists = b.column(0).filter(some), lists.filter(some)
            flat = lists.flatten().cast(pa.float64())
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            n = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(n)
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            keep = bad[ends] == bad[ends - n]
            with np.errstate(all="ignore"):
                x = np.clip(np.floor(scale * values), -_END, _END)
            x = np.where(np.isfinite(x), x, 0).astype("<i8") + shift
            for s, e in zip((ends - n)[keep].tolist(), ends[keep].tolist(), strict=True):
                xs.append(x[s:e].tobytes())
            ids, size = ids_of.filter(pa.array(keep)), n[keep]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(xs, pa.binary())], ["vec_id", "size", "x"])

    rows = pick(vectors, vec_id, embedding).toDF("vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, size int, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Binary rows of d whole numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


@dataclass
class Centred:
    """The centred rows A of a table (size, x), and sums over them."""

    rows: DataFrame
    d: int
    n: int = 0
    sums: list[int] = field(default_factory=list)  # exact
    variance: float = 0.0  # of all dimensions, times n

    @classmethod
    def of(cls, rows: DataFrame, d: int) -> Centred:
        found = cls(rows, d)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, [0] * d
            for b in batches:
                x = _matrix(b.column(0), d)
                n += len(x)
                high, low = x >> 26, x & (1 << 26) - 1  # sums of either fit 64 bits
                sums = [s + (h << 26) + v for s, h, v in zip(sums, high.sum(0).tolist(), low.sum(0).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

        parts = found._tasks().mapInArrow(summed, "n long, sums array<string>").collect()  # one row a task
        found.n = sum(p["n"] for p in parts)
        found.sums = [sum(int(p["sums"][i]) for p in parts) for i in range(d)]
        found.variance = found.over(lambda a: {"v": (a * a).sum().reshape(1)})["v"].item() if found.n else 0.0
        return found

    def _tasks(self) -> DataFrame:
        x = self.rows.select("x")
        return x.coalesce(MOST_TASKS) if x.rdd.getNumPartitions() > MOST_TASKS else x

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean of each dimension: its whole part, and the rest."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])

    def over(self, f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """f's results of blocks of rows, added up."""
        (base, rest), d = self.centre(), self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for b in batches:
                step = max(1, BLOCK // d)
                for at in range(0, b.num_rows, step):
                    a = (_matrix(b.column(0).slice(at, step), d) - base) - rest
                    for k, v in f(a).items():
                        total[k] = total[k] + v if k in total else v
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([list(v.shape)], pa.list_(pa.int32()))], ["name", "value", "shape"])

        out: dict[str, np.ndarray] = {}
        for r in self._tasks().mapInArrow(run, "name string, value binary, shape array<int>").collect():
            v = np.frombuffer(r["value"], "<f8").reshape(r["shape"])
            out[r["name"]] = out[r["name"]] + v if r["name"] in out else v
        return out


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without its part in the span of the basis' columns, taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalised(a: Centred, most: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(components, singular values) of A, the `most` largest, with components as columns."""
    d, rng = a.d, np.random.default_rng(seed)
    fresh = lambda basis: (lambda w: w / np.linalg.norm(w))(_orthogonal(rng.standard_normal(d), basis))
    vs, qs, zs = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))  # v; u = A q; z = A' u
    diagonal, above = [], []  # of the bidiagonal matrix; above[j] links u_j and v_j+1
    v = fresh(vs)
    scale = np.sqrt(a.variance)
    while True:
        q = qs.copy()
        c = a.over(lambda x, q=q, v=v: {"c": (x @ q).T @ (x @ v)})["c"] if q.size else np.empty(0)
        new = v - qs @ c
        got = a.over(lambda x, q=q, new=new: (lambda u: {"c": (x @ q).T @ u, "uu": (u @ u).reshape(1), "z": x.T @ u})(x @ new))
        again = got["c"] if q.size else np.empty(0)
        norm = np.sqrt(max(0.0, float(got["uu"][0]) - float(again @ again)))
        vs = np.column_stack([vs, v])
        if norm > 1e-13 * scale:
            u = (new - qs @ again) / norm
            z = (got["z"] - zs @ again) / norm
            qs, zs = np.column_stack([qs, u]), np.column_stack([zs, z])
            diagonal.append(norm)
            w = _orthogonal(z, vs)
            beta = float(np.linalg.norm(w))
        else:  # A v is nothing new: u is none, and neither does v lead on
            qs, zs = np.column_stack([qs, np.zeros(d)]), np.column_stack([zs, np.zeros(d)])
            diagonal.append(0.0)
            beta = 0.0
        k = len(diagonal)
        b = np.diag(diagonal) + np.diag(above, 1) if above else np.diag(diagonal)
        left, values, right = np.linalg.svd(b)
        wanted = min(most, k)
        settled = k > most and np.all(beta * np.abs(left[-1, :wanted]) <= 1e-15 * values[0])
        left_over = a.variance - float((values**2).sum())
        if k == d or settled and left_over < 0.5 * values[wanted - 1] ** 2:
            return vs @ right[:wanted].T, values[:wanted]
        if beta > 1e-13 * scale:
            v, link = w / beta, beta
        else:
            v, link = fresh(vs), 0.0
        above.append(link)


def whitened(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component; deviation: the
    sum over dimensions of (n x - S)^2, exact, as a decimal of 38 digits."""
    rows = stored(whole(vectors, scale, shift, vec_id, embedding))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    sizes = rows.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes["size"]
    rows = rows.where(F.col("size") == d)
    a = Centred.of(rows, d)
    if a.variance <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    components, values = bidiagonalised(a, most)
    kept = values**2 > LEAST * values[0] ** 2
    components, values = components[:, kept], values[kept]
    turn = components / (values / np.sqrt(a.n))
    moments = a.over(lambda x: (lambda w: {"sum": w.sum(0), "squares": w.T @ w})(x @ turn))
    mean = moments["sum"] / a.n
    error = float(np.abs(moments["squares"] / a.n - np.outer(mean, mean) - np.eye(len(values))).max())
    explained = values**2 / a.variance
    return rows.select("vec_id", "x").mapInArrow(_projected(a.n, d, a.centre(), a.sums, turn, explained, error), schema)


def _projected(n: int, d: int, centre: tuple, sums: list[int], turn: np.ndarray, explained: np.ndarray, error: float):
    (base, rest), k = centre, turn.shape[1]
    over = [s - n * int(b) for s, b in zip(sums, base.tolist(), strict=True)]  # n x - S = n (x - base) - over

    def deviations(y: np.ndarray) -> list[int]:
        m = int(np.abs(y).max(initial=0)) + 1
        if m * m * d < 1 << 62 and m * n * d < 1 << 62:
            squares, mixed = (y * y).sum(1).tolist(), (y @ np.array(over, np.int64)).tolist()
        else:
            exact = [[int(v) for v in r] for r in y.tolist()]
            squares, mixed = [sum(v * v for v in r) for r in exact], [sum(v * o for v, o in zip(r, over, strict=True)) for r in exact]
        alone = sum(o * o for o in over)
        return [n * n * s - 2 * n * m + alone for s, m in zip(squares, mixed, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            step = max(1, BLOCK // d)
            for at in range(0, b.num_rows, step):
                ids, y = b.column(0).slice(at, step), _matrix(b.column(1).slice(at, step), d) - base
                each = np.repeat(np.arange(len(y)), k)
                deviation = pa.array([Decimal(v) for v in deviations(y)], pa.decimal128(38, 0))
                columns = [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(each), n, np.int64)), deviation.take(pa.array(each)),
                    pa.array(((y - rest) @ turn).ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
