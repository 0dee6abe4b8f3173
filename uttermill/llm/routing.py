"""Learned partitions of a vector space: a balanced cut of a neighbour graph, and a classifier that repeats it for any vector.

Only the fits see samples, each of which is bounded by a parameter; every vector is routed by the fitted models. Up to
``FLAT_PARTS`` parts there is one model; beyond, a first model tells groups and one more for each group tells its parts.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most vectors that one fit looks at, but for the scatter of a hashed sample.
FIT_ROWS = 16_384
#: Vectors for each part that a fit looks at, where that is less.
FIT_PER_PART = 160
#: Neighbours per vector in the graph that is cut.
GRAPH_NEIGHBOURS = 10
#: Vectors per part on average; the number of parts grows with the table.
PART_ROWS = 1_024
#: Most parts that one model tells apart: each must have enough of the sample to learn from.
FLAT_PARTS = 256
#: Most groups of parts, which bounds the models that a task holds: 33,024 weights for each.
MOST_GROUPS = 256
#: Most probable parts that each vector is sent to.
LOOKUPS = 6
#: Most probable groups whose parts are scored for a vector.
GROUPS_SCORED = 8
#: A part in which more rows than this are to be expected is compared in tiles of so many rows.
TILE_ROWS = 16_384


def _log_share(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass(frozen=True)
class Linear:
    """Linear scores of some parts."""

    weights: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _best(score: np.ndarray, m: int) -> np.ndarray:
    """Columns of the ``m`` largest scores of each row, best first."""
    n = score.shape[1]
    m = min(m, n)
    some = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(score), 1))
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)


@dataclass(frozen=True)
class Router:
    """Tells the most probable parts of a vector. ``expected`` says how many rows each part will see if each has ``LOOKUPS``."""

    first: Linear
    inner: list[Linear] = field(default_factory=list)
    expected: np.ndarray | None = None

    @property
    def starts(self) -> np.ndarray:
        """The number of the first part of each group, and of all parts at the end."""
        return np.cumsum([0, *(g.parts for g in self.inner)])

    @property
    def parts(self) -> int:
        return int(self.starts[-1]) if self.inner else self.first.parts

    def top(self, x: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` most probable parts of each row, best first; fewer, if there are fewer."""
        if not self.inner:
            return _best(self.first.score(x), m).astype(np.int32)
        starts = self.starts
        outer = 0.5 * _log_share(self.first.score(x))
        groups = _best(outer, GROUPS_SCORED)
        most = max(g.parts for g in self.inner)
        score = np.full((len(x), groups.shape[1] * most), -np.inf, np.float32)
        name = np.full(score.shape, -1, np.int32)
        for j in range(groups.shape[1]):
            for g in np.unique(groups[:, j]):
                at, k = np.flatnonzero(groups[:, j] == g), self.inner[g].parts
                to = slice(j * most, j * most + k)
                score[at, to] = outer[at, g][:, None] + _log_share(self.inner[g].score(x[at]))
                name[at, to] = np.arange(starts[g], starts[g] + k)
        return np.take_along_axis(name, _best(score, min(m, self.parts)), 1)

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        models = [self.first, *self.inner]
        expected = np.zeros(0) if self.expected is None else self.expected
        np.savez(held, n=np.array([len(models)]), expected=expected, **{f"w{i}": m.weights for i, m in enumerate(models)}, **{f"b{i}": m.bias for i, m in enumerate(models)})
        return held.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Router:
        a = np.load(io.BytesIO(raw))
        models = [Linear(a[f"w{i}"], a[f"b{i}"]) for i in range(int(a["n"][0]))]
        return cls(models[0], models[1:], a["expected"] if len(a["expected"]) else None)


def part_count(rows: int) -> int:
    """Parts for a table of so many vectors."""
    return max(1, math.ceil(rows / PART_ROWS))


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``k`` most similar other rows and their cosines, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    at, near = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        some = np.argpartition(s, n - k, axis=1)[:, n - k :]
        at[i : i + 1024], near[i : i + 1024] = some, np.take_along_axis(s, some, 1)
    return at, near


def _priced(base: np.ndarray, price: np.ndarray, rate: float, steps: int = 6) -> np.ndarray:
    """The best part of each row under prices that rise for full parts and fall for empty ones."""
    n, parts = base.shape
    choice = np.zeros(n, np.int64)
    for _ in range(steps):
        choice = np.argmax(base - rate * price, axis=1)
        price += 0.03 * np.log(np.maximum(np.bincount(choice, minlength=parts), 1) * parts / n)
    return choice


def _centres(x: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    sums = np.zeros((parts, x.shape[1]), np.float64)
    np.add.at(sums, part, x)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def balanced_cut(x: np.ndarray, at: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of nearly equal size that cut few and weak edges of the neighbour graph and that a classifier can learn.

    Starts from cells around centres and moves each node to the part where most of its neighbours' weight and its
    nearest centre lie, under prices that keep the sizes equal. Returns parts, centres and prices.
    """
    n = len(x)
    centre, price = x[rng.choice(n, parts, replace=n < parts)].copy(), np.zeros(parts)
    for _ in range(8):
        part = _priced(x @ centre.T, price, 1.0)
        centre = _centres(x, part, parts)
    src = np.repeat(np.arange(n), at.shape[1])
    weight = np.maximum(near, 0.0).ravel() ** 4
    a, b, w = np.r_[src, at.ravel()], np.r_[at.ravel(), src], np.r_[weight, weight]
    share = (w / np.maximum(np.bincount(a, w, n), 1e-6)[a]).astype(np.float32)
    for _ in range(4):
        cells = x @ centre.T
        for _ in range(5):
            pull = np.zeros((n, parts), np.float32)
            np.add.at(pull, (a, part[b]), share)
            part = _priced(pull + cells, price, 1.0)
        centre = _centres(x, part, parts)
    return part, centre, price


def fit_linear(x: np.ndarray, parts: int, epochs: int = 12, seed: int = 5) -> Linear:
    """Cut the neighbour graph of unit vectors and train a softmax classifier to repeat the cut. A single part needs no scores."""
    rng = np.random.default_rng(seed)
    if parts < 2 or len(x) < 2:
        return Linear(np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32))
    at, near = neighbour_graph(x, GRAPH_NEIGHBOURS)
    y, centre, price = balanced_cut(x, at, near, parts, rng)
    w = [(centre.T * 10).astype(np.float32), (-price * 10).astype(np.float32)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        rate = 0.0015 * (1 + math.cos(math.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for i in range(0, len(x), 512):
            rows_now = order[i : i + 512]
            z = x[rows_now] @ w[0] + w[1]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows_now)), y[rows_now]] -= 1
            z /= len(rows_now)
            step += 1
            for j, g in enumerate((x[rows_now].T @ z, z.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                w[j] = w[j] - np.float32(rate) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return Linear(w[0].astype(np.float32), w[1].astype(np.float32))


# ---------------------------------------------------------------- tables of vectors


def packed(x: np.ndarray, small: bool = False) -> pa.Array:
    """Rows as half-precision bytes, or as one byte for each value, scaled to the row's largest.

    Half precision errs by about 3e-5 in a cosine, one byte by about 1e-3.
    """
    if small:
        flat = np.ascontiguousarray(np.round(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))), np.int8)
    else:
        flat = np.ascontiguousarray(x, np.float16)
    width = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, small: bool = False) -> np.ndarray:
    """The rows of :func:`packed`, in single precision and again of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.int8 if small else np.float16).reshape(len(column), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit_vectors(df: DataFrame, name: str, vector: str, loaded_at: str, dims: int = 128, small: bool = False) -> DataFrame:
    """``name STRING, vec BINARY``: each name's latest usable vector, scaled to length 1 and :func:`packed`.

    Usable are vectors of ``dims`` finite values that are not all zero. Null names are left out. Of vectors loaded at
    the same time the larger bytes count; null times are the oldest.
    """
    kind = "name string, loaded_at timestamp, vec binary"

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emb = batch.column("emb")
            keep = pc.fill_null(pc.equal(pc.list_value_length(emb), dims), False)
            batch = batch.filter(keep)
            if not batch.num_rows:
                continue
            flat = batch.column("emb").flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            most = np.abs(x).max(axis=1)
            good = np.isfinite(most) & (most > 0)
            x = x[good] / most[good][:, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            batch = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("loaded_at"), packed(x, small)], names=["name", "loaded_at", "vec"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(loaded_at).cast("timestamp").alias("loaded_at"), F.col(vector).alias("emb"))
    scaled = rows.where("name is not null and emb is not null").mapInArrow(scale, kind)
    return scaled.groupBy("name").agg(F.max(F.struct("loaded_at", "vec")).alias("best")).select("name", "best.vec")


def _held(batches: Iterator[pa.RecordBatch], dims: int, small: bool = False) -> np.ndarray:
    """The vectors of a sample, in the order of their names."""
    names, vectors = [], []
    for batch in batches:
        if batch.num_rows:
            names += batch.column("name").to_pylist()
            vectors.append(unpacked(batch.column("vec"), small))
    x = np.concatenate(vectors) if vectors else np.zeros((0, dims), np.float32)
    return np.ascontiguousarray(x[np.argsort(np.array(names, object).astype(str), kind="stable")] if len(x) else x)


def _spot(name: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit(seed)), F.lit(2**31))


def learned_router(df: DataFrame, name: str, vector: str, loaded_at: str, dims: int = 128, seed: int = 7) -> Router:
    """A router for a table of raw vectors, see :func:`fitted`. Only names of the samples are normalised."""
    rows = df.where(F.size(vector) == dims).count()
    return fitted(lambda share: unit_vectors(df.where(_spot(name, seed) < int(share * 2**31)), name, vector, loaded_at, dims), rows, dims)


def router_of(vectors: DataFrame, dims: int = 128, seed: int = 7, small: bool = False) -> Router:
    """A router for a stored table of ``name, vec``, see :func:`fitted`."""
    return fitted(lambda share: vectors.where(_spot("name", seed) < int(share * 2**31)).select("name", "vec"), vectors.count(), dims, small)


def fitted(drawn: Callable[[float], DataFrame], rows: int, dims: int, small: bool = False) -> Router:
    """Fit a router for so many rows from samples of about ``FIT_ROWS`` names for each model, or fewer if there are few parts, each model in one task.

    ``drawn`` gives the rows of a share of the names. Only fitted models come to the driver: at most ``MOST_GROUPS`` of
    at most ``FLAT_PARTS`` parts, 34 MB in all.
    """
    parts = part_count(rows)
    groups = min(MOST_GROUPS, math.ceil(2 * parts / FLAT_PARTS)) if parts > FLAT_PARTS else 1

    def sample(n: int) -> DataFrame:
        return drawn(min(1.0, n / max(rows, 1)))

    def fit(parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = _held(batches, dims, small)[: 2 * FIT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([_measured(Router(fit_linear(x, parts)), x, rows).to_bytes()], pa.binary())], names=["model"])

        return run

    first = Router.from_bytes(sample(min(FIT_ROWS, FIT_PER_PART * parts)).repartition(1).mapInArrow(fit(parts if groups == 1 else groups), "model binary").first()[0])
    if groups == 1:
        return first
    each = min(FLAT_PARTS, math.ceil(parts / groups))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                group = first.top(unpacked(batch.column("vec"), small), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(group), batch.column("name"), batch.column("vec")], names=["grp", "name", "vec"])

    def fit_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _held(pa.Table.from_pandas(pdf[["name", "vec"]], preserve_index=False).to_batches(), dims, small)[: 2 * FIT_ROWS]
        return pd.DataFrame({"grp": [key[0]], "model": [Router(fit_linear(x, each)).to_bytes()]})

    # A group's sample is about FIT_ROWS rows, whatever the size of the table.
    laid = sample(FIT_ROWS * groups).mapInArrow(grouped, "grp int, name string, vec binary")
    models = {r["grp"]: Router.from_bytes(r["model"]).first for r in laid.groupBy("grp").applyInPandas(fit_group, "grp int, model binary").collect()}
    none = Linear(np.zeros((dims, 1), np.float32), np.zeros(1, np.float32))
    router = Router(first.first, [models.get(g, none) for g in range(first.first.parts)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_measured(router, _held(batches, dims, small)[: 2 * FIT_ROWS], rows).to_bytes()], pa.binary())], names=["model"])

    return Router.from_bytes(sample(FIT_ROWS).repartition(1).mapInArrow(measure, "model binary").first()[0])


def _measured(router: Router, x: np.ndarray, rows: int) -> Router:
    """The router with the rows that each part is expected to see, from a sample."""
    if not len(x):
        return router
    seen = np.bincount(router.top(x, LOOKUPS).ravel(), minlength=router.parts) / len(x)
    return Router(router.first, router.inner, seen * rows)


@dataclass(frozen=True)
class Tiles:
    """How the rows of each part are laid out: in ``cuts`` slices by hash, of which every two meet in a tile."""

    cuts: np.ndarray

    @classmethod
    def of(cls, router: Router) -> Tiles:
        expected = np.zeros(router.parts) if router.expected is None else router.expected
        return cls(np.where(expected > TILE_ROWS, np.ceil(2 * expected / TILE_ROWS), 1).astype(np.int64))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(np.r_[0, self.cuts * (self.cuts + 1) // 2])

    @property
    def count(self) -> int:
        return int(self.starts[-1])

    def places(self, part: np.ndarray, spot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For rows with their part and a hash: which rows go to which tile, on which side (0: all meet all, 1 and 2: the sides meet)."""
        cuts, starts = self.cuts[part], self.starts[part]
        slot = spot % cuts
        for other in range(int(cuts.max(initial=1))):
            at = np.flatnonzero(cuts > other)
            low, high = np.minimum(slot[at], other), np.maximum(slot[at], other)
            side = np.where(low == high, 0, np.where(slot[at] == low, 1, 2))
            yield at, starts[at] + high * (high + 1) // 2 + low, side
