"""Trained back-ends: two-covariance models, discriminant projections, chains of transforms and calibration.

The cluster reduces a table to sufficient statistics of fixed size; only those are solved on the driver.
"""

from __future__ import annotations

import json
import math
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import drop_written, written


#: Groups in which the partial sums of tasks are added up before they meet in one.
TREE_WIDTH = 8


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def second_moments(df: DataFrame, vector: str, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, weighted sum and weighted sum of outer products of all vectors; vectors of one length, nulls left out.

    Every task sums what it reads. The sums of tasks are added up in ``TREE_WIDTH`` groups, as a stream that holds one
    sum at a time, and those of the groups once more, so neither a task nor the driver holds more than a few matrices.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(vector).isNotNull()).select(w.alias("w"), F.col(vector).alias("x"))
    kind = "at int, sums array<double>"  # weight, sum, and the upper triangle of the outer products

    def out(total: np.ndarray | None, at: int) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["at", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tri = None, None
        for b in batches:
            if b.num_rows:
                y, x = b.column("w").to_numpy(), _matrix(b.column("x"))
                tri = np.triu_indices(x.shape[1]) if tri is None else tri
                new = np.r_[y.sum(), y @ x, ((x * y[:, None]).T @ x)[tri]]
                total = new if total is None else total + new
        yield from out(total, TaskContext.get().partitionId() % TREE_WIDTH)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                new = _matrix(b.column("sums")).sum(axis=0)
                total = new if total is None else total + new
        yield from out(total, 0)

    partial = rows.mapInArrow(part, kind)
    found = partial.repartition(TREE_WIDTH, "at").mapInArrow(add, kind).repartition(1).mapInArrow(add, kind).collect()  # one row
    if not found:
        raise ValueError("there are no vectors")
    sums = np.array(found[0]["sums"])
    d = int((-3 + math.sqrt(9 + 8 * (len(sums) - 1))) / 2 + 0.5)
    square = np.zeros((d, d))
    square[np.triu_indices(d)] = sums[1 + d :]
    return sums[0], sums[1 : 1 + d], square + np.triu(square, 1).T


def _affine(matrix: np.ndarray, offset: np.ndarray, to_root_of_dims: bool = False) -> Callable[[Column], Column]:
    """``matrix @ x + offset`` for a batch of vectors at once; a matrix is too large to be an expression."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            known = x.notna().to_numpy()
            out: list = [None] * len(x)
            if known.any():
                y = np.stack(x[known].to_list()).astype(np.float64) @ matrix.T + offset
                if to_root_of_dims:
                    y *= np.sqrt(y.shape[1]) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-10)
                for i, row in zip(np.flatnonzero(known), y):
                    out[i] = row
            yield pd.Series(out)

    return run


def _prepared(x: Column, mean: np.ndarray | None, normalize_length: bool) -> Column:
    """Vectors less the mean and scaled to length root of their dimensions, as far as asked for."""
    x = x if mean is None else V.subtract(x, V.literal_vector(mean))
    return V.length_normalized(x, scale_by_dims=True) if normalize_length else F.transform(x, lambda v: v.cast("double"))


def averaged(parameters: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``keys, value``: parameters averaged over exactly ``n`` checkpoints; another number of them raises an error once the result runs."""
    fault = F.concat(F.lit(f"a parameter does not come from {n} checkpoints: "), F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)))
    per = parameters.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(value), F.count(value).alias("__n"))
    return per.where(F.when(F.col("__n") == n, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).drop("__n")


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, n, mean`` of each class with a name."""
    from uttermill.operators.verify import mean_vector

    return mean_vector(df.where(F.col(label).isNotNull()), vector, label)


# ---------------------------------------------------------------- two-covariance model


@dataclass
class TwoCovariance:
    """Between- and within-class model: ``transform`` whitens within and makes between the diagonal ``psi``."""

    mu: np.ndarray
    transform: np.ndarray
    psi: np.ndarray
    normalize_length: bool = False
    mean: np.ndarray | None = None

    @property
    def offset(self) -> np.ndarray:
        return -self.transform @ self.mu

    @classmethod
    def of(cls, mu: np.ndarray, between: np.ndarray, within: np.ndarray) -> TwoCovariance:
        try:
            white = np.linalg.inv(np.linalg.cholesky(within))
        except np.linalg.LinAlgError:
            white = np.linalg.inv(np.linalg.cholesky(within + 1e-6 * np.eye(len(within))))
        values, vectors = np.linalg.eigh(white @ between @ white.T)
        order = np.argsort(-values, kind="stable")
        return cls(mu, vectors[:, order].T @ white, np.maximum(values[order], 0.0))

    @classmethod
    def fit(cls, df: DataFrame, label: str, vector: str, rounds: int = 10, normalize_length: bool = False, subtract_mean: bool = False) -> TwoCovariance:
        """Expectation maximisation on the labelled vectors, after the mean of all vectors is taken off and they are scaled to length root of dims, if so asked.

        The mean that is taken off is that of all vectors, labelled or not. Classes of equal size share their posterior
        covariance, so one matrix for each size suffices; sizes are handled one after the other.
        """
        mean = None
        if subtract_mean:
            n, first, _ = second_moments(df, vector)
            mean = first / n
        ready = df.where(F.col(label).isNotNull()).withColumn(vector, _prepared(F.col(vector), mean, normalize_length))
        means = written(class_means(ready, label, vector), "means")
        n_all, _, raw = second_moments(ready, vector)
        sizes = [r["n"] for r in means.select("n").distinct().orderBy("n").collect()]
        per_size = {size: second_moments(means.where(F.col("n") == size), "mean") for size in sizes}
        drop_written(means)
        classes = sum(m[0] for m in per_size.values())
        mu = sum(m[1] for m in per_size.values()) / classes
        # Sum of squares within classes: all of them less that of the means, each as often as its class has members.
        scatter = raw - sum(size * m[2] for size, m in per_size.items())
        centred = {size: (m[0], m[2] - np.outer(m[1], mu) - np.outer(mu, m[1]) + m[0] * np.outer(mu, mu)) for size, m in per_size.items()}
        eye = np.eye(len(mu))
        between, within = eye.copy(), eye.copy()
        for _ in range(rounds):
            prior, noise = np.linalg.inv(between), np.linalg.inv(within)
            b, w = np.zeros_like(eye), scatter.copy()
            for size, (count, square) in centred.items():
                cov = np.linalg.inv(prior + size * noise)
                gain = size * cov @ noise
                b += count * cov + gain @ square @ gain.T
                w += size * (count * cov + (eye - gain) @ square @ (eye - gain).T)
            between, within = b / classes, w / n_all
            between, within = (between + between.T) / 2, (within + within.T) / 2
        return replace(cls.of(mu, between, within), normalize_length=normalize_length, mean=mean)

    def adapted(self, df: DataFrame, vector: str, between_scale: float = 0.5, within_scale: float = 0.5) -> TwoCovariance:
        """Adapt to unlabelled vectors: variance beyond what the model expects is shared out between both covariances."""
        n, first, second = second_moments(df.withColumn(vector, _prepared(F.col(vector), self.mean, self.normalize_length)), vector)
        mean = first / n
        cov = (second - n * np.outer(mean, mean)) / (n - 1)
        back = np.linalg.inv(self.transform)
        within, between = back @ back.T, back @ np.diag(self.psi) @ back.T
        root = np.linalg.cholesky((within + between + (within + between).T) / 2)
        inverse = np.linalg.inv(root)
        values, vectors = np.linalg.eigh(inverse @ cov @ inverse.T)
        more = values > 1
        excess = root @ vectors[:, more] * np.sqrt(values[more] - 1)
        extra = excess @ excess.T
        return replace(TwoCovariance.of(mean, between + between_scale * extra, within + within_scale * extra), normalize_length=self.normalize_length, mean=self.mean)

    def transformed(self, x: Column) -> Column:
        """A vector in the model's space, scaled to length root of its dimensions if the model says so."""
        return _affine(self.transform, self.offset, self.normalize_length)(_prepared(x, self.mean, self.normalize_length))

    def score(self, trials: DataFrame, enroll: DataFrame, test: DataFrame, count_sessions: bool = False) -> DataFrame:
        """``enroll, test, score, label`` of trials against enrolled means (``name, emb, n``) and test vectors (``utt, emb``)."""
        e = enroll.select(F.col("name").alias("enroll"), self.transformed(F.col("emb")).alias("e"), (F.col("n") if count_sessions else F.lit(1)).alias("n"))
        t = test.select(F.col("utt").alias("test"), self.transformed(F.col("emb")).alias("t"))
        joined = trials.join(e, "enroll").join(t, "test")
        return joined.select("enroll", "test", V.plda_llr(F.col("e"), F.col("t"), V.literal_vector(self.psi), F.col("n")).alias("score"), "label")

    def save(self, spark, path: str) -> None:
        row = (self.mu.tolist(), self.transform.tolist(), self.psi.tolist(), self.normalize_length, None if self.mean is None else self.mean.tolist())
        spark.createDataFrame([row], "mu array<double>, transform array<array<double>>, psi array<double>, normalize_length boolean, mean array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TwoCovariance:
        r = spark.read.parquet(path).first()
        return cls(np.array(r["mu"]), np.array(r["transform"]), np.array(r["psi"]), r["normalize_length"], None if r["mean"] is None else np.array(r["mean"]))


# ---------------------------------------------------------------- chains of transforms


def discriminant(df: DataFrame, label: str, vector: str, dims: int, floor: float = 1e-6, equal_weight: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection that separate classes best. Classes of one vector tell nothing and are left out."""
    kept = class_means(df, label, vector).where("n > 1")
    counted = second_moments(kept, "mean", weight=None if equal_weight else "n")
    mean = counted[1] / counted[0]
    between = counted[2] / counted[0] - np.outer(mean, mean)
    members = df.join(kept.select(label, F.col("n").alias("__n")), label)
    if equal_weight:
        members = members.withColumn("__w", 1 / F.col("__n"))
        total, squares = second_moments(members, vector, "__w"), second_moments(kept, "mean")
    else:
        total, squares = second_moments(members, vector), counted
    within = (total[2] - squares[2]) / total[0]
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    white = (vectors / np.sqrt(np.maximum(values, values.max() * floor))).T
    _, best = np.linalg.eigh(white @ between @ white.T)
    return mean, white.T @ best[:, -dims:]


@dataclass
class Chain:
    """Fitted transforms in order. ``text`` such as ``mean-subtract | length-norm | lda --dim 16`` describes one."""

    links: list[dict] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> list[tuple[str, dict[str, str]]]:
        """``name --key value ... | name ...`` as names and options."""
        out = []
        for part in text.split("|"):
            words = shlex.split(part)
            if not words:
                raise ValueError("an empty link in the chain")
            name, rest = words[0], words[1:]
            if len(rest) % 2 or any(not k.startswith("--") for k in rest[::2]):
                raise ValueError(f"options of {name} must come as --key value")
            out.append((name, {k[2:]: v for k, v in zip(rest[::2], rest[1::2])}))
        return out

    def fit(self, text: str, df: DataFrame, vector: str, label: str | None = None) -> Chain:
        """Fit each link on the vectors as the links before it leave them."""
        for name, options in self.parse(text):
            self.links.append(self._fitted(name, options, self.apply(df, vector), vector, label))
        return self

    def refit(self, at: int, text: str, df: DataFrame, vector: str, label: str | None = None) -> Chain:
        """Fit one link anew; the links behind it stay as they are."""
        ((name, options),) = self.parse(text)
        new = self._fitted(name, options, Chain(self.links[:at]).apply(df, vector), vector, label)
        return Chain([*self.links[:at], new, *self.links[at + 1 :]])

    @staticmethod
    def _fitted(name: str, options: dict[str, str], df: DataFrame, vector: str, label: str | None) -> dict:
        if name == "length-norm":
            return {"name": name}
        if name == "mean-subtract":
            n, first, _ = second_moments(df, vector)
            return {"name": name, "mean": (first / n).tolist()}
        if name == "lda":
            if label is None:
                raise ValueError("lda needs labels")
            mean, projection = discriminant(df, label, vector, int(options["dim"]), float(options.get("eps", 1e-6)))
            return {"name": name, "mean": mean.tolist(), "rows": projection.T.tolist()}
        raise ValueError(f"{name} cannot be fitted; known links are mean-subtract, length-norm and lda")

    def apply(self, df: DataFrame, vector: str) -> DataFrame:
        for link in self.links:
            x = F.col(vector)
            if link["name"] == "length-norm":
                x = V.length_normalized(x)
            elif link["name"] == "mean-subtract":
                x = V.subtract(x, V.literal_vector(link["mean"]))
            else:
                rows = np.array(link["rows"])
                x = _affine(rows, -rows @ np.array(link["mean"]))(x)
            df = df.withColumn(vector, x)
        return df

    def to_json(self) -> str:
        return json.dumps(self.links)

    @classmethod
    def from_json(cls, text: str) -> Chain:
        return cls(json.loads(text))


# ---------------------------------------------------------------- calibration


def fit_calibration(df: DataFrame, factors: list[str], label: str = "label", rounds: int = 30, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the class-balanced cost in bits of ``w x + b`` as a log-likelihood ratio.

    Newton steps; each is one pass that sums a gradient and a curvature of a few factors per task.
    """
    rows = written(df.select(F.array(*(F.col(c).cast("double") for c in factors)).alias("x"), (F.col(label) == "target").alias("t")).dropna(), "factors")
    counts = rows.groupBy("t").count().collect()
    n = {r["t"]: r["count"] for r in counts}
    if len(n) < 2:
        raise ValueError("calibration needs target and other trials")
    d = len(factors)
    theta, last = np.r_[np.full(d, 1.0 / d), 0.0], np.inf
    best = theta

    def passed(theta: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cost, grad, curve = 0.0, np.zeros(d + 1), np.zeros((d + 1, d + 1))
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.c_[_matrix(b.column("x")), np.ones(b.num_rows)]
                t = b.column("t").to_numpy(zero_copy_only=False)
                w = np.where(t, 0.5 / n[True], 0.5 / n[False])
                s = np.where(t, -1.0, 1.0) * (x @ theta)
                p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
                cost += (w * np.logaddexp(0, s)).sum()
                grad += x.T @ (w * np.where(t, -p, p))
                curve += (x * (w * p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([[cost, *grad, *curve.ravel()]], pa.list_(pa.float64()))], names=["s"])

        return run

    for _ in range(rounds):
        parts = np.sum([r["s"] for r in rows.mapInArrow(passed(theta), "s array<double>").collect()], axis=0)  # one short row per task
        cost, grad, curve = parts[0], parts[1 : d + 2], parts[d + 2 :].reshape(d + 1, d + 1)
        if cost > last + tolerance:  # a step too far: halfway back
            theta = (theta + best) / 2
            continue
        done, last, best = last - cost < tolerance, cost, theta
        if done:
            break
        theta = theta - np.linalg.solve(curve + 1e-9 * np.eye(d + 1), grad)
    drop_written(rows)
    return best[:d], float(best[d])
