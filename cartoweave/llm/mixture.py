"""Gaussian mixture by expectation-maximisation over all rows (problem 1, first half).

Features are standardised and reduced to their principal axes; covariances are regularised. Several numbers of components
are fitted in the same passes: every task turns its rows into sufficient statistics of every component of every candidate
(a few rows, whatever the task read), these are summed on the executors and only the sums reach the driver. Steps end when
the likelihood hardly grows. The Bayesian information criterion chooses the number of components: it is doubled from 1 as
long as the criterion falls, then numbers between are tried. Starting means come from a bounded sample chosen by the hash of
the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that the starting means are taken from.
START_ROWS = 4_000
#: Numbers of components that are fitted first; further ones are doubled from the last.
CANDIDATES = (1, 2, 4, 8)
#: Steps end when the mean log-likelihood of a row grows by less than this, or after so many.
GROWTH, ROUNDS = 1e-3, 60
RIDGE = 1e-4


@dataclass
class Mixture:
    """A mixture in the space of the reduced features; ``centre`` and ``axes`` lead there from the columns."""

    centre: np.ndarray
    axes: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    bic: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of every component for every row of features."""
        d = z.shape[1]
        inv = np.linalg.inv(self.covs)
        _, logdet = np.linalg.slogdet(self.covs)
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            diff = z - self.means[k]
            out[:, k] = -0.5 * np.einsum("ij,ij->i", diff @ inv[k], diff) - 0.5 * logdet[k]
        return out + np.log(np.maximum(self.weights, 1e-300)) - 0.5 * d * np.log(2 * np.pi)


def log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(1)
    return top + np.log(np.exp(parts - top[:, None]).sum(1))


def _columns(b: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], 1)


def _summed(df: DataFrame, make, width: int, keys: int) -> np.ndarray:  # noqa: ANN001
    """Sum of the (keys x width) statistics that ``make`` gives for each batch of rows; one set of rows leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width))
        for b in batches:
            total += make(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(keys, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(width)]], ["key", *[f"s{j}" for j in range(width)]])

    schema = "key int, " + ", ".join(f"s{j} double" for j in range(width))
    sums = df.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect()
    out = np.zeros((keys, width))
    for r in sums:
        out[r[0]] = r[1:]
    return out


def _starts(z: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spread starting means: each next one is drawn in proportion to the squared distance from those taken."""
    rng = np.random.default_rng([seed, k])
    taken = [z[rng.integers(len(z))]]
    dist = ((z - taken[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = dist.sum()
        taken.append(z[rng.choice(len(z), p=dist / total)] if total > 0 else z[rng.integers(len(z))])
        dist = np.minimum(dist, ((z - taken[-1]) ** 2).sum(1))
    return np.array(taken)


def _free(k: int, dims: int) -> float:
    """Free parameters of a mixture of k components."""
    return k - 1 + k * dims + k * dims * (dims + 1) / 2


def _fitted(points: DataFrame, cols: list[str], starts: list[Mixture], n: int, rounds: int, ridge: float, growth: float) -> list[Mixture]:
    """Every mixture after its steps, with the criterion of exactly these parameters; the open ones share each pass."""
    done: list[Mixture] = []
    current, former = starts, [-np.inf] * len(starts)
    for step in range(rounds + 1):
        dims = current[0].means.shape[1]
        sizes = [len(f.weights) for f in current]

        def sums(b: pa.RecordBatch, current: list[Mixture] = current) -> np.ndarray:
            x = _columns(b, cols)
            blocks = []
            for f in current:
                z = f.features(x)
                parts = f.log_parts(z)
                ll = log_sum(parts)
                r = np.exp(parts - ll[:, None])
                zz = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                lead = np.zeros(len(f.weights))
                lead[0] = ll.sum()
                blocks.append(np.c_[lead, r.sum(0), r.T @ z, r.T @ zz])
            return np.concatenate(blocks)

        total = _summed(points.select(*cols), sums, 2 + dims + dims * dims, sum(sizes))
        following, likelihoods, at = [], [], 0
        for f, before, k in zip(current, former, sizes, strict=True):
            s = total[at : at + k]
            at += k
            likelihood = float(s[0, 0])
            if step == rounds or likelihood - before < growth * n:
                f.bic = -2 * likelihood + _free(k, dims) * np.log(n)
                done.append(f)
                continue
            nk = np.maximum(s[:, 1], 1e-9)
            means = s[:, 2 : 2 + dims] / nk[:, None]
            covs = s[:, 2 + dims :].reshape(k, dims, dims) / nk[:, None, None] - means[:, :, None] * means[:, None, :]
            covs = (covs + covs.transpose(0, 2, 1)) / 2
            floor = np.maximum(ridge - np.linalg.eigvalsh(covs)[:, 0], 0)
            covs += (ridge + floor)[:, None, None] * np.eye(dims)
            following.append(Mixture(f.centre, f.axes, nk / nk.sum(), means, covs))
            likelihoods.append(likelihood)
        current, former = following, likelihoods
        if not current:
            break
    return done


def fit_mixture(points: DataFrame, cols: list[str], id_col: str = "id", candidates: tuple[int, ...] = CANDIDATES, rounds: int = ROUNDS, ridge: float = RIDGE, keep: float = 0.999, growth: float = GROWTH, seed: int = 5) -> Mixture | None:
    """The mixture with the best information criterion; None for an empty table. Rows must hold finite numbers.

    ``keep`` is the share of the standardised variance that the reduced features retain. A mixture has at most as many
    components as the sample of the starting means has rows.
    """
    d = len(cols)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _columns(b, cols)
        return np.r_[len(x), x.sum(0), (x[:, :, None] * x[:, None, :]).sum(0).ravel()][None]

    total = _summed(points.select(*cols), moments, 1 + d + d * d, 1)[0]
    n = int(total[0])
    if not n:
        return None
    centre = total[1 : d + 1] / n
    cov = total[d + 1 :].reshape(d, d) / n - np.outer(centre, centre)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 1e-9), vectors[:, order]
    dims = int(np.searchsorted(np.cumsum(values) / values.sum(), keep) + 1)
    axes = vectors[:, :dims] / dev[:, None]
    sample = points.select(id_col, *cols).orderBy(F.xxhash64(id_col), id_col).limit(START_ROWS).toPandas()
    z0 = (sample[cols].to_numpy(float) - centre) @ axes
    fits: dict[int, Mixture] = {}

    def fit(numbers: list[int]) -> None:
        new = sorted({min(max(1, k), len(z0)) for k in numbers} - set(fits))
        if new:
            starts = [Mixture(centre, axes, np.full(k, 1 / k), _starts(z0, k, seed), np.tile(np.eye(dims) * max(0.05, 1 / k), (k, 1, 1))) for k in new]
            fits.update({len(f.weights): f for f in _fitted(points, cols, starts, n, rounds, ridge, growth)})

    def best() -> int:
        return min(fits, key=lambda k: fits[k].bic)

    fit(list(candidates))
    while best() == max(fits) and max(fits) < len(z0):
        fit([2 * max(fits), 4 * max(fits)])
    fit([best() * 3 // 4, best() * 5 // 4, best() * 3 // 2])
    return fits[best()]


def score_mixture(points: DataFrame, cols: list[str], model: Mixture) -> DataFrame:
    """``points`` with component (most probable one) and log_density."""
    from pyspark.sql import types as T

    schema = T.StructType([*points.schema.fields, T.StructField("component", T.IntegerType()), T.StructField("log_density", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = model.log_parts(model.features(_columns(b, cols))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts.argmax(1).astype(np.int32)), pa.array(log_sum(parts) if b.num_rows else np.zeros(0))], schema.names)

    return points.mapInArrow(run, schema)
