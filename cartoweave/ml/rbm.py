"""Restricted Boltzmann machines and the autoencoder built of them (M01-M09), numpy on the driver.

Training works on a bounded matrix (``LIMIT`` rows; the caller takes a documented sample); encoding, the part that sees all
rows, runs distributed in ``encode``. All chance comes from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 20_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def initial_weights(rng: np.random.Generator, inputs: int, outputs: int) -> np.ndarray:
    """Uniform within 4 sqrt(6 / (inputs + outputs)) on both sides, for sigmoid units."""
    bound = 4 * np.sqrt(6 / (inputs + outputs))
    return rng.uniform(-bound, bound, (inputs, outputs))


@dataclass
class RBM:
    """``visible`` is bernoulli, poisson (counts; their mean keeps the size of the row) or softmax."""

    weights: np.ndarray
    hidden_bias: np.ndarray
    visible_bias: np.ndarray
    visible: str = "bernoulli"
    rng: np.random.Generator = field(default_factory=lambda: np.random.default_rng(1))

    @classmethod
    def new(cls, inputs: int, outputs: int, visible: str = "bernoulli", seed: int = 1) -> RBM:
        rng = np.random.default_rng(seed)
        return cls(initial_weights(rng, inputs, outputs), np.zeros(outputs), np.zeros(inputs), visible, rng)

    def free_energy(self, v: np.ndarray) -> np.ndarray:
        return -np.logaddexp(0, v @ self.weights + self.hidden_bias).sum(1) - v @ self.visible_bias

    def up(self, v: np.ndarray) -> np.ndarray:
        """Means of the hidden units."""
        x = v @ self.weights + self.hidden_bias
        return sigmoid(softmax(x)) if self.visible == "softmax" else sigmoid(x)

    def down(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Means of the visible units."""
        x = h @ self.weights.T + self.visible_bias
        if self.visible == "poisson":
            return softmax(x) * sizes[:, None]
        return sigmoid(softmax(x)) if self.visible == "softmax" else sigmoid(x)

    def sample_visible(self, means: np.ndarray) -> np.ndarray:
        return self.rng.poisson(means).astype(float) if self.visible == "poisson" else (self.rng.random(means.shape) < means).astype(float)

    def step(self, v: np.ndarray, rate: float, k: int = 1, chain: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """One contrastive-divergence step (persistent when ``chain`` is given); the reconstruction cost and the chain's end."""
        sizes = v.sum(1)
        data_hidden = self.up(v)
        x = v if chain is None else chain
        for _ in range(k):
            h = (self.rng.random((len(x), len(self.hidden_bias))) < self.up(x)).astype(float)
            means = self.down(h, sizes)
            x = self.sample_visible(means)
        model_hidden = self.up(x)
        scale = rate / (5 * max(sizes.mean(), 1e-9)) if self.visible == "poisson" else rate
        self.weights += scale * (v.T @ data_hidden - x.T @ model_hidden) / len(v)
        self.hidden_bias += rate * (data_hidden - model_hidden).mean(0)
        if self.visible != "poisson":
            self.visible_bias += rate * (v - x).mean(0)
        p = np.clip(means, 1e-9, 1 - 1e-9) if self.visible != "poisson" else means
        cost = ((v - means) ** 2).sum(1).mean() if self.visible == "poisson" else -(v * np.log(p) + (1 - v) * np.log(1 - p)).sum(1).mean()
        return float(cost), x


Layers = list[tuple[np.ndarray, np.ndarray]]


def batches(n: int, size: int) -> Iterator[slice]:
    """Whole batches; the rows that are left over do not take part."""
    for i in range(n // size):
        yield slice(i * size, (i + 1) * size)


def pretrain(x: np.ndarray, sizes: list[int], epochs: int = 10, rate: float = 0.1, batch: int = 20, k: int = 1, first: str = "bernoulli", seed: int = 1) -> Layers:
    """A stack of machines, each trained on the means of the one below."""
    layers: Layers = []
    for i, outputs in enumerate(sizes):
        machine = RBM.new(x.shape[1], outputs, first if i == 0 else "bernoulli", seed + i)
        for _ in range(epochs):
            for part in batches(len(x), min(batch, len(x))):
                machine.step(x[part], rate, k)
        layers.append((machine.weights, machine.hidden_bias))
        x = machine.up(x)
    return layers


def unrolled(layers: Layers) -> Layers:
    """The stack and its mirror: transposed weights, zero biases."""
    return [*layers, *[(w.T.copy(), np.zeros(w.shape[0])) for w, _ in reversed(layers)]]


def forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    out = [x]
    for w, b in layers:
        out.append(sigmoid(out[-1] @ w + b))
    return out


def fine_tune(x: np.ndarray, layers: Layers, validation: np.ndarray, epochs: int = 50, rate: float = 0.1, batch: int = 20, patience: int = 4, growth: int = 2, better: float = 0.995) -> Layers:
    """Back-propagation of the squared difference; stops when patience (in epochs) runs out.

    Patience is doubled by an epoch that betters the validation cost by half a percent; the best weights are returned.
    """
    net = [(w.copy(), b.copy()) for w, b in layers]
    cost = lambda v: float(((forward(v, net)[-1] - v) ** 2).sum(1).mean())
    best, kept, limit = cost(validation), [(w.copy(), b.copy()) for w, b in net], patience
    for epoch in range(1, epochs + 1):
        for part in batches(len(x), min(batch, len(x))):
            acts = forward(x[part], net)
            delta = 2 * (acts[-1] - acts[0]) * acts[-1] * (1 - acts[-1])
            for i in range(len(net) - 1, -1, -1):
                w, b = net[i]
                back = delta @ w.T * acts[i] * (1 - acts[i])
                net[i] = (w - rate * acts[i].T @ delta / len(delta), b - rate * delta.mean(0))
                delta = back
        now = cost(validation)
        if now < best:
            if now < best * better:
                limit = max(limit, epoch * growth)
            best, kept = now, [(w.copy(), b.copy()) for w, b in net]
        if epoch >= limit:
            break
    return kept


def training_matrix(rows: DataFrame, id_col: str, vector: str, limit: int = LIMIT) -> np.ndarray:
    """At most ``limit`` vectors chosen by the hash of their id (documented bound of the fit)."""
    taken = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(limit).select(vector).toPandas()[vector]
    return np.stack(taken.to_list()).astype(float) if len(taken) else np.zeros((0, 0))


def encode(rows: DataFrame, id_col: str, vector: str, layers: Layers) -> DataFrame:
    """(id, code) of every row by the encoder half; null vectors have null codes. Weights are broadcast (their size is the
    network's, not the data's)."""
    shared = rows.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def code(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        ok = v.notna().to_numpy()
        if ok.any():
            made = forward(np.stack(v[ok].to_list()).astype(float), shared.value)[-1]
            out[np.flatnonzero(ok)] = list(made)
        return out

    return rows.select(F.col(id_col).alias("id"), code(vector).alias("code"))


def weight_rows(spark, layers: Layers) -> DataFrame:  # noqa: ANN001
    """(layer, weights, bias) of a network."""
    return spark.createDataFrame([(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(layers)], "layer int, weights array<array<double>>, bias array<double>")


def layers_of(rows: DataFrame, count: int | None = None) -> Layers:
    """The network of saved rows; a wrong number of layers is an error."""
    found = rows.orderBy("layer").collect()
    if count is not None and len(found) != count:
        raise ValueError(f"{len(found)} layers instead of {count}")
    return [(np.array(r["weights"]), np.array(r["bias"])) for r in found]


def softmax_regression(rows: DataFrame, features: str, label: str, steps: int = 100):  # noqa: ANN201
    """Multinomial logistic regression; (model, mean error rate on the rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=steps, family="multinomial").fit(data)
    wrong = model.transform(data).agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
    return model, wrong


def argmax_label(labels: str):  # noqa: ANN201
    """The last set position of a multi-hot label, -1 without any."""
    return F.coalesce(F.array_max(F.transform(labels, lambda x, i: F.when(x > 0, i))), F.lit(-1))
