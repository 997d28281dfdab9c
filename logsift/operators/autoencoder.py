"""Dense autoencoder trained as Spark jobs (O-M4, O-M5).

Architecture in → 64 → 32 → 32 (code) → 32 → 64 → in, ReLU inside, linear output, MSE
loss, Adam. Training is data parallel: rows are packed once into blocks of a written table; every step is a
job in which each task sums the gradients of its blocks, the sums are added up in a tree, and the driver
takes one Adam step with the mean over all rows. So any number of tasks gives the same weights (up to
the rounding of sums), no task holds a part of the data that does not grow with the cluster,
and what moves is a model per task. A step stands for many small batches, and its rate is
scaled by the root of their number, up to ``MOST_RATE``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..session import materialize, share, ship_package
from .features import dense


def layer_dims(d: int, hidden=DEFAULT.hidden_layers, code: int = DEFAULT.encoding_dim) -> list[int]:
    return [d, *hidden, code, *reversed(hidden), d]


def init_params(dims: list[int], seed: int) -> list[np.ndarray]:
    """Glorot-uniform weights, zero biases: [W0, b0, W1, b1, …]."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(dims[:-1], dims[1:]):
        lim = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-lim, lim, size=(a, b)), np.zeros(b)]
    return out


def flatten(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def unflatten(flat: np.ndarray, dims: list[int]) -> list[np.ndarray]:
    out, i = [], 0
    for a, b in zip(dims[:-1], dims[1:]):
        out.append(flat[i:i + a * b].reshape(a, b))
        i += a * b
        out.append(flat[i:i + b])
        i += b
    return out


def forward(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    acts = [x]
    n_layers = len(params) // 2
    for j in range(n_layers):
        z = acts[-1] @ params[2 * j] + params[2 * j + 1]
        acts.append(np.maximum(z, 0.0) if j < n_layers - 1 else z)
    return acts


def reconstruction_error(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean squared error per row."""
    return np.mean((forward(params, x)[-1] - x) ** 2, axis=1)


def gradients(params: list[np.ndarray], x: np.ndarray, grads: list[np.ndarray] | None = None):
    """Mean squared error of ``x`` and its gradient for every parameter.

    With ``grads`` (arrays of the parameters' shapes, e.g. views into one flat buffer) the
    gradients are written in place.
    """
    acts = forward(params, x)
    n, d = x.shape
    diff = acts[-1] - x
    flat_diff = diff.ravel()
    loss = float(flat_diff @ flat_diff) / (n * d)
    delta = diff * (2.0 / (n * d))
    if grads is None:
        grads = [np.empty_like(p) for p in params]
    for j in range(len(params) // 2 - 1, -1, -1):
        np.matmul(acts[j].T, delta, out=grads[2 * j])
        np.add.reduce(delta, axis=0, out=grads[2 * j + 1])
        if j:
            delta = (delta @ params[2 * j].T) * (acts[j] > 0)
    return loss, grads


class Adam:
    """Adam on one flat vector."""

    def __init__(self, flat: np.ndarray, lr: float, beta1=0.9, beta2=0.999, eps=1e-7):
        self.flat, self.m, self.v, self.t = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
        self.lr, self.beta1, self.beta2, self.eps = lr, beta1, beta2, eps

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += (1 - self.beta1) * (gradient - self.m)
        self.v += (1 - self.beta2) * (gradient * gradient - self.v)
        self.flat -= (self.lr / (1 - self.beta1 ** self.t)) * self.m / (np.sqrt(self.v / (1 - self.beta2 ** self.t)) + self.eps)


#: Numbers of a dense batch that are held at a time, rows of a packed block, and the largest learning rate of a step.
DENSE_CELLS, BLOCK_ROWS, MOST_RATE = 1 << 22, 4096, 0.01


def _chunks(pdf: pd.DataFrame, base: np.ndarray | None, width: int):
    """Dense matrices of a batch, few rows at a time where they are wide."""
    rows = max(1, DENSE_CELLS // max(1, width))
    for k in range(0, len(pdf), rows):
        yield dense(pdf.iloc[k:k + rows], base)


_BLOCK = "n long, ends binary, idx binary, v binary"


def _pack(batches):
    """Rows (x, or pairs) as blocks: where each row ends, and the places and values of its numbers."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            col = batch.column(0).slice(k, BLOCK_ROWS)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)).astype("<i8")
            flat = pc.list_flatten(col)
            if pa.types.is_struct(flat.type):
                idx, v = flat.field("idx").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False)
            else:
                idx, v = np.arange(len(flat)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])), flat.to_numpy(zero_copy_only=False)
            row = [[len(col)], [ends.tobytes()], [idx.astype("<i4").tobytes()], [v.astype("<f8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["n", "ends", "idx", "v"])


def _unpack(block: dict, base: np.ndarray):
    """Dense matrices of a block on top of ``base``."""
    ends, idx, v = np.frombuffer(block["ends"], "<i8"), np.frombuffer(block["idx"], "<i4"), np.frombuffer(block["v"], "<f8")
    rows = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    step = max(1, DENSE_CELLS // max(1, len(base)))
    for k in range(0, len(ends), step):
        a, z = (ends[k - 1] if k else 0), ends[min(len(ends), k + step) - 1]
        x = np.repeat(base[None, :], min(step, len(ends) - k), axis=0)
        x[rows[a:z] - k, idx[a:z]] += v[a:z]
        yield x


_SUM = "part long, n long, loss double, gradient binary"


def _gradient_sums(shared, dims: list[int], branches: int):
    """One row a task: the sums over its rows, and the branch that adds them up further."""

    def run(batches):
        flat, base = shared.value
        params = unflatten(flat, dims)
        total, n, loss = np.zeros_like(flat), 0, 0.0
        own = np.empty_like(flat)
        views = unflatten(own, dims)
        for batch in batches:
            for block in batch.to_pylist():
                for x in _unpack(block, base):
                    mean, _ = gradients(params, x, views)
                    total += own * len(x)
                    loss += mean * len(x)
                    n += len(x)
        if n:
            from pyspark import TaskContext

            yield _sum_row(TaskContext.get().partitionId() % branches, n, loss, total)

    return run


def _sum_row(part: int, n: int, loss: float, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "loss", "gradient"])


def _add(batches):
    """The sum of the rows of each partition; holds two of them at a time."""
    total, n, loss = None, 0, 0.0
    for batch in batches:
        for r in batch.to_pylist():
            g = np.frombuffer(r["gradient"])
            total = g.copy() if total is None else np.add(total, g, out=total)
            n, loss = n + r["n"], loss + r["loss"]
    if total is not None:
        yield _sum_row(0, n, loss, total)


def fit_autoencoder(vectors: DataFrame, keys: list[str], epochs: int = DEFAULT.epochs,
                    batch_size: int = DEFAULT.batch_size, lr: float = DEFAULT.learning_rate,
                    validation_split: float = DEFAULT.validation_split, seed: int = DEFAULT.seed,
                    base: np.ndarray | None = None) -> dict:
    """Train on ``vectors`` (keys…, x array<double>, or pairs over ``base``); returns the model dict (dims, flat
    weights, training loss of each epoch, validation loss). An epoch is one step over all rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    col = "x" if base is None else "pairs"
    first = vectors.select(col).first()
    if first is None:
        raise ValueError("cannot train an autoencoder on no rows")
    zero = np.zeros(len(first["x"])) if base is None else base
    dims = layer_dims(len(zero))
    u = F.pmod(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    tagged = vectors.select(col, (u < validation_split).alias("_val"))
    train = materialize(tagged.filter(~F.col("_val")).select(col).mapInArrow(_pack, _BLOCK), "ae-train")
    rows, tasks = train.agg(F.sum("n")).first()[0], train.rdd.getNumPartitions()
    if not rows:
        raise ValueError("no training rows (all rows fell into the validation split)")
    branches = max(1, round(tasks ** 0.5))
    adam = Adam(flatten(init_params(dims, seed)), min(max(lr, MOST_RATE), lr * (rows / batch_size) ** 0.5) if rows > batch_size else lr)
    history = []
    for _ in range(epochs):
        shared = share(spark, (adam.flat, zero), adam.flat.nbytes + zero.nbytes, "an autoencoder of so many columns")
        sums = train.mapInArrow(_gradient_sums(shared, dims, branches), _SUM)
        if branches > 2:  # the driver adds up one row a branch
            sums = sums.repartition(branches, "part").mapInArrow(_add, _SUM)
        total, n, loss = np.zeros_like(adam.flat), 0, 0.0
        for r in sums.toLocalIterator() if len(adam.flat) > 1 << 20 else sums.collect():
            total += np.frombuffer(r.gradient)
            n, loss = n + r.n, loss + r.loss
        adam.step(total / n)
        history.append(loss / n)
        shared.unpersist()
    model = {"dims": dims, "weights": adam.flat}
    val_loss = mse_table(tagged.filter("_val").select(col), model, base).agg(F.avg("mse")).first()[0]
    return {**model, "train_loss": history, "val_loss": None if val_loss is None else float(val_loss),
            "params": unflatten(adam.flat, dims)}


def mse_table(vectors: DataFrame, model: dict, base: np.ndarray | None = None) -> DataFrame:
    """Adds ``mse`` (reconstruction error per row) with a broadcast forward pass."""
    spark = vectors.sparkSession
    ship_package(spark)
    dims = model["dims"]
    weights = np.asarray(model["weights"], dtype=np.float64)
    shared = share(spark, (weights, base), weights.nbytes + 8 * dims[0], "an autoencoder of so many columns")
    schema = T.StructType(vectors.schema.fields + [T.StructField("mse", T.DoubleType())])

    def run(batches):
        weights, zero = shared.value
        params = unflatten(weights, dims)
        for pdf in batches:
            pdf["mse"] = np.concatenate([np.zeros(0), *(reconstruction_error(params, x) for x in _chunks(pdf, zero, dims[0]))])
            yield pdf

    return vectors.mapInPandas(run, schema)
