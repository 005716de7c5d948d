"""Data-parallel forward passes of small models: weights are arguments, rows are scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64) if len(v) else np.zeros((0, 1))


def affect_step(state: Column, stimulus: Column, w: np.ndarray, out: np.ndarray, retain: np.ndarray, bounds: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The next state: leaky hidden units h' = a h + (1 - a) tanh(W [state, stimulus]), then state + tanh(O h'), clamped."""

    @F.arrow_udf("array<double>")
    def of(s: pa.Array, x: pa.Array) -> pa.Array:
        a, b = _rows(s), _rows(x)
        keep = 1 / (1 + np.exp(-retain))
        h = (1 - keep) * np.tanh(np.hstack([a, b]) @ w.T)
        return pa.array(np.clip(a + np.tanh(h @ out.T), *bounds).tolist(), pa.list_(pa.float64()))

    return of(state, stimulus)


def mixture(x: Column, router: np.ndarray, up: np.ndarray, down: np.ndarray, shared: tuple[np.ndarray, np.ndarray], top: int = 2) -> Column:
    """A shared expert plus the ``top`` routed ones, weighted by a softmax over those chosen; ties go to the lower expert.

    router: experts x dim; up: experts x hidden x dim; down: experts x dim x hidden.
    """

    @F.arrow_udf("array<double>")
    def of(v: pa.Array) -> pa.Array:
        rows = _rows(v)
        logits = rows @ router.T
        chosen = np.argsort(-logits, axis=1, kind="stable")[:, :top]
        picked = np.take_along_axis(logits, chosen, axis=1)
        gate = np.exp(picked - picked.max(axis=1, keepdims=True))
        gate /= gate.sum(axis=1, keepdims=True)
        y = np.maximum(rows @ shared[0].T, 0) @ shared[1].T
        for e in range(len(router)):
            weight = (gate * (chosen == e)).sum(axis=1, keepdims=True)
            own = weight[:, 0] > 0
            if own.any():
                y[own] += weight[own] * (np.maximum(rows[own] @ up[e].T, 0) @ down[e].T)
        return pa.array(y.tolist(), pa.list_(pa.float64()))

    return of(x)


def low_rank(x: Column, a: np.ndarray, b: np.ndarray, scale: float) -> Column:
    """What an adapter adds: scale * B (A x)."""

    @F.arrow_udf("array<double>")
    def of(v: pa.Array) -> pa.Array:
        return pa.array((scale * (_rows(v) @ a.T) @ b.T).tolist(), pa.list_(pa.float64()))

    return of(x)


def causal_forward(tokens: Column, embed: np.ndarray, decay: float = 0.5) -> Column:
    """The greedy next token of each sequence: a decaying sum of embeddings, normed, against the tied head; -1 if empty."""

    @F.arrow_udf("int")
    def of(ids: pa.Array) -> pa.Array:
        out = []
        for row in ids.to_pylist():
            h = np.zeros(embed.shape[1])
            for t in row or []:
                h = decay * h + embed[t % len(embed)]
            norm = np.sqrt((h**2).mean() + 1e-5)
            out.append(int(np.argmax(embed @ (h / norm))) if row else -1)
        return pa.array(out, pa.int32())

    return of(tokens)
