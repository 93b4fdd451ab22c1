"""Gated recurrent units in numpy: forward, backward through time, and Adam."""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def sigmoid(x: Array) -> Array:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(x: Array, h: Array, u: Array, b: Array) -> Array:
    """One step without a record: x holds the inputs' share of the update, reset and new gates side by side."""
    n = h.shape[1]
    a = h @ u
    gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
    new = np.tanh(x[:, 2 * n :] + gates[:, n:] * (a[:, 2 * n :] + b))
    return new + gates[:, :n] * (h - new)


def forward(x: Array, h: Array, u: Array, b: Array, keep: Array | None = None) -> tuple[Array, list]:
    """States after each step of x (steps, rows, 3n), and what backward() needs. keep (steps, rows): 0 where a
    row starts anew from the zero state, else 1."""
    n, out, record = h.shape[1], np.empty((*x.shape[:2], h.shape[1]), x.dtype), []
    for t in range(len(x)):
        h = h if keep is None else h * keep[t][:, None]
        a = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        z, r, c = gates[:, :n], gates[:, n:], a[:, 2 * n :] + b
        new = np.tanh(x[t, :, 2 * n :] + r * c)
        record.append((h, z, r, c, new))
        out[t] = h = new + z * (h - new)
    return out, record


def backward(d_out: Array, record: list, u: Array, keep: Array | None = None) -> tuple[Array, Array, Array, Array]:
    """Gradients of x, of the first state, of u and of b, from those of the states."""
    steps, rows, n = d_out.shape
    d_x, d_u, d_b, d_h = np.empty((steps, rows, 3 * n), d_out.dtype), np.zeros_like(u), np.zeros(n, u.dtype), np.zeros((rows, n), d_out.dtype)
    for t in reversed(range(steps)):
        h, z, r, c, new = record[t]
        d_h = d_h + d_out[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z, d_r = d_h * (h - new) * z * (1 - z), d_new * c * r * (1 - r)
        d_x[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += h.T @ d_a
        d_b += (d_new * r).sum(axis=0)
        d_h = d_h * z + d_a @ u.T
        d_h = d_h if keep is None else d_h * keep[t][:, None]
    return d_x, d_h, d_u, d_b


class Adam:
    """Updates named weights in place; the gradients' joint norm is clipped."""

    def __init__(self, weights: dict[str, Array], rate: float, clip: float = 5.0):
        self.w, self.rate, self.clip, self.t = weights, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def __call__(self, grads: dict[str, Array], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-9))
        rate = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.w[k].dtype)


def weights(rng: np.random.Generator, *shape: int) -> Array:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
