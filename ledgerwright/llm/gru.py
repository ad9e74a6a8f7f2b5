"""A bidirectional gated recurrent layer in numpy, with backpropagation through time.

Sequences lie in (time, batch, ...) arrays. Inputs come already multiplied by the input
weights, as `3 * hidden` pre-activations per direction (update gate, reset gate, candidate),
so that repeated inputs (bytes, words) are projected once. Sequences of different lengths are
sorted by falling length: at each step only the sequences that still run take part.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def running(lengths: np.ndarray, steps: int) -> np.ndarray:
    """How many sequences (sorted by falling length) still run at each step."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left")


def backwards(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Index that turns each sequence of (time, batch) round within its own length."""
    at = np.arange(len(ids))[:, None]
    return np.where(at < lengths[None, :], lengths[None, :] - 1 - at, at)


def init_layer(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    return {"u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F32), "c": np.zeros(hidden, F32)}


def run_layer(x: np.ndarray, live: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """Hidden states (time, batch, hidden) of one direction; with `keep`, what `grad_layer` needs."""
    steps, batch, _ = x.shape
    hidden = len(p["c"])
    out = np.zeros((steps, batch, hidden), F32)
    h, u, c = np.zeros((batch, hidden), F32), p["u"], p["c"]
    kept = []
    for t in range(steps):
        n = live[t]
        if n == 0:
            break
        before = h[:n]
        through = before @ u
        xt = x[t, :n]
        gates = xt[:, :2 * hidden] + through[:, :2 * hidden]
        np.negative(gates, out=gates)
        np.clip(gates, -30, 30, out=gates)
        np.exp(gates, out=gates)
        gates += 1.0
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :hidden], gates[:, hidden:]
        back = through[:, 2 * hidden:] + c
        cand = np.tanh(xt[:, 2 * hidden:] + r * back)
        after = cand + z * (before - cand)
        if keep:
            kept.append((before, z, r, back, cand))
        out[t, :n] = after
        h = after
    return (out, kept) if keep else out


def scan_layer(table: np.ndarray, ids: np.ndarray, live: np.ndarray, p: dict[str, np.ndarray], out: np.ndarray) -> np.ndarray:
    """Hidden states times `out` (columns, time, batch) for inputs `table[ids]`, step by step in little memory.

    The batch lies along the last axis, where numpy's loops and products are fastest.
    """
    steps, batch = ids.shape
    hidden = len(p["c"])
    made = np.zeros((out.shape[1], steps, batch), F32)
    u, c, last = np.ascontiguousarray(p["u"].T), p["c"][:, None], np.ascontiguousarray(out.T)
    wide, h = np.ascontiguousarray(table.T), np.zeros((hidden, batch), F32)
    ids = ids.astype(np.intp)
    with np.errstate(over="ignore"):
        for t in range(steps):
            n = live[t]
            if n == 0:
                break
            if n < h.shape[1]:
                h = np.ascontiguousarray(h[:, :n])
            through, x = u @ h, wide.take(ids[t, :n], axis=1)
            gates = through[:2 * hidden]
            gates += x[:2 * hidden]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1.0
            np.reciprocal(gates, out=gates)
            cand = through[2 * hidden:]
            cand += c
            cand *= gates[hidden:]
            cand += x[2 * hidden:]
            np.tanh(cand, out=cand)
            h -= cand
            h *= gates[:hidden]
            h += cand
            made[:, t, :n] = last @ h
    return made


def grad_layer(dout: np.ndarray, kept: list, live: np.ndarray, p: dict[str, np.ndarray]):
    """Gradients of the inputs and the weights from those of the hidden states."""
    steps, batch, hidden = dout.shape
    dx = np.zeros((steps, batch, 3 * hidden), F32)
    du, dc = np.zeros_like(p["u"]), np.zeros_like(p["c"])
    carried = np.zeros((batch, hidden), F32)
    for t in range(len(kept) - 1, -1, -1):
        n = live[t]
        before, z, r, back, cand = kept[t]
        dh = dout[t, :n] + carried[:n]
        dz = dh * (before - cand) * z * (1 - z)
        dcand = dh * (1 - z) * (1 - cand * cand)
        dr = dcand * back * r * (1 - r)
        dback = dcand * r
        dx[t, :n] = np.concatenate([dz, dr, dcand], 1)
        dthrough = np.concatenate([dz, dr, dback], 1)
        du += before.T @ dthrough
        dc += dback.sum(0)
        carried = np.zeros((batch, hidden), F32)
        carried[:n] = dh * z + dthrough @ p["u"].T
    return dx, {"u": du, "c": dc}


class Adam:
    """Adam over a nested dict of arrays."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict, scale: float = 1.0) -> None:
        self.t += 1
        self._walk(params, grads, (), scale)

    def _walk(self, params, grads, path, scale) -> None:
        for k, g in grads.items():
            if isinstance(g, dict):
                self._walk(params[k], g, (*path, k), scale)
                continue
            key = (*path, k)
            g = np.clip(g, -1.0, 1.0)
            m = self.m[key] = 0.9 * self.m.get(key, 0.0) + 0.1 * g
            v = self.v[key] = 0.999 * self.v.get(key, 0.0) + 0.001 * g * g
            rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            params[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(F32)
