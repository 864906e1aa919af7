"""A gated recurrent cell in numpy: forward, backpropagation through time, and Adam.

Inputs are symbols; their share of the gates is a row of a table. Gates are clipped lines instead of
logistic curves, which costs no exponential; the candidate state is a tanh.
"""

from __future__ import annotations

import numpy as np


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return (rng.standard_normal((rows, columns)) * np.sqrt(2 / (rows + columns))).astype(np.float32)


def _blocks(values: np.ndarray, size: int) -> np.ndarray:
    """(..., rows, 3 * size) as (..., 3, rows, size), so that each gate lies in one piece."""
    split = values.reshape(*values.shape[:-1], 3, size)
    return np.ascontiguousarray(np.moveaxis(split, -2, -3))


def forward(inputs: np.ndarray, weights: np.ndarray, state: np.ndarray, keep: bool = False):
    """States after each step, (steps, batch, size), for ``inputs`` (steps, batch, 3 * size); with ``keep`` also what ``backward`` needs."""
    ready = _scaled(_blocks(inputs, state.shape[1]), 0.5)
    return run(np.moveaxis(ready, 1, 0), _scaled(_blocks(weights, state.shape[1])), state, keep)


def _scaled(blocks: np.ndarray, shift: float = 0) -> np.ndarray:
    """The part of the two gates as the clipped lines take it: a quarter, and ``shift``."""
    gates = blocks[..., :2, :, :]
    gates *= np.float32(0.25)
    gates += np.float32(shift)
    return blocks


def prepared(table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``table`` (symbols, 3 * size) and ``weights`` in the form that ``run`` reads: (3, symbols, size) and (3, size, size)."""
    size = len(weights)
    return _scaled(_blocks(table, size), 0.5), _scaled(_blocks(weights, size))


def run(inputs: np.ndarray, weights: np.ndarray, state: np.ndarray, keep: bool = False):
    """As ``forward``, for prepared ``inputs`` (3, steps, batch, size) and ``weights``."""
    _, steps, batch, size = inputs.shape
    states, memory = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        through = np.matmul(state, weights)
        gates = inputs[:2, t] + through[:2]
        np.maximum(gates, np.float32(0), out=gates)
        np.minimum(gates, np.float32(1), out=gates)
        old, q = state, through[2]
        new = gates[1] * q
        new += inputs[2, t]
        np.tanh(new, out=new)
        state = np.subtract(old, new, out=states[t])
        state *= gates[0]
        state += new
        if keep:
            memory.append((old, gates, q, new))
    return (states, memory) if keep else states


def backward(grads: np.ndarray, weights: np.ndarray, memory: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``weights`` from those of the states."""
    steps, batch, size = grads.shape
    d_inputs, d_weights, carried = np.empty((steps, 3, batch, size), np.float32), np.zeros((3, size, size), np.float32), np.zeros((batch, size), np.float32)
    turned = np.ascontiguousarray(_blocks(weights, size).transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        old, gates, q, new = memory[t]
        d, d_in, z = grads[t] + carried, d_inputs[t], gates[0]
        slope = ((gates > 0) & (gates < 1)).astype(np.float32)
        slope *= np.float32(0.25)
        d_candidate = d_in[2]
        np.multiply(1 - z, d, out=d_candidate)
        d_candidate *= 1 - new * new
        np.multiply(old - new, d, out=d_in[0])
        np.multiply(d_candidate, q, out=d_in[1])
        d_in[:2] *= slope
        d_through = d_in.copy()
        d_through[2] *= gates[1]
        carried = d * z
        carried += np.matmul(d_through, turned).sum(axis=0)
        d_weights += np.matmul(old.T, d_through)
    return np.moveaxis(d_inputs, 1, 2).reshape(steps, batch, 3 * size), np.moveaxis(d_weights, 0, 1).reshape(size, 3 * size)


def table_grad(symbols: np.ndarray, grads: np.ndarray, rows: int) -> np.ndarray:
    """Sums of gradients by symbol."""
    out = np.zeros((rows, grads.shape[-1]), np.float32)
    flat, grads = symbols.ravel(), grads.reshape(-1, grads.shape[-1])
    if rows <= 1 << 15:
        flat = flat.astype(np.int16)  # sorted by digits
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.diff(flat, prepend=-1))
    out[flat[starts]] = np.add.reduceat(grads[order], starts)
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    out /= out.sum(axis=1, keepdims=True)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        spread = np.sqrt(1 - 0.999 ** self.step)
        rate, floor = np.float32(self.rate * spread / (1 - 0.9 ** self.step)), np.float32(1e-8 * spread)
        for k, g in grads.items():
            g, first, second = g * scale, self.first[k], self.second[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.001)
            second *= np.float32(0.999)
            second += g
            np.sqrt(second, out=g)
            g += floor
            np.divide(first, g, out=g)
            g *= rate
            self.params[k] -= g
