"""A small byte-level convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, passed through a
rectifier and max-pooled over a fixed-length window; a linear layer gives the
window's class scores. Training is plain minibatch gradient descent with Adam
on a bounded set of labelled windows; the result depends on the seed and the
windows only.
"""

from __future__ import annotations

import numpy as np

WIDTHS = (2, 3, 4, 5)


class ByteCNN:
    """``classes`` scores for windows of ``length`` bytes (zero-padded)."""

    def __init__(self, classes: int, length: int = 256, embed: int = 6, filters: int = 8, widths: tuple[int, ...] = WIDTHS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.length, self.widths, self.reach = length, widths, max(widths)
        self.embedding = rng.normal(0, 0.5, (256, embed)).astype(np.float32)
        self.embedding[0] = 0
        # one matrix holds all widths; a shorter filter is zero where it doesn't reach
        n = filters * len(widths)
        self.mask = np.zeros((self.reach, embed, n), np.float32)
        for k, w in enumerate(widths):
            self.mask[:w, :, k * filters : (k + 1) * filters] = 1
        self.mask = self.mask.reshape(self.reach * embed, n)
        self.kernel = (rng.normal(0, 1, self.mask.shape) * self.mask * np.sqrt(2 / self.mask.sum(0))).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, np.sqrt(1 / n), (n, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Neighbourhoods of every position: windows by positions by reach * embed."""
        x = self.embedding[windows]
        n, length, e = x.shape
        flat = np.lib.stride_tricks.as_strided(x, (n, length - self.reach + 1, self.reach * e), (x.strides[0], x.strides[1], x.strides[2]))
        return flat

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled filters of each window (uint8, rows of ``length``)."""
        out = np.empty((len(windows), len(self.bias)), np.float32)
        for at in range(0, len(windows), 32):
            c = self._columns(windows[at : at + 32])
            y = np.ascontiguousarray(c).reshape(-1, c.shape[2]) @ self.kernel
            out[at : at + 32] = y.reshape(c.shape[0], c.shape[1], -1).max(1)
        return np.maximum(out + self.bias, 0)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return self.pooled(windows) @ self.out + self.out_bias

    def fit(self, windows: np.ndarray, classes: np.ndarray, weights: np.ndarray | None = None, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> ByteCNN:
        """Train on windows with class numbers."""
        rng = np.random.default_rng(seed)
        weights = np.ones(len(windows), np.float32) if weights is None else weights.astype(np.float32)
        names = ("embedding", "kernel", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        steps = 0
        total = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                steps += 1
                g = self._gradients(windows[rows], classes[rows], weights[rows])
                lr = rate * (1 - 0.95 * steps / total)
                for k in names:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.01 * (g[k] ** 2 - second[k])
                    step = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - lr * step).astype(np.float32))
                self.embedding[0] = 0
        return self

    def _gradients(self, windows: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        c = self._columns(windows)
        n, positions, width = c.shape
        y = (np.ascontiguousarray(c).reshape(-1, width) @ self.kernel).reshape(n, positions, -1)
        place = y.argmax(1)
        top = np.take_along_axis(y, place[:, None], 1)[:, 0] + self.bias
        active = top > 0
        hidden = np.where(active, top, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), classes] -= 1
        p *= (weights / weights.sum())[:, None]
        d = (p @ self.out.T) * active  # windows by filters
        at = c[np.arange(n)[:, None], place]  # windows by filters by width
        kernel = np.einsum("nfw,nf->wf", at, d) * self.mask
        back = np.einsum("nf,wf->nfw", d, self.kernel).reshape(n, len(self.bias), self.reach, -1)
        embedding = np.zeros_like(self.embedding)
        bytes_ = windows[np.arange(n)[:, None, None], place[:, :, None] + np.arange(self.reach)]
        np.add.at(embedding, bytes_.ravel(), back.reshape(-1, back.shape[-1]))
        return {"embedding": embedding, "kernel": kernel, "bias": d.sum(0), "out": hidden.T @ p, "out_bias": p.sum(0)}


def windows_of(text: bytes, length: int, stride: int) -> np.ndarray:
    """Windows that cover the whole text, the last zero-padded; one empty window for an empty text."""
    n = max(1, -(-(len(text) - length) // stride) + 1) if len(text) > length else 1
    padded = np.zeros((n - 1) * stride + length, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::stride]


def text_groups(texts: list[bytes], length: int, stride: int, most: int = 4096):
    """Windows of several texts together, as ``(windows, text number of each)``; a very long text comes in several parts."""
    held, owner, n = [], [], 0
    for k, text in enumerate(texts):
        w = windows_of(text, length, stride)
        for at in range(0, len(w), most):
            part = w[at : at + most]
            held.append(part)
            owner.append(np.full(len(part), k))
            n += len(part)
            if n >= most:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(owner)
