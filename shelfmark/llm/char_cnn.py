"""A small character convolutional network in numpy: embedding, one convolution, maximum over time, logistic output.

A candidate is shown whole, whatever its length, as windows of ``WIDTH`` characters that overlap by one kernel less a character. Every
place of the kernel so lies in just one window, and the maximum over all windows of a candidate is the one over its whole text.
"""

from __future__ import annotations

import numpy as np

WIDTH = 72  # characters of a window
BEFORE = 20  # characters before the candidate
AFTER = 20  # characters behind it, at least
_CLASSES = 40
_KERNEL = 5
_STEP = WIDTH - _KERNEL + 1
_CHUNK = 2048  # windows convolved at a time


def _table() -> np.ndarray:
    """Class of every byte: hexadecimal letters and digits apart, other letters by case, punctuation by sign, rest 1."""
    out = np.ones(256, np.uint8)
    out[0] = 0
    for c in range(48, 58):
        out[c] = 2
    for c in range(97, 123):
        out[c] = 3 if c < 103 else 4
    for c in range(65, 91):
        out[c] = 5 if c < 71 else 6
    for i, c in enumerate(b" \n\"'=:+/_.-@,;()[]{}<>|#*&%$!?"):
        out[c] = 7 + i
    return out


TABLE = _table()


def window(text: str, start: int, end: int, context: bool = True) -> str:
    """The whole candidate with ``BEFORE`` characters before it and at least ``AFTER`` behind it, filled to ``WIDTH``; it starts at ``BEFORE``."""
    head = text[max(0, start - BEFORE) : start] if context else ""
    tail = text[start : max(start + WIDTH - BEFORE, end + AFTER)] if context else text[start:end]
    return head.rjust(BEFORE, "\0") + tail.ljust(WIDTH - BEFORE, "\0")


class Shown:
    """Coded candidates: all their windows, and where those of each candidate begin."""

    def __init__(self, windows: np.ndarray, starts: np.ndarray):
        self.windows, self.starts = windows, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, rows) -> Shown:
        rows = np.arange(len(self))[rows]
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Shown(self.windows[at], starts)


def coded(shown: list[str]) -> Shown:
    """Windows of texts made by ``window``; the last window of each is filled."""
    sizes = np.array([1 + max(0, -(-(len(w) - WIDTH) // _STEP)) for w in shown], np.int64)
    lengths = sizes * _STEP + _KERNEL - 1
    raw = b"".join(w.encode("ascii", "replace").ljust(n, b"\0") for w, n in zip(shown, lengths.tolist()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    inner = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    begin = np.repeat(np.cumsum(lengths) - lengths, sizes) + inner * _STEP
    data = TABLE[np.frombuffer(raw, np.uint8)]
    return Shown(data[begin[:, None] + np.arange(WIDTH)], starts)


def _as_shown(x: Shown | np.ndarray) -> Shown:
    return x if isinstance(x, Shown) else Shown(x, np.arange(len(x) + 1))


class CharCNN:
    def __init__(self, filters: int = 24, size: int = 6, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (_CLASSES, size))
        self.conv = rng.normal(0, 1 / np.sqrt(_KERNEL * size), (_KERNEL * size, filters))
        self.bias = np.zeros(filters)
        self.out = rng.normal(0, 0.3, filters)
        self.shift = np.zeros(1)
        self.scale, self.offset = 1.0, 0.0  # calibration
        self.rng = rng
        self.first, self.second = ([np.zeros_like(p) for p in self.params()] for _ in range(2))  # moments of the steps
        self.step = 0

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.out, self.shift]

    def state(self) -> np.ndarray:
        """Parameters and moments as one vector; that of several networks may be averaged."""
        return np.concatenate([p.ravel() for p in (*self.params(), *self.first, *self.second)])

    def restore(self, state: np.ndarray, step: int) -> CharCNN:
        at = 0
        for p in (*self.params(), *self.first, *self.second):
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size
        self.step = step
        return self

    def _convolve(self, x: np.ndarray):
        """Columns under the kernel, place and value of the maximum of every filter in every window."""
        e = self.emb[x]
        n, t, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, _KERNEL, axis=1)  # n, t', d, kernel
        cols = cols.transpose(0, 1, 3, 2).reshape(n, t - _KERNEL + 1, _KERNEL * d)
        z = cols @ self.conv + self.bias
        at = z.argmax(axis=1)
        return cols, at, np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]

    def _forward(self, x: Shown | np.ndarray):
        """Columns, place of the maximum in its window, activation and logit of every candidate; last, the window of the maximum."""
        x = _as_shown(x)
        cols, at, top = self._convolve(x.windows)
        first, sizes = x.starts[:-1], np.diff(x.starts)
        best = np.maximum.reduceat(top, first, axis=0)
        wins = np.where(top == np.repeat(best, sizes, axis=0), np.arange(len(top))[:, None], len(top))
        won = np.minimum.reduceat(wins, first, axis=0)
        act = np.maximum(best, 0)
        return cols, np.take_along_axis(at, won, axis=0), act, act @ self.out + self.shift[0], won

    def logits(self, x: Shown | np.ndarray) -> np.ndarray:
        x = _as_shown(x)
        if not len(x):
            return np.zeros(0)
        top = np.concatenate([self._convolve(x.windows[i : i + _CHUNK])[2] for i in range(0, len(x.windows), _CHUNK)])
        return np.maximum(np.maximum.reduceat(top, x.starts[:-1], axis=0), 0) @ self.out + self.shift[0]

    def probability(self, x: Shown | np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -30, 30)))

    def fit(self, x: Shown, y: np.ndarray, weight: np.ndarray, rounds: int = 12, batch: int = 128, rate: float = 0.01) -> CharCNN:
        for _ in range(rounds):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                self.step += 1
                for p, g, m, v in zip(self.params(), self._gradients(x[rows], y[rows], weight[rows]), self.first, self.second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        return self

    def _gradients(self, x, y, weight):
        x = _as_shown(x)
        cols, at, act, logit, won = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)
        d_act = d[:, None] * self.out * (act > 0)
        picked = cols[won, at]  # n, filters, kernel * size
        d_conv = np.einsum("nfk,nf->kf", picked, d_act)
        d_cols = np.einsum("nf,kf->nfk", d_act, self.conv)
        d_emb = np.zeros_like(self.emb)
        size = self.emb.shape[1]
        for k in range(_KERNEL):
            np.add.at(d_emb, x.windows[won, at + k], d_cols[:, :, k * size : (k + 1) * size])
        return d_emb, d_conv, d_act.sum(axis=0), act.T @ d, np.array([d.sum()])

    def calibrate(self, x: Shown, y: np.ndarray, steps: int = 200) -> CharCNN:
        """Platt scaling on held-out findings."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        spread = max(float(np.abs(z).max(initial=1.0)), 1.0)
        for _ in range(steps):
            r = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
            a -= float((r * z).mean()) / spread
            b -= float(r.mean())
        self.scale, self.offset = max(a, 1e-3), b
        return self


def recall_place(positives: int, recall: float) -> int:
    """Which of the positives, from the highest probability on, sets the largest threshold at which at least ``recall`` of them are found; 0 without any."""
    return int(np.ceil(recall * positives))
