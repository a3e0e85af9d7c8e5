"""A character-level bidirectional LSTM with CRF transitions, trained and applied in numpy.

Both directions advance in one batched product a step. Training follows the gradient of the field's likelihood
(forward-backward) through the recurrent layers; decoding gives the best path of each window and its marginals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Units of each direction, sequences of a step, steps, rate, greatest norm of a step's gradient.
UNITS, BATCH, STEPS, RATE, CLIP = 24, 48, 600, 0.015, 5.0

#: Characters as the model sees them: padding, ASCII from space on, line breaks, other letters, the rest.
_LINE, _LETTER, _REST = 96, 97, 98
SYMBOLS = 99
_CODES = np.full(1 << 16, _REST, np.uint8)
_CODES[32:127] = np.arange(1, 96)
_CODES[[9, 10, 13]] = _LINE
_CODES[0xC0:0x250] = _CODES[0x370:0x1FFF] = _CODES[0x3040:0xD7A4] = _LETTER


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODES[np.where(points < 1 << 16, points, 0xFFFF)]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, which are real), a column a sequence."""
    size = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(size.max(initial=1))), np.uint8)
    for row, r in zip(out, rows, strict=True):
        row[: len(r)] = r
    return out.T.copy(), (np.arange(out.shape[1])[:, None] < size)


@dataclass
class Tagger:
    """Input weights (direction, symbol, gate), recurrent weights, output weights, and the field's start and transitions."""

    inputs: np.ndarray
    recurrent: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    change: np.ndarray

    @classmethod
    def fresh(cls, tags: int, units: int = UNITS, seed: int = 11) -> Tagger:
        draw = np.random.Generator(np.random.PCG64(seed))
        make = lambda *shape, s: (draw.normal(size=shape) * s).astype(np.float32)
        out = cls(make(2, SYMBOLS, 4 * units, s=0.3), make(2, units, 4 * units, s=units**-0.5), make(2 * units, tags, s=0.3), *(np.zeros(s, np.float32) for s in ((tags,), (tags,), (tags, tags))))
        out.inputs[:, :, units : 2 * units] += 0.5  # remembers at first
        return out

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.outputs, self.bias, self.start, self.change]

    def states(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """(hidden states (step, sequence, 2 · units), what the gradient needs). The second direction reads from the end."""
        n = self.recurrent.shape[1]
        length, batch = x.shape
        both, mask = np.stack([x, x[::-1]]), np.stack([real, real[::-1]]).astype(np.float32)[..., None]
        gates = np.stack([self.inputs[d][both[d]] for d in (0, 1)], 1)  # step, direction, sequence, gate
        scale = np.ones(4 * n, np.float32)
        scale[: 3 * n] = 0.5  # a sigmoid is a shifted tanh of half its argument
        h, c = np.zeros((2, batch, n), np.float32), np.zeros((2, batch, n), np.float32)
        hidden, cells = np.empty((length, 2, batch, n), np.float32), np.empty((length, 2, batch, n), np.float32) if keep else None
        for t in range(length):
            g = gates[t]
            g += h @ self.recurrent
            g *= scale
            np.tanh(g, out=g)
            g[..., : 3 * n] += 1
            g[..., : 3 * n] *= 0.5
            c = (g[..., n : 2 * n] * c + g[..., :n] * g[..., 3 * n :]) * mask[:, t]
            h = g[..., 2 * n : 3 * n] * np.tanh(c) * mask[:, t]
            hidden[t] = h
            if keep:
                cells[t] = c
        joined = np.concatenate([hidden[:, 0], hidden[::-1, 1]], 2)
        return joined, (gates, hidden, cells, both, mask)

    def emissions(self, joined: np.ndarray) -> np.ndarray:
        return joined @ self.outputs + self.bias

    def chains(self, emit: np.ndarray, real: np.ndarray):
        """(marginals, expected first tags, expected transitions, log of the normalisers) by forward-backward."""
        length, batch, tags = emit.shape
        top = emit.max(2, keepdims=True)
        e = np.exp(emit - top)
        peak = self.change.max()
        move = np.exp(self.change - peak)
        ahead, back = np.empty_like(e), np.ones_like(e)
        first = np.exp(self.start) * e[0]
        norm = first.sum(1, keepdims=True)
        ahead[0] = first / norm
        total = np.log(norm[:, 0]) + top[0, :, 0]
        for t in range(1, length):
            step = (ahead[t - 1] @ move) * e[t]
            norm = step.sum(1, keepdims=True)
            on = real[t][:, None]
            ahead[t] = np.where(on, step / norm, ahead[t - 1])
            total += np.where(real[t], np.log(norm[:, 0]) + top[t, :, 0] + peak, 0)
        moves = np.zeros((tags, tags), np.float32)
        for t in range(length - 2, -1, -1):
            after = e[t + 1] * back[t + 1]
            on = real[t + 1][:, None]
            step = after @ move.T
            scale = (ahead[t] * step).sum(1, keepdims=True)
            moves += (np.where(on, ahead[t] / scale, 0)).T @ after * move
            back[t] = np.where(on, step / step.sum(1, keepdims=True), 1)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        return p, p[0].sum(0), moves, total

    def likelihood(self, x: np.ndarray, real: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of the tags a character, and its gradient by part."""
        n = self.recurrent.shape[1]
        joined, (gates, hidden, cells, both, mask) = self.states(x, real, keep=True)
        emit = self.emissions(joined)
        p, first, moves, total = self.chains(emit, real)
        size, each = real.sum(), np.arange(x.shape[1])
        count = np.zeros_like(self.change)
        pairs = real[1:]
        np.add.at(count, (tags[:-1][pairs], tags[1:][pairs]), 1)
        gold = np.take_along_axis(emit, tags[..., None].astype(np.int64), 2)[..., 0]
        loss = (total.sum() - gold[real].sum() - self.start[tags[0]].sum() - (self.change * count).sum()) / size
        d = p
        d[np.arange(len(x))[:, None], each[None], tags] -= 1
        d *= real[..., None] / np.float32(size)
        start = first - np.bincount(tags[0], minlength=len(first))
        flat = joined.reshape(-1, 2 * n)
        outputs, bias = flat.T @ d.reshape(len(flat), -1), d.sum((0, 1))
        back = d @ self.outputs.T
        grads = np.stack([back[..., :n], back[::-1, :, n:]], 1)
        # through time, both directions at once
        dh, dc = np.zeros_like(hidden[0]), np.zeros_like(hidden[0])
        dg = np.empty_like(gates)
        for t in range(len(x) - 1, -1, -1):
            g, c = gates[t], cells[t]
            i, f, o, m = (g[..., k * n : (k + 1) * n] for k in range(4))
            dh = (dh + grads[t]) * mask[:, t]
            squashed = np.tanh(c)
            dc = (dc + dh * o * (1 - squashed * squashed)) * mask[:, t]
            before = cells[t - 1] if t else 0
            dg[t, ..., :n] = dc * m * i * (1 - i)
            dg[t, ..., n : 2 * n] = dc * before * f * (1 - f)
            dg[t, ..., 2 * n : 3 * n] = dh * squashed * o * (1 - o)
            dg[t, ..., 3 * n :] = dc * i * (1 - m * m)
            dh, dc = dg[t] @ self.recurrent.transpose(0, 2, 1), dc * f
        inputs, recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        seen = np.eye(SYMBOLS, dtype=np.float32)
        for k in (0, 1):
            flat = dg[:, k].reshape(-1, 4 * n)
            inputs[k] = seen[both[k].ravel()].T @ flat
            recurrent[k] = hidden[:-1, k].reshape(-1, n).T @ dg[1:, k].reshape(-1, 4 * n)
        return float(loss), [inputs, recurrent, outputs, bias, (start / size).astype(np.float32), ((moves - count) / size).astype(np.float32)]

    def train(self, rows: list[np.ndarray], tags: list[np.ndarray], steps: int = STEPS, rate: float = RATE, batch: int = BATCH, seed: int = 3) -> list[float]:
        """Steps on seeded batches, with moments of the gradient; the losses."""
        draw = np.random.Generator(np.random.PCG64(seed))
        mean, square, losses = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], []
        for k in range(1, steps + 1):
            pick = draw.integers(0, len(rows), batch)
            x, real = padded([rows[i] for i in pick])
            y, _ = padded([tags[i] for i in pick])
            loss, grads = self.likelihood(x, real, y)
            losses.append(loss)
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            shrink, pace = min(1.0, CLIP / (norm + 1e-9)), rate * min(1.0, 2 * (1 - k / (steps + 1)))
            for p, g, m, s in zip(self.parts, grads, mean, square, strict=True):
                g = g * shrink
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (pace * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best tags of each sequence, and the marginal of each of these tags."""
        x, real = padded(rows)
        emit = self.emissions(self.states(x, real)[0])
        p = self.chains(emit, real)[0]
        length, batch, tags = emit.shape
        best, back = self.start + emit[0], np.zeros((length, batch, tags), np.uint8)
        stay = np.arange(tags, dtype=np.uint8)
        for t in range(1, length):
            step = best[:, :, None] + self.change
            back[t] = step.argmax(1)
            ahead = step.max(1) + emit[t]
            on = real[t][:, None]
            back[t] = np.where(on, back[t], stay)
            best = np.where(on, ahead, best)
        path = np.empty((length, batch), np.int64)
        path[-1] = best.argmax(1)
        each = np.arange(batch)
        for t in range(length - 1, 0, -1):
            path[t - 1] = back[t][each, path[t]]
        sure = np.take_along_axis(p, path[..., None], 2)[..., 0]
        return [(path[: len(r), k], sure[: len(r), k]) for k, r in enumerate(rows)]
