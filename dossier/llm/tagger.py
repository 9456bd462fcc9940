"""A character tagger in numpy: bidirectional LSTM, linear layer, CRF over the tags; trained by Adam on labelled windows."""

from __future__ import annotations

import io
import string

import numpy as np

#: Characters that the tagger tells apart: letters regardless of case, one for all digits, ASCII punctuation, white space, other letters, the rest.
SYMBOLS = string.ascii_lowercase + "0" + string.punctuation + " \n"
PAD, LETTER, OTHER = len(SYMBOLS), len(SYMBOLS) + 1, len(SYMBOLS) + 2
SIZE = OTHER + 1
HIDDEN = 16
_CODES = np.full(128, OTHER, np.int16)
for _c in map(chr, range(128)):
    _CODES[ord(_c)] = max(SYMBOLS.find("0" if _c.isdigit() else " " if _c == "\t" else "\n" if _c in "\r\v\f" else _c.lower()), -1)
_CODES[_CODES < 0] = OTHER


def codes(text: str, width: int) -> np.ndarray:
    """The text's symbols, padded to width."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[:width]
    out = np.full(width, PAD, np.int16)
    out[: len(points)] = np.where(points < 128, _CODES[np.minimum(points, 127)], LETTER)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _exp(x: np.ndarray) -> np.ndarray:
    """exp of what is zero at most; tiny results are kept off the slow subnormal numbers."""
    return np.exp(np.maximum(x, -60))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(_exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags 0 (nothing) and, for kind k, 2k + 1 (its first character) and 2k + 2 (a further one)."""

    def __init__(self, kinds: int, seed: int = 1) -> None:
        rng, self.tags = np.random.default_rng(seed), 2 * kinds + 1
        scale = lambda *shape: (rng.normal(size=shape) / np.sqrt(HIDDEN)).astype(np.float32)
        self.p = {"in": scale(2, SIZE, 4 * HIDDEN), "rec": scale(2, HIDDEN, 4 * HIDDEN), "bias": np.zeros((2, 1, 4 * HIDDEN), np.float32)}
        self.p["bias"][:, :, HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"out": scale(2 * HIDDEN, self.tags), "out_bias": np.zeros(self.tags, np.float32), "trans": np.zeros((self.tags, self.tags), np.float32), "start": np.zeros(self.tags, np.float32)}
        # A further character of a kind follows only that kind.
        self.banned = np.zeros((self.tags, self.tags), np.float32)
        for k in range(kinds):
            self.banned[:, 2 * k + 2] = -1e4
            self.banned[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
        self.first = self.banned[0]

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes, kinds: int) -> Tagger:
        out = cls(kinds)
        out.p = dict(np.load(io.BytesIO(data)))
        return out

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """(states by time and row, what the way back needs) over symbols (time, row); both directions take each step together."""
        n, rows, side = len(x), x.shape[1], np.arange(2)[:, None]
        h = c = np.zeros((2, rows, HIDDEN), np.float32)
        out, kept = np.empty((n, rows, 2 * HIDDEN), np.float32), []
        table = self.p["in"] + self.p["bias"]
        for t in range(n):
            own = np.stack([x[t], x[n - 1 - t]])
            z = table[side, own] + h @ self.p["rec"]
            gates, new = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            before, c = (h, c), f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t, :, :HIDDEN], out[n - 1 - t, :, HIDDEN:] = h
            if keep:
                kept.append((t, own, i, f, o, new, squashed, *before))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x, False)[0] @ self.p["out"] + self.p["out_bias"]

    def decoded(self, x: np.ndarray) -> np.ndarray:
        """The best tags (row, time) of symbols (row, time)."""
        e = self.emissions(x.T)
        trans = self.p["trans"] + self.banned
        score, back = e[0] + self.p["start"] + self.first, []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans
            at = step.argmax(1)
            back.append(at)
            score = np.take_along_axis(step, at[:, None], 1)[:, 0] + e[t]
        tag = score.argmax(1)
        out = [tag]
        for at in reversed(back):
            tag = at[np.arange(len(tag)), tag]
            out.append(tag)
        return np.stack(out[::-1], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log-likelihood of a row, gradients) for symbols and tags (row, time)."""
        x, y = x.T, y.T
        n, rows = len(x), np.arange(x.shape[1])
        both, kept = self._run(x, True)
        e = both @ self.p["out"] + self.p["out_bias"]
        trans = self.p["trans"] + self.banned
        a = [e[0] + self.p["start"] + self.first]
        for t in range(1, n):
            a.append(_logsum(a[-1][:, :, None] + trans, 1) + e[t])
        total = _logsum(a[-1], 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        de, b = np.empty_like(e), np.zeros_like(e[0])
        gold = e[0][rows, y[0]] + (self.p["start"] + self.first)[y[0]]
        for t in range(n - 1, -1, -1):
            de[t] = _exp(a[t] + b - total[:, None])
            de[t][rows, y[t]] -= 1
            if t:
                gold = gold + e[t][rows, y[t]] + trans[y[t - 1], y[t]]
                ahead = (e[t] + b)[:, None, :] + trans
                g["trans"] += _exp(a[t - 1][:, :, None] + ahead - total[:, None, None]).sum(0)
                np.add.at(g["trans"], (y[t - 1], y[t]), -1)
                b = _logsum(ahead, 2)
        g["start"] = de[0].sum(0)
        g["out"] = np.tensordot(both, de, ([0, 1], [0, 1]))
        g["out_bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        back, steps, read = self.p["rec"].transpose(0, 2, 1), [], []
        later_h = later_c = np.zeros((2, len(rows), HIDDEN), np.float32)
        for t, own, i, f, o, new, squashed, h0, c0 in reversed(kept):
            d = np.stack([dh[t][:, :HIDDEN], dh[n - 1 - t][:, HIDDEN:]]) + later_h
            dc = d * o * (1 - squashed**2) + later_c
            dz = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), d * squashed * o * (1 - o), dc * i * (1 - new**2)], 2)
            g["rec"] += h0.transpose(0, 2, 1) @ dz
            g["bias"] += dz.sum(1, keepdims=True)
            steps.append(dz)
            read.append(own)
            later_h, later_c = dz @ back, dc * f
        all_dz, all_x = np.concatenate(steps, 1), np.concatenate(read, 1)
        for k in range(2):
            g["in"][k] = (all_x[k][:, None] == np.arange(SIZE)).astype(np.float32).T @ all_dz[k]
        return float((total - gold).mean()), {k: v / len(rows) for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 1) -> float:
        """Adam with a falling rate and clipped gradients; the last epoch's mean loss."""
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        last = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, loss = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                one, g = self.gradients(x[at], y[at])
                loss += one * len(at) / len(x)
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                for k, a in g.items():
                    a = a * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] = self.p[k] - np.float32(rate * (1 - 0.9 * step / last)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return loss
