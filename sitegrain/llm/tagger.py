"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Windows of equal length are rows of character classes; tags are numbers. ``fit`` minimises the CRF's negative log-likelihood by Adam,
with gradients through the forward-backward algorithm and through time; ``decode`` returns each window's most likely tags.
"""

from __future__ import annotations

import numpy as np

#: Character classes: ASCII as it is, then other letters, other characters, and nothing (beyond a text).
CLASSES = 131


def classes(text: str, length: int) -> np.ndarray:
    """Classes of the characters of a window, filled up with nothing."""
    out = np.full(length, 130)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[:length]
    out[: len(c)] = np.where(c < 128, c, 129)
    for i in np.flatnonzero(c >= 128).tolist():
        if text[i].isalpha():
            out[i] = 128
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    def __init__(self, tags: int, width: int = 12, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(size=shape) / np.sqrt(shape[0])
        self.hidden = hidden
        self.p = {"chars": draw(CLASSES, width) * 4, "out": draw(2 * hidden, tags), "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "first": np.zeros(tags)}
        for side in ("right", "left"):
            self.p |= {f"{side}_x": draw(width, 4 * hidden), f"{side}_h": draw(hidden, 4 * hidden), f"{side}_b": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    def _run(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over (time, window, width), in the order of ``x``, and what the backward pass needs."""
        n, z = self.hidden, x @ self.p[f"{side}_x"] + self.p[f"{side}_b"]
        h, c, kept, out = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n)), [], []
        for step in z:
            a = step + h @ self.p[f"{side}_h"]
            i, f, o = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), _sigmoid(a[:, 2 * n : 3 * n])
            g, before = np.tanh(a[:, 3 * n :]), c
            c = f * c + i * g
            t = np.tanh(c)
            kept.append((i, f, o, g, before, t, h))
            h = o * t
            out.append(h)
        return np.stack(out), kept

    def _back(self, side: str, x: np.ndarray, kept: list, dh_out: np.ndarray, grads: dict) -> np.ndarray:
        wh, n = self.p[f"{side}_h"], self.hidden
        dh, dc, dz = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0]), np.zeros((*dh_out.shape[:2], 4 * n))
        grads[f"{side}_h"] = np.zeros_like(wh)
        for s in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, t, h = kept[s]
            dh = dh + dh_out[s]
            dc = dc + dh * o * (1 - t * t)
            dz[s] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"{side}_h"] += h.T @ dz[s]
            dh, dc = dz[s] @ wh.T, dc * f
        grads[f"{side}_x"] = np.einsum("tbd,tbz->dz", x, dz, optimize=True)
        grads[f"{side}_b"] = dz.sum((0, 1))
        return dz @ self.p[f"{side}_x"].T

    def emissions(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["chars"][windows.T]
        right, r_kept = self._run("right", x)
        left, l_kept = self._run("left", x[::-1])
        h = np.concatenate([right, left[::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (x, h, r_kept, l_kept)

    def loss(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of a window's tags, and its gradients."""
        e, (x, h, r_kept, l_kept) = self.emissions(windows)
        steps, n, k = e.shape
        move, gold = self.p["move"], tags.T
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = self.p["first"] + e[0]
        for t in range(1, steps):
            a[t] = _logsumexp(a[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = _logsumexp(move[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        total = _logsumexp(a[-1], 1)
        rows = np.arange(n)
        score = self.p["first"][gold[0]] + sum(e[t, rows, gold[t]] for t in range(steps)) + sum(move[gold[t - 1], gold[t]] for t in range(1, steps))
        de = np.exp(a + b - total[None, :, None])
        grads: dict = {"move": np.zeros((k, k))}
        for t in range(1, steps):
            grads["move"] += np.exp(a[t - 1][:, :, None] + move + (e[t] + b[t] - total[:, None])[:, None, :]).sum(0)
            np.add.at(grads["move"], (gold[t - 1], gold[t]), -1)
        for t in range(steps):
            de[t, rows, gold[t]] -= 1
        de, grads["move"] = de / n, grads["move"] / n
        grads["first"] = de[0].sum(0)
        grads["out"], grads["bias"] = np.einsum("tbh,tbk->hk", h, de, optimize=True), de.sum((0, 1))
        dh = de @ self.p["out"].T
        dx = self._back("right", x, r_kept, dh[:, :, : self.hidden], grads) + self._back("left", x[::-1], l_kept, dh[::-1, :, self.hidden :], grads)[::-1]
        grads["chars"] = np.zeros_like(self.p["chars"])
        np.add.at(grads["chars"], windows.T, dx)
        return float((total - score).mean()), grads

    def fit(self, windows: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Tagger:
        r, step = np.random.default_rng(seed), 0
        epochs = -(-steps // -(-len(windows) // batch))
        mean, square = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for start in range(0, len(order), batch):
                rows, step = order[start : start + batch], step + 1
                _, grads = self.loss(windows[rows], tags[rows])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.01 * (g * g - square[name])
                    self.p[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely tags of each window, and by how much each tag's emission is above that of tag 0."""
        e, _ = self.emissions(windows)
        steps, n, k = e.shape
        best, came = self.p["first"] + e[0], np.zeros((steps, n, k), np.int16)
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"]
            came[t] = paths.argmax(1)
            best = paths.max(1) + e[t]
        tags = np.zeros((steps, n), np.int64)
        tags[-1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t, rows, tags[t]]
        margin = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags.T, margin.T
