"""A bidirectional LSTM in numpy that labels every block of a page, and its training on generated pages."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tidemark.llm.html_blocks import INPUTS, PATHS, WORDS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM per direction, a dense layer over both states, a probability per block."""

    def __init__(self, hidden: int = 16, seed: int = 7, inputs: int = INPUTS):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.08, (inputs, 4 * hidden))
            self.w[f"h{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            self.w[f"c{d}"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        self.w["out"] = rng.normal(0, 0.3, 2 * hidden)
        self.w["bias"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (batch, time, hidden) of one direction; padding leaves the state as it is."""
        n, steps, _ = x.shape
        h_size = self.hidden
        gates = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
        states, tape = np.zeros((n, steps, h_size), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[:, t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * h_size])
            i, f, o, g = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :], np.tanh(z[:, 3 * h_size :])
            m = mask[:, t, None]
            new_c = f * c + i * g
            th = np.tanh(new_c)
            if keep:
                tape.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * new_c + (1 - m) * c
            states[:, t] = h
        return states, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks and its gradients, by back-propagation through time."""
        h_size = self.hidden
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = mask * (p - y) / total
        grads = {"out": np.einsum("nth,nt->h", both, dz), "bias": dz.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            dstates = dz[:, :, None] * self.w["out"][k * h_size : (k + 1) * h_size]
            dgates = np.zeros((*x.shape[:2], 4 * h_size), np.float32)
            dh, dc = np.zeros((len(x), h_size), np.float32), np.zeros((len(x), h_size), np.float32)
            dwh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, g, th, m in reversed(runs[d][1]):
                dh = dh + dstates[:, t]
                own = m * dh
                dcell = m * dc + own * o * (1 - th * th)
                da = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * th * o * (1 - o), dcell * i * (1 - g * g)), axis=1)
                dgates[:, t] = da
                dwh += h.T @ da
                dh = (1 - m) * dh + da @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + dcell * f
            grads[f"x{d}"] = np.einsum("nti,ntg->ig", x, dgates, optimize=True)
            grads[f"h{d}"] = dwh
            grads[f"c{d}"] = dgates.sum(axis=(0, 1))
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over the pages (vectors, labels); the mean loss of each epoch. The rate falls to a tenth, and half the
        pages of a step hide their words, so that labels rest on structure first."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            by_length = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][1]))
            groups = [by_length[a : a + batch] for a in range(0, len(by_length), batch)]
            seen = []
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[g]])
                x[rng.random(len(x)) < 0.5, :, PATHS : PATHS + WORDS] = 0
                y = padded([pages[i][1][:, None] for i in groups[g]])[0][:, :, 0]
                loss, grads = self.gradients(x, mask, y)
                seen.append(loss)
                step += 1
                norm = float(np.sqrt(sum((v * v).sum() for v in grads.values())))
                for k, v in grads.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - rate * (1 - 0.9 * epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def label(self, pages: list[np.ndarray], cells: int = 8192) -> list[np.ndarray]:
        """A flag per block of each page; pages of like length go through together, up to `cells` padded blocks."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        waiting: list[int] = []

        def run() -> None:
            if waiting:
                x, mask = padded([pages[i] for i in waiting])
                for i, p in zip(waiting, self.probabilities(x, mask)):
                    out[i] = p[: len(pages[i])] >= 0.5
                waiting.clear()

        for i in sorted(range(len(pages)), key=lambda i: len(pages[i])):
            if len(pages[i]):
                if waiting and (len(waiting) + 1) * len(pages[i]) > cells:
                    run()
                waiting.append(i)
        run()
        return out


def padded(pages: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pages = list(pages)
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask
