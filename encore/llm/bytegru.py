"""A bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that a network reads before it starts afresh, units a direction, sequences computed at a time.
LENGTH, UNITS, TOGETHER = 64, 8, 4096
EPOCHS, BATCH, RATE = 6, 128, 0.01

#: Bytes that belong to letters: ASCII letters, and all of characters beyond ASCII.
LETTER = np.zeros(256, np.float32)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def sequences(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut every text into runs of LENGTH bytes: (place, sequence) bytes, lengths, and the text of each run."""
    size = np.diff(ends)
    count = -(-size // LENGTH)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    nth = np.arange(len(owner)) - first[owner]
    start = ends[:-1][owner] + nth * LENGTH
    length = np.minimum(LENGTH, ends[1:][owner] - start)
    place = np.arange(LENGTH)[:, None]
    cells = np.where(place < length, data[np.minimum(start + place, max(len(data) - 1, 0))], 0) if len(owner) else np.zeros((LENGTH, 0))
    return cells.astype(np.uint8), length, owner


class ByteNetwork:
    """Two minimal gated units (one gate that both updates and resets), one from either end, and a label at every byte.

    gate = clip(z / 4 + 1/2, 0, 1), candidate = clip(x + gate * (state U), -1, 1),
    state += gate * (candidate - state): piecewise linear, so that whole texts cost little.
    """

    def __init__(self, labels: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.params = {}
        for way in ("fore", "back"):
            self.params[way, "x"] = rng.normal(0, 0.4, (256, 2 * UNITS)).astype(np.float32)
            self.params[way, "u"] = rng.normal(0, 0.3, (UNITS, 2 * UNITS)).astype(np.float32)
            self.params[way, "v"] = rng.normal(0, 0.3, (UNITS, labels)).astype(np.float32)
        self.params["bias"] = np.zeros(labels, np.float32)

    def _run(self, way: str, cells: np.ndarray):
        """States after each byte, in reading order of ``way``; yields (place, state before, gate, pre-candidate, recurrent part, state)."""
        x, u = self.params[way, "x"], self.params[way, "u"]
        state = np.zeros((cells.shape[1], UNITS), np.float32)
        order = range(len(cells)) if way == "fore" else range(len(cells) - 1, -1, -1)
        for t in order:
            a = x[cells[t]]
            r = state @ u
            gate = (a[:, :UNITS] + r[:, :UNITS]) * 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            raw = gate * r[:, UNITS:]
            raw += a[:, UNITS:]
            step = np.clip(raw, -1, 1)
            step -= state
            step *= gate
            new = state + step
            yield t, state, gate, raw, r, new
            state = new

    def label(self, cells: np.ndarray) -> np.ndarray:
        """Probabilities of the labels at every byte: (place, sequence, label)."""
        out = np.empty((*cells.shape, len(self.params["bias"])), np.float32)
        for t, *_, state in self._run("fore", cells):
            np.matmul(state, self.params["fore", "v"], out=out[t])
        for t, *_, state in self._run("back", cells):
            out[t] += state @ self.params["back", "v"]
        out += self.params["bias"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def pooled(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean over each text's letter bytes of the probabilities; rows of zeros without any."""
        cells, length, owner = sequences(data, ends)
        labels = len(self.params["bias"])
        total, weight = np.zeros((len(ends) - 1, labels)), np.zeros(len(ends) - 1)
        for at in range(0, len(owner), TOGETHER):
            part = cells[:, at : at + TOGETHER]
            mine = LETTER[part] * (np.arange(LENGTH)[:, None] < length[at : at + TOGETHER])
            sums = np.einsum("tnl,tn->nl", self.label(part), mine)
            own = owner[at : at + TOGETHER]
            np.add.at(total, own, sums)
            np.add.at(weight, own, mine.sum(axis=0))
        return total / np.maximum(weight, 1)[:, None]

    def train(self, cells: np.ndarray, length: np.ndarray, label: np.ndarray) -> None:
        """Adam on the mean log loss of all labelled bytes, gradients by backpropagation through time."""
        rng = np.random.default_rng(self.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        steps = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(cells.shape[1])
            rate = RATE * (0.5 if epoch >= EPOCHS // 2 else 1.0)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                grads = self._gradients(np.ascontiguousarray(cells[:, some]), length[some], label[some])
                steps += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.params[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)

    def _gradients(self, cells: np.ndarray, length: np.ndarray, label: np.ndarray) -> dict:
        runs = {way: list(self._run(way, cells)) for way in ("fore", "back")}
        states = {way: np.stack([s[-1] for s in sorted(run, key=lambda s: s[0])]) for way, run in runs.items()}
        z = sum(states[way] @ self.params[way, "v"] for way in runs) + self.params["bias"]
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        mine = (np.arange(LENGTH)[:, None] < length).astype(np.float32)
        p[:, np.arange(len(label)), label] -= 1
        dz = p * (mine / max(mine.sum(), 1))[:, :, None]
        grads = {"bias": dz.sum(axis=(0, 1))}
        for way, run in runs.items():
            u = self.params[way, "u"]
            grads[way, "v"] = np.einsum("tnh,tnl->hl", states[way], dz)
            above = dz @ self.params[way, "v"].T
            carry = np.zeros_like(run[0][1])
            du, dx = np.zeros_like(u), np.zeros((256, 2 * UNITS), np.float32)
            for t, before, gate, raw, r, _ in reversed(run):
                d = carry + above[t]
                draw = d * gate * (np.abs(raw) < 1)
                dgate = d * (np.clip(raw, -1, 1) - before) + draw * r[:, UNITS:]
                dpre = dgate * 0.25 * ((gate > 0) & (gate < 1))
                dr = np.concatenate([dpre, draw * gate], axis=1)
                np.add.at(dx, cells[t], np.concatenate([dpre, draw], axis=1))
                du += before.T @ dr
                carry = d * (1 - gate) + dr @ u.T
            grads[way, "x"], grads[way, "u"] = dx, du
        return grads
