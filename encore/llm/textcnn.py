"""A small convolutional text classifier in numpy: hashed embeddings, filter widths, max pooling."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from encore.llm.cgk import BREAK
from encore.llm.common import text_bytes
from encore.llm.tokens import split_words, word_hashes

#: Bits of the word table and of the table of word beginnings, and the bytes of a beginning.
WORD_BITS, STEM_BITS, STEM_BYTES = 15, 13, 4
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 12, 16, 0.05

#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with be by are this",
    "de": "der die und das ist nicht ein zu mit den von auf für im dem",
    "fr": "le la et les des est une du que pour dans par sur avec pas",
    "es": "el los las del y en que por con una para como su al lo",
}


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and beginning bucket of every word (lower case, without punctuation), and the words before each text."""
    data, ends = text_bytes(pc.utf8_lower(column))
    starts, stops, before = split_words(data, ends, BREAK)
    word = word_hashes(data, starts, stops) >> np.uint64(64 - WORD_BITS)
    stem = word_hashes(data, starts, np.minimum(stops, starts + STEM_BYTES)) >> np.uint64(64 - STEM_BITS)
    return word.astype(np.int32), stem.astype(np.int32), before


def _buckets(words: str) -> np.ndarray:
    return tokens(pa.array([words]))[0]


def languages(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Index of the language whose function words are most frequent in each text; the number of languages if none occurs."""
    names = list(FUNCTION_WORDS)
    member = np.zeros((len(names), 1 << WORD_BITS), np.int32)
    for k, name in enumerate(names):
        member[k, _buckets(FUNCTION_WORDS[name])] = 1
    counts = np.zeros((len(names), len(before) - 1), np.int64)
    for k in range(len(names)):
        sums = np.concatenate([[0], np.cumsum(member[k, word])])
        counts[k] = sums[before[1:]] - sums[before[:-1]]
    return np.where(counts.max(axis=0, initial=0) > 0, counts.argmax(axis=0), len(names))


def _padded(word: np.ndarray, stem: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with padding (the last bucket of each table) behind every text; start and stop of each text's windows.

    A text without words is one padding token, so that every text has a window.
    """
    gap = max(WIDTHS)
    size = np.diff(before)
    room = np.maximum(size, 1) + gap - 1
    begin = np.concatenate([[0], np.cumsum(room)])
    out_word = np.full(begin[-1], 1 << WORD_BITS, np.int32)
    out_stem = np.full(begin[-1], 1 << STEM_BITS, np.int32)
    at = np.arange(len(word)) + np.repeat(begin[:-1] - before[:-1], size)
    out_word[at], out_stem[at] = word, stem
    return out_word, out_stem, begin[:-1], begin[:-1] + np.maximum(size, 1)


@dataclass
class TextCnn:
    seed: int = 5
    words: np.ndarray = field(init=False)
    stems: np.ndarray = field(init=False)
    filters: dict = field(init=False)
    bias: dict = field(init=False)
    out: np.ndarray = field(init=False)
    out_bias: float = field(init=False, default=0.0)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.words = rng.normal(0, 0.02, ((1 << WORD_BITS) + 1, DIM)).astype(np.float32)
        self.stems = rng.normal(0, 0.02, ((1 << STEM_BITS) + 1, DIM)).astype(np.float32)
        self.words[-1] = self.stems[-1] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)

    def flat(self) -> np.ndarray:
        """All parameters as one vector."""
        parts = [self.words, self.stems, *self.filters.values(), *self.bias.values(), self.out, np.array([self.out_bias])]
        return np.concatenate([p.reshape(-1) for p in parts]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        """Take the parameters from a vector that flat has given."""
        at = 0
        for p in [self.words, self.stems, *self.filters.values(), *self.bias.values(), self.out]:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias = float(flat[at])

    def train(
        self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, square: dict | None = None, share: float | None = None
    ) -> dict:
        """Adagrad on the weighted log loss (classes weigh the same); only the windows that win the pooling carry gradients.

        Returns Adagrad's sums of squares, from which another call may go on; share is that of class 1, by default as in the labels.
        """
        rng = np.random.default_rng(self.seed + 1)
        share = np.clip(labels.mean() if share is None else share, 0.02, 0.98)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        if square is None:
            square = {"words": np.full(self.words.shape, 1e-2, np.float32), "stems": np.full(self.stems.shape, 1e-2, np.float32)}
            square |= {("f", w): np.full(f.shape, 1e-2, np.float32) for w, f in self.filters.items()}
            square |= {("b", w): np.full(FILTERS, 1e-2, np.float32) for w in WIDTHS}
            square |= {"out": np.full(self.out.shape, 1e-2, np.float32), "bias": 1e-2}
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                self._step([texts[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]], weight[order[at : at + BATCH]], square)
        return square

    def _step(self, texts, labels, weight, square) -> None:
        size = np.array([len(w) for w, _ in texts])
        before = np.concatenate([[0], np.cumsum(size)])
        word, stem, start, stop = _padded(np.concatenate([w for w, _ in texts]), np.concatenate([s for _, s in texts]), before)
        x = self.words[word] + self.stems[stem]
        pooled, won = [], {}
        for w in WIDTHS:
            z = sum(x[j : len(x) - w + 1 + j] @ self.filters[w][j] for j in range(w)) + self.bias[w]
            best = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(start, stop, strict=True)])
            won[w] = best
            pooled.append(np.take_along_axis(z, best, axis=0))
        h = np.concatenate(pooled, axis=1)
        active = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.out_bias, -30, 30)))
        g = ((p - labels) * weight / len(labels)).astype(np.float32)
        dh = np.outer(g, self.out) * (h > 0)
        step = {"out": active.T @ g, "bias": g.sum()}
        places, grads = [], []
        for k, w in enumerate(WIDTHS):
            d, best = dh[:, k * FILTERS : (k + 1) * FILTERS], won[w]
            step["b", w] = d.sum(axis=0)
            df = np.empty_like(self.filters[w])
            for j in range(w):
                df[j] = np.einsum("bfd,bf->df", x[best + j], d)
                places.append((best + j).reshape(-1))
                grads.append((d[:, :, None] * self.filters[w][j].T[None]).reshape(-1, DIM))
            step["f", w] = df
        at, grad = np.concatenate(places), np.concatenate(grads)
        for name, table, index in (("words", self.words, word), ("stems", self.stems, stem)):
            rows, inverse = np.unique(index[at], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse, grad)
            square[name][rows] += total**2
            table[rows] -= RATE * total / np.sqrt(square[name][rows])
            table[-1] = 0
        for w in WIDTHS:
            for key, value in ((("f", w), self.filters[w]), (("b", w), self.bias[w])):
                square[key] += step[key] ** 2
                value -= RATE * step[key] / np.sqrt(square[key])
        square["out"] += step["out"] ** 2
        self.out -= RATE * step["out"] / np.sqrt(square["out"])
        square["bias"] += step["bias"] ** 2
        self.out_bias -= float(RATE * step["bias"] / np.sqrt(square["bias"]))

    def tables(self) -> dict:
        """What each token adds to each place of each filter: convolution by look-up."""
        return {(w, j): (self.words @ self.filters[w][j], self.stems @ self.filters[w][j]) for w in WIDTHS for j in range(w)}

    def logits(self, word: np.ndarray, stem: np.ndarray, before: np.ndarray, tables: dict | None = None) -> np.ndarray:
        """Log odds of class 1 for each text."""
        if len(before) < 2:
            return np.zeros(0)
        tables = self.tables() if tables is None else tables
        word, stem, start, stop = _padded(word, stem, before)
        pooled = []
        for w in WIDTHS:
            n = len(word) - w + 1
            z = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                a, b = tables[w, j]
                z += a[word[j : n + j]]
                z += b[stem[j : n + j]]
            cuts = np.stack([start, stop], axis=1).reshape(-1)
            # the last text's windows end where the array may end
            ends = cuts[:-1] if cuts[-1] >= n else cuts
            pooled.append(np.maximum.reduceat(z, ends, axis=0)[::2] + self.bias[w])
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias
