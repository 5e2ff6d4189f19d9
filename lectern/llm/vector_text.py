"""Vectorised hashing of tokens and n-grams in numpy.

Texts are laid end to end as code points. With P the running sum of c[i] * B**i
modulo 2**64 and B odd, the hash of any span is (P[end] - P[start]) * B**-start, so
all tokens and n-grams of a block of texts are hashed without a loop over them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are handled in blocks of about so many characters, so memory stays bounded.
BLOCK_CHARS = 400_000

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3


def blocks(texts: Sequence[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have at most `most` characters, or are one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _all_powers(b: int, n: int) -> np.ndarray:
    p = np.full(n, b, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


#: So many powers are kept, enough for a block of texts.
KEPT = 1 << 19


@functools.cache
def _kept_powers(b: int) -> np.ndarray:
    p = _all_powers(b, KEPT)
    p.flags.writeable = False
    return p


def _powers(b: int, n: int) -> np.ndarray:
    return _kept_powers(b)[:n] if n <= KEPT else _all_powers(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def unique_pairs(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each (group, hash) pair, and how often the pair occurs."""
    key = mix(h + group.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return order[first], np.diff(np.r_[first, len(key)])


def _classes() -> np.ndarray:
    table = np.full(0x3000, _OTHER, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = _LETTER if ch.isalpha() or ch in "'’" else _DIGIT if ch.isdigit() else _SPACE if ch.isspace() else _OTHER
    return table


CLASSES = _classes()


class Codes:
    """Code points of texts laid end to end, each followed by a line feed."""

    def __init__(self, texts: Sequence[str]):
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.starts = np.r_[0, self.ends[:-1]]
        self.kind = CLASSES[np.minimum(self.codes, len(CLASSES) - 1)]
        n = len(self.codes)
        self._inverse = _powers(INVERSE, n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        step = self.codes.astype(np.uint64)
        step += np.uint64(1)
        step *= _powers(BASE, n)
        np.cumsum(step, out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of letters, runs of digits, and single other signs; no white space."""
        k = self.kind
        cut = np.r_[True, (k[1:] != k[:-1]) | (k[1:] == _OTHER)]
        cut[self.starts] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(k)]
        keep = k[start] != _SPACE
        return start[keep], end[keep]


def hashed_features(texts: Sequence[str], bits: int, words: int = 2, chars: tuple[int, ...] = (), whole_digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs as often as they occur: token n-grams up to `words`, and
    character n-grams inside words with their edges. Runs of digits count as one token."""
    c = Codes(texts)
    mask = np.uint64((1 << bits) - 1)
    start, end = c.tokens()
    owner = c.text_of(start)
    h = c.hashes(start, end)
    if whole_digits and len(start):
        h = np.where(c.kind[start] == _DIGIT, np.uint64(7), h)
    owners, feats = [], []
    gram = h
    for n in range(1, words + 1):
        if n > 1:
            if len(h) < n:
                break
            gram = mix(gram[: len(h) - n + 1] * np.uint64(31) + h[n - 1 :] + np.uint64(n))
        same = owner[: len(gram)] == owner[n - 1 :]
        owners.append(owner[: len(gram)][same])
        feats.append((gram[same] * np.uint64(2)) & mask)
    for n in chars:
        # windows of n code points that hold letters only, but for a blank at either edge
        total = len(c.codes)
        if total < n:
            continue
        inner = (c.kind == _LETTER).astype(np.int32)
        run = np.r_[0, np.cumsum(inner)]
        at = np.arange(total - n + 1)
        ok = run[at + n - 1] - run[at + 1] == n - 2
        at = at[ok & (c.kind[at] != _OTHER) & (c.kind[at + n - 1] != _OTHER)]
        who = c.text_of(at)
        inside = at + n <= c.ends[who]
        at, who = at[inside], who[inside]
        owners.append(who)
        feats.append((c.hashes(at, at + n) * np.uint64(2) + np.uint64(1)) & mask)
    return np.concatenate(owners), np.concatenate(feats).astype(np.int64)


class LinearModel:
    """Multinomial logistic regression with an L2 penalty over sparse counted features."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, owner: np.ndarray, feat: np.ndarray, label: np.ndarray, size: int, classes: int, l2: float = 1e-4, epochs: int = 30, rate: float = 0.5, weight: np.ndarray | None = None, seed: int = 7) -> "LinearModel":
        """owner, feat: as hashed_features() gives them. Adagrad on mini-batches; deterministic."""
        n = len(label)
        order = np.argsort(owner, kind="stable")
        owner, feat = owner[order], feat[order]
        w, b = np.zeros((size, classes)), np.zeros(classes)
        gw, gb = np.full(size, 1e-8), np.full(classes, 1e-8)
        first = np.searchsorted(owner, np.arange(n + 1))
        weight = np.ones(n) if weight is None else weight
        rnd = np.random.default_rng(seed)
        batch = max(16, min(512, n // 20 or 1))
        for _ in range(epochs):
            for rows in np.array_split(rnd.permutation(n), max(1, n // batch)):
                rows = np.sort(rows)
                counts = first[rows + 1] - first[rows]
                idx = np.repeat(first[rows] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                f, local = feat[idx], np.repeat(np.arange(len(rows)), counts)
                scale = 1 / np.sqrt(np.maximum(counts, 1))
                wf = w[f]
                z = np.stack([np.bincount(local, wf[:, k], minlength=len(rows)) for k in range(classes)], 1)
                z = z * scale[:, None] + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                g = p * weight[rows][:, None] / len(rows)
                uniq, inv = np.unique(f, return_inverse=True)
                each = g[local] * scale[local][:, None]
                d = np.stack([np.bincount(inv, each[:, k], minlength=len(uniq)) for k in range(classes)], 1)
                d += l2 * w[uniq]
                gw[uniq] += (d**2).sum(1)
                w[uniq] -= rate * d / np.sqrt(gw[uniq])[:, None]
                gb += g.sum(0) ** 2
                b -= rate * g.sum(0) / np.sqrt(gb)
        return cls(w, b)

    def scores(self, owner: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of n rows."""
        counts = np.bincount(owner, minlength=n)
        scale = 1 / np.sqrt(np.maximum(counts, 1))
        z = np.stack([np.bincount(owner, self.weights[feat, k], minlength=n) for k in range(len(self.bias))], 1)
        z = z * scale[:, None] + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
