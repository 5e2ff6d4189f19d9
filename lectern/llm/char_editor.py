"""A character editor: an averaged perceptron that reads a word as recognised and
writes the word as printed, by keep, replace, delete, insert and line-join operations."""

from __future__ import annotations

import random
from collections import defaultdict

#: Signs and how character recognition misreads them.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("s", "5"), ("a", "@"), ("t", "†"), ("g", "9"), ("e", "c"), ("c", "e"),
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "b"), ("b", "6"), ("z", "2"), ("n", "ri"), ("l", "|"), ("i", "!"),
    ("b", "8"), ("y", "v"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"),
]
BREAKS = ("-\n", "¬\n", "\xad\n")
KEEP, DELETE, JOIN = "K", "D", "J"
MISSED = 0.01


def corrupt(word: str, rnd: random.Random) -> tuple[str, list[str]]:
    """A misread, broken or whole form of the word, and the operation for each of its signs."""
    if rnd.random() < 0.03:
        return _dropped(word, rnd)
    out, ops = [], []
    errors = rnd.choice((0, 1, 1, 1, 2))
    spots = set(rnd.sample(range(len(word)), min(errors, len(word))))
    broken = rnd.randrange(2, len(word) - 1) if len(word) > 4 and rnd.random() < 0.25 else -1
    for i, ch in enumerate(word):
        if i == broken:
            for b in rnd.choice(BREAKS):
                out.append(b)
                ops.append(JOIN if b == "\n" else DELETE)
        seen = [r for p, r in CONFUSIONS if p == ch] if i in spots else []
        if seen:
            r = rnd.choice(seen)
            out.append(r[0])
            ops.append("R" + ch)
            for x in r[1:]:
                out.append(x)
                ops.append(DELETE)
        else:
            out.append(ch)
            ops.append(KEEP)
    return "".join(out), ops


def _dropped(word: str, rnd: random.Random) -> tuple[str, list[str]]:
    if len(word) < 4:
        return word, [KEEP] * len(word)
    i = rnd.randrange(0, len(word) - 1)
    rest = word[:i] + word[i + 1 :]
    return rest, [KEEP] * i + ["I" + word[i]] + [KEEP] * (len(rest) - i - 1)


def _features(text: str, i: int, last: str) -> list[str]:
    t = f"^^{text}$$"
    j = i + 2
    return [
        t[j], t[j - 1 : j + 1], t[j : j + 2], t[j - 1 : j + 2], t[j - 2 : j + 1], t[j : j + 3], "o" + last, "p" + last + t[j], "w" + t[j - 2 : j + 3],
    ]


class CharEditor:
    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.options: dict[str, list[str]] = {}
        #: So much below the word as it was read a reading may score.
        self.margin = 0.0

    @classmethod
    def fit(cls, words: list[str], epochs: int = 3, seed: int = 5) -> "CharEditor":
        """words: as printed. Noise is drawn from CONFUSIONS; the same words give the same editor.

        The margin is the one that all but MISSED of newly drawn noise keeps.
        """
        ed, rnd = cls(), random.Random(seed)
        pairs = [corrupt(w, rnd) for w in words]
        options: dict[str, set[str]] = defaultdict(set)
        for text, ops in pairs:
            for ch, op in zip(text, ops):
                options[ch].add(op)
        ed.options = {ch: sorted(o | {KEEP}) for ch, o in options.items()}
        w, total, stamp, now = defaultdict(float), defaultdict(float), defaultdict(int), 0

        def bump(key: tuple[str, str], by: float) -> None:
            total[key] += (now - stamp[key]) * w[key]
            stamp[key] = now
            w[key] += by

        for _ in range(epochs):
            rnd.shuffle(pairs)
            for text, ops in pairs:
                last = KEEP
                for i, gold in enumerate(ops):
                    now += 1
                    f = _features(text, i, last[0])
                    can = ed.options[text[i]]
                    best = max(can, key=lambda o: sum(w.get((x, o), 0.0) for x in f))
                    if best != gold:
                        for x in f:
                            bump((x, gold), 1.0)
                            bump((x, best), -1.0)
                    last = gold
        for key in w:
            total[key] += (now - stamp[key]) * w[key]
        ed.weights = {k: v / max(now, 1) for k, v in total.items() if abs(v) > 1e-9}
        fresh = random.Random(seed + 1)
        drawn = [(x, ops) for x, ops in (corrupt(w, fresh) for w in words for _ in range(2)) if set(ops) != {KEEP} and "\n" not in x]
        kept = sorted(ed.score(x, ops) - ed.keeping(x) for x, ops in drawn)
        ed.margin = min(0.0, kept[int(len(kept) * MISSED)]) if kept else 0.0
        return ed

    def score(self, text: str, ops: list[str]) -> float:
        """Of the operations on the signs of the text."""
        total, last = 0.0, KEEP
        for i, op in enumerate(ops):
            total += sum(self.weights.get((x, op), 0.0) for x in _features(text, i, last))
            last = op[0]
        return total

    def keeping(self, text: str) -> float:
        """Score of the word as it was read."""
        return self.score(text, [KEEP] * len(text))

    def readings(self, text: str, beam: int = 24, prefixes: frozenset[str] | None = None) -> list[tuple[str, float]]:
        """What may have been printed with its score, the best first. prefixes: what it may begin with, if known."""
        hypotheses = [(0.0, "", KEEP)]
        for i, ch in enumerate(text):
            can = self.options.get(ch, [KEEP])
            after: dict[tuple[str, str], float] = {}
            for score, out, last in hypotheses:
                f = _features(text, i, last)
                for op in can:
                    s = score + sum(self.weights.get((x, op), 0.0) for x in f)
                    o = out + ch if op == KEEP else out + op[1] if op[0] == "R" else out + op[1] + ch if op[0] == "I" else out
                    if prefixes is not None and o not in prefixes:
                        continue
                    key = (o, op[0])
                    if s > after.get(key, -1e18):
                        after[key] = s
            hypotheses = [(s, o, a) for (o, a), s in sorted(after.items(), key=lambda x: (-x[1], x[0]))[:beam]]
        best: dict[str, float] = {}
        for s, o, _ in hypotheses:
            best.setdefault(o, s)
        return list(best.items())
