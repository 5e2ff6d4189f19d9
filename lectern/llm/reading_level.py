"""Reading level of each parsed file.

A multinomial logistic model with an L2 penalty gives every sentence a level, from
hashed words, character trigrams and the shape of the sentence. It is fitted on the
sentences of the graded passages (at most MOST_SAMPLES of them, the only bound). A
file's mean sentence distribution is calibrated to a band by a second model, fitted on
the passages' own distributions as models see them that were fitted on the others.

Plan. Fitting is on the driver, over the bounded passages. The model (2**16 weights a
class) is shipped with the task closure. Paragraphs are scored in Arrow batches and
summed per file before anything is shuffled.

Defined results: only body paragraphs; lines that are entries, rows or junk do not
count, nor do short lines repeated in the file; null and blank texts add nothing;
twins count once; a file without a sentence has no row; equal bands go to the easier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import quality
from lectern.llm.sentences import sentences
from lectern.llm.vector_text import LinearModel, blocks, hashed_features

BANDS = ("basic", "standard", "advanced")
BITS = 16
MOST_SAMPLES = 5_000
#: Folds of the graded passages for the calibration.
FOLDS = 5
_JOINT = re.compile(r"[,;]| and | but | so ")
_LETTERS = "abcdefghijklmnop"


def _shaped(s: str) -> str:
    """The sentence in lower case with tokens for its length, word length and joints."""
    n = s.count(" ") + 1
    size, word, joints = _LETTERS[min(15, n // 4)], _LETTERS[min(15, len(s) // n)], _LETTERS[min(5, len(_JOINT.findall(s)))]
    return f"{s.lower()} q{size}xx z{word}xx v{joints}xx q{size}{joints}x z{size}{word}x"


def _features(shaped: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_features(shaped, BITS, words=1, chars=(3,))


class ReadingLevel:
    """Sentence model and calibration; bands are numbered as in BANDS."""

    def __init__(self, model: LinearModel, calibration: np.ndarray):
        self.model, self.calibration = model, calibration

    @classmethod
    def fit(cls, texts: list[str], bands: list[int], l2: float = 1e-3, epochs: int = 15) -> "ReadingLevel":
        owner, shaped = [], []
        for i, t in enumerate(texts):
            for s in sentences(t):
                owner.append(i)
                shaped.append(_shaped(s))
        owner, bands = np.array(owner), np.array(bands)
        model = LinearModel.fit(*_features(shaped), bands[owner], 1 << BITS, len(BANDS), l2=l2, epochs=epochs)
        # calibrated on sentences of texts that the model which judges them has not seen
        p, fold = np.zeros((len(shaped), len(BANDS))), owner % FOLDS
        for k in range(FOLDS):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(rest) and len(own):
                other = LinearModel.fit(*_features([shaped[i] for i in rest]), bands[owner[rest]], 1 << BITS, len(BANDS), l2=l2, epochs=epochs)
                p[own] = other.scores(*_features([shaped[i] for i in own]), len(own))
            elif len(own):
                p[own] = model.scores(*_features([shaped[i] for i in own]), len(own))
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        x = np.stack([np.bincount(owner, p[:, k], minlength=len(texts)) / n for k in range(len(BANDS))] + [np.ones(len(texts))], 1)
        w, y = np.zeros((x.shape[1], len(BANDS))), np.eye(len(BANDS))[bands]
        for _ in range(3000):
            z = x @ w
            q = np.exp(z - z.max(1, keepdims=True))
            w -= x.T @ (q / q.sum(1, keepdims=True) - y) / len(y) + 1e-4 * w
        return cls(model, w)

    def sentence_levels(self, texts: list[str]) -> np.ndarray:
        """Per text the number of sentences and the sums of the level probabilities."""
        out = np.zeros((len(texts), 1 + len(BANDS)))
        for a, b in blocks(texts):
            owner, shaped = [], []
            for i in range(a, b):
                own = sentences(texts[i])
                owner += [i] * len(own)
                shaped += map(_shaped, own)
            if shaped:
                p = self.model.scores(*_features(shaped), len(shaped))
                owner = np.array(owner)
                out[:, 0] += np.bincount(owner, minlength=len(texts))
                for k in range(len(BANDS)):
                    out[:, 1 + k] += np.bincount(owner, p[:, k], minlength=len(texts))
        return out

    def band(self, mean: np.ndarray) -> np.ndarray:
        return (np.c_[mean, np.ones(len(mean))] @ self.calibration).argmax(1)


def fit(graded: DataFrame) -> ReadingLevel:
    """graded: text, grade_band. Rows without text or with an unknown band are left out."""
    rows = (
        graded.select("text", F.lower(F.trim("grade_band")).alias("band")).filter(F.col("text").isNotNull() & F.col("band").isin(*BANDS))
        .distinct().orderBy(F.xxhash64("text"), "text", "band").limit(MOST_SAMPLES).collect()
    )
    return ReadingLevel.fit([r.text for r in rows], [BANDS.index(r.band) for r in rows])


def run_levels(d: pd.DataFrame, level: ReadingLevel) -> pd.DataFrame:
    """Per run of the batch: sums of sentence levels over its prose, and characters by kind."""
    n = int(d["g"].max()) + 1
    lines, owner = [], []
    for t, g in zip(d["text"].tolist(), d["g"].to_numpy()):
        own = quality.lines_of(t)
        lines += own
        owner += [g] * len(own)
    owner = np.array(owner, dtype=np.int64)
    kinds, hashes, size = [], [], []
    for a, b in blocks(lines):
        x = quality.Lines(lines[a:b])
        kinds.append(np.where(x.monotonous, quality.JUNK, x.kind))
        hashes.append(x.hash)
        size.append(x.chars)
    kind, size, h = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (kinds, size, hashes))
    times = np.ones(len(lines), dtype=np.int64)
    if len(lines):
        # short lines that recur in a run are furniture of its pages
        place = pd.Series(h ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        times = place.groupby(place).transform("size").to_numpy()
    prose = np.flatnonzero((kind == quality.PROSE) & ((times < 3) | (size > 60)))
    levels = level.sentence_levels([lines[i] for i in prose])
    out = {"n_sentences": np.bincount(owner[prose], levels[:, 0], minlength=n)}
    for k, b in enumerate(BANDS):
        out[b] = np.bincount(owner[prose], levels[:, 1 + k], minlength=n)
    for k, name in enumerate(quality.KINDS[:4]):
        out[f"{name}_chars"] = np.bincount(owner, np.where(kind == k, size, 0), minlength=n).astype(np.int64)
    return pd.DataFrame({"doc_id": d.drop_duplicates("g")["doc_id"].to_numpy(), **out})


def file_levels(paragraphs: DataFrame, level: ReadingLevel, key: str = "doc_id") -> DataFrame:
    """(doc_id, text_kind, n_sentences, basic, standard, advanced, grade_band) per file.

    The three shares are the file's mean sentence distribution.
    """
    chars = [f"{k}_chars" for k in ("prose", "list", "table", "junk")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in quality.whole_runs(batches):
            yield run_levels(d, level)

    kind = paragraphs.schema[key].dataType.simpleString()
    sums = quality.body(paragraphs, key).mapInPandas(
        score, f"doc_id {kind}, n_sentences double, {', '.join(f'{b} double' for b in BANDS)}, {', '.join(f'{c} long' for c in chars)}"
    )
    total = sums.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_sentences", *BANDS, *chars)]).filter("n_sentences > 0")
    mean = total.select(
        "doc_id", quality.kind_by_size().alias("text_kind"), F.col("n_sentences").cast("long").alias("n_sentences"),
        *[(F.col(b) / F.col("n_sentences")).alias(b) for b in BANDS],
    )
    w = level.calibration
    logits = [sum((F.col(b) * float(w[i, k]) for i, b in enumerate(BANDS)), F.lit(float(w[-1, k]))) for k in range(len(BANDS))]
    best = F.greatest(*logits)
    return mean.withColumn("grade_band", F.when(logits[0] == best, BANDS[0]).when(logits[1] == best, BANDS[1]).otherwise(BANDS[2]))
