"""Latent Dirichlet topics fitted over a cluster, with every paragraph as one document.

Plan. Terms are 64-bit hashes from the vectorised tokeniser; document frequencies are
summed per batch before they are shuffled. The vocabulary is the `vocabulary` most
frequent terms below `most_share` of the paragraphs, so what is sent to the workers is
bounded by parameters. Encoded paragraphs are written once to the shared folder, their
words as bytes. Each round of variational EM reads all of them; a task returns its own
sums by topic and term, which are added up by (topic, term): topics x vocabulary numbers
at most. Paragraphs of nearly the same length are laid out as one block of words x
topics, in pieces that stay in the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.vector_text import _LETTER, _OTHER, _SPACE, Codes, blocks
from lectern.session import cut

VOCABULARY = 8_192
MOST_SHARE = 0.12
LEAST_LENGTH = 3
#: So many more terms are known, as too frequent or too rare for a topic.
KNOWN_MORE = 4_000
#: Counts of so many terms of blocks are added up before they leave a task.
HELD = 300_000
#: The E step handles so many words at a time.
PIECE = 32_768
#: The fit has settled when topics change by less than SETTLED of their mass, and less than in the round before.
SETTLED, MOST_ROUNDS = 1 / 3, 12


def _terms(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Codes, np.ndarray, np.ndarray]]:
    """Per block: offset of its first text, owners and hashes of the words, and where they stand."""
    for a, b in blocks(texts):
        c = Codes([t.lower() for t in texts[a:b]])
        start, end = c.tokens()
        keep = (c.kind[start] == _LETTER) & (end - start >= LEAST_LENGTH)
        start, end = start[keep], end[keep]
        yield a, c.text_of(start), c.hashes(start, end).astype(np.int64), c, start, end


def _numbered(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word's number among the distinct hashes, these hashes, and the distinct (owner, number) pairs, by owner."""
    code, term = pd.factorize(h)
    key = np.sort(owner * max(len(term), 1) + code)
    return code, term, *np.divmod(key[np.diff(key, prepend=-1) > 0], max(len(term), 1))


def vocabulary(texts: DataFrame, size: int = VOCABULARY, most_share: float = MOST_SHARE, least: int = 3) -> pd.DataFrame:
    """term (hash), word, df, used of the most frequent terms, the used ones first; ties by hash. texts: column text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        word: dict[int, str] = {}

        def added_up() -> pd.DataFrame:
            code, term = pd.factorize(np.concatenate([t for t, _ in held]))
            df = np.bincount(code, np.concatenate([n for _, n in held]), minlength=len(term)).astype(np.int64)
            return pd.DataFrame({"term": term, "word": [word[t] for t in term.tolist()], "df": df})

        for d in batches:
            for _, owner, h, c, start, end in _terms(d["text"].tolist()):
                code, term, _, one = _numbered(owner, h)
                first = np.zeros(len(term), dtype=np.int64)
                first[code[::-1]] = np.arange(len(code))[::-1]
                for t, i in zip(term.tolist(), first.tolist()):
                    if t not in word:
                        word[t] = c.codes[start[i] : end[i]].tobytes().decode("utf-32-le", "replace")
                held.append((term, np.bincount(one, minlength=len(term))))
                if sum(len(t) for t, _ in held) > HELD:
                    yield added_up()
                    held, word = [], {}
            yield pd.DataFrame({"term": [0], "word": [""], "df": [len(d)]})
        if held:
            yield added_up()

    counted = texts.select("text").mapInPandas(count, "term long, word string, df long").groupBy("term").agg(F.min("word").alias("word"), F.sum("df").alias("df"))
    top = counted.filter(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(size + KNOWN_MORE + 1).toPandas()
    total = int(top.loc[top["word"] == "", "df"].sum()) or 1
    top = top[top["word"] != ""].reset_index(drop=True)
    rare = top["df"] <= most_share * total
    top["used"] = rare & (rare.cumsum() <= size)
    return top.sort_values("used", ascending=False, kind="stable").reset_index(drop=True)


def id_type(used: int) -> type:
    """The numbers of so many terms fit into it."""
    return np.uint16 if used <= 1 << 16 else np.int32


def encode(texts: DataFrame, vocab: pd.DataFrame, *keys: str) -> DataFrame:
    """keys, h (hash of the text), n_chars, junk and ids of every text, cut from its lineage.

    ids: numbers of the used terms, as often as they occur, as bytes of id_type(). junk:
    most letters are in words that are not known, or one or two words make up all, or it
    is mostly signs.
    """
    order = np.argsort(vocab["term"].to_numpy())
    known, used = vocab["term"].to_numpy()[order], int(vocab["used"].sum())
    kind = np.dtype(id_type(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, sizes, junk, hashes = [], [], [], []
            for _, owner, h, c, start, end in _terms(texts):
                n = len(c.starts)
                code, term, pair, _ = _numbered(owner, h)
                of = lambda kind, c=c: np.add.reduceat((c.kind == kind).astype(np.int64), c.starts)
                letters, signs, dense = of(_LETTER), of(_OTHER), c.ends - c.starts - of(_SPACE)
                number = np.full(len(term), -1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                    number = np.where(known[at] == term, order[at], -1)
                number = number[code]
                hit = number >= 0
                long = np.bincount(owner, end - start, minlength=n)
                clear = np.bincount(owner[hit], (end - start)[hit], minlength=n)
                words = np.bincount(owner, minlength=n)
                distinct = np.bincount(pair, minlength=n)
                short = np.maximum(letters - long, 0)
                junk.append(
                    ((letters >= 20) & ((clear * 20 < long * 7) | (short * 2 > letters) & (clear * 2 < letters)))
                    | ((words >= 6) & (distinct <= 2)) | ((dense >= 12) & (letters * 4 < dense) & (signs * 4 > dense))
                )
                hashes.append(c.hashes(c.starts, c.ends - 1).astype(np.int64))
                hit &= number < used
                ids.append(number[hit].astype(kind))
                sizes.append(np.bincount(owner[hit], minlength=n))
            ends = np.r_[0, np.cumsum(np.concatenate(sizes))] * kind.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(ids))])
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(np.concatenate(hashes)), pa.array(lengths), pa.array(np.concatenate(junk)), packed], names=[*keys, "h", "n_chars", "junk", "ids"],
            )

    types = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return cut(texts.select(*keys, "text").mapInArrow(run, f"{types}, h long, n_chars long, junk boolean, ids binary"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence and the asymptotic series."""
    out = np.zeros_like(x)
    for _ in range(3):
        out -= 1 / x
        x = x + 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def laid_out(batch: pa.RecordBatch, used: int, column: str = "ids") -> tuple[np.ndarray, np.ndarray]:
    """(numbers of terms laid end to end, how many each row has) of what encode() made with so many used terms."""
    kind = np.dtype(id_type(used))
    col = batch.column(column).cast(pa.binary())
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset) if len(col) else np.zeros(1, np.int32)
    n = int(offsets[-1] - offsets[0]) // kind.itemsize
    flat = np.frombuffer(col.buffers()[2], kind, n, int(offsets[0])) if n else np.zeros(0, kind)
    return flat, np.diff(offsets).astype(np.int64) // kind.itemsize


def _widths(lengths: np.ndarray) -> np.ndarray:
    """Lengths rounded up to one of a few: to 16 as they are, then to one of eight between two powers of two."""
    step = np.maximum(1 << np.maximum(np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64) - 4, 0), 1)
    return -(-lengths // step) * step


def expectation(flat: np.ndarray, lengths: np.ndarray, beta: np.ndarray, alpha: float, rounds: int, total: np.ndarray | None = None) -> np.ndarray:
    """Variational E step. beta: vocabulary x topics, exp E[log phi], in single precision.

    Returns gamma (documents x topics). Adds the words' topic responsibilities to total
    (topics x vocabulary), if there.
    """
    v, k = beta.shape
    first = np.cumsum(lengths) - lengths
    # rows that fill up a block are of a term beyond the vocabulary, which has no topic
    filled, flat = np.concatenate([beta, np.zeros((1, k), dtype=np.float32)]), np.r_[flat, v]
    gamma = np.full((len(lengths), k), alpha, dtype=np.float32)
    sums = np.zeros((k, v + 1))
    width = _widths(lengths)
    order = np.argsort(width, kind="stable")
    order = order[np.searchsorted(width[order], 1) :]
    cuts = np.flatnonzero(np.diff(width[order], prepend=-1, append=-1))
    for a, z in zip(cuts[:-1], cuts[1:]):
        wide = np.arange(width[order[a]])
        most = max(1, PIECE // len(wide))
        for p in range(a, z, most):
            own = order[p : min(z, p + most)]
            n = lengths[own, None]
            term = flat[np.where(wide < n, first[own, None] + wide, len(flat) - 1)]
            b = filled[term]
            g = np.repeat((alpha + n / k).astype(np.float32), k, axis=1)
            for i in range(rounds):
                # a word's share of a topic is b * theta over its sum; theta is the same for all words of a document, and a factor of it falls out
                theta = np.exp(_digamma(g))
                part = 1 / np.maximum(np.matmul(b, theta[:, :, None])[:, :, 0], np.float32(1e-30))
                g = alpha + theta * np.matmul(part[:, None, :], b)[:, 0]
                if total is not None and i == rounds - 1:
                    exact, of_topic = part.astype(np.float64), theta.T.astype(np.float64)
                    for j in range(k):
                        sums[j] += np.bincount(term.ravel(), (exact * of_topic[j, :, None]).ravel(), minlength=v + 1)
            gamma[own] = g
    if total is not None:
        total += sums[:, :v] * beta.T
    return gamma


def expected_beta(lam: np.ndarray) -> np.ndarray:
    """lam: topics x vocabulary. exp E[log phi] as vocabulary x topics."""
    return np.exp(_digamma(lam) - _digamma(lam.sum(1))[:, None]).T.astype(np.float32)


def fit(encoded: DataFrame, start: np.ndarray, rounds: int = MOST_ROUNDS, alpha: float = 0.1, eta: float = 0.05, inner: int = 3) -> np.ndarray:
    """Topic weights (topics x vocabulary) by passes of EM over all rows until they settle, or after `rounds`."""
    lam = start
    k, v = lam.shape
    if not v:
        return lam
    before = 0.0
    for _ in range(rounds):
        beta = expected_beta(lam)

        def step(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, v))
            for batch in batches:
                expectation(*laid_out(batch, v), beta, alpha, inner, total)
            topic, term = np.nonzero(total > 1e-6)
            yield pa.RecordBatch.from_pydict({"topic": pa.array(topic.astype(np.int32)), "term": pa.array(term.astype(np.int32)), "value": pa.array(total[topic, term])})

        got = encoded.select("ids").mapInArrow(step, "topic int, term int, value double").groupBy("topic", "term").agg(F.sum("value").alias("value")).toPandas()
        new = np.full((k, v), eta)
        new[got["topic"], got["term"]] += got["value"]
        change = np.abs(new / new.sum(1, keepdims=True) - lam / lam.sum(1, keepdims=True)).sum(1).mean()
        lam = new
        if change < SETTLED and change < before:
            break
        before = change
    return lam
