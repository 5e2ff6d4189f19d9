"""Fuzzy resolution of names to entities by character n-grams.

Batch semantics: every name is compared with all extracted entities, not with those seen
so far, so the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators import blocks
from lectern.session import cut

#: So many names are held against all entities at once.
NAMES = 20_000


def char_ngrams(text: Column) -> Column:
    """2- to 4-grams of words in lower case with a blank at both ends; a short word gives itself once."""
    def windows(p: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))

    def of(w: Column) -> Column:
        p, none = F.concat(F.lit(" "), w, F.lit(" ")), F.array().cast("array<string>")
        size = F.length(p)
        return F.concat(
            windows(p, 2), F.when(size <= 3, F.array(p)).otherwise(windows(p, 3)),
            F.when(size <= 3, none).when(size == 4, F.array(p)).otherwise(windows(p, 4)),
        )

    return F.flatten(F.transform(words(F.lower(text)), of))


def padded_words(text: Column) -> Column:
    """Words in lower case with one blank around each; the windows of it that hold no blank inside are its n-grams."""
    w = words(F.lower(text))
    return F.when(F.size(w) > 0, F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).otherwise("")


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of padded words, in order of rows. An n-gram is a number: its signs of 16 bits, or a hash where they have more."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    blank, rows, codes = c == 32, [], []
    for n in (2, 3, 4):
        m = len(c) - n + 1
        if m <= 0:
            continue
        ok = (row[:m] == row[n - 1 :]) & ~(blank[:m] & blank[1 : m + 1])
        code, far, wide = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=bool)
        for i in range(n):
            x = c[i : i + m]
            if 0 < i < n - 1:
                ok &= ~blank[i : i + m]
            code, far, wide = (code << 16) | (x & 0xFFFF), far * 0x5851F42D4C957F2D + x, wide | (x > 0xFFFF)
        rows.append(row[:m][ok])
        codes.append(np.where(wide, far, code)[ok])
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    terms, at = np.unique(np.concatenate(codes), return_inverse=True)
    pair, count = np.unique(np.concatenate(rows) * len(terms) + at, return_counts=True)
    return pair // max(len(terms), 1), terms[pair % max(len(terms), 1)], count


def resolve(names: DataFrame, entities: DataFrame, least: float = 0.4) -> DataFrame:
    """(name, key, cosine): the entity nearest to each name, if near enough; of equal ones the smallest key.

    entities: key, name, description. N-grams are counted in the tasks, once for their
    frequencies and once to compare, and never shuffled. A name's n-grams are ordered from
    rare to frequent and only the first of them look for candidates; parts of the entities
    are held in arrays and all names come to them, so only pairs that are near enough leave a task.
    """
    spark = entities.sparkSession
    e = cut(blocks.by_key(entities.select("key", padded_words(F.concat_ws(" ", "name", "description")).alias("text")), "key"))
    n = e.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            x, m = np.unique(gram_counts(b["text"].to_pylist())[1], return_counts=True)
            t, at = np.unique(np.concatenate([t, x]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c, m]), len(t)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], names=["t", "n"])

    got = e.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["t"].to_numpy())
    terms, df = got["t"].to_numpy()[order], got["n"].to_numpy()[order]
    known = spark.sparkContext.broadcast((terms, np.log((1 + n) / (1 + df)) + 1))
    kind = entities.schema["key"].dataType.simpleString()
    held = e.coalesce(spark.sparkContext.defaultParallelism) if n < blocks.PART else e
    asked = names.select("name").distinct().filter("name IS NOT NULL").select("name", padded_words(F.col("name")).alias("text")).toArrow()
    found = spark.createDataFrame([], f"name string, key {kind}, cosine double")
    for lo in range(0, len(asked) if len(terms) else 0, NAMES):
        some = asked.slice(lo, NAMES)
        row, t, tf = gram_counts(some["text"].to_pylist())
        i = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
        ok = terms[i] == t
        row, i, w = row[ok], i[ok], (tf * (np.log((1 + n) / (1 + df[i])) + 1))[ok]
        w = w / np.sqrt(np.bincount(row, w * w, len(some)))[row]
        sent = spark.sparkContext.broadcast((some["name"].to_pylist(), np.searchsorted(row, np.arange(len(some) + 1)), terms[i], w, df[i], np.unique(terms[i])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (terms, idf), (names, at, t, w, df, wanted) = known.value, sent.value

            def weighed() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    row, x, tf = gram_counts(b["text"].to_pylist())
                    v = tf * idf[np.searchsorted(terms, x)]
                    v = v / np.sqrt(np.bincount(row, v * v, len(b)))[row]
                    keep = np.isin(x, wanted)
                    row, x, v = row[keep], x[keep], v[keep]
                    p = np.searchsorted(row, np.arange(len(b) + 1))
                    z = [blocks.pack(x[i:j], v[i:j]) for i, j in zip(p, p[1:])]
                    yield pa.RecordBatch.from_arrays([b["key"], pa.array(np.zeros(len(b), dtype=np.int64)), pa.array(np.diff(p).astype(np.int32)), pa.array(z, pa.binary())], names=["key", "size", "n", "z"])

            part = blocks.Part(weighed(), "key")
            if not part.n:
                return
            for q, d, x in part.near(at, t, w, df, least):
                best = np.lexsort((d, -np.round(x, 9), q))
                best = best[np.r_[True, np.diff(q[best]) > 0]]
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(q[best])), part.keys.take(pa.array(d[best])), pa.array(x[best])], names=["name", "key", "cosine"])

        found = found.unionByName(held.mapInArrow(run, f"name string, key {kind}, cosine double"))
    best = F.min_by("key", F.struct(-F.round("cosine", 9), F.col("key")))
    return found.groupBy("name").agg(best.alias("key"), F.max("cosine").alias("cosine"))
