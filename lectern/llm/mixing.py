"""Mixing sources to target weights.

Every source gets its share of the total size in tokens: as many certain whole copies of
all its documents as fit, and for the rest a Pareto order sample: documents are ranked by
random odds divided by inclusion odds and taken in that order until the size is reached.
The chance of inclusion grows with the square root of the size.

Plan. Tokens are counted in Arrow batches and written once. Totals per source and
histograms (sizes, then ranks: at most some thousand buckets a source) are all that is
gathered, so a source with a third of all rows is never sorted as a whole: the bucket of
ranks in which the size is reached is found from the histogram, divided again by rank, and only the documents in the part of it
in which the size is reached are put in order.

Defined results: sources are compared by their clean spelling; documents of other
sources, without text or with no token are not used; a target without documents keeps
share 0 and its share is divided among the others in proportion; the total is the largest
for which no document is used more than max_repeats times, unless `total` is given, in
which case sources may fall short; equal ranks go by doc_id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.residue import host
from lectern.session import cut

SIZE_STEPS, RANK_STEPS, FINE_STEPS = 32, 256, 4096
_ENCODINGS: dict[int, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(ranks: bytes):
    """Byte-level BPE from the lines of a rank file; each worker makes it once."""
    key = hash(ranks)
    if key not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def count_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) with the source in its clean spelling, written once."""
    with open(tokenizer or default_tokenizer(), "rb") as f:
        ranks = f.read()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks)
        for d in batches:
            yield pd.DataFrame({"doc_id": d["doc_id"], "source": d["source"], "tokens": [len(enc.encode_ordinary(t)) for t in d["text"]]})

    docs = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", host(F.col("source")).alias("source"), "text")
    return cut(docs.mapInPandas(run, f"doc_id {kind}, source string, tokens long").dropDuplicates(["doc_id"]).filter("tokens > 0"))


def _scale(size: np.ndarray, count: np.ndarray, total: np.ndarray, want: float) -> float:
    """The factor k for which the chances min(1, k * sqrt(size)) give `want` tokens."""
    if want <= 0 or not len(size):
        return 0.0
    low, high = 0.0, 1.0
    got = lambda k: float((np.minimum(1, k * np.sqrt(size)) * total).sum())
    if want >= total.sum():
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < want else (low, mid)
    return (low + high) / 2


def plan(tokens: DataFrame, targets: DataFrame, total: float | None = None) -> pd.DataFrame:
    """Per source: share asked for, share to be reached, size, whole copies, rest and scale of chances."""
    rows = targets.select(host(F.col("source")).alias("source"), "target_share", "max_repeats").distinct().orderBy("source").toPandas()
    size = F.round(F.log2("tokens") * SIZE_STEPS).cast("int")
    bins = (
        tokens.filter(F.col("source").isin(rows["source"].tolist())).groupBy("source", size.alias("b"))
        .agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).toPandas()
    )
    have = bins.groupby("source")["t"].sum()
    rows["available"] = rows["source"].map(have).fillna(0).astype(float)
    usable = (rows["available"] > 0) & (rows["target_share"] > 0) & (rows["max_repeats"] > 0)
    rows["share"] = np.where(usable, rows["target_share"], 0.0)
    rows["share"] /= max(rows["share"].sum(), 1e-12)
    most = rows["available"] * rows["max_repeats"]
    if total is None:
        total = float((most[usable] / rows["share"][usable]).min()) if usable.any() else 0.0
    rows["size"] = np.minimum(rows["share"] * total, most.where(usable, 0.0))
    rows["copies"] = np.where(usable, np.floor(rows["size"] / rows["available"].where(usable, 1.0) + 1e-9), 0).astype(int)
    rows["rest"] = np.maximum(rows["size"] - rows["copies"] * rows["available"], 0.0)
    rows.loc[rows["copies"] >= rows["max_repeats"], "rest"] = 0.0
    scale = []
    for r in rows.itertuples():
        own = bins[bins["source"] == r.source]
        t, n = own["t"].to_numpy(float), own["n"].to_numpy(float)
        scale.append(_scale(t / np.maximum(n, 1), n, t, r.rest))
    return rows.assign(scale=scale)


def choose(tokens: DataFrame, planned: pd.DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents that are used."""
    spark = tokens.sparkSession
    cols = ["source", "copies", "rest", "scale"]
    small = spark.createDataFrame([tuple(x) for x in planned[cols].itertuples(index=False)], "source string, copies int, rest double, scale double")
    # one row for each source of the fixed table of targets
    docs = tokens.join(F.broadcast(small), "source")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    p = F.least(F.lit(1.0), F.col("scale") * F.sqrt("tokens"))
    rank = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1e300)).otherwise(u / (1 - u) * (1 - p) / p)
    ranked = docs.withColumn("rank", rank).withColumn("bin", F.floor(F.log2(F.col("rank") + 1e-18) * RANK_STEPS).cast("int"))

    def reached(rows: DataFrame, step: str, have: str) -> DataFrame:
        """(source, edge, before): the bucket in which a source reaches its size, and the tokens before it."""
        bins = rows.groupBy("source", step).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first(have).alias("have"))
        upto = F.col("have") + F.sum("t").over(W.partitionBy("source").orderBy(step))
        return (
            bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest")).groupBy("source")
            .agg(F.min(F.struct(step, "upto", "t")).alias("e")).select("source", F.col(f"e.{step}").alias(f"{step}_edge"), (F.col("e.upto") - F.col("e.t")).alias(f"{step}_before"))
        )

    ranked = ranked.filter("rest > 0").withColumn("none", F.lit(0))
    first = reached(ranked, "bin", "none")
    placed = ranked.join(F.broadcast(first), "source", "left")
    inner = placed.filter(F.col("bin_edge").isNull() | (F.col("bin") < F.col("bin_edge"))).select("doc_id")
    # the bucket is divided once more by rank, so that what is put in order stays small
    within = placed.filter("bin = bin_edge").withColumn("fine", F.floor((F.log2(F.col("rank") + 1e-18) * RANK_STEPS - F.col("bin")) * FINE_STEPS).cast("int"))
    second = reached(within, "fine", "bin_before")
    fine = within.join(F.broadcast(second), "source", "left")
    middle = fine.filter(F.col("fine_edge").isNull() | (F.col("fine") < F.col("fine_edge"))).select("doc_id")
    order = W.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = (
        fine.filter("fine = fine_edge").withColumn("upto", F.col("fine_before") + F.sum("tokens").over(order))
        .filter(F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id")
    )
    inner = inner.unionByName(middle)
    extra = inner.unionByName(last).withColumn("extra", F.lit(1))
    return (
        docs.join(extra, "doc_id", "left").withColumn("repeats", (F.col("copies") + F.coalesce("extra", F.lit(0))).cast("int"))
        .filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    )


def shares(chosen: DataFrame, planned: pd.DataFrame) -> DataFrame:
    """Per source of the targets: what was asked for and what was reached."""
    cols = ["source", "target_share", "max_repeats", "share", "available", "size"]
    asked = chosen.sparkSession.createDataFrame(
        [tuple(x) for x in planned[cols].itertuples(index=False)],
        "source string, target_share double, max_repeats int, planned_share double, available_tokens double, planned_tokens double",
    )
    got = chosen.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("repeats").alias("n_copies"), F.max("repeats").alias("most_repeats"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"),
    )
    out = asked.join(got, "source", "left").fillna(0, ["n_documents", "n_copies", "most_repeats", "tokens"])
    # one row for each source of the targets
    total = F.sum("tokens").over(W.partitionBy())
    return out.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
