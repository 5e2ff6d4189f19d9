"""BM25 with a constant per query, rankings, and retrieval measures.

The reference adds its delta for every query term to every document, so it is a constant
of the query: rankings are those of BM25, and documents without any term share one score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import TOKEN1, tokens
from lectern.operators import blocks
from lectern.operators.features import entropy_of, postings
from lectern.session import cut

K1, B, DELTA = 1.5, 0.75, 1.0


def bm25_index(texts: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(postings with the term's share of the score, idf per term). All words count, stop words too."""
    post = postings(texts, key, TOKEN1, ())
    docs = texts.select(key).distinct().join(post.groupBy(key).agg(F.sum("tf").alias("dl")), key, "left").fillna(0, ["dl"])
    n = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    # n is one row
    full = post.join(docs, key).crossJoin(F.broadcast(n)).join(idf, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return full.select(key, "term", part.alias("part")), idf


def bm25(queries: DataFrame, index: DataFrame, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score) of documents with any term. queries: query_id, term, n (times in the query)."""
    q = queries.join(idf, "term")
    constant = q.groupBy("query_id").agg(F.sum(F.col("n") * F.col("idf") * DELTA).alias("constant"))
    return (
        queries.join(index, "term").groupBy("query_id", key).agg(F.sum(F.col("n") * F.col("part")).alias("s"))
        .join(constant, "query_id").select("query_id", key, (F.col("s") + F.col("constant")).alias("score"))
    )


def bm25_top(queries: DataFrame, index: DataFrame, idf: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rank, score): the k best documents of each query, exactly, without scoring all that share a frequent term.

    The documents of a query's rarest terms are scored in full; the k-th of them bounds what
    is needed. Terms whose largest parts together stay below that bound can't bring a
    document in by themselves, so only the others look for candidates, and of these only
    those that can still reach the bound are scored in full.
    """
    peak = index.groupBy("term").agg(F.max("part").alias("peak"), F.count("*").alias("df"))
    q = queries.join(peak, "term").join(idf, "term").select("query_id", "term", "n", (F.col("n") * F.col("peak")).alias("peak"), "df", "idf")
    q = cut(q)
    index = cut(index)

    def full(pairs: DataFrame) -> DataFrame:
        parts = pairs.join(q.select("query_id", "term", "n"), "query_id").join(index, ["term", key])
        return parts.groupBy("query_id", key).agg(F.sum(F.col("n") * F.col("part")).alias("s"))

    before = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    rare = q.withColumn("have", F.coalesce(F.sum("df").over(before), F.lit(0))).filter(F.col("have") < k).select("query_id", "term")
    first = full(rare.join(index.select("term", key), "term").select("query_id", key).distinct())
    best = first.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s")))).filter(F.col("rn") <= k)
    bound = best.groupBy("query_id").agg(F.count("*").alias("m"), F.min("s").alias("least")).select("query_id", F.when(F.col("m") == k, F.col("least") - 1e-8).otherwise(0.0).alias("bound"))
    upto = F.sum("peak").over(W.partitionBy("query_id").orderBy("peak", "term").rowsBetween(W.unboundedPreceding, 0))
    told = q.join(bound, "query_id").withColumn("upto", upto).withColumn("alone", F.col("upto") >= F.col("bound"))
    rest = told.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("alone"), F.col("peak"))), F.lit(0.0)).alias("rest"), F.first("bound").alias("bound"))
    met = told.filter("alone").select("query_id", "term", "n").join(index, "term").groupBy("query_id", key).agg(F.sum(F.col("n") * F.col("part")).alias("s"))
    able = met.join(rest, "query_id").filter(F.col("s") + F.col("rest") >= F.col("bound")).select("query_id", key)
    constant = q.groupBy("query_id").agg(F.sum(F.col("n") * F.col("idf") * DELTA).alias("constant"))
    return top_k(full(able).join(constant, "query_id").select("query_id", key, (F.col("s") + F.col("constant")).alias("score")), k, key)


def search(queries: DataFrame, texts: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rank, score): bm25_index and bm25_top of the distinct texts without their joins. queries: query_id, term, n.

    Documents are counted once for the terms of all queries and held in parts; a part gives
    the k best of its documents for each query, so no pairs are shuffled but these.
    """
    spark = texts.sparkSession
    asked = cut(queries.select("query_id", F.xxhash64("term").alias("t"), F.col("n").cast("double").alias("n")))
    wanted = np.sort(asked.select("t").distinct().toArrow()["t"].to_numpy())
    hashed = blocks.by_key(texts.select(key, "text"), key).distinct().select(key, F.transform(tokens(F.col("text"), TOKEN1), lambda t: F.xxhash64(t)).alias("t"))
    packed = blocks.counted(hashed, key, wanted)
    n, avgdl = packed.agg(F.count("*"), F.avg("size")).first()
    terms, df = blocks.frequencies(packed)
    idf = np.log(((n or 0) - df + 0.5) / (df + 0.5) + 1)
    held, kind, qkind = blocks.parts(packed), texts.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast((terms, idf, avgdl))
    found = spark.createDataFrame([], f"query_id {qkind}, {key} {kind}, score double")
    for ids, at, t, more in blocks.blocks(asked):
        i = np.minimum(np.searchsorted(terms, t), max(len(terms) - 1, 0))
        ok = terms[i] == t if len(terms) else np.zeros(len(t), dtype=bool)
        own = np.where(ok, more["n"] * (idf[i] if len(terms) else 0.0) * DELTA, 0.0)
        sent = spark.sparkContext.broadcast((ids, at, t, more["n"], np.add.reduceat(own, at[:-1])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, idf, avgdl = known.value
            ids, at, t, times, constant = sent.value

            def share(t: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
                return idf[np.searchsorted(terms, t)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

            part = blocks.Part(batches, key, share)
            if not part.n:
                return
            begin, end = part.spans(t)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q in range(len(ids)):
                spans = [(begin[j], end[j], times[j]) for j in range(at[q], at[q + 1]) if end[j] > begin[j]]
                if not spans:
                    continue
                rows = np.concatenate([part.rows[a:b] for a, b, _ in spans])
                s = np.bincount(rows, np.concatenate([part.values[a:b] * x for a, b, x in spans]), part.n)
                # the k-th of the shortest list that has so many bounds what is needed
                enough = [(b - a, a) for a, b, _ in spans if b - a >= k]
                if enough:
                    size, a = min(enough)
                    least = np.partition(s[part.rows[a : a + size]], size - k)[size - k]
                    cand = np.flatnonzero(s >= least - 1e-8)
                else:
                    cand = np.unique(rows)
                x = s[cand] + constant[q]
                best = np.lexsort((cand, -np.round(x, 9)))[:k]
                out.append((np.full(len(best), q), cand[best], x[best]))
                if len(out) >= 10_000:
                    yield given(ids, part, out)
                    out = []
            if out:
                yield given(ids, part, out)

        def given(ids: pa.Array, part: blocks.Part, out: list) -> pa.RecordBatch:
            q, d, x = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.keys.take(pa.array(d)), pa.array(x)], names=["query_id", key, "score"])

        found = found.unionByName(held.mapInArrow(run, f"query_id {qkind}, {key} {kind}, score double"))
    return top_k(found, k, key)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n) of queries with a text."""
    return postings(queries, "query_id", TOKEN1, ()).withColumnRenamed("tf", "n")


def top_k(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Ranks from 1; equal scores (to nine places) by key."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def combinations(m: int, most: int = 20) -> list[tuple[int, int, int]]:
    """Of m terms the choices of three, in order; of more than `most` evenly many of them."""
    all_ = [(a, b, c) for a in range(1, m + 1) for b in range(a + 1, m + 1) for c in range(b + 1, m + 1)]
    return all_ if len(all_) <= most else all_[:: len(all_) // most][:most]


def own_terms(weights: DataFrame, n_terms: int = 8) -> DataFrame:
    """(q, term, r, entropy): the heaviest terms of each document, and the entropy of all its weights. Weights are read once."""
    whole = W.partitionBy("doc_id")
    w = whole.orderBy(F.desc(F.round("weight", 9)), "term")
    every = weights.filter("weight > 0").withColumns({"entropy": entropy_of("weight", whole), "r": F.row_number().over(w)})
    return cut(every.filter(F.col("r") <= n_terms).select(F.col("doc_id").alias("q"), "term", F.col("r").cast("int").alias("r"), "entropy"))


def self_retrieval(weights: DataFrame, index: DataFrame, n_terms: int = 8, k: int = 5, most: int = 20) -> DataFrame:
    """(doc_id, self_retrieval): share of queries of three of its top terms that find the document among the first k."""
    w = W.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    top = cut(weights.filter("weight > 0").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_terms).select(F.col("doc_id").alias("q"), "term", F.col("r").cast("int").alias("r")))
    index = index.join(top.select("term").distinct(), "term", "left_semi").select("doc_id", "term", "part")
    return _self_retrieval(top, blocks.lists(index, "doc_id", "part"), None, n_terms, k, most)


def self_retrieval_of(top: DataFrame, texts: DataFrame, n_terms: int = 8, k: int = 5, most: int = 20) -> DataFrame:
    """self_retrieval for own_terms and the index of texts, whose postings are counted in arrays and not shuffled.

    texts: doc_id, text; the rows of a document lie in one partition.
    """
    wanted = np.sort(top.select(F.xxhash64("term").alias("t")).distinct().toArrow()["t"].to_numpy())
    packed = blocks.counted(texts.select("doc_id", F.transform(tokens(F.col("text"), TOKEN1), lambda t: F.xxhash64(t)).alias("t")), "doc_id", wanted)
    n, avgdl = packed.agg(F.count("*"), F.avg("size")).first()
    terms, df = blocks.frequencies(packed)
    return _self_retrieval(top, packed, (terms, np.log(((n or 0) - df + 0.5) / (df + 0.5) + 1), avgdl), n_terms, k, most)


def _self_retrieval(top: DataFrame, packed: DataFrame, counts: tuple[np.ndarray, np.ndarray, float] | None, n_terms: int, k: int, most: int) -> DataFrame:
    """Rank by counting: a query is a hit if fewer than k documents beat it. Parts of the
    documents are held in arrays; there all queries of a document are scored at once as a
    product of matrices, and only counts up to k are shuffled. packed has the parts of the
    score, or with counts (terms, their idf, mean length) how often the terms stand there.
    """
    spark = top.sparkSession
    have = top.groupBy("q").agg(F.count("*").cast("int").alias("m"))
    known = spark.sparkContext.broadcast(counts)

    def share(t: np.ndarray, v: np.ndarray, dl: np.ndarray) -> np.ndarray:
        if known.value is None:
            return v
        terms, idf, avgdl = known.value
        return idf[np.searchsorted(terms, t)] * v * (K1 + 1) / (v + K1 * (1 - B + B * dl / avgdl))

    own = top.join(have.filter("m >= 3"), "q").select(F.col("q").alias("query_id"), F.xxhash64("term").alias("t"), "r", "m")
    own = cut(own)
    held, kind = blocks.parts(packed), top.schema["q"].dataType.simpleString()
    chosen = {m: combinations(m, most) for m in range(3, n_terms + 1)}
    width = max((len(c) for c in chosen.values()), default=0)
    uses = {m: np.zeros((n_terms, len(c))) for m, c in chosen.items()}
    for m, c in chosen.items():
        for i, rs in enumerate(c):
            uses[m][[r - 1 for r in rs], i] = 1
    out = f"q {kind}, " + ", ".join(f"c{i} int" for i in range(width))

    def ordered(keys: pa.Array) -> np.ndarray:
        """Keys as numpy can compare them, in Spark's order."""
        return np.array([k.encode() for k in keys.to_pylist()], dtype=object) if pa.types.is_string(keys.type) or pa.types.is_large_string(keys.type) else keys.to_numpy(zero_copy_only=False)

    def by_own(packed: DataFrame, ids: pa.Array, at: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The parts of each document for its own terms."""
        sent = spark.sparkContext.broadcast((ids, at, t))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, at, t = sent.value
            place = {k: i for i, k in enumerate(ids.to_pylist())}
            for b in batches:
                rows, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
                for k, size, n, z in zip(b["doc_id"].to_pylist(), b["size"].to_pylist(), b["n"].to_pylist(), b["z"].to_pylist()):
                    if (i := place.get(k)) is not None:
                        x, v = blocks.unpack([n], [z])
                        v = share(x, v, size)
                        span = np.arange(at[i], at[i + 1])
                        _, mine, theirs = np.intersect1d(t[span], x, return_indices=True)
                        rows.append(span[mine])
                        values.append(v[theirs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(values))], names=["i", "v"])

        got = packed.mapInArrow(run, "i long, v double").toArrow()
        sent.destroy()
        mine = np.zeros((len(ids), n_terms))
        i = got["i"].to_numpy()
        mine[np.searchsorted(at, i, side="right") - 1, r[i] - 1] = got["v"].to_numpy()
        return mine

    beats = spark.createDataFrame([], out)
    for ids, at, t, more in blocks.blocks(own, "r m"):
        mine = by_own(packed, ids, at, t, more["r"])
        sent = spark.sparkContext.broadcast((ids, at, t, more["r"], more["m"], mine))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, at, t, r, m, mine = sent.value
            part = blocks.Part(batches, "doc_id", share)
            if not part.n:
                return
            begin, end = part.spans(t)
            keys, asking = ordered(part.keys), ordered(ids)
            before = np.searchsorted(keys, asking)
            known, who, counts = np.minimum(before, part.n - 1), [], []
            itself = np.where(keys[known] == asking, before, -1)
            for q in range(len(ids)):
                spans = [(begin[j], end[j], r[j] - 1) for j in range(at[q], at[q + 1]) if end[j] > begin[j]]
                if not spans:
                    continue
                rows, inv = np.unique(np.concatenate([part.rows[a:b] for a, b, _ in spans]), return_inverse=True)
                score = np.zeros((len(rows), n_terms))
                score[inv, np.repeat([c for *_, c in spans], [b - a for a, b, _ in spans])] = np.concatenate([part.values[a:b] for a, b, _ in spans])
                use = uses[int(m[at[q]])]
                theirs, its = np.round(score @ use, 9), np.round(mine[q] @ use, 9)
                n = (((theirs > its) | (theirs == its) & (rows < before[q])[:, None]) & (rows != itself[q])[:, None]).sum(axis=0)
                if n.any():
                    who.append(q)
                    counts.append(np.pad(np.minimum(n, k), (0, width - len(n))))
            if who:
                c = np.array(counts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), *[pa.array(c[:, i]) for i in range(width)]], names=["q", *[f"c{i}" for i in range(width)]])

        beats = beats.unionByName(cut(held.mapInArrow(run, out)))
        sent.destroy()
    total = beats.groupBy("q").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])
    missed = total.select("q", sum(((F.col(f"c{i}") >= k).cast("int") for i in range(width)), F.lit(0)).alias("missed"))
    sizes = F.create_map(*[x for m, c in chosen.items() for x in (F.lit(m), F.lit(len(c)))])
    return (
        have.withColumn("asked", sizes[F.col("m")]).join(missed, "q", "left")
        .select(F.col("q").alias("doc_id"), F.when(F.col("asked") > 0, 1 - F.coalesce("missed", F.lit(0)) / F.col("asked")).otherwise(0.0).alias("self_retrieval"))
    )


#: Words that a query leaves out.
QUERY_STOP = "the and for with from that this into your about over under when where what which".split()
QUERY_TERM = "[a-zA-Z][a-zA-Z0-9-]{2,}"


def query_words(text: Column) -> Column:
    """Words of a text that may stand in a query, in lower case and in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({QUERY_TERM})"), F.lit(1)), lambda t: F.lower(t)), lambda t: ~t.isin(QUERY_STOP))


def benchmark_queries(docs: DataFrame, paras: DataFrame, weights: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, text): for each file the first words of its headings, then its heaviest terms, `most` in all.

    Files with neither are asked for by the words of their stem, or by their file name.
    Equal weights go to the smaller term.
    """
    heads = paras.filter("level > 0").select("doc_id", "index", F.posexplode(query_words(F.col("text"))).alias("pos", "term"))
    heads = heads.select("doc_id", "term", F.struct(F.lit(0).alias("by"), F.col("index").cast("double").alias("a"), F.col("pos").alias("b")).alias("place"))
    heavy = weights.filter(~F.col("term").isin(QUERY_STOP)).select("doc_id", "term", F.struct(F.lit(1).alias("by"), (-F.round("weight", 9)).alias("a"), F.lit(0).alias("b")).alias("place"))
    # heaviest terms that can count at all, kept apart before the shuffle
    heavy = heavy.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("place", "term"))).filter(F.col("rn") <= 2 * most).drop("rn")
    each = heads.unionByName(heavy).groupBy("doc_id", "term").agg(F.min("place").alias("place"))
    rank = W.partitionBy("doc_id").orderBy("place", "term")
    few = each.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= most)
    made = few.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rn", "term"))).alias("t")).select("doc_id", F.array_join(F.transform("t", lambda x: x.term), " ").alias("made"))
    stem = F.array_join(F.slice(query_words(F.col("stem")), 1, most), " ")
    return docs.join(made, "doc_id", "left").select(F.col("doc_id").alias("query_id"), F.coalesce("made", F.when(stem != "", stem), F.col("filename")).alias("text"))


def padded(ranked: DataFrame, items: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """Rankings filled up to k with the first items that aren't in them. items: key; queries: query_id."""
    short = queries.select("query_id").distinct().join(ranked.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").fillna(0, ["n"]).filter(F.col("n") < k)
    # k items a query at most are needed, of the first 2 k of all
    first = items.select(key).distinct().orderBy(key).limit(2 * k)
    free = short.crossJoin(F.broadcast(first)).join(ranked.select("query_id", key), ["query_id", key], "left_anti")
    more = free.withColumn("rank", F.col("n") + F.row_number().over(W.partitionBy("query_id").orderBy(key))).filter(F.col("rank") <= k)
    return ranked.select("query_id", key, "rank").unionByName(more.select("query_id", key, F.col("rank").cast("int").alias("rank")))


def measures(rankings: DataFrame, gold: DataFrame, key: str, k: int = 5, depth: int = 10) -> DataFrame:
    """One row: hit rate at k (called recall), MRR to `depth`, nDCG at k. rankings: query_id, key, rank; gold: query_id, key."""
    hit = rankings.filter(F.col("rank") <= depth).join(gold, ["query_id", key]).select("query_id", "rank")
    per = gold.groupBy("query_id").agg(F.count("*").alias("g")).join(
        hit.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")), "query_id", "left"
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("g"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.agg(
        F.avg((F.coalesce(F.col("first"), F.lit(depth + 1)) <= k).cast("double")).alias("recall_at_k"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"), F.count("*").alias("query_count"),
    )
