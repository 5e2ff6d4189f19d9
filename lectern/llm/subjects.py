"""Subject areas of each parsed file.

Latent Dirichlet topics are fitted over all paragraphs. They start nearly alike: each
subject has a topic that leans by LEAN to the terms of files whose analyses or ratings name
it, and the fit, run until it settles, makes them what they are. A topic is mapped to a
subject through its top terms: each term carries the subjects of the files it stands in. A
file gets the subjects to which whole paragraphs are given over, from the topic proportions
of its paragraphs.

What analyses say is read from their domain; topics and content types get the subject that
most analyses with a clear domain use them for, and speak where the domain does not.

Defined results: null and blank paragraphs say nothing; twins count once; a file whose
text is mostly junk has no subject; analyses that are missing, vague or unknown are no
evidence, wrong ones are outvoted; a file whose paragraphs hold too few known words gets
the subject that its own analysis names, if any; without any evidence no topic has a
subject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import topics
from lectern.session import cut

#: Words by which analyses call the subject areas.
NAMES = {
    "education": "education educational edu school schools schooling curriculum curricula teaching teacher pupils lessons lesson instruction",
    "law": "law legal juridical regulatory contract contracts compliance statutes courts litigation",
    "software": "software tech technical programming computing devops dev it engineering systems code",
    "medicine": "medicine medical clinical clinic nursing healthcare health patient care",
    "finance": "finance financial banking accounting treasury economics economic tax money",
    "marketing": "marketing advertising promo promotion brand brands comms communications growth sales",
    "customer_support": "support helpdesk customer service product help cs after-sales aftersales",
    "science": "science scientific sciences research lab stem biology chemistry physics natural",
    "sport": "sport sports athletics athletic fitness coaching recreation training physical",
    "public_administration": "public administration government gov municipal civic civil council local sector",
}
EXTRA_TOPICS = 6
TOP_TERMS = 40
LEAN = 0.1
#: A topic or content type stands for a subject that so many analyses, and this share of them, use it for.
LEAST_USES, USE_SHARE = 3, 0.7


def named_subjects(said: Column, subjects: list[str]) -> Column:
    """Subjects that a wording names: those with most of its words, if any."""
    own = [(NAMES.get(s, "") + " " + s.replace("_", " ")).split() for s in subjects]
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  # c is worked out once, not wherever f has it
    count = lambda ws, of: F.size(F.filter(ws, lambda w: w.isin(of)))
    words = F.filter(F.split(F.lower(said), r"[^\p{L}-]+"), lambda w: w != "")
    hits = once(words, lambda ws: F.array(*(count(ws, o) for o in own)))

    def best(n: Column) -> Column:
        names = F.array_compact(F.array(*(F.when(n[i] == F.array_max(n), F.lit(s)) for i, s in enumerate(subjects))))
        return F.when(F.array_max(n) > 0, names).otherwise(F.array().cast("array<string>"))

    return once(hits, best)


def evidence(analyses: DataFrame, ratings: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject): what analyses and ratings name, when they name one subject.

    analyses: doc_id, domain, and topics and content_type if there.
    """
    known = {"topics", "content_type"} <= set(analyses.columns)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    words = F.concat(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: plain(t)), F.array(plain(F.col("content_type")))) if known else F.array().cast("array<string>")
    # read once: what the domain names, and the other values
    read = analyses.filter("doc_id IS NOT NULL").select("doc_id", named_subjects(F.col("domain"), subjects).alias("s"), F.array_distinct(words).alias("values"))
    read = cut(read.select("doc_id", F.when(F.size("s") == 1, F.col("s")[0]).alias("subject"), "values").distinct()) if known else read.select("doc_id", F.when(F.size("s") == 1, F.col("s")[0]).alias("subject"), "values")
    said = read.filter("subject IS NOT NULL").select("doc_id", "subject")
    both = said.unionByName(ratings.select("doc_id", "subject").filter(F.col("subject").isin(subjects)))
    if known:
        most = lambda x, by: x.groupBy(by).agg(F.max_by("subject", F.struct("n", "subject")).alias("subject"), F.max("n").alias("most"), F.sum("n").alias("n"))
        used = read.select("doc_id", "subject", F.explode("values").alias("value")).filter("value <> ''")
        uses = used.filter("subject IS NOT NULL").groupBy("value", "subject").agg(F.count("*").alias("n"))
        meaning = most(uses, "value").filter((F.col("most") >= LEAST_USES) & (F.col("most") >= USE_SHARE * F.col("n"))).select("value", F.col("subject").alias("means"))
        votes = used.filter("subject IS NULL").join(meaning, "value").groupBy("doc_id", F.col("means").alias("subject")).agg(F.count("*").alias("n"))
        hinted = most(votes, "doc_id").filter(F.col("most") * 3 >= F.col("n") * 2).select("doc_id", "subject")
        both = both.unionByName(hinted)
    return both.filter(F.col("doc_id").isNotNull()).distinct()


def _one(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(p.sum(-1, keepdims=True), 1e-12)


class SubjectModel:
    """Topics, and the subject of each topic (-1: none)."""

    def __init__(self, lam: np.ndarray, of_topic: np.ndarray, subjects: list[str], words: list[str], alpha: float):
        self.lam, self.of_topic, self.subjects, self.words, self.alpha = lam, of_topic, subjects, words, alpha
        self.beta = topics.expected_beta(lam)

    def shares(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per paragraph the expected number of words of each subject, and of no subject."""
        gamma = topics.expectation(flat, lengths, self.beta, self.alpha, 6)
        mass = np.maximum(gamma - self.alpha, 0)
        out = np.stack([mass[:, self.of_topic == s].sum(1) for s in range(len(self.subjects))], 1)
        return out, mass[:, self.of_topic < 0].sum(1)

    def table(self) -> list[tuple[int, str | None, str]]:
        phi = _one(self.lam)
        lift = phi * np.log(np.maximum(phi, 1e-12) / np.maximum(phi.mean(0), 1e-12))
        return [(k, self.subjects[s] if (s := self.of_topic[k]) >= 0 else None, " ".join(self.words[i] for i in np.argsort(-lift[k], kind="stable")[:15])) for k in range(len(phi))]


def term_subjects(encoded: DataFrame, named: DataFrame, subjects: list[str], size: int) -> np.ndarray:
    """Vocabulary x subjects: how many paragraphs of files of a subject hold the term."""
    at = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(subjects) * size, dtype=np.int64)
        for batch in batches:
            flat, lengths = topics.laid_out(batch, size)
            key = np.sort(np.repeat(np.arange(len(lengths)), lengths) * size + flat)
            row, term = np.divmod(key[np.diff(key, prepend=-1) > 0], max(size, 1))
            total += np.bincount(batch.column("s").to_numpy()[row] * size + term, minlength=len(total))
        s, term = np.divmod(np.flatnonzero(total), max(size, 1))
        yield pa.RecordBatch.from_pydict({"term": pa.array(term.astype(np.int32)), "s": pa.array(s.astype(np.int32)), "n": pa.array(total[total > 0].astype(np.float64))})

    got = (
        encoded.join(named.withColumn("s", at[F.col("subject")]), "doc_id").select("s", "ids")
        .mapInArrow(count, "term int, s int, n double").groupBy("term", "s").agg(F.sum("n").alias("n")).toPandas()
    )
    out = np.zeros((size, len(subjects)))
    out[got["term"], got["s"]] = got["n"]
    return out


def fit(encoded: DataFrame, vocab: pd.DataFrame, named: DataFrame, subjects: list[str], rounds: int = topics.MOST_ROUNDS, alpha: float = 0.1, seed: int = 11) -> SubjectModel:
    vocab = vocab[vocab["used"]]
    v, s = len(vocab), len(subjects)
    counts = term_subjects(encoded, named, subjects, v)
    # how much more often a term stands in files of a subject than in files at large
    rate = (counts + 0.2) / (counts.sum(0) + 0.2 * v) if v else counts
    lift = np.clip(rate / rate.mean(1, keepdims=True), 0.2, 5) if v else rate
    df = vocab["df"].to_numpy(float)
    rnd = np.random.default_rng(seed)
    leaning = df[:, None] * (1 + LEAN * (lift - 1)) if v else np.zeros((0, s))
    free = df[:, None] * rnd.gamma(20.0, 1 / 20.0, (v, EXTRA_TOPICS))
    start = np.concatenate([leaning, free], 1).T + 0.05
    lam = topics.fit(encoded, start, rounds, alpha)
    phi = _one(lam)
    # the subject of a topic is what its top terms stand for, if they stand for one clearly
    of_topic = np.full(len(phi), -1)
    share = _one(rate)
    for k in range(len(phi) if v else 0):
        rel = phi[k] * np.log(np.maximum(phi[k], 1e-12) / np.maximum(phi.mean(0), 1e-12))
        top = np.argsort(-rel, kind="stable")[:TOP_TERMS]
        vote = (np.maximum(rel[top], 0)[:, None] * share[top]).sum(0)
        vote = vote / max(vote.sum(), 1e-12)
        if vote.max() > 2.5 / s and counts.sum() > 0:
            of_topic[k] = int(vote.argmax())
    return SubjectModel(lam, of_topic, subjects, vocab["word"].tolist(), alpha)


#: A paragraph is given over to a subject with WHOLE of its subject words, at least LEAST of them;
#: two with MOSTLY are as good. Entries too short to tell count together.
WHOLE, MOSTLY, LEAST, PART = 0.85, 0.65, 3.0, 0.15


def file_subjects(encoded: DataFrame, model: SubjectModel, named: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, share): the subjects of each file; share is of its subject words.

    named: evidence(), for files whose paragraphs say too little; their share is null.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = model.shares(*topics.laid_out(batch, model.lam.shape[1]))
            total = x.sum(1).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(x.argmax(1).astype(np.int32)), pa.array(x.max(1).astype(np.float64) / np.maximum(total, 1e-9)), pa.array(total)], names=[*kept, "s", "share", "words"],
            )

    kept = ["doc_id", "para_index", "h", "n_chars", "junk"]
    paras = (
        encoded.filter(F.coalesce("heading_level", F.lit(0)) == 0).select("doc_id", "para_index", "h", "n_chars", "junk", "ids")
        .mapInArrow(judge, f"doc_id {kind}, para_index int, h long, n_chars long, junk boolean, s int, share double, words double")
        .dropDuplicates(["doc_id", "para_index", "h"])
    )
    enough = F.col("words") >= LEAST
    one = lambda c: F.sum(F.when(c & ~F.col("junk"), 1).otherwise(0))
    by_subject = paras.groupBy("doc_id", "s").agg(
        one(enough & (F.col("share") >= WHOLE)).alias("whole"),
        one(enough & (F.col("share") >= MOSTLY)).alias("mostly"),
        F.sum(F.when(~enough & (F.col("share") >= WHOLE) & ~F.col("junk"), F.col("words")).otherwise(0)).alias("small"),
        F.sum(F.when(~F.col("junk"), F.col("words")).otherwise(0)).alias("words"),
        F.sum(F.when(F.col("junk"), F.col("n_chars")).otherwise(0)).alias("junk_chars"),
        F.sum("n_chars").alias("chars"),
    )
    # at most one row for each subject of a file
    w = W.partitionBy("doc_id")
    known = by_subject.withColumns({
        "total": F.sum("words").over(w), "is_junk": F.sum("junk_chars").over(w) * 2 >= F.sum("chars").over(w),
        "rank": F.row_number().over(w.orderBy(F.desc("words"), "s")),
    })
    given = (F.col("whole") >= 1) | (F.col("mostly") >= 2) | ((F.col("small") >= 5) & (F.col("small") >= PART * F.col("total")))
    name = F.element_at(F.array(*map(F.lit, model.subjects)), F.col("s") + 1)
    judged = known.withColumn("given", given).withColumn("any", F.max("given").over(w)).filter(~F.col("is_junk"))
    said = F.col("given") | (~F.col("any") & (F.col("rank") == 1) & (F.col("words") >= LEAST))
    silent = ~F.col("any") & (F.col("rank") == 1) & (F.col("words") < LEAST)
    rows = judged.filter(said | silent).select("doc_id", F.when(said, name).alias("subject"), F.when(said & (F.col("total") > 0), F.col("words") / F.col("total")).alias("share"))
    if named is not None:
        one = named.groupBy("doc_id").agg(F.min("subject").alias("own"), F.count("*").alias("n")).filter("n = 1").select("doc_id", "own")
        rows = rows.join(one, "doc_id", "left").select("doc_id", F.coalesce("subject", "own").alias("subject"), "share")
    return rows.filter("subject IS NOT NULL")
