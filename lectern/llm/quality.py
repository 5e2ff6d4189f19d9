"""Text quality statistics of each parsed file, and whether it is prose.

Plan. Paragraphs are shuffled once, by file and run of RUN paragraphs, so that even a
file holding a third of all rows is spread; twins fall there. Each partition is then
read in order, one whole run after the other, in Arrow batches; words, lines and word
pairs of many runs at a time are counted in numpy. Only sums leave the workers, and are
added up per file. Of files with several runs the hashes of lines, paragraphs and word
pairs leave as well, counted per run, and are added up per file and hash, so that
repetition is that of the whole file whatever its length.

Defined results: only heading_level 0 counts (null counts as body); null and blank
texts add nothing; a file without any body text has no row; twins count once; other
columns are ignored; texts are measured whole. A paragraph wrapped at the margin is one
line. A line that stands OFTEN times or more in a file is boilerplate: it counts for no
kind. Equal lines are told by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.vector_text import _DIGIT, _LETTER, _SPACE, Codes, blocks, mix, unique_pairs

RUN = 5_000
#: So often a line stands in a file that it is boilerplate; MOSTLY of the text says that it all is.
OFTEN, MOSTLY = 3, 0.6
#: The commonest short words of English running text.
COMMON = (
    "the a an of to in on at by and or but so if when then that which while we you they i it is are was were can do does "
    "not how now some most many each about after before as from with for these those this must should have has had be been "
    "who what where there here their its our your his her he she them us only than more less no nor any all both such may "
    "might will would could into over under between through because although whether until first too very also just"
).split()
#: Words that a list entry seldom and a clause nearly always holds.
CLAUSE = (
    "can are is was were must should have has had will would not they we you i it he she do does did which that when if "
    "although whether"
).split()
KINDS = ("prose", "list", "table", "junk", "other")
PROSE, LIST, TABLE, JUNK, OTHER = range(5)

BULLET = re.compile(r"^\s*(?:[-*•–—▪◦●■‣+·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+")
_ANY_BULLET = re.compile(BULLET.pattern, re.M)
_TABLE = re.compile(
    r"\|.*\||\t|^\s*\"[^\"]*\",|\",\"|\S {2,}\S+ {2,}\S|^[^,]*(?:,[^, ]{1,12}){2,}$|^(?:[^;]{1,40};){2,}[^;]{0,40}$"
    r"|^(?:[-+]?[\d.,/%]+\s+){2,}[-+]?[\d.,/%]+$|^[^:.!?]{2,40}: ?(?:\S*\d\S*|-|–|n/a|yes|no|[a-z][a-z-]{0,11})$"
)
_GARBLED = re.compile(r"Ã.|â€.|Â.|ï¿½|�")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{2} ){6,}[0-9a-fA-F]{2}$")
_BASE64 = re.compile(r"^[A-Za-z0-9+/=]{40,}$")
_ODD_SIGNS = re.compile(r"(?:[,:.][,:.-].*){3}")
_FURNITURE = re.compile(r"^(?:```.*|[-=_*#~ ]{3,}|\W*\d{0,4}\W*|(?i:(?:page|p\.|seite|-|–|\[)?\s*[\dlio]{1,4}(?:\s*(?:/|of)\s*[\dlio]{1,4})?\s*[-–\]]?))$")
_CODE = re.compile(r"^[\w.\[\]\"']+ ?(?:=|\+=) ?\S+.*[)\]\w\"'}]$|^\s*(?:import|def|return|for|export|echo|if|print)\b.*[(){}=$:]")
_JOINT = re.compile(r", (?:then|so|but|and)\b")
_SENTENCE_END = re.compile(r"[.!?][\"”’')\]]*(?:\s|$)")
_WRAP = re.compile(r"\n[a-zà-ÿ(]")
_BREAK = re.compile(r"\r\n|\r|\n")
_STRIP = " \t\r\n\x0b\x0c\xa0"


def lines_of(text: str) -> list[str]:
    """Non-blank lines; a paragraph wrapped at the margin is one line."""
    if "\n" not in text and "\r" not in text:
        t = text.strip(_STRIP)
        return [t] if t else []
    text = _BREAK.sub("\n", text)
    if _WRAP.search(text) and _SENTENCE_END.search(text) and "\t" not in text and "|" not in text and not _ANY_BULLET.search(text):
        t = " ".join(x for x in (y.strip(_STRIP) for y in text.split("\n")) if x)
        return [t] if t else []
    return [x for x in (y.strip(_STRIP) for y in text.split("\n")) if x]


def _known(words: list[str]) -> np.ndarray:
    c = Codes(words)
    return np.sort(c.hashes(c.starts, c.ends - 1))


_COMMON, _CLAUSE = _known(COMMON), _known(CLAUSE)


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Lines:
    """Measures of a block of lines, an array each."""

    def __init__(self, lines: list[str]):
        n = len(lines)
        c = self.codes = Codes([x.lower() for x in lines])
        of = lambda mask: np.add.reduceat(mask.astype(np.int64), c.starts) if n else np.zeros(0, dtype=np.int64)
        self.chars = c.ends - c.starts - 1
        self.hash = c.hashes(c.starts, c.ends - 1)
        self.letters, digits, spaces = of(c.kind == _LETTER), of(c.kind == _DIGIT), of(c.kind == _SPACE) - 1
        self.dense = self.chars - spaces
        self.symbols = self.dense - self.letters - digits
        start, end = c.tokens()
        word = c.kind[start] == _LETTER
        start, end = start[word], end[word]
        self.owner, self.words = c.text_of(start), c.hashes(start, end)
        self.lengths = end - start
        count = lambda w=None: np.bincount(self.owner, w, minlength=n)
        self.n_words = count()
        self.word_chars = count(self.lengths)
        self.common = count(_is_in(self.words, _COMMON))
        clause = count(_is_in(self.words, _CLAUSE))
        vowels = np.r_[0, np.cumsum(np.isin(c.codes, np.array([ord(x) for x in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûü"], dtype=np.uint32)))]
        hard = count((self.lengths >= 3) & (vowels[end] == vowels[start]))
        # word pairs inside a line
        same = self.owner[1:] == self.owner[:-1]
        self.pair_owner = self.owner[:-1][same]
        self.pair = mix(self.words[:-1][same] * np.uint64(31) + self.words[1:][same])
        self.pair_chars = (self.lengths[:-1] + self.lengths[1:])[same]
        self.ending = np.fromiter((x.rstrip("\"”’')]")[-1:] in (".", "!", "?", "…", ":", ";") for x in lines), dtype=bool, count=n)
        self.kind = np.full(n, PROSE, dtype=np.int8)
        # what ends like a sentence and reads like one needs no closer look
        full = np.fromiter((x.rstrip("\"”’')]")[-1:] in (".", "!", "?", "…") for x in lines), dtype=bool, count=n)
        plain = full & (self.common * 8 >= self.n_words) & (self.n_words >= 3) & (self.letters * 2 > self.dense) & (hard * 4 < self.n_words)
        unclear = ~plain[self.owner]
        owner, words = self.owner[unclear], self.words[unclear]
        # one or two words over and over
        self.monotonous = ~plain & (self.n_words >= 6) & (np.bincount(owner[unique_pairs(owner, words)[0]], minlength=n) <= 2)
        for i in np.flatnonzero(~plain):
            self.kind[i] = _kind(lines[i], int(self.n_words[i]), int(self.letters[i]), int(self.dense[i]), int(self.symbols[i]), int(hard[i]), int(clause[i]), int(self.common[i]), bool(full[i]))


def _kind(line: str, n: int, letters: int, dense: int, symbols: int, hard: int, clause: int, common: int, full: bool) -> int:
    if _FURNITURE.match(line) or _CODE.match(line):
        return OTHER
    if _HEX.match(line) or _BASE64.match(line):
        return JUNK
    if sum(len(x) for x in _GARBLED.findall(line)) * 8 >= len(line):
        return JUNK
    table = bool(_TABLE.search(line))
    if not table and (hard * 2 >= n >= 2 and len(line) >= 12 or dense >= 20 and letters * 4 < dense):
        return JUNK
    if dense >= 12 and (dense - symbols) * 20 < dense * 7 or letters * 4 < dense and _ODD_SIGNS.search(line):
        return JUNK
    if table and not full and not clause:
        return TABLE
    rest = BULLET.sub("", line)
    if not full and not clause and n <= 8 and common <= 3 and letters and not _JOINT.search(rest):
        return LIST
    return PROSE


def body(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct body paragraphs (doc_id, run, text): shuffled once by file and run, and in their order."""
    level = F.coalesce(F.col("heading_level"), F.lit(0)) == 0
    return (
        paragraphs.filter(level & F.col("text").isNotNull() & (F.trim("text") != ""))
        .select(F.col(key).alias("doc_id"), F.floor(F.coalesce(F.col("para_index"), F.lit(0)) / RUN).cast("int").alias("run"), "para_index", "text")
        .repartition("doc_id", "run")
        .sortWithinPartitions("doc_id", "run", "para_index")
        .select("doc_id", "run", "para_index", "text")
    )


def whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in which every run is whole and twins are gone, with the number of the run in the batch as g."""
    rest = None
    for d in batches:
        if rest is not None:
            d = pd.concat([rest, d], ignore_index=True)
        if not len(d):
            continue
        last = _same(d, -1)
        cutoff = int(np.argmax(last))
        rest = d.iloc[cutoff:]
        if cutoff:
            yield _numbered(d.iloc[:cutoff])
    if rest is not None and len(rest):
        yield _numbered(rest)


def _same(d: pd.DataFrame, i: int) -> np.ndarray:
    doc, run = d["doc_id"].iloc[i], d["run"].iloc[i]
    return ((d["doc_id"] == doc) | (d["doc_id"].isna() & pd.isna(doc))).to_numpy() & (d["run"] == run).to_numpy()


def _numbered(d: pd.DataFrame) -> pd.DataFrame:
    d = d.drop_duplicates(["doc_id", "run", "para_index", "text"]).reset_index(drop=True)
    return d.assign(g=d.groupby(["doc_id", "run"], sort=False, dropna=False).ngroup())


SUMS = (
    "paragraphs", "repeated_paragraphs", "lines", "repeated_lines", "chars", "words", "word_chars", "symbols", "ending", "common",
    "top_pair_chars", "boilerplate_chars", *(f"{k}_chars" for k in KINDS),
)
#: What is counted over the whole of a file with several runs.
OVER_RUNS = ("repeated_paragraphs", "repeated_lines", "top_pair_chars", "boilerplate_chars", *(f"{k}_chars" for k in KINDS))


def _repeated(g: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Per group the number of rows beyond the first of each value."""
    return np.bincount(g, minlength=n) - np.bincount(g[unique_pairs(g, h)[0]], minlength=n)


class _Runs:
    """Measures of the runs of a batch: lines with their run, kind and hash, paragraphs, word pairs."""

    def __init__(self, d: pd.DataFrame):
        self.group = d["g"].to_numpy()
        self.n = int(d["g"].max()) + 1
        texts = d["text"].tolist()
        none = np.zeros(0, dtype=np.uint64)
        c = [none]
        for a, b in blocks(texts):
            x = Codes(texts[a:b])
            c.append(x.hashes(x.starts, x.ends - 1))
        self.paragraphs = np.concatenate(c)
        lines, owner = [], []
        for t, g in zip(texts, self.group):
            own = lines_of(t)
            lines += own
            owner += [g] * len(own)
        self.owner = np.array(owner, dtype=np.int64)
        self.sums = {k: np.zeros(self.n, dtype=np.int64) for k in ("chars", "words", "word_chars", "symbols", "ending", "common")}
        hashes, chars, kinds, pairs = [none], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int8)], []
        for a, b in blocks(lines):
            x, g = Lines(lines[a:b]), self.owner[a:b]
            hashes.append(x.hash)
            chars.append(x.chars)
            kinds.append(x.kind)
            for name, w in (("chars", x.chars), ("words", x.n_words), ("word_chars", x.word_chars), ("symbols", x.symbols), ("ending", x.ending), ("common", x.common)):
                self.sums[name] += np.bincount(g, w, minlength=self.n).astype(np.int64)
            if len(x.pair):
                first, count = unique_pairs(g[x.pair_owner], x.pair)
                pairs.append(pd.DataFrame({"g": g[x.pair_owner][first], "h": x.pair[first], "l": x.pair_chars[first], "n": count}))
        self.hash, self.chars, self.kind = np.concatenate(hashes), np.concatenate(chars), np.concatenate(kinds)
        p = pd.concat(pairs) if pairs else pd.DataFrame({"g": [], "h": none, "l": [], "n": []}).astype({"g": np.int64, "l": np.int64, "n": np.int64})
        self.pairs = p.groupby(["g", "h", "l"], as_index=False, sort=False)["n"].sum() if len(pairs) > 1 else p


def run_sums(d: pd.DataFrame) -> pd.DataFrame:
    """One row of sums for each run of the batch."""
    r = _Runs(d)
    n = r.n
    out = {c: np.zeros(n, dtype=np.int64) for c in SUMS} | r.sums
    out["paragraphs"] = np.bincount(r.group, minlength=n)
    out["lines"] = np.bincount(r.owner, minlength=n)
    out["repeated_paragraphs"] = _repeated(r.group, r.paragraphs, n)
    out["repeated_lines"] = _repeated(r.owner, r.hash, n)
    often = np.zeros(len(r.hash), dtype=bool)
    if out["repeated_lines"].any():
        _, back, count = np.unique(mix(r.hash + r.owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_inverse=True, return_counts=True)
        often = count[back] >= OFTEN
    add = lambda own: np.bincount(r.owner[own], r.chars[own], minlength=n).astype(np.int64)
    out["boilerplate_chars"] = add(often)
    for k, name in enumerate(KINDS):
        out[f"{name}_chars"] = add((r.kind == k) & ~often)
    p = r.pairs[r.pairs["n"] > 1]
    np.maximum.at(out["top_pair_chars"], p["g"].to_numpy(), (p["n"] * p["l"]).to_numpy())
    first = d.drop_duplicates("g")
    return pd.DataFrame({"doc_id": first["doc_id"].to_numpy(), **{c: out[c] for c in SUMS}})


PARAGRAPH, LINE, PAIR = range(3)


def run_hashes(d: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, what, h, kind, size, n): how often each run holds a paragraph, line or pair of words."""
    r = _Runs(d)
    doc = d.drop_duplicates("g")["doc_id"].to_numpy()

    def counted(what: int, g: np.ndarray, h: np.ndarray, kind, size) -> pd.DataFrame:
        first, n = unique_pairs(g, h)
        return pd.DataFrame({"doc_id": doc[g[first]], "what": what, "h": h[first].view(np.int64), "kind": kind[first], "size": size[first], "n": n})

    zero = np.zeros(len(r.group), dtype=np.int64)
    pairs = r.pairs
    return pd.concat([
        counted(PARAGRAPH, r.group, r.paragraphs, zero, zero), counted(LINE, r.owner, r.hash, r.kind.astype(np.int64), r.chars),
        pd.DataFrame({"doc_id": doc[pairs["g"].to_numpy()], "what": PAIR, "h": pairs["h"].to_numpy().astype(np.uint64).view(np.int64), "kind": 0, "size": pairs["l"].to_numpy(), "n": pairs["n"].to_numpy()}),
    ])


def long_files(paragraphs: DataFrame, least: int, key: str = "doc_id") -> DataFrame | None:
    """Files with a paragraph of number `least` or more, None if there is none."""
    found = paragraphs.filter(F.col("para_index") >= least).select(key).filter(F.col(key).isNotNull())
    return None if found.isEmpty() else found.distinct()


def _over_runs(paragraphs: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """(doc_id, OVER_RUNS) of the files with several runs."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in whole_runs(batches):
            yield run_hashes(d)

    kind = paragraphs.schema[key].dataType.simpleString()
    hashes = body(paragraphs.join(long, key, "left_semi"), key).mapInPandas(measure, f"doc_id {kind}, what int, h long, kind int, size long, n long")
    total = hashes.groupBy("doc_id", "what", "h").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.max("kind").alias("kind"))
    line, n = F.col("what") == LINE, F.col("n")
    part = lambda on, value: F.coalesce(F.sum(F.when(on, value)), F.lit(0))
    return total.groupBy("doc_id").agg(
        part(F.col("what") == PARAGRAPH, n - 1).alias("repeated_paragraphs"), part(line, n - 1).alias("repeated_lines"),
        F.coalesce(F.max(F.when((F.col("what") == PAIR) & (n > 1), n * F.col("size"))), F.lit(0)).alias("top_pair_chars"),
        part(line & (n >= OFTEN), n * F.col("size")).alias("boilerplate_chars"),
        *[part(line & (n < OFTEN) & (F.col("kind") == k), n * F.col("size")).alias(f"{name}_chars") for k, name in enumerate(KINDS)],
    )


def file_statistics(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per file: counts, shares, repetition and the verdict text_kind."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in whole_runs(batches):
            yield run_sums(d)

    kind = paragraphs.schema[key].dataType.simpleString()
    runs = body(paragraphs, key).mapInPandas(measure, f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}")
    total = runs.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    if (long := long_files(paragraphs, RUN, key)) is not None:
        over = _over_runs(paragraphs, long, key).select("doc_id", *[F.col(c).alias(f"{c}_over") for c in OVER_RUNS])
        total = total.join(over, "doc_id", "left").withColumns({c: F.coalesce(f"{c}_over", c) for c in OVER_RUNS}).select("doc_id", *SUMS)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    stats = total.filter("lines > 0").select(
        "doc_id", "paragraphs", "lines", F.col("words").alias("word_count"), "chars",
        share("word_chars", "words").alias("mean_word_length"),
        share("symbols", "chars").alias("symbol_share"),
        share("ending", "lines").alias("ending_line_share"),
        share("common", "words").alias("common_word_share"),
        share("repeated_lines", "lines").alias("repeated_line_share"),
        share("repeated_paragraphs", "paragraphs").alias("repeated_paragraph_share"),
        F.least(share("top_pair_chars", "word_chars"), F.lit(1.0)).alias("top_pair_share"),
        share("boilerplate_chars", "chars").alias("boilerplate_share"),
        *[f"{k}_chars" for k in ("prose", "list", "table", "junk")],
    )
    return stats.withColumn("text_kind", verdict())


def kind_by_size() -> Column:
    """The kind that most of the text is of, by characters; prose first among equals."""
    prose, lst, table, junk = (F.col(f"{k}_chars") for k in ("prose", "list", "table", "junk"))
    most = F.greatest(prose, lst, table, junk)
    return (
        F.when(most == 0, "prose")
        .when(junk * 2 >= prose + lst + table + junk, "junk")
        .when(prose == most, "prose")
        .when(table == most, "table")
        .when(lst == most, "list")
        .otherwise("junk")
    )


def verdict() -> Column:
    """By the size of what isn't boilerplate; a text that mostly repeats lines, paragraphs or one pair of words is junk."""
    pair = (F.col("top_pair_share") > 0.3) & (F.col("word_count") > 20) & (F.col("repeated_line_share") < 0.5)
    again = ((F.col("boilerplate_share") > MOSTLY) | (F.col("repeated_paragraph_share") > MOSTLY)) & (F.col("word_count") > 20)
    return F.when(pair | again, "junk").otherwise(kind_by_size())


#: What the spellings of quality flags say about the kind of text.
FLAG_KINDS = {"table": "table", "tabular": "table", "listlike": "list", "list": "list", "garbled": "junk", "lowalpha": "junk"}


def with_flags(stats: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds what the quality flags of the file's chunks say, and whether they agree with the verdict.

    flags_agree is null for a file without chunks. Flags that say nothing about the
    kind of text (and null, blank or unknown ones) count as none.
    """
    plain = lambda f: F.regexp_replace(F.lower(f), r"[^a-z]", "")
    said = F.transform(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda f: F.coalesce(plain(f), F.lit("")))
    has = lambda kind: F.arrays_overlap(said, F.array(*[F.lit(k) for k, v in FLAG_KINDS.items() if v == kind])).cast("int")
    flagged = (
        chunks.select(F.col(key).alias("doc_id"), "chunk_id", *[has(k).alias(k) for k in ("list", "table", "junk")])
        .groupBy("doc_id", "chunk_id").agg(*[F.max(k).alias(k) for k in ("list", "table", "junk")])
        .groupBy("doc_id").agg(F.count("*").alias("n_chunks"), *[F.sum(k).alias(f"{k}_flags") for k in ("list", "table", "junk")])
    )
    votes = F.array(*[F.struct(F.col(f"{k}_flags").alias("n"), F.lit(k).alias("k")) for k in ("junk", "list", "table")])
    top = F.array_max(votes)
    said_kind = F.when(top.n * 2 > F.col("n_chunks"), top.k).otherwise("prose")
    return (
        stats.join(flagged, "doc_id", "left")
        .withColumn("flagged_kind", F.when(F.col("n_chunks") > 0, said_kind))
        .withColumn("flags_agree", F.col("flagged_kind") == F.col("text_kind"))
    )
