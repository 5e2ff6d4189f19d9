"""Repair of text from files that were scanned page by page.

An averaged-perceptron character editor (char_editor.py) proposes what was printed where
a word is unknown or broken. A proposal counts if it is a word of the vocabulary and the
editor's score for it is not further below that of the word as it was read than drawn
noise is; where a sign that words don't hold stands
in a word, what the editor scores best counts also outside the vocabulary. Running headers
and page numbers are told by their place on the page, their form and their recurrence.

Plan. The vocabulary is counted over all paragraphs of files that are never scanned
(CLEAN_TYPES) and bounded by MOST_WORDS. The editor is fitted on at most FIT_WORDS of its
most frequent words with drawn noise. Paragraphs of files with pages are shuffled once by
file and run of quality.RUN paragraphs and read in order; only unknown words of a file
reach the editor, and each worker remembers what it has read. A file of several runs is
read twice: first for what its lines and starts of paragraphs recur by, counted over the
file, then each run with HALO paragraphs before and after it and with those counts, and
whether the file was scanned is decided from the findings of all its runs.

Defined results: files whose type is in CLEAN_TYPES or that have no pages (page_count
null counts as having some) are left alone; headings (heading_level > 0) are no
furniture, but may hold misread or broken words; null and blank texts hold nothing; twins
count once; a file is taken for scanned if it shows page numbers, a recurring header,
or broken or misread words; paragraphs that are no readable text are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import quality
from lectern.llm.char_editor import CharEditor
from lectern.llm.vector_text import _LETTER, Codes, blocks
from lectern.session import cut

CLEAN_TYPES = ("docx", "md", "txt")
MOST_WORDS = 60_000
FIT_WORDS = 4_000
#: So many paragraphs of the neighbouring runs are read along.
HALO = 20
#: A header has at most so many words.
HEADER_WORDS = 9
KINDS = ("hyphenation", "misread", "running_header", "page_number")

_NUMBER = r"(?:[\dlIoOiSs|]{1,4}|[ivxlIVXL]{1,6})"
PAGE = re.compile(rf"^(?:(?:page|p\.|pg\.?|seite|s\.)\s*{_NUMBER}(?:\s*(?:/|of|von|de)\s*{_NUMBER})?|[-–—\[(]?\s*{_NUMBER}(?:\s*(?:/|of)\s*{_NUMBER})?\s*[-–—\])]?)$", re.I)
_LEAD = re.compile(rf"^(?:{_NUMBER})\s{{2,}}(\S.*)$|^(\d{{1,4}})\s+(\S.*)$")
_TAIL = re.compile(rf"^(.*\S)\s{{2,}}(?:{_NUMBER})$|^(.*\S)\s+(\d{{1,4}})$")
_BREAK = re.compile(r"([^\W\d_][^\s¬\xad-]*)(-[ \n]\n?|[¬\xad]\s?\n?)(?=[^\W_])([^\s¬\xad.,;:!?()\"]*)")
_END = re.compile(r"([^\W\d_][^\s¬\xad-]*)[-¬\xad]\s*$")
_START = re.compile(r"^\s*([^\W_][^\s.,;:!?()\"]*)")
_CHUNK = re.compile(r"[^\s¬\xad\"“”()\[\],;:?]+")
_RUN = re.compile(r"[^\W\d_]+")
_EDGE = ".!'’*_`-–—"
#: A sign inside or beside the letters of a word that words don't hold.
_ODD = re.compile(r"[^\W_][0-9@†|!][^\W_]|[^\W\d_][0-9@†|]|[0-9@†|!][^\W\d_]{2}")


def count_words(texts: DataFrame, most: int = MOST_WORDS, least: int = 2) -> list[str]:
    """Words in lower case, by falling number of paragraphs they occur in. texts: column text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            seen: Counter[str] = Counter()
            for t in d["text"]:
                seen.update(set(_RUN.findall(t.lower())))
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    counted = texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    # short runs of letters come about by chance
    top = rows[0].n if rows else 0
    return [r.word for r in rows if len(r.word) > 3 or r.n * 500 >= top]


def skeleton(text: str) -> str:
    """The text with signs that are taken for each other made equal; digits go."""
    t = text.lower()
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        t = t.replace(a, b)
    return re.sub(r"[^a-z]", "", t.translate(str.maketrans("01!|5@†9c6b82", "olllsatgehhsz")).replace("i", "l"))


def _after(text: str, prefix: str) -> str:
    """The text without the words of the prefix."""
    parts = text.split(None, len(prefix.split()))
    return text if not prefix else parts[-1] if len(parts) > len(prefix.split()) else ""


class Known:
    """Forms, to which others that differ in at most one sign of six are taken."""

    def __init__(self, forms: Iterable[str]):
        self.forms, self._seen = frozenset(forms), {}
        self._by: dict[tuple, list[str]] = {}
        for f in sorted(self.forms):
            for key in {("a", f[:3], len(f)), ("z", f[-3:], len(f))}:
                self._by.setdefault(key, []).append(f)

    def __bool__(self) -> bool:
        return bool(self.forms)

    def __contains__(self, k: str) -> bool:
        return k in self.forms

    def nearest(self, k: str) -> str:
        """The known form, the first in order, that k may be, else k."""
        if not k or k in self.forms:
            return k
        if k not in self._seen:
            near = {o for n in (len(k) - 1, len(k), len(k) + 1) for key in (("a", k[:3], n), ("z", k[-3:], n)) for o in self._by.get(key, ())}
            self._seen[k] = next((o for o in sorted(near) if SequenceMatcher(None, o, k, autojunk=False).ratio() >= 1 - 1 / 6), k)
        return self._seen[k]


class Context(NamedTuple):
    """What the whole of a file says to one of its runs: how often lines and starts of paragraphs recur."""

    lines: dict[str, int] = {}
    starts: dict[str, int] = {}
    paged: bool = False
    headed: bool = False


ALONE = Context()


class Reader:
    """Reads files paragraph by paragraph with a vocabulary and an editor."""

    def __init__(self, words: list[str], editor: CharEditor):
        self.vocabulary, self.editor = frozenset(words), editor
        c = Codes(words or [""])
        self.known = np.sort(c.hashes(c.starts, c.ends - 1))
        self._read: dict[str, str | None] = {}
        self._guessed: dict[str, str | None] = {}
        self._prefixes: frozenset[str] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_read": {}, "_guessed": {}, "_prefixes": None}

    @property
    def prefixes(self) -> frozenset[str]:
        """All that words of the vocabulary begin with; made by each worker for itself."""
        if self._prefixes is None:
            self._prefixes = frozenset(w[:i] for w in self.vocabulary for i in range(len(w) + 1))
        return self._prefixes

    def word(self, w: str) -> bool:
        """Whether w is made of words only."""
        runs = _RUN.findall(w.lower())
        return bool(runs) and not _ODD.search(w) and all(r in self.vocabulary for r in runs)

    def printed(self, w: str) -> str | None:
        """The word of the vocabulary that was printed where w was read, if it differs from w."""
        w = w.lower()
        if w not in self._read:
            if len(self._read) > 200_000:
                self._read.clear()
            letters = sum(c.isalpha() for c in w)
            found = None
            if len(w) >= 3 and letters * 2 >= len(w) and not self.word(w):
                least = self.editor.keeping(w) + self.editor.margin
                for r, score in self.editor.readings(w, prefixes=self.prefixes):
                    if score > least and r != w and len(r) >= 3 and r in self.vocabulary:
                        found = r
                        break
            self._read[w] = found
        return self._read[w]

    def unheard(self, w: str) -> str | None:
        """What the editor scores best, if that is letters only; w holds a sign that words don't."""
        w = w.lower()
        if len(w) < 5 or sum(c.isalpha() for c in w) < 4 or not _ODD.search(w):
            return None
        if w not in self._guessed:
            if len(self._guessed) > 200_000:
                self._guessed.clear()
            r, score = self.editor.readings(w, beam=4)[0]
            self._guessed[w] = r if r.isalpha() and r != w and score > self.editor.keeping(w) else None
        return self._guessed[w]

    def misread(self, chunk: str) -> str | None:
        core = chunk.strip(_EDGE)
        if not core or core.isdigit() or not any(c.isalpha() for c in core):
            return None
        strange = any(c.isdigit() or c in "@†|!" for c in core)
        if not strange and self.word(core):
            return None
        if strange and re.fullmatch(r"[A-Z]{1,3}[-.]?\d+(?:-\d+)?|\d+[A-Za-z]{1,2}", core):
            return None
        parts, changed = [], False
        for p in re.split(r"([-/'’.])", core):
            if p and any(c.isalpha() for c in p) and not (p.isalpha() and p.lower() in self.vocabulary):
                r = self.printed(p) or (self.unheard(p) if strange else None)
                if r is None:
                    return None
                changed = True
                p = r
            parts.append(p)
        return "".join(parts) if changed else None

    def joined(self, a: str, b: str, sure: bool) -> tuple[str, bool] | None:
        """(whole word, misread) if a and b are the parts of a word written in one piece."""
        a, b = a.strip("'’.*_"), b.strip("'’.*_!")
        whole = (a + b).lower()
        if not a or not b or b.lower() in ("and", "or", "to", "und", "et"):
            return None
        if self.word(whole):
            return whole, False
        if len(whole) > 4 and (r := self.printed(whole)):
            return r, True
        if self.word(a) and self.word(b) and not sure:
            return None
        unknown = whole.isalpha() and len(whole) >= 5 and b[:1].islower()
        return (whole, False) if unknown and (sure or not self.word(a) or not self.word(b)) else None

    def strange(self, texts: list[str]) -> np.ndarray:
        """Whether a text holds a letter run that is no word, or a broken word."""
        out = np.zeros(len(texts), dtype=bool)
        for s, e in blocks(texts):
            c = Codes([t.lower() for t in texts[s:e]])
            start, end = c.tokens()
            letters = c.kind[start] == _LETTER
            h = c.hashes(start[letters], end[letters])
            no = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] != h
            out[s:e] = np.bincount(c.text_of(start[letters][no]), minlength=e - s) > 0
        return out | np.fromiter((bool(_BREAK.search(t) or _END.search(t) or _ODD.search(t)) for t in texts), dtype=bool, count=len(texts))

    def file(self, index: list[int], level: list[int], texts: list[str], strange: np.ndarray, title: str | None, context: Context = ALONE) -> list[tuple[int, str, str, str | None]]:
        """(place in the list, kind, what was found, what was printed) for one file, or a run of it in its context."""
        n, found = len(texts), []
        flat = [" ".join(t.split()) for t in texts]
        pages = [level[i] == 0 and bool(flat[i]) and bool(PAGE.match(flat[i])) for i in range(n)]
        header, number, prefix = self._headers(level, texts, flat, pages, title, context)
        for i in range(n):
            if pages[i] or number[i]:
                found.append((i, "page_number", flat[i][:80], None))
            if header[i]:
                found.append((i, "running_header", " ".join(prefix[i].split())[:120] if prefix[i] else flat[i][:120], None))
        front = [prefix[i] if header[i] and len(flat[i]) > len(" ".join(prefix[i].split())) + 12 else "" for i in range(n)]
        body = [i for i in range(n) if level[i] == 0 and not pages[i] and (not header[i] or front[i]) and flat[i]]
        # the paragraph that goes on after the furniture
        after = dict(zip(body, body[1:]))
        taken: dict[int, int] = {}
        for i in range(n):
            if pages[i] or not strange[i] or not self._readable(texts[i]):
                continue
            text, spans = texts[i], []
            for m in _BREAK.finditer(text):
                if j := self.joined(m.group(1), m.group(3), m.group(2)[0] in "¬\xad"):
                    found.append((i, "hyphenation", m.group(0), j[0]))
                    if j[1]:
                        found.append((i, "misread", m.group(0), j[0]))
                    spans.append(m.span())
            if i in after and (m := _END.search(text)) and (s := _START.match(ahead := _after(texts[k := after[i]], front[k]))):
                if s.group(1)[:1].islower() or not s.group(1)[:1].isalpha():
                    if j := self.joined(m.group(1), s.group(1), m.group(0).rstrip()[-1] in "¬\xad"):
                        found.append((i, "hyphenation", f"{m.group(0)} {s.group(1)}", j[0]))
                        if j[1]:
                            # the wrong signs are in the part that holds no whole word of it
                            at = i if not j[0].startswith(m.group(1).lower()) else k
                            found.append((at, "misread", f"{m.group(0)} {s.group(1)}", j[0]))
                        spans.append(m.span())
                        taken[k] = len(texts[k]) - len(ahead) + s.end()
            rest, last = [], 0
            for a, b in sorted(spans):
                rest.append(text[last:a])
                last = max(last, b)
            rest.append(text[last:])
            head = taken.get(i, 0)
            clean = "\n".join(rest)
            clean = clean[head:] if head and not (spans and min(spans)[0] < head) else clean
            for m in _CHUNK.finditer(clean):
                if r := self.misread(m.group(0)):
                    found.append((i, "misread", m.group(0).strip(_EDGE), r))
        found += self._odd_headers(header, prefix, context)
        return found

    @staticmethod
    def _readable(text: str) -> bool:
        words = text.split()
        letters = sum(c.isalpha() for c in text)
        return letters * 2 > len(text) - text.count(" ") and max(map(len, words)) < 60

    @staticmethod
    def _bare(level: list[int], texts: list[str], flat: list[str], pages: list[bool]) -> tuple[list[str], list[bool]]:
        """Lines that may be headers without their number, and whether they had one."""
        n = len(texts)
        bare, number = [""] * n, [False] * n
        for i in range(n):
            if level[i] or pages[i] or not flat[i] or flat[i].count("|") > 1:
                continue
            t = texts[i].strip()
            if "\n" in t:
                continue
            for pattern in (_LEAD, _TAIL):
                if m := pattern.match(t):
                    got = [g for g in m.groups() if g and not g.isdigit()]
                    if got and not re.search(r"[.!?,;:]\s*$", got[0]) and len(got[0].split()) <= HEADER_WORDS:
                        bare[i], number[i] = got[0], True
                        break
            if not bare[i] and len(t.split()) <= HEADER_WORDS and not re.search(r"[.!?,;:]$", t) and not quality.BULLET.match(t) and t[0].isupper():
                bare[i] = t
        return bare, number

    @staticmethod
    def _starts(text: str, known: Known) -> Iterator[tuple[str, str]]:
        """(form, start) of the starts of a paragraph that may be a header in front of it."""
        words = text.split(None, HEADER_WORDS + 1)[: HEADER_WORDS + 1]
        for m in range(2, min(HEADER_WORDS, len(words) - 1) + 1):
            start = " ".join(words[:m])
            k = skeleton(start)
            if len(k) < 6:
                continue
            fresh = words[m][:1].isupper() or words[m][:1] in "“\"("
            caps = all(w[:1].isupper() or not w[:1].isalpha() for w in words[:m])
            full = start.endswith((".", ",")) and not re.search(r"\d\.?$", start)
            k = known.nearest(k)
            if k in known or fresh and caps and not full:
                yield k, start

    def signs(self, level: list[int], texts: list[str], title: str | None, own: list[bool]) -> tuple[Counter[str], Counter[str], bool, bool]:
        """What a run adds to the Context of its file; own: paragraphs that are its own."""
        flat = [" ".join(t.split()) for t in texts]
        pages = [level[i] == 0 and bool(flat[i]) and bool(PAGE.match(flat[i])) for i in range(len(texts))]
        bare, number = self._bare(level, texts, flat, pages)
        lines = Counter(k for i, b in enumerate(bare) if own[i] and b and len(k := skeleton(b)) >= 4)
        known, starts = Known({skeleton(title)} if title else ()), Counter()
        for i, t in enumerate(texts):
            if own[i] and not level[i] and not pages[i] and flat[i]:
                starts.update({k for k, _ in self._starts(t, known)})
        header, *_ = self._headers(level, texts, flat, pages, title, ALONE)
        return lines, starts, any(p for p, o in zip(pages, own) if o) or any(x for x, o in zip(number, own) if o), any(header)

    def _headers(self, level: list[int], texts: list[str], flat: list[str], pages: list[bool], title: str | None, context: Context) -> tuple[list[bool], list[bool], list[str]]:
        n = len(texts)
        header, prefix = [False] * n, [""] * n
        bare, number = self._bare(level, texts, flat, pages)
        keys = [skeleton(b) if b else "" for b in bare]
        count = Counter(k for k in keys if len(k) >= 4)
        wanted = skeleton(title or "")
        repeated = Known({k for k, c in count.items() if c >= 2} | {k for k, c in context.lines.items() if c >= 2})
        keys = [repeated.nearest(k) for k in keys]
        firsts = {i for i in range(n) if i == 0 or any(pages[max(0, i - 1) : i])}
        paged = any(pages) or any(number) or context.paged
        edge = lambda i: i in firsts or i + 1 < n and pages[i + 1] or i == n - 1
        for i in range(n):
            k = keys[i]
            if not k or len(k) < 4:
                number[i] = False
                continue
            titled = all(w[:1].isupper() or not w[:1].isalpha() for w in bare[i].split())
            if k in repeated or (number[i] and (repeated or paged)) or (paged and repeated and (edge(i) or titled)):
                header[i] = True
            number[i] = number[i] and header[i]
        # in front of the body text: a title-like start that several paragraphs share, or a known header
        known = Known(repeated.forms | ({wanted} if wanted else set()))
        starts: dict[str, set[int]] = {}
        for i in range(n):
            if not (level[i] or header[i] or pages[i]) and flat[i]:
                for k, _ in self._starts(texts[i], known):
                    starts.setdefault(k, set()).add(i)
        fronts = Known(k for k, own in starts.items() if len(own) >= 2 or k in repeated or context.starts.get(k, 0) >= 2)
        for i in range(n) if fronts else ():
            if level[i] or header[i] or pages[i] or not flat[i]:
                continue
            words = texts[i].split(None, HEADER_WORDS + 1)[: HEADER_WORDS + 1]
            for m in range(min(HEADER_WORDS, len(words) - 1), 1, -1):
                start = " ".join(words[:m])
                if fronts.nearest(skeleton(start)) in fronts:
                    header[i], prefix[i] = True, start
                    break
        if paged and (any(header) or context.headed):
            # left and right pages may have headers of their own
            for i in range(n):
                if keys[i] and len(keys[i]) >= 4 and not header[i] and all(w[:1].isupper() or not w[:1].isalpha() for w in bare[i].split()) and len(bare[i].split()) > 1:
                    header[i] = True
        return header, number, [p or b for p, b in zip(prefix, bare)]

    def _odd_headers(self, header: list[bool], prefix: list[str], context: Context) -> list[tuple[int, str, str, str | None]]:
        """Headers that are read otherwise than most of their kind."""
        forms: dict[str, Counter[str]] = {}
        count = Counter(skeleton(prefix[i]) for i, h in enumerate(header) if h)
        usual = Known({k for k, c in count.items() if c >= 2} | {k for k in count if context.lines.get(k, 0) >= 2})
        for i, h in enumerate(header):
            if h:
                forms.setdefault(usual.nearest(skeleton(prefix[i])), Counter())[re.sub(r"\d+\s*$", "", " ".join(prefix[i].split())).lower()] += 1
        out = []
        for i, h in enumerate(header):
            if h and len(own := forms[usual.nearest(skeleton(prefix[i]))]) > 1:
                mine, best = re.sub(r"\d+\s*$", "", " ".join(prefix[i].split())).lower(), max(own, key=lambda f: (-sum(c.isdigit() or c in "!@|†" for c in f), sum(self.word(w) for w in f.split()), own[f], f))
                if mine != best:
                    out.append((i, "misread", mine, best))
        return out


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair(index: list[int], level: list[int], texts: list[str], found: list[tuple[int, str, str, str | None]]) -> list[tuple[int, int, int, str]]:
    """(first index, last index, level, text): readable paragraphs of one file.

    Page numbers and headers go, also in front of the text; broken words are joined,
    misread ones written as printed; lines run on, and so does a paragraph broken by the
    end of a page.
    """
    gone = {i for i, k, _, _ in found if k == "page_number"}
    headers = {i: f for i, k, f, _ in found if k == "running_header"}
    fixes: dict[int, list[tuple[str, str]]] = {}
    for i, k, f, p in found:
        if p and k in ("hyphenation", "misread") and i not in gone:
            fixes.setdefault(i, []).append((f, p))
    out: list[list] = []
    joined: dict[int, str] = {}
    body = [i for i in range(len(texts)) if texts[i].strip() and i not in gone]
    starts = {i: _front(texts[i], headers[i], level[i]) for i in body if i in headers}
    body = [i for i in body if starts.get(i) != ""]
    for n, i in enumerate(body):
        text = starts.get(i, texts[i])
        if i in joined:
            text = text.lstrip()[len(joined[i]) :]
        runs_on = None
        for f, p in sorted(fixes.get(i, []), key=lambda x: -len(x[0])):
            if f in text:
                text = text.replace(f, _cased(p, f))
            elif n + 1 < len(body) and (m := re.match(r"^(.*?[-¬\xad]\s*) (\S+)$", f, re.S)) and text.rstrip().endswith(m.group(1).rstrip()):
                text = text.rstrip()[: -len(m.group(1).rstrip())] + _cased(p, f)
                runs_on = m.group(2)
        text = " ".join(text.split())
        if runs_on:
            joined[body[n + 1]] = runs_on
        last = out[-1] if out else None
        if last and (i in joined or level[i] == last[2] == 0 and last[3] and last[3][-1] not in ".!?:;…”\"" and text[:1].islower()):
            last[1], last[3] = index[i], f"{last[3]}{'' if i in joined and not text[:1].isalnum() else ' '}{text}".strip()
        else:
            out.append([index[i], index[i], level[i], text])
    return [tuple(x) for x in out if x[3]]


def _front(text: str, header: str, level: int) -> str:
    """What follows the header; a heading stays whole."""
    if level:
        return text
    words, want = text.split(), skeleton(header)
    for m in range(1, min(len(words), 10) + 1):
        if skeleton(" ".join(words[:m])) == want:
            return _after(text, " ".join(words[:m]))
    # the header that was found holds the whole first words of the paragraph
    return "" if len(words) <= 10 else text


def scanned_paragraphs(paragraphs: DataFrame, files: DataFrame, long: DataFrame | None, parted: bool = False) -> DataFrame:
    """Paragraphs of files that may have been scanned, with the title, shuffled once by file and run.

    parted: of the long files, each run with its halo and whether a paragraph is its own; else of the other files.
    """
    own = (
        files.filter((F.coalesce("page_count", F.lit(1)) > 0) & ~F.lower(F.coalesce("file_type", F.lit(""))).isin(*CLEAN_TYPES))
        .groupBy("doc_id").agg(F.min("title").alias("title"))
    )
    if long is not None:
        own = own.join(long, "doc_id", "left_semi" if parted else "left_anti")
    at = F.coalesce(F.col("para_index"), F.lit(0))
    run = F.floor(at / quality.RUN).cast("int")
    rows = (
        paragraphs.filter(F.col("text").isNotNull() & (F.trim("text") != ""))
        .select("doc_id", run.alias("home"), "para_index", F.coalesce("heading_level", F.lit(0)).alias("level"), "text").join(own, "doc_id")
    )
    if parted:
        at = F.coalesce(F.col("para_index"), F.lit(0))
        near = F.array_distinct(F.array("home", *[F.floor((at + d) / quality.RUN).cast("int") for d in (-HALO, HALO)]))
        rows = rows.withColumn("run", F.explode(F.filter(near, lambda r: r >= 0)))
    else:
        rows = rows.withColumn("run", F.lit(0))
    return rows.repartition("doc_id", "run").sortWithinPartitions("doc_id", "run", "para_index")


def fit(paragraphs: DataFrame, files: DataFrame) -> Reader:
    clean = files.filter(F.lower("file_type").isin(*CLEAN_TYPES)).select("doc_id").distinct()
    words = count_words(paragraphs.filter("text IS NOT NULL").select("doc_id", "text").join(clean, "doc_id", "left_semi"))
    return Reader(words, CharEditor.fit([w for w in words if len(w) >= 3 and w.isascii()][:FIT_WORDS]))


def contexts(parted: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, run, what, form, n) of long files: forms of lines and starts that recur, with how often in the file.

    Every run gets the forms of its own that recur, and the lines that recur from run to run.
    """
    kind = parted.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in quality.whole_runs(batches):
            rows = []
            for _, g in d.groupby("g", sort=False):
                doc, run = g["doc_id"].iloc[0], int(g["run"].iloc[0])
                own = (g["home"] == run).tolist()
                lines, starts, paged, headed = reader.signs(g["level"].tolist(), g["text"].tolist(), g["title"].iloc[0], own)
                rows += [(doc, run, "line", k, n) for k, n in lines.items()] + [(doc, run, "start", k, n) for k, n in starts.items()]
                rows += [(doc, run, w, "", 2) for w, yes in (("paged", paged), ("headed", headed)) if yes]
            yield pd.DataFrame(rows, columns=["doc_id", "run", "what", "form", "n"])

    told = cut(parted.mapInPandas(count, f"doc_id {kind}, run int, what string, form string, n long"))
    total = told.groupBy("doc_id", "what", "form").agg(F.sum("n").alias("n"), F.count("*").alias("runs")).filter("n >= 2")
    mine = told.select("doc_id", "run", "what", "form").join(total, ["doc_id", "what", "form"]).select("doc_id", "run", "what", "form", "n")
    runs = parted.select("doc_id", "run").distinct()
    shared = total.filter("runs >= 2 AND what <> 'start' OR what IN ('paged', 'headed')").join(runs, "doc_id").select("doc_id", "run", "what", "form", "n")
    return mine.unionByName(shared).distinct()


def _context(c: pd.DataFrame) -> Context:
    of = lambda what: dict(zip(c["form"][c["what"] == what], c["n"][c["what"] == what]))
    return Context(of("line"), of("start"), (c["what"] == "paged").any(), (c["what"] == "headed").any())


def _findings(paragraphs: DataFrame, files: DataFrame, reader: Reader, rows_of, schema: str) -> DataFrame:
    """What rows_of makes of the files that were scanned.

    rows_of(index, level, texts, found, own) gives rows for one file, or for a run of a long one
    with its neighbours, of which own are its own.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    long = quality.long_files(paragraphs, quality.RUN - HALO)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in quality.whole_runs(batches):
            rows, texts = [], d["text"].tolist()
            strange = reader.strange(texts)
            doc, index, level, title = d["doc_id"].tolist(), d["para_index"].tolist(), d["level"].tolist(), d["title"].tolist()
            cuts = np.flatnonzero(np.r_[True, np.diff(d["g"].to_numpy()) != 0, True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if not _maybe_scanned(texts[a:b], strange[a:b]):
                    continue
                found = reader.file(index[a:b], level[a:b], texts[a:b], strange[a:b], title[a])
                if is_scanned(evidence(found, [True] * (b - a))):
                    rows += [(doc[a], *x) for x in rows_of(index[a:b], level[a:b], texts[a:b], found, [True] * (b - a))]
            yield pd.DataFrame(rows, columns=names)

    whole = scanned_paragraphs(paragraphs, files, long).mapInPandas(run, schema)
    if long is None:
        return whole
    parted = cut(scanned_paragraphs(paragraphs, files, long, parted=True))
    told = contexts(parted, reader)

    def read(d: pd.DataFrame, c: pd.DataFrame) -> tuple:
        d = d.drop_duplicates(["para_index", "text"]).sort_values("para_index", kind="stable")
        texts, own = d["text"].tolist(), (d["home"] == d["run"]).tolist()
        index, level = d["para_index"].tolist(), d["level"].tolist()
        return index, level, texts, reader.file(index, level, texts, reader.strange(texts), d["title"].iloc[0], _context(c)), own

    def signs(d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame(columns=["doc_id", "what", "n"])
        *_, found, own = read(d, c)
        kinds = evidence(found, own)
        return pd.DataFrame([(d["doc_id"].iloc[0], k, n) for k, n in kinds.items()], columns=["doc_id", "what", "n"])

    def rows(d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame(columns=names)
        got = rows_of(*read(d, c))
        return pd.DataFrame([(d["doc_id"].iloc[0], *x) for x in got], columns=names)

    kind = paragraphs.schema["doc_id"].dataType.simpleString()
    by = lambda x: x.groupBy("doc_id", "run")
    seen = by(parted).cogroup(by(told)).applyInPandas(signs, f"doc_id {kind}, what string, n long").groupBy("doc_id", "what").agg(F.sum("n").alias("n"))
    enough = F.when(F.col("what") == "hyphenation", F.col("n") >= 1).otherwise(F.col("n") >= 2)
    scanned = seen.filter(enough).select("doc_id").distinct()
    return whole.unionByName(by(parted).cogroup(by(told)).applyInPandas(rows, schema).join(scanned, "doc_id", "left_semi"))


def find_noise(paragraphs: DataFrame, files: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, para_index, noise_kind, found, printed): what was wrong where."""
    kind = paragraphs.schema["doc_id"].dataType.simpleString()

    def rows_of(index, level, texts, found, own):
        return [(index[i], k, f, p) for i, k, f, p in found if own[i]]

    return _findings(paragraphs, files, reader, rows_of, f"doc_id {kind}, para_index int, noise_kind string, found string, printed string")


def repaired_paragraphs(paragraphs: DataFrame, files: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, first_index, last_index, heading_level, text) of every scanned file."""
    kind = paragraphs.schema["doc_id"].dataType.simpleString()

    def rows_of(index, level, texts, found, own):
        mine = {i for i, o in zip(index, own) if o}
        return [x for x in repair(index, level, texts, found) if x[0] in mine]

    return _findings(paragraphs, files, reader, rows_of, f"doc_id {kind}, first_index int, last_index int, heading_level int, text string")


def _maybe_scanned(texts: list[str], strange: np.ndarray) -> bool:
    """Whether a closer look may find the file scanned: see is_scanned()."""
    return bool(strange.any()) or sum(t.count(" ") < 2 * HEADER_WORDS and any(c.isdigit() or c in "lIixv" for c in t) and bool(PAGE.match(t.strip()) or _LEAD.match(t.strip()) or _TAIL.match(t.strip())) for t in texts) >= 2


def evidence(found: list[tuple[int, str, str, str | None]], own: list[bool]) -> Counter[str]:
    """How often a file, or a run of it, shows what scanned files show."""
    headers = {i for i, k, _, _ in found if k == "running_header"}
    kinds: Counter[str] = Counter()
    for i, k, t, _ in found:
        if not own[i]:
            continue
        if k == "page_number":
            kinds["alone" if i not in headers else f"number {skeleton(t)}"] += 1
        elif k in ("hyphenation", "misread"):
            kinds[k] += 1
    return kinds


def is_scanned(kinds: Counter[str]) -> bool:
    """Two of a kind, or a single broken word."""
    return any(n >= (1 if k == "hyphenation" else 2) for k, n in kinds.items())
