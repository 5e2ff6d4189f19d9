"""Evaluation passages and questions that leaked into documents.

Q-gram filter: words are folded (signs that recognition mixes up made equal); a stretch of
WORDS words of which two are changed and two more hold one wrong character each still
shares LEAST q-grams of Q characters with the item, inside one band of diagonals (measured
over drawn stretches, see the tests). Counts are taken in overlapping bands of BAND
diagonals; bands that meet the bound are verified by banded alignment of words, in which
words may differ by single characters. About one word in six may be changed, added or
dropped.

Plan. The items are a fixed small table; their index is shipped with the closure, in shards
of at most MOST_ITEM_CHARS characters. Documents are only mapped: one pass hashes all
q-grams of a block of texts in numpy and keeps texts that hold enough q-grams of any item
close together; only those are counted by item, and all their bands are aligned at once,
row by row in numpy. Where there are several shards, each reads the documents once and the
alignments are put together by document before items are decided between.

Defined results: null and blank texts and items hold nothing; a first line that stands
before three or more different passages is an instruction and left out, a passage that
several items share is not; where another item fits the same stretch by nearly as many
words other than names, places and numbers, the one whose names, places and numbers agree
counts, and none if none agrees; else the words alone decide; items of one and the same
wording, and all with equal agreement, count together; copies of a document count each;
twins once.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.llm.vector_text import Codes, blocks

Q, BAND, LEAST, WINDOW = 8, 48, 12, 130
WORDS, MATCHES = 12, 9
NEAR = 0.75
MOST_ITEM_CHARS = 20_000_000
#: Bands that are aligned at once.
GROUP = 1_024
_TAG = re.compile(r"<[^<>]{1,60}>")
_JOIN = re.compile(r"(?<=[^\W\d_])(?:-|¬|\xad)[ \t]*\r?\n[>\s]*(?=[a-zß-ÿ0-9@†])|[\xad¬]\s*|(?<=[a-z])- (?=[a-z])")
_WORD = re.compile(r"[^\W_]+(?:['’@†!|-][^\W_]+)*[@†]?|[@†][^\W_]+")
_NUMBERS = re.compile(
    r"^(?:\d+|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:one|two|three|four|five|six|seven|eight|nine)?|hundred|thousand)$"
)
_FOLD = str.maketrans("01!|5@†9c6", "olllsatgeb")


def plain_words(text: str) -> list[str]:
    """Words as they are written, free of markup, line breaks and hyphens."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub("", text))
    return [w.replace("-", "").replace("’", "").replace("'", "") for w in _WORD.findall(_JOIN.sub("", text))]


def fold(word: str) -> str:
    """Lower case, with signs that are taken for each other made equal."""
    w = word.lower().translate(_FOLD).replace("rn", "m").replace("cl", "d").replace("el", "d").replace("ii", "u").replace("vv", "w")
    return w.replace("i", "l").replace("c", "e").replace("h", "b")


def _close(a: str, b: str) -> bool:
    """Equal but for a character in five."""
    la, lb = len(a), len(b)
    most = max(la, lb) // 5
    if not most or abs(la - lb) > most or a[0] != b[0] and a[-2:] != b[-2:]:
        return False
    row = list(range(lb + 1))
    for i in range(1, la + 1):
        left, row[0] = row[0], i
        for j in range(1, lb + 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a[i - 1] != b[j - 1]))
        if min(row) > most:
            return False
    return row[lb] <= most


def _signs(word: str) -> int:
    """Its characters as a set of bits: words k edits apart differ in 2 k bits at most."""
    return sum({1 << (ord(c) & 63) for c in word})


#: Columns of a fit: an alignment of an item with words first to last of a text. clear: long
#: and like enough to be a leak; wording: number of the item's text, the same for equal texts.
FIT = ("item_id", "wording", "agree", "clash", "matches", "first", "last", "clear")


def decided(fits: np.ndarray) -> dict[int, tuple[int, int]]:
    """item_id -> (matches, agree) of the best of the fits that are leaks. fits: rows of FIT."""
    item, wording, agree, clash, matches, first, last, clear = fits.T
    named = (agree >= 2) & ((clash == 0) | (clash == 1) & (agree >= 3))
    plain = matches - agree
    found: dict[int, tuple[int, int]] = {}
    for x in np.flatnonzero(clear)[np.lexsort((matches[clear > 0], agree[clear > 0]))[::-1]]:
        over = (item != item[x]) & (wording != wording[x]) & (np.minimum(last, last[x]) - np.maximum(first, first[x]) > 0.5 * (last[x] - first[x]))
        rivals = over & (plain >= NEAR * plain[x])
        # a single name decides if nothing speaks against it and no rival has one
        if rivals.any() and not named[x] and (agree[x] != 1 or clash[x] or (agree[rivals] > 0).any()):
            continue
        # another item may own the same stretch by more of its names
        if int(item[x]) not in found and not (over & (clear > 0) & named & ((agree > agree[x]) | (agree == agree[x]) & (matches > matches[x]))).any():
            found[int(item[x])] = (int(matches[x]), int(agree[x]))
    return found


class LeakIndex:
    """q-gram index of passages and questions."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], among: list[tuple[int, str | None, str | None]] | None = None):
        """among: all items, where these are a shard of them."""
        among = items if among is None else among
        after = defaultdict(set)
        for _, p, _ in among:
            head, _, rest = (p or "").strip().partition("\n")
            if rest.strip():
                after[head.strip()].add(rest.strip())
        instructions = {x for x, rests in after.items() if len(rests) >= 3}
        common = Counter(w for _, p, q in among for t in (p, q) if t for w in set(re.findall(r"[^\W\d_]+", t)))
        ids, named, texts, self.vocabulary = [], [], [], {}
        self.item_id, self.wording, flat = [], [], []
        for item_id, passage, question in items:
            head, _, rest = (passage or "").strip().partition("\n")
            for text in (rest if head.strip() in instructions else passage or "", question or ""):
                words = plain_words(text)
                if not words:
                    continue
                # names, places and numbers: capitals that aren't just the start of a sentence
                low = {w.lower() for w in words if w.islower()}
                named += [bool(_NUMBERS.match(w.lower())) or w[:1].isupper() and w.lower() not in low and not (common[w.lower()] or common[w] > 0.15 * len(among) + 3) for w in words]
                folded = [fold(w) for w in words]
                texts.append(" ".join(folded))
                self.item_id.append(item_id)
                self.wording.append(int.from_bytes(hashlib.blake2b(texts[-1].encode("utf-8", "replace"), digest_size=7).digest()))
                flat += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in folded]
                ids.append(len(words))
        self.named, self.flat = np.array(named, dtype=bool), np.array(flat, dtype=np.int64)
        self.length = np.array(ids, dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.spelt = list(self.vocabulary)
        self.signs, self.sizes = np.array([_signs(w) for w in self.spelt], dtype=np.uint64), np.array([len(w) for w in self.spelt], dtype=np.int64)
        self.names = {self.spelt[i] for i in np.unique(self.flat[self.named])}
        gram, owner, place = [], [], []
        for a, b in blocks(texts):
            c = Codes(texts[a:b])
            at = np.arange(max(0, len(c.codes) - Q + 1))
            who = c.text_of(at)
            inside = at + Q <= c.ends[who] - 1
            at, who = at[inside], who[inside]
            gram.append(c.hashes(at, at + Q))
            owner.append(who + a)
            place.append(at - c.starts[who])
        none = np.zeros(0, dtype=np.int64)
        g = np.concatenate(gram) if gram else none.astype(np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams = g[order]
        self.owner = np.concatenate(owner)[order].astype(np.int64) if gram else none
        self.place = np.concatenate(place)[order].astype(np.int64) if gram else none
        self.known, self.first = np.unique(self.grams, return_index=True)
        self.count = np.diff(np.r_[self.first, len(self.grams)])
        # number of the word that a character of an item belongs to, its items laid end to end
        sizes = self.sizes[self.flat] + 1
        self.word_at = np.repeat(np.arange(len(self.flat)), sizes) - np.repeat(self.offset, np.bincount(np.repeat(np.arange(len(ids)), self.length), sizes, minlength=len(ids)).astype(np.int64))
        self.char_offset = np.r_[0, np.cumsum([len(t) + 1 for t in texts])][:-1].astype(np.int64)

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Folded texts with enough q-grams of any item in one window: number, places, and q-gram numbers."""
        if not len(self.known):
            return
        for a, b in blocks(texts):
            c = Codes(texts[a:b])
            n = len(c.codes)
            if n < Q:
                continue
            at = np.arange(n - Q + 1)
            h = c.hashes(at, at + Q)
            i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[i] == h
            run = np.r_[0, np.cumsum(hit)]
            dense = run[np.minimum(at + WINDOW, n - Q + 1)] - run[at] >= LEAST
            if not dense.any():
                continue
            for t in np.unique(c.text_of(at[dense])):
                s, e = c.starts[t], max(c.starts[t], c.ends[t] - Q)
                own = np.flatnonzero(hit[s:e])
                if len(own) >= LEAST:
                    yield a + int(t), own, i[s:e][own]

    def bands(self, starts: np.ndarray, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Rows (item, first and last word of it, first and last diagonal of words) of the bands that meet the bound.

        starts: where the words of the text start; at, gram: as candidates() gives them.
        """
        many = self.count[gram]
        pos = np.repeat(at, many)
        idx = np.repeat(self.first[gram] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        item, half = self.owner[idx], BAND // 2
        level = (pos - self.place[idx]) // half
        level -= level.min()
        wide = int(level.max()) + 3
        # a band has two neighbouring levels; hits in bands that can't meet the bound go first
        key = item * wide + level + 1
        if len(self.item_id) * wide <= 4_000_000:
            counts = np.bincount(key, minlength=len(self.item_id) * wide + 1)
            below, here, above = counts[key - 1], counts[key], counts[key + 1]
        else:
            some, where, n = np.unique(key, return_inverse=True, return_counts=True)
            here = n[where]
            around = [np.minimum(np.searchsorted(some, some + d), len(some) - 1) for d in (-1, 1)]
            below, above = (np.where(some[x] == some + d, n[x], 0)[where] for x, d in zip(around, (-1, 1)))
        low, high = below + here >= LEAST, here + above >= LEAST
        both = np.concatenate([key[low] - 1, key[high]])
        if not len(both):
            return np.zeros((0, 5), dtype=np.int64)
        who = np.concatenate([np.flatnonzero(low), np.flatnonzero(high)])
        order = np.argsort(both, kind="stable")
        both, who = both[order], who[order]
        edge = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        own = item[who]
        wi = self.word_at[self.char_offset[own] + self.place[idx[who]]]
        shift = np.searchsorted(starts, pos[who], side="right") - 1 - wi
        least, most = np.minimum.reduceat, np.maximum.reduceat
        which = own[edge]
        rows = np.stack([which, np.maximum(0, least(wi, edge) - 12), np.minimum(self.length[which], most(wi, edge) + 13), least(shift, edge) - 4, most(shift, edge) + 4], 1)
        return np.unique(rows, axis=0)


class Aligner:
    """Aligns bands of many texts at once; remembers which words are close."""

    MOST_KEPT = 200_000

    def __init__(self, index: LeakIndex):
        self.index, self._near, self._folded = index, {}, {}

    def folded(self, words: list[str]) -> list[str]:
        if len(self._folded) > self.MOST_KEPT:
            self._folded.clear()
        own = self._folded
        for w in words:
            if w not in own:
                own[w] = fold(w)
        return [own[w] for w in words]

    def near(self, word: str) -> list[int]:
        """Numbers of the words of items that are the same or close."""
        if (got := self._near.get(word)) is None:
            x = self.index
            most = np.maximum(x.sizes, len(word)) // 5
            like = np.flatnonzero((np.abs(x.sizes - len(word)) <= most) & (np.bitwise_count(x.signs ^ np.uint64(_signs(word))) <= 2 * most))
            got = [i for i in like.tolist() if x.spelt[i] == word or _close(x.spelt[i], word)]
            if word in x.vocabulary and x.vocabulary[word] not in got:
                got.append(x.vocabulary[word])
            if len(self._near) > self.MOST_KEPT:
                self._near.clear()
            self._near[word] = got
        return got

    def able(self, folded: list[str], bands: np.ndarray) -> np.ndarray:
        """Which bands can hold a leak at all, by the words of the item that stand anywhere in the text.

        A leak has a run of WORDS words of the item of which nine are there, or seven and two names.
        """
        x = self.index
        there = np.zeros(len(x.spelt) + 1, dtype=bool)
        for w in set(folded):
            there[self.near(w)] = True
        have = there[x.flat]
        count, named = np.r_[0, np.cumsum(have)], np.r_[0, np.cumsum(have & x.named)]
        n = len(have)
        until = np.minimum(np.arange(n) + WORDS, n)
        run = count[until] - count[:n]
        full, some = np.r_[0, np.cumsum(run >= 9)], np.r_[0, np.cumsum(run >= 7)]
        a, b = x.offset[bands[:, 0]] + bands[:, 1], x.offset[bands[:, 0]] + bands[:, 2]
        last = np.maximum(a + 1, b - WORDS + 1)  # where a run may start
        return (full[last] > full[a]) | (some[last] > some[a]) & (named[b] - named[a] >= 2)

    def fits(self, texts: list[tuple[list[str], list[str]]], bands: np.ndarray, leaks_only: bool = False) -> np.ndarray:
        """texts: written and folded words; bands: number of the text, then as LeakIndex.bands() gives them.

        Returns the number of the text and FIT of every band that has an alignment;
        leaks_only: bands whose words, in the band, are too few for a leak are left out.
        """
        x = self.index
        size = np.array([len(f) for _, f in texts], dtype=np.int64)
        offset = np.cumsum(size) - size
        bands = bands[np.argsort(bands[:, 2] - bands[:, 3], kind="stable")]
        text, item, i0, i1, low, high = bands.T
        # words that stand in no band are never looked at
        met = np.zeros(int(size.sum()) + 1, dtype=np.int64)
        np.add.at(met, np.clip(i0 + low, 0, size[text]) + offset[text], 1)
        np.add.at(met, np.clip(i1 + high, 0, size[text]) + offset[text], -1)
        met = np.cumsum(met)[:-1] > 0
        local: dict[str, int] = {}
        word, other = np.zeros(len(met), dtype=np.int64), np.zeros(len(met), dtype=bool)
        for k, a, b in zip(range(len(texts)), offset.tolist(), (offset + size).tolist()):
            written, folded = texts[k]
            for i in np.flatnonzero(met[a:b]).tolist():
                w, f = written[i], folded[i]
                word[a + i] = local.setdefault(f, len(local))
                # what speaks against a name of an item
                other[a + i] = f in x.names or bool(_NUMBERS.match(w.lower())) or w[:1].isupper() and not w.isupper()
        rows, width = i1 - i0, high - low + 1
        item_words = np.unique(np.concatenate([x.flat[x.offset[k] + a : x.offset[k] + b] for k, a, b in zip(item, i0, i1)]))
        here = np.full(len(x.spelt), -1)
        here[item_words] = np.arange(len(item_words))
        same = np.zeros((len(item_words), len(local)), dtype=bool)
        for w, u in local.items():
            if own := self.near(w):
                at = here[own]
                same[at[at >= 0], u] = True
        same = same.ravel()
        n, wide = len(bands), int(width.max())
        col = np.arange(wide)
        j = (i0 + low)[:, None] + col[None, :]
        inside_band = col[None, :] < width[:, None]

        def hits(t: int, m: int) -> tuple[np.ndarray, ...]:
            """Of row t of the first m bands: places in the text, which are in the band, where their words lie, matches, words of items."""
            at = j[:m] + t
            ok = inside_band[:m] & (at >= 0) & (at < size[text[:m]][:, None])
            where = np.where(ok, at + offset[text[:m]][:, None], 0)
            iw = x.offset[item[:m]] + i0[:m] + t
            return at, ok, where, same[here[x.flat[iw]][:, None] * len(local) + word[where]] & ok, iw

        if leaks_only:
            have, named = np.zeros((n, int(rows.max()) + 1), dtype=np.int32), np.zeros(n, dtype=np.int64)
            for t in range(int(rows.max())):
                m = int(np.searchsorted(-rows, -t))
                *_, hit, iw = hits(t, m)
                some = hit.any(1)
                have[:m, t + 1] = some
                named[:m] += some & x.named[iw]
            have = np.cumsum(have, 1)
            run = (have[:, WORDS:] - have[:, :-WORDS]).max(1) if have.shape[1] > WORDS else have[:, -1]
            keep = (run >= 9) | (run >= 7) & (named >= 2)
            if not keep.any():
                return np.zeros((0, 1 + len(FIT)), dtype=np.int64)
            text, item, i0, i1, low, high, rows, width, j, inside_band = (a[keep] for a in (text, item, i0, i1, low, high, rows, width, j, inside_band))
            n = len(text)
        # score, and packed: start in item and text; matches, agreeing and disagreeing names
        score = np.zeros((n, wide + 1), dtype=np.int32)
        start, tally = np.zeros((n, wide + 1), dtype=np.int64), np.zeros((n, wide + 1), dtype=np.int64)
        best, best_start, best_tally = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        end_i, end_j = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        one, agree_1, clash_1 = 1 << 42, 1 << 21, 1
        for t in range(int(rows.max())):
            m = int(np.searchsorted(-rows, -t))  # bands of more than t rows
            i = i0[:m] + t
            at, ok, where, hit, iw = hits(t, m)
            name = x.named[iw][:, None]
            d, ds, dt = score[:m, :wide], start[:m, :wide], tally[:m, :wide]
            fresh = d <= 0
            cell = np.where(hit, np.where(fresh, 2, d + 2), d - 3)
            cs = np.where(hit & fresh, (i[:, None] << 32) + at, ds)
            ct = np.where(hit, np.where(fresh, 0, dt) + one + name * agree_1, dt + (name & other[where]) * clash_1)
            up = score[:m, 1:] - 3
            take = up > cell
            cell = np.where(take, up, cell)
            cs, ct = np.where(take, start[:m, 1:], cs), np.where(take, tally[:m, 1:], ct)
            cell = np.where(ok & (cell > 0), cell, 0)
            # words of the text that the item lacks: carried to the right at 3 each
            level = cell + 3 * col[None, :].astype(np.int32)
            top = np.maximum.accumulate(level, axis=1)
            source = np.maximum.accumulate(np.where(level == top, col[None, :], 0), axis=1)
            cell = np.where(ok, np.maximum(top - 3 * col[None, :].astype(np.int32), 0), 0)
            cs, ct = np.take_along_axis(cs, source, 1), np.take_along_axis(ct, source, 1)
            score[:m, :wide], start[:m, :wide], tally[:m, :wide] = cell, cs, ct
            most = cell.argmax(1)
            row = np.arange(m)
            better = np.flatnonzero(cell[row, most] > best[:m])
            k = most[better]
            best[better], best_start[better], best_tally[better] = cell[better, k], cs[better, k], ct[better, k]
            end_i[better], end_j[better] = i[better], at[better, k]
        si, sj = best_start >> 32, best_start & 0xFFFFFFFF
        matches, agree, clash = best_tally >> 42, (best_tally >> 21) & 0x1FFFFF, best_tally & 0x1FFFFF
        span = np.maximum(end_i - si, end_j - sj) + 1
        clear = (span >= WORDS) & (matches >= np.maximum(MATCHES, 0.7 * span))
        # without agreeing names the words alone must keep the edit budget
        named = (agree >= 2) & ((clash == 0) | (clash == 1) & (agree >= 3))
        clear &= named | (matches >= span - np.round(span / 6))
        ids, wording = np.array(x.item_id, dtype=np.int64), np.array(x.wording, dtype=np.int64)
        out = np.stack([text, ids[item], wording[item], agree, clash, matches, sj, end_j, clear], 1)
        return np.unique(out[best > 0], axis=0)


def fits_of(index: LeakIndex, aligner: Aligner, texts: list[str], every: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, rows of FIT) of texts that an item fits well enough to be a leak.

    Bands that can hold a leak are aligned first, then those that share its stretch; every:
    all bands of all texts.
    """
    words = [plain_words(t) for t in texts]
    folded = [aligner.folded(w) for w in words]
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def aligned(part: list[tuple[int, np.ndarray]], leaks_only: bool) -> dict[int, np.ndarray]:
        own = [(words[t], folded[t]) for t, _ in part]
        group = np.concatenate([np.column_stack([np.full(len(b), k), b]) for k, (_, b) in enumerate(part)])
        # bands of like size go together
        wide = group[:, 5] - group[:, 4]
        group = group[np.lexsort((group[:, 2] - group[:, 3], np.minimum(wide // 8, 3)))]
        got = np.concatenate([aligner.fits(own, group[a : a + GROUP], leaks_only) for a in range(0, len(group), GROUP)])
        return {t: got[got[:, 0] == k][:, 1:] for k, (t, _) in enumerate(part)}

    def done() -> Iterator[tuple[int, np.ndarray]]:
        first = aligned([(t, b[able]) for t, b, able in waiting], not every)
        rest = []
        for t, b, able in waiting:
            sure = first[t][first[t][:, -1] > 0]
            near = ~able & ((b[:, 1] + b[:, 3])[:, None] <= sure[None, :, 6]).any(1) & ((b[:, 2] + b[:, 4])[:, None] >= sure[None, :, 5]).any(1)
            if near.any():
                rest.append((t, b[near]))
        more = aligned(rest, False) if rest else {}
        for t, fits in first.items():
            if fits[:, -1].any() or every and len(fits):
                yield t, np.unique(np.concatenate([fits, more[t]]) if t in more else fits, axis=0)

    n = 0
    for t, at, gram in index.candidates([" ".join(f) for f in folded]):
        starts = np.cumsum([0] + [len(w) + 1 for w in folded[t]])
        b = index.bands(starts, at, gram)
        able = np.ones(len(b), dtype=bool) if every else aligner.able(folded[t], b)
        if able.any():
            waiting.append((t, b, able))
            n += int(able.sum())
        if n >= 4 * GROUP:
            yield from done()
            waiting, n = [], 0
    if waiting:
        yield from done()


def find_leaks(documents: DataFrame, index: LeakIndex | list[LeakIndex]) -> DataFrame:
    """(doc_id, item_id, matched_words, named_words) for every item a document leaks."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shards = index if isinstance(index, list) else [index]
    out = f"doc_id {kind}, item_id long, matched_words int, named_words int"
    texts = documents.filter("text IS NOT NULL").select("doc_id", "text")

    def rows_of(doc_id, fits: np.ndarray) -> list[tuple]:
        return [(doc_id, item, matches, agree) for item, (matches, agree) in decided(fits).items()]

    if len(shards) == 1:
        only = shards[0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            aligner = Aligner(only)
            for d in batches:
                ids = d["doc_id"].tolist()
                rows = [r for t, fits in fits_of(only, aligner, d["text"].tolist()) for r in rows_of(ids[t], fits)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "named_words"])

        return texts.mapInPandas(run, out)

    columns = ", ".join(f"{c} long" for c in FIT)

    def fitted(shard: LeakIndex) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            aligner = Aligner(shard)
            for d in batches:
                ids, rows = d["doc_id"].tolist(), []
                for t, fits in fits_of(shard, aligner, d["text"].tolist(), every=True):
                    rows += [(ids[t], *f) for f in fits.tolist()]
                yield pd.DataFrame(rows, columns=["doc_id", *FIT])

        return texts.mapInPandas(run, f"doc_id {kind}, {columns}")

    def choose(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rows_of(d["doc_id"].iloc[0], d[list(FIT)].to_numpy(np.int64)), columns=["doc_id", "item_id", "matched_words", "named_words"])

    union = fitted(shards[0])
    for shard in shards[1:]:
        union = union.unionByName(fitted(shard))
    # a document has at most one row for each band of an item
    return union.groupBy("doc_id").applyInPandas(choose, out)


def index_of(items: DataFrame, most_chars: int = MOST_ITEM_CHARS) -> LeakIndex | list[LeakIndex]:
    """items: item_id, passage, question. Shards of at most most_chars characters, or of one item."""
    rows = [(r.item_id, r.passage, r.question) for r in items.select("item_id", "passage", "question").distinct().orderBy("item_id", "passage", "question").collect()]
    parts, size = [[]], 0
    for r in rows:
        n = len(r[1] or "") + len(r[2] or "")
        if parts[-1] and size + n > most_chars:
            parts.append([])
            size = 0
        parts[-1].append(r)
        size += n
    shards = [LeakIndex(p, rows) for p in parts]
    return shards[0] if len(shards) == 1 else shards
