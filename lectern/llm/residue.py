"""Template residue, filler, error pages and script notices in documents.

A multinomial logistic model with an L2 penalty judges every segment (a sentence of a
line) from hashed word n-grams, the shapes of signs around words, length and place. It is
fitted on segments with weak labels: phrases, status lines and the forms of unfilled
fields; what stands in quotation marks or code is cut out before, so that texts about such
things teach the model what is not residue. At most MOST_EACH segments of each label are
drawn by a hash of their place, so a line that stands often is drawn often; each counts
for as many as it was drawn from, so the shares of the labels, and with them the results,
don't follow the bound. The model also sees the phrases that gave the labels alone, and error
and script segments without them. Sources whose hash falls into the held-out part, and
phrases withheld in turn, serve to validate.

Plan. Documents are mapped only. Fitting takes bounded draws: a task hands on at most the
bound of each label, the first by hash of them all are taken. The model (2**18 weights a
class) goes to the workers with the closure.

Defined results: null and blank texts are no cases; a document counts if any segment is
residue with probability LEAST or more; copies of a document count each; twins once;
texts of any length are read whole, sentences of more than LONG characters as runs that
overlap by half; no weak label at all gives no case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.vector_text import LinearModel, hashed_features
from lectern.session import cut

CLASSES = ("clean", "placeholder", "filler", "error", "script")
BITS = 18
MOST_EACH = 4_000
#: Below a half, since residue that stays costs more than a text that goes.
LEAST = 0.3
LONG = 300

#: Words of the customary dummy text.
DUMMY = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat proident sunt culpa officia deserunt mollit anim laborum purus donec mauris vitae quam felis arcu metus tortor ligula nunc lectus justo porta "
    "augue cursus".split()
)
#: Kinds of things that a server fails to give.
_THING = r"(?:page|resource|record|file|document|lesson|article|url|site|item|entry)"
_SCRIPTS = r"(?:java ?script|scripts?|scripting)"
#: The weak labels, as patterns over a segment without its quotations and code.
WEAK = {
    "placeholder": re.compile(
        r"\{\{[^{}]{1,40}\}\}|\$\{[^{}]{1,40}\}|\{%[^%{}]{1,60}%\}|<%=?[^%<>]{1,60}%>|<<[^<>]{1,40}>>|@@\w{1,40}@@|(?<!\w)__[A-Za-z]\w*?__(?!\w)|\[\[[^\[\]]{1,40}\]\]"
        r"|(?<![\w%])%[A-Za-z_]{2,40}%(?!\w)|<[\w ]{1,40} goes here>|\[(?:your|insert|enter|add|type|fill in)\b[^\[\]]{0,40}\]|(?<![\w$])\{[A-Za-z_]{2,40}\}"
        r"|\[(?:name|first name|last name|date|title|company|amount|author|address|unit|clause|teacher|summary|order_id|student_name|email)\]"
        r"|\bundefined\b.*\b(?:NaN|undefined|null|Invalid Date)\b|\bInvalid Date\b|^TBD\b|\bTBD[.:]?$|\[object Object\]|^TODO:",
        re.I,
    ),
    "filler": re.compile(
        r"\b(?:type|enter|add|put|insert|write) your (?:content|text|own (?:text|words)|title|summary) here\b|\bcontent coming soon\b|^coming soon[.!]?$|^sample text\b|\bthis is placeholder (?:copy|text)\b"
        r"|^(?:#+ )?(?:title|heading|subtitle|text|body|content|summary|your text) (?:goes )?here\.?$|^#+ heading(?: \d)?$|^replace this (?:paragraph|text)\b|\bthis page (?:is|was) intentionally left blank\b",
        re.I,
    ),
    "error": re.compile(
        r"^(?:error|http(?: status| error)?)[\s:–-]*[45]\d\d\b|^[45]\d\d[\s:–-]+(?:bad request|unauthori[sz]ed|forbidden|(?:page )?not found|request time-?out|gone|too many requests|internal (?:server )?(?:error|failure)|bad gateway|service unavailable|gateway time-?out)\b"
        rf"|^(?:the )?{_THING} (?:was |could )?not (?:be )?found\b|^access (?:is |was )?denied\b|^too many requests\b|^traceback \(most recent call last\)|^at [\w.$]+\([\w.]+:\d+\)|^\w+(?:Error|Exception): |\bdatabase connection failed\b"
        r"|^seite nicht gefunden\b|^página no encontrada\b|^page (?:non trouvée|introuvable)\b|^accès refusé\b|^zugriff verweigert\b|^acceso denegado\b|\byour session has (?:expired|timed out)\b|^(?:sorry|oops)\b.{0,20}\bsomething went wrong\b|^you do not have permission to (?:open|view|access|see)\b"
        rf"|^the requested {_THING} (?:has been|was|could|cannot|is)\b|^we (?:could|can) ?not load (?:this|the) {_THING}\b",
        re.I,
    ),
    "script": re.compile(
        rf"\b(?:please|you (?:need|have|must)|bitte|veuillez|por favor)\b[^.]{{0,40}}\b{_SCRIPTS}\b|^turn on {_SCRIPTS}\b|\b(?:this|the) (?:site|page|app|application|reader|viewer)\b[^.]{{0,20}}\b(?:needs?|requires?)\b[^.]{{0,20}}\b{_SCRIPTS}\b"
        rf"|\byour browser\b[^.]{{0,40}}\b{_SCRIPTS}\b|^java ?script (?:is|has been) (?:disabled|turned off|switched off|not enabled)\b|^checking your browser\b|\(noscript\)$",
        re.I,
    ),
}
#: A line that is only a status code counts where it opens the text.
_STATUS = re.compile(r"^[45]\d\d$")
#: What any segment with a weak label holds in lower case, so that patterns are tried on few.
_SIGNS = (
    "{ < @@ __ [ % undefined invalid|date tbd todo: here coming|soon sample|text placeholder replace|this intentionally # not|found not|be|found denied too|many traceback .java: .py: .js: .php: error exception "
    "connection|failed nicht|gefunden no|encontrada introuvable trouvée refusé verweigert denegado session went|wrong permission the|requested not|load script browser gone forbidden gateway unavailable unauthori bad|request http"
).replace("|", "\x00").split()
#: Classes whose labelling phrase is hidden in a second copy.
MASKED = ("error", "script")
_QUOTED = re.compile(r"\"[^\"\n]{0,80}\"|“[^”\n]{0,80}”|„[^“\n]{0,80}“|«[^»\n]{0,80}»|`[^`\n]{1,80}`")
_SENTENCE = re.compile(r"(?<=[^\s\d][.!?])\s+(?=[A-ZÀ-Ý\[{<%@_$])")
_SHAPE = re.compile(r"[^\w\s.,;:!?'’\"“”()-]{1,3}=?\s?(?:\w+\s?){1,4}[^\w\s.,;:!?'’\"“”()-]{1,3}|(?<![A-Za-z0-9])_{2}\w+?_{2}")
#: Clean segments with words or signs that residue has, of which more are drawn.
_NEAR = re.compile(r"_{3,}|[\[\]{}<>%$@#|]|\b(?:scripts?|javascript|errors?|page|found|text|sample|status|browser|code|enable|error|denied|needs?|content|qquote)\b|\d{3}", re.I)
NEAR = len(CLASSES)
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_LETTERS = re.compile(r"[a-zà-ÿ]+")
_WORDS = re.compile(r"[A-Za-zÀ-ÿ]\w*")


def pieces(sentence: str) -> list[str]:
    """A sentence of more than LONG characters as runs of words that overlap by half."""
    if len(sentence) <= LONG:
        return [sentence]
    out, start = [], 0
    while start + LONG < len(sentence):
        end = sentence.rfind(" ", start + LONG * 3 // 4, start + LONG + 1)
        out.append(sentence[start : end if end > 0 else start + LONG].strip())
        mid = sentence.find(" ", start + LONG // 2, start + LONG * 3 // 4)
        start = mid + 1 if mid > 0 else start + LONG // 2
    return [x for x in (*out, sentence[start:].strip()) if x]


def segments(text: str) -> list[tuple[str, int]]:
    """(segment without quotations and code, place: 0 first, 1 within, 2 last)."""
    out, code = [], False
    for line in text.split("\n"):
        line = line.strip()
        if line[:3] in ("```", "~~~"):
            code = not code
            continue
        if code or not line:
            continue
        if '"' in line or "`" in line or "“" in line or "„" in line or "«" in line:
            line = _QUOTED.sub(" qquote ", line)
        for x in _SENTENCE.split(line):
            if len(x) <= LONG:
                out.append(x)
            else:
                out += pieces(x)
    last = len(out) - 1
    return [(s, 0 if i == 0 else 2 if i == last else 1) for i, s in enumerate(out)]


def _automaton():
    """Finds any of _SIGNS or DUMMY in one pass; None where the library is missing."""
    try:
        import ahocorasick
    except ImportError:
        return None
    found = ahocorasick.Automaton()
    for x in (*(x.replace("\x00", " ") for x in _SIGNS), *(x for x in DUMMY if len(x) > 3)):
        found.add_word(x, True)
    found.make_automaton()
    return found


_SIGN_FINDER: list = []


def weak_label(segment: str, place: int = 1) -> tuple[int, re.Match | None]:
    """Number of the class whose phrases or forms the segment holds, 0 for none, and what matched.

    A word said over and over and sentences mostly of dummy words are filler.
    """
    if not _SIGN_FINDER:
        _SIGN_FINDER.append(_automaton())
    low = segment.lower()
    if place == 0 and _STATUS.match(segment):
        return CLASSES.index("error"), None
    start = low.split(None, 4)
    if len(start) >= 4 and start[0] == start[1] == start[2] == start[3].rstrip(".,"):
        return CLASSES.index("filler"), None
    if _SIGN_FINDER[0] is not None and next(_SIGN_FINDER[0].iter(low), None) is None and low[:1] not in "45":
        return 0, None
    words = _LETTERS.findall(low)
    if len(words) >= 4 and sum(w in DUMMY for w in words) * 10 >= 7 * len(words):
        return CLASSES.index("filler"), None
    for name, pattern in WEAK.items():
        if m := pattern.search(segment):
            return CLASSES.index(name), m
    return 0, None


def _letters(sign: str) -> str:
    return "".join(chr(97 + ord(c) % 26) + chr(97 + ord(c) // 26 % 26) for c in sign)


def shaped(segment: str, place: int, title: str | None) -> str:
    """The segment with tokens for the signs around words, length, place and title."""
    n = segment.count(" ") + 1
    extra = [f"zlen{'abcdefgh'[min(7, n // 3)]}", f"zplace{'abc'[place]}", "ztitled" if title else "zuntitled"]
    if title and segment.lower().lstrip("# ") == title.lower():
        extra.append("zistitle")
    for m in _SHAPE.finditer(segment):
        left, right = re.match(r"[\W_]*", m.group(0)).group(0).strip(), re.search(r"[\W_]*$", m.group(0)).group(0).strip()
        extra.append(f"zshape{_letters(left)}zz{_letters(right)}")
    words = _LETTERS.findall(segment.lower())
    if words:
        extra.append(f"zdummy{'abcd'[min(3, 4 * sum(w in DUMMY for w in words) // len(words))]}")
        extra.append(f"zsame{'abcd'[min(3, 4 * max(Counter(words).values()) // len(words))]}")
    return f"{segment.lower()} {' '.join(extra)}"


def _features(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_features(rows, BITS, words=3)


def host(source: Column) -> Column:
    """Source in one spelling."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(source, F.lit("")))), r"[\s_-]+", "_")


def masked(segment: str, place: int, title: str | None, k: int, match: re.Match | None) -> str | None:
    """The segment without the phrase that gave its label, if three words are left."""
    if match is None or CLASSES[k] not in MASKED:
        return None
    rest = segment[: match.start()] + " " + segment[match.end() :]
    return shaped(rest.strip(), place, title) if len(_LETTERS.findall(rest.lower())) >= 3 else None


def alone(place: int, title: str | None, k: int, match: re.Match | None) -> str | None:
    """The phrase that gave the label and nothing else; of a placeholder the form, whatever its name."""
    if match is None:
        return None
    return shaped(_WORDS.sub("qname", match.group(0)) if CLASSES[k] == "placeholder" else match.group(0), place, title)


def labelled(documents: DataFrame, most_each: int = MOST_EACH) -> pd.DataFrame:
    """shaped, hidden, alone, label, phrase, host, weight: bounded draws of the segments of each label.

    Segments are drawn by a hash of document, place and words: most_each with each weak
    label, three times as many clean ones, and as many of the clean ones near to residue
    (short, or with its words and signs). weight: of how many segments one was drawn.
    hidden: the segment without what gave the label; alone: only that. What is drawn doesn't depend on how
    the documents are spread.
    """
    bound = [most_each * (1 if 0 < k < NEAR else 3) for k in range(NEAR + 1)]
    # about ten times the clean segments needed pass this bar where documents have ten segments
    bar = int(min(1.0, bound[0] / max(1, documents.count())) * 2**32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple]] = [[] for _ in bound]
        total = [0] * len(bound)
        for d in batches:
            for key, text, title, own in zip(d["doc_id"].astype(str), d["text"], d["title"], d["host"]):
                seed = zlib.crc32(key.encode())
                for i, (s, p) in enumerate(segments(text)):
                    k, m = weak_label(s, p)
                    if not k and (len(s) < 40 or _NEAR.search(s)):
                        k = NEAR
                    total[k] += 1
                    h = zlib.crc32(b"%d %s" % (i, s.encode("utf-8", "replace")), seed)
                    if 0 < k < NEAR or h < bar:
                        kept[k].append((h, s, p, title, own, m))
            for k, rows in enumerate(kept):
                if len(rows) > 2 * bound[k]:
                    kept[k] = sorted(rows, key=lambda x: (x[0], x[1]))[: bound[k]]
        rows = []
        for k, own in enumerate(kept):
            label = 0 if k == NEAR else k
            for h, s, p, title, host_, m in sorted(own, key=lambda x: (x[0], x[1]))[: bound[k]]:
                rows.append((h, k, shaped(s, p, title), masked(s, p, title, label, m), alone(p, title, label, m), m.group(0).lower() if m else None, host_, 1))
        rows += [(None, k, None, None, None, None, None, n) for k, n in enumerate(total) if n]
        yield pd.DataFrame(rows, columns=["h", "stratum", "shaped", "hidden", "alone", "phrase", "host", "n"])

    texts = documents.filter("text IS NOT NULL").select("doc_id", "text", "title", host(F.col("source")).alias("host"))
    got = cut(texts.mapInPandas(run, "h long, stratum int, shaped string, hidden string, alone string, phrase string, host string, n long"))
    total = {r.stratum: r.n for r in got.filter("h IS NULL").groupBy("stratum").agg(F.sum("n").alias("n")).collect()}
    parts = []
    for k in total:
        own = got.filter((F.col("stratum") == k) & F.col("h").isNotNull()).drop("n").orderBy("h", "shaped").limit(bound[k]).toPandas()
        parts.append(own.assign(weight=total[k] / max(1, len(own))))
    if not parts:
        return pd.DataFrame(columns=["shaped", "hidden", "alone", "label", "phrase", "host", "weight"])
    rows = pd.concat(parts, ignore_index=True)
    return rows.assign(label=rows["stratum"].where(rows["stratum"] != NEAR, 0).astype(int)).drop(columns=["h", "stratum"])


def held_out(hosts: pd.Series) -> np.ndarray:
    """About a fifth of the hosts, by a fixed hash of their names."""
    return hosts.fillna("").map(lambda x: sum((i + 1) * ord(c) for i, c in enumerate(x)) % 5 == 2).to_numpy(dtype=bool)


def fit(rows: pd.DataFrame, l2: float = 1e-7, epochs: int = 12) -> LinearModel:
    """rows: as labelled() gives them."""
    copies = [rows[rows[c].notna()] for c in ("hidden", "alone")]
    rows = pd.concat([rows, *(x.assign(shaped=x[c], weight=x["weight"] / 2) for x, c in zip(copies, ("hidden", "alone")))], ignore_index=True)
    rows = rows.groupby(["shaped", "label"], as_index=False).agg(weight=("weight", "sum"))
    owner, feat = _features(rows["shaped"].tolist())
    weight = rows["weight"].to_numpy(dtype=float)
    return LinearModel.fit(owner, feat, rows["label"].to_numpy(), 1 << BITS, len(CLASSES), l2=l2, epochs=epochs, weight=weight / weight.mean())


def _residue_shares(model: LinearModel, shaped_rows: list[str]) -> np.ndarray:
    return model.scores(*_features(shaped_rows), len(shaped_rows))


def validate(rows: pd.DataFrame) -> list[tuple[str, str, int, float, float]]:
    """(way, class, segments, precision, recall), weighted by what segments stand for.

    way 'host': against the weak labels of hosts not seen in fitting. way 'phrase': recall
    of the segments whose phrases (a fifth of them, by hash) gave no labels in fitting;
    precision there is that among them and the clean segments.
    """
    out = []
    phrase_out = rows["phrase"].fillna("").map(lambda x: bool(x) and zlib.crc32(x.encode()) % 5 == 2).to_numpy(dtype=bool)
    for way, mask in (("host", held_out(rows["host"])), ("phrase", phrase_out)):
        if not mask.any() or mask.all() or rows[~mask]["label"].nunique() < 2:
            continue
        model = fit(rows[~mask])
        test = rows[mask | ((rows["label"] == 0).to_numpy() if way == "phrase" else False)]
        residue = 1 - _residue_shares(model, test["shaped"].tolist())[:, 0] >= LEAST
        y, w = test["label"].to_numpy(), test["weight"].to_numpy(dtype=float)
        clean_hit = w[residue & (y == 0)].sum()
        for k, name in enumerate(CLASSES[1:], 1):
            own = y == k
            good = w[residue & own].sum()
            if own.any():
                out.append((way, name, int(own.sum()), float(good / max(1e-9, good + clean_hit)), float(good / w[own].sum())))
    return out


def find_residue(documents: DataFrame, model: LinearModel | None) -> DataFrame:
    """(doc_id, kind, segment, p): every segment that is residue."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows, ids, titles = [], d["doc_id"].tolist(), d["title"].tolist()
            texts = d["text"].tolist()
            for a in range(0, len(texts), 256):
                own = [(i, s, p) for i in range(a, min(a + 256, len(texts))) for s, p in segments(texts[i])]
                if not own or model is None:
                    continue
                for x in range(0, len(own), 4096):
                    part = own[x : x + 4096]
                    p = model.scores(*_features([shaped(s, q, titles[i]) for i, s, q in part]), len(part))
                    for j in np.flatnonzero(1 - p[:, 0] >= LEAST):
                        i, s, _ = part[j]
                        rows.append((ids[i], CLASSES[1 + int(p[j, 1:].argmax())], s[:200], float(1 - p[j, 0])))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "segment", "p"])

    return documents.filter("text IS NOT NULL").select("doc_id", "text", "title").mapInPandas(run, f"doc_id {kind}, kind string, segment string, p double")
