"""Column expressions on text, with the same meaning in Java's and RE2's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Any other sign.
INK = "[^" + BLANK[1:]
#: Tokens of one or more, and of two or more word characters.
TOKEN1 = r"[\p{L}\p{N}_]+"
TOKEN2 = r"[\p{L}\p{N}_]{2,}"
#: Words that carry no topic; a parameter wherever it is used.
STOP_WORDS = (
    "a about above after again against all almost along already also although always am among an and another any anyone anything "
    "are around as at back be became because been before behind being below beside between beyond both but by can cannot could do "
    "done down during each either else enough even ever every everyone everything few find first for former found from full get give "
    "go had has have he hence her here hers him himself his how however if in indeed into is it its itself keep last least less made "
    "many may me might mine more most mostly move much must my myself namely neither never next no nobody none nor not nothing now "
    "of off often on once one only onto or other others our ours out over own part per perhaps please put rather same see seem she "
    "should show side since so some someone something still such take than that the their them then there these they this those "
    "through to together too top toward under until up upon us very was we well were what when where whether which while who whole "
    "whom whose why will with within without would yet you your"
).split()


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def has_text(c: Column) -> Column:
    """Whether anything is left of a text that is stripped; it is read up to its first sign only."""
    return c.rlike(INK)


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Size of words(c). Where single spaces alone divide a text they are counted instead."""
    single = (c != "") & ~c.startswith(" ") & ~c.endswith(" ") & ~c.contains("  ") & ~c.rlike(f"[[^ -~]&&{BLANK}]")
    spaces = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(single, spaces + 1).otherwise(F.size(words(c)))


def tokens(c: Column, pattern: str = TOKEN1) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1))


def stem_of(filename: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename, r"(.)\.[^.]*$", "$1")


def syllables(word: Column) -> Column:
    """Vowel groups of a word without one final e, at least one."""
    w = F.when(F.length(word) > 2, F.regexp_replace(word, "e$", "")).otherwise(word)
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")))
