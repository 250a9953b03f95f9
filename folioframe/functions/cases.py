"""A text put into the case of another, word by word, also where runs part it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms that keep their capitals in a title.
ACRONYMS = (
    "HVAC", "DDC", "VAV", "BAS", "BACNET", "AHU", "RTU", "VFD", "MAU", "ERV", "HRV", "FCU", "WSHP", "DX", "CHW", "HHW", "CW",
    "TAB", "MEP", "ASHRAE", "SMACNA", "NFPA", "UL", "ASTM", "PVC", "CPVC", "HDPE", "FRP", "BTU", "CFM", "GPM", "PSI",
)


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _titled(word: Column, acronyms: tuple[str, ...]) -> Column:
    """The letters of one word or separator, each as it shall be; words in capitals that are no acronym get one capital a part."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    shouted = (word == F.upper(word)) & (word != F.lower(word)) & ~letters.isin(*acronyms)
    own = _chars(word)
    begins = lambda i: (i == 0) | F.get(own, i - 1).rlike(r"[^\p{L}]")
    return F.when(shouted, F.transform(own, lambda c, i: F.when(begins(i), F.upper(c)).otherwise(F.lower(c)))).otherwise(own)


def _letters(text: Column, pattern: Column, acronyms: tuple[str, ...]) -> Column:
    """One string for each code point of ``text``."""
    words = F.regexp_extract_all(text, F.lit(r"([\s\-]+|[^\s\-]+)"), 1)
    titled = F.flatten(F.transform(words, lambda w: _titled(w, acronyms)))
    return F.when(pattern == "upper", F.transform(_chars(text), lambda c: F.upper(c))).when(pattern == "title", titled).otherwise(_chars(text))


def applied(text: Column, pattern: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """``text`` in the case that ``roles.case_pattern`` told of another: ``upper``, ``title``; any other pattern changes nothing.

    In a title, words that are all capitals get one capital for each part
    between hyphens (and behind marks within a word), unless their letters are
    an acronym; words with small letters stay.  White space stays as it is; null
    text or a null pattern changes nothing.
    """
    return F.array_join(_letters(text, F.coalesce(pattern, F.lit("")), acronyms), "")


def applied_to_runs(texts: Column, pattern: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """As ``applied`` for an array of texts that stand one after the other: words go on across them, each keeps its own part."""
    known = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    whole = _letters(F.array_join(known, ""), F.coalesce(pattern, F.lit("")), acronyms)
    sizes = F.transform(known, lambda t: F.length(t))
    before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    return F.transform(sizes, lambda n, i: F.array_join(F.slice(whole, before(i) + 1, n), ""))
