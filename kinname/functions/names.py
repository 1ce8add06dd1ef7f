"""Column functions on names, all Catalyst expressions: Soundex, trigrams, bounded edits, formatting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinname.schema import MOST_EDITS

#: The Soundex digit of each letter from A to Z; 0 for vowels, H, W and Y.
SOUNDEX_DIGITS = "01230120022455012623010202"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def soundex(name: Column) -> Column:
    """The 4-character Soundex code; H, W and signs that are not letters part equal digits, as vowels do. '' where there is no letter.

    Spark's own function does it once H and W are vowels to it; names that start with a letter meet no pattern.
    """
    upper = F.upper(name)
    first = F.substring(upper, 1, 1)
    word = F.when((first >= "A") & (first <= "Z"), upper).otherwise(F.regexp_replace(upper, "^[^A-Z]+", ""))
    return F.soundex(F.concat(F.substring(word, 1, 1), F.translate(F.substring(word, F.lit(2), F.length(word)), "HW", "AA")))


def soundex_of(name: str) -> str:
    """The same code of a Python string, for literals that the optimiser folds predicates with."""
    word = re.sub("^[^A-Z]+", "", name.upper())
    if not word:
        return ""
    digits = "".join(SOUNDEX_DIGITS[_LETTERS.index(c)] if c in _LETTERS else "0" for c in word)
    tail = re.sub("[^1-6]", "", re.sub(r"([0-9])\1+", r"\1", digits)[1:])
    return (word[0] + tail)[:4].ljust(4, "0")


def trigrams(name: Column) -> Column:
    """The distinct trigrams of a name's words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigrams_of(name: str) -> list[str]:
    words = [w for w in re.split(r"[^\w]+|_", name.lower()) if w]
    return list(dict.fromkeys(p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(w) + 1)))


def overlap(grams: Column, others: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 where neither has any."""
    shared = F.size(F.array_intersect(grams, others))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(grams) + F.size(others) - shared).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def similarity_to(grams: Column, name: str) -> Column:
    """Similarity of a trigram column to a fixed name."""
    own = trigrams_of(name)
    return overlap(grams, F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))


def within_edits(name: Column, query: str, most: int = MOST_EDITS) -> Column:
    """Whether at most ``most`` edits apart, in upper case. The bounded function gives -1 beyond the bound."""
    return F.levenshtein(F.upper(name), F.lit(query.upper()), most) >= 0


def edits(a: Column, b: Column, most: int | None = None) -> Column:
    """The edit distance in upper case; with a bound, bound + 1 stands for anything beyond it."""
    if most is None:
        return F.levenshtein(F.upper(a), F.upper(b))
    d = F.levenshtein(F.upper(a), F.upper(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def full_name(first: Column, middle: Column, last: Column) -> Column:
    return F.concat_ws(" ", first, F.nullif(middle, F.lit("")), last)


def with_thousands(number: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(number, 0)


def without_double(name: Column) -> Column:
    """A name without one of its first pair of equal neighbours; its Soundex code stays."""
    return F.regexp_replace(name, r"^(.*?)(.)\2", "$1$2")


def parsed_date(text: Column) -> Column:
    """A date from year-month-day with or without padding; anything else gives null, never an error."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.trim(text), "yyyy-M-d"))


def any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
