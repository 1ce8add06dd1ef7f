"""Fill-in-middle: texts cut at units, their middle moved to the end, and restored from what comes out.

A unit grammar is alternatives of one character class each, a maximal run (``[..]+``) or one character
(``[..]``). It is translated to a zero-width regex that looks at the classes of the two neighbours of a
place: a unit ends wherever they are not of one run. Spark's split at that regex keeps every piece. All of
it is DataFrame functions.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import spread, text_or_empty

#: Runs of ASCII letters, and every other character by itself.
WORDS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that are moved, and of 100 moved ones those whose suffix comes first.
MOVED, SUFFIX_FIRST = 90, 20
_ALTERNATIVE = re.compile(r"(\[\^?(?:\\.|[^\]\\])+\])(\+?)")


@lru_cache
def boundaries(grammar: str) -> str:
    """The zero-width regex of the places between units.

    The classes must be apart and take in all characters, as every place is judged by its neighbours
    alone; ValueError for alternatives that are not one class, and for characters in two classes or none.
    """
    parts = [m.groups() for m in _ALTERNATIVE.finditer(grammar)]
    if "|".join(c + plus for c, plus in parts) != grammar:
        raise ValueError(f"not alternatives of one character class each: {grammar}")
    classes = [re.compile(c) for c, _ in parts]
    for code in range(0x110000):
        if sum(c.match(chr(code)) is not None for c in classes) != 1:
            raise ValueError(f"character {code:#x} is not in one class of {grammar}")
    some = r"(?=[\s\S])"  # no unit ends behind the last character
    return "|".join(f"(?<={c})" + (f"(?!{c}){some}" if plus else some) for c, plus in parts)


def units(text: Column, grammar: str = WORDS) -> Column:
    """The units of a text, which together are the text; none of the empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundaries(grammar)))


def _number(digest: Column, i: int) -> Column:
    """Group ``i`` of 8 hex digits of a digest."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _after(text: Column, before: Column, mark: str) -> Column:
    """What follows ``before`` and a mark of three characters."""
    return F.substring(text, F.length(before) + len(mark) + 1, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from. A text that is moved holds no mark, so each mark stands where it was put."""
    body = F.substring(output, F.lit(4), F.length(output))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substring(body, F.length(one) + F.length(second) + 1, F.length(body))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = _after(rest, two, MIDDLE)
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def fill_in_middle(docs: DataFrame, *, grammar: str = WORDS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    The middle lies between two places among the n + 1 of a text of n units, both drawn from the
    SHA-256 of the seed and the id, as is the form: plain (as it was), psm or spm by the order of parts. A text
    that holds a mark, and the empty one, are plain; then the numbers of code points are null.

    One narrow pass: nothing is shuffled, and hot keys cost nothing. A null text is the empty text, a null
    id draws as the empty string and stays null, rows that share an id draw the same places, repeated rows give
    repeated results, an empty table an empty one; other columns are left out, whatever their names.
    """
    text = text_or_empty(text_col)
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    cut = spread(docs.select(F.col(id_col).alias("id"), text.alias("text"), seeded.alias("h"))).select("id", "text", "h", units(F.col("text"), grammar).alias("unit"))
    cut = cut.withColumn("n", F.size("unit").cast("long"))
    a, b = (_number(F.col("h"), i) % (F.col("n") + 1) for i in (0, 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = (
        F.when((F.col("n") == 0) | marked | (_number(F.col("h"), 2) % 100 >= MOVED), "plain")
        .when(_number(F.col("h"), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    )
    placed = cut.select("id", "text", "unit", "n", form.alias("form"), F.least(a, b).cast("int").alias("low"), F.greatest(a, b).cast("int").alias("high"))
    joined = lambda start, size: F.array_join(F.slice("unit", start, size), "")
    parts = placed.select(
        "id", "text", "n", "form", joined(F.lit(1), F.col("low")).alias("prefix"), joined(F.col("low") + 1, F.col("high") - F.col("low")).alias("middle"),
        joined(F.col("high") + 1, F.size("unit") - F.col("high")).alias("suffix"),
    )
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    )
    return parts.select(F.col("id").alias(id_col), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))
