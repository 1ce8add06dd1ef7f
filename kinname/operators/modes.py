"""The match modes as predicates on columns. Codes and trigrams of the query are literals, so they fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.schema import BITS


def _dm(name: Column, query: str) -> Column:
    own = dm.codes_of(query)
    return F.lit(False) if own is None else F.coalesce(F.arrays_overlap(dm.codes(name), F.array(*map(F.lit, own))), F.lit(False))


#: The modes that are OR-ed into the main filter, with their predicate on one name.
BASE: dict[str, Callable[[Column, str], Column]] = {
    "prefix": lambda c, v: F.startswith(F.upper(c), F.upper(F.lit(v))),
    "legacy": lambda c, v: F.contains(F.upper(c), F.upper(F.lit(v))),
    "soundex": lambda c, v: N.soundex(c) == N.soundex_of(v),
    "dm": _dm,
}


def mode_filter(mode: str, names: dict[str, str]) -> Column:
    """All given names match in one mode."""
    out = F.lit(True)
    for column, value in names.items():
        out = out & BASE[mode](F.col(column), value)
    return out


def edits_filter(names: dict[str, str]) -> Column:
    out = F.lit(True)
    for column, value in names.items():
        out = out & N.within_edits(F.col(column), value)
    return out


def base_modes(modes: Sequence[str]) -> list[str]:
    return [m for m in BASE if m in modes]


def match_source(flags: dict[str, Column]) -> Column:
    """The bits of the modes whose flags hold; 0 of none."""
    out = F.lit(0)
    for mode, flag in flags.items():
        out = out.bitwiseOR(F.when(flag, F.lit(BITS[mode])).otherwise(F.lit(0)))
    return out


def flags_of(source: Column) -> dict[str, Column]:
    return {f"has_{m}": source.bitwiseAND(F.lit(b)) != 0 for m, b in BITS.items()}


def distances(names: dict[str, str]) -> dict[str, Column]:
    """Trigram distance of each given name."""
    return {c: 1 - N.similarity_to(N.trigrams(F.col(c)), v) for c, v in names.items()}


