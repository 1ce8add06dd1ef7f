"""Search requests: the parsing contract of modes, names, dates and sort keys."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import lru_cache

from kinname.schema import DEFAULT_MODES, MODES, SORTS


def parse_modes(text: str | None) -> list[str]:
    """Comma-joined modes as they stand: no stripping, unknown ones dropped, order and repeats kept; the default if none is left."""
    return list(_modes(text))


def parse_explain_modes(modes: str | None, mode: str | None = None) -> list[str]:
    """For explanations: stripped, and an empty ``modes`` falls back to ``mode``."""
    return list(_explain_modes(modes or mode or ""))


@lru_cache(1 << 18)  # dates recur
def parse_date(text: str | None) -> date | None:
    """Year-month-day, padded or not; None for anything else."""
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", (text or "").strip())
    try:
        return date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def parse_reference_date(text: str) -> date:
    """A date that must be right; ValueError otherwise."""
    if (found := _strict_date(text)) is None:
        raise ValueError(f"time data {text!r} does not match format '%Y-%m-%d'")
    return found


@lru_cache(1 << 18)
def _strict_date(text: str) -> date | None:
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


@lru_cache(1_000)
def _modes(text: str | None) -> tuple[str, ...]:
    return tuple(m for m in (text or "").split(",") if m in MODES) or tuple(DEFAULT_MODES)


@lru_cache(1_000)
def _explain_modes(text: str) -> tuple[str, ...]:
    return tuple(m for t in text.split(",") if (m := t.strip()) in MODES) or ("prefix",)


@dataclass(frozen=True)
class SearchRequest:
    modes: list[str] = field(default_factory=lambda: list(DEFAULT_MODES))
    first_name: str = ""
    last_name: str = ""
    date_of_birth: date | None = None
    sort_field: str = ""

    @classmethod
    def parse(cls, params: dict[str, str], explain: bool = False) -> SearchRequest:
        get = lambda k: params.get(k) or ""
        modes = parse_explain_modes(params.get("modes"), params.get("mode")) if explain else parse_modes(params.get("modes"))
        return cls(modes, get("first_name").strip(), get("last_name").strip(), parse_date(params.get("date_of_birth")), SORTS.get(get("sort"), ""))

    @property
    def names(self) -> dict[str, str]:
        """The names that are given, by column."""
        return {c: v for c, v in (("first_name", self.first_name), ("last_name", self.last_name)) if v}
