"""What a search runs: display SQL of the modes, and the plan of the query, with or without running it."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

from kinname.operators.index import NameIndex
from kinname.operators.request import SearchRequest
from kinname.operators.search import _sort, plan
from kinname.plans import figures
from kinname.schema import LEAST_SIMILARITY, MODES, MOST_EDITS, RESULT_LIMIT

_TEMPLATES = {
    "prefix": "startswith(upper({c}), upper({v}))",
    "legacy": "contains(upper({c}), upper({v}))",
    "soundex": "soundex_code({c}) = soundex_code({v})",
    "dm": "arrays_overlap(daitch_mokotoff({c}), daitch_mokotoff({v}))",
    "levenshtein": "levenshtein(upper({c}), upper({v}), " + str(MOST_EDITS) + ") >= 0",
    "trigram": "similarity({c}, {v}) >= " + str(LEAST_SIMILARITY),
}


def quoted(value: str) -> str:
    """A SQL string literal, whatever the value holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mode_sql(mode: str, first_name: str, last_name: str) -> str:
    """The mode's description and predicate for display; '' if no name is given or the mode is unknown."""
    names = {c: quoted(v) for c, v in (("first_name", first_name), ("last_name", last_name)) if v}
    if mode not in _TEMPLATES or not names:
        return ""
    parts = [_TEMPLATES[mode].format(c=c, v=v) for c, v in names.items()]
    text = " AND ".join(parts)
    if mode == "trigram":
        text += " ORDER BY " + ", ".join(f"1 - similarity({c}, {names[c]})" for c in ("last_name", "first_name") if c in names)
    return f"{MODES[mode].description} {text}"


def query_for(records: DataFrame, request: SearchRequest, vocabulary: DataFrame | NameIndex | None = None) -> tuple[DataFrame | None, str]:
    """The query to explain and its kind: the trigram one whenever a search would run it, else the main one."""
    built = plan(records, request, vocabulary)
    if built.trigram is not None:
        return built.trigram.orderBy("_far", "id").limit(RESULT_LIMIT), "trigram"
    if built.main is not None:
        return built.main.orderBy(*_sort(built.order), "id").limit(RESULT_LIMIT), "main"
    return None, ""


def explain(records: DataFrame, request: SearchRequest, *, analyze: bool = False, vocabulary: DataFrame | NameIndex | None = None) -> dict:
    """Plan text of what a search would run; with ``analyze`` the query runs, and the final adaptive plan is shown with figures.

    The same keys always: plan, kind, subject, modes, descriptions, error, and of a query that ran: figures (the rows,
    time, bytes and files of each node, see :mod:`kinname.plans.figures`), rows, and executions, all that ran for it
    (a vocabulary's and an index's too). Nothing to search for gives an error text.
    """
    out = {"figures": None, "rows": None, "executions": None, "plan": None, "kind": "", "subject": f"Explaining: {' + '.join(request.modes)}", "modes": " + ".join(MODES[m].label for m in request.modes), "descriptions": " ".join(MODES[m].description for m in request.modes), "error": None}
    if not request.names and request.date_of_birth is None:
        return out | {"error": "Give a first name, a last name or a date of birth to explain a query."}
    with figures.recorded(records.sparkSession) as ran:
        df, kind = query_for(records, request, vocabulary)
        if df is not None and analyze:
            try:
                out["rows"] = len(df.collect())
            except Exception as e:  # an explanation reports what went wrong
                return out | {"kind": kind, "error": str(e)}
    if df is None:
        return out | {"error": "No query to explain: give a name with a search mode, or a date of birth."}
    if kind == "trigram":
        out["subject"] = "Explaining: trigram query" + (f" (of the modes {', '.join(request.modes)})" if len(request.modes) > 1 else "")
    try:
        if analyze:
            found = figures.nodes(df)
            out |= {"figures": found, "executions": ran.executions}
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("formatted")
        shown = figures.table(found) + "\n\n" + text.getvalue() if analyze else text.getvalue()
        return out | {"plan": shown, "kind": kind}
    except Exception as e:  # an explanation reports what went wrong
        return out | {"kind": kind, "error": str(e)}
