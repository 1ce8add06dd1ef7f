"""The search: modes OR-ed in one scan, edit distance on top, trigram neighbours after, pages of 200."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.operators import modes as M
from kinname.operators import vocabulary as V
from kinname.operators.index import NameIndex
from kinname.operators.request import SearchRequest
from kinname.schema import BITS, EDITS_BIT, LEAST_SIMILARITY, RESULT_LIMIT, TRIGRAM_SLOTS


def _sort(field: str) -> list[Column]:
    if not field:
        return []
    return [F.col(field[1:]).desc() if field.startswith("-") else F.col(field).asc()]


@dataclass(frozen=True)
class Plan:
    """What a request runs: the filtered rows of the main part, if there is one, and of the trigram part."""

    main: DataFrame | None
    trigram: DataFrame | None
    order: str
    limit: int


def plan(records: DataFrame, request: SearchRequest, vocabulary: DataFrame | NameIndex | None = None) -> Plan:
    """Builds both parts lazily; search and explanation share it, so they cannot differ.

    A request of names never falls back to all rows of a date. A sort is dropped beside the substring
    mode. Edit distance refines the main part, or is its filter if no other mode gives one. With a
    vocabulary, requests with a fuzzy mode judge each distinct name once and join the records to them; with
    an index of ``records``, names are found by its postings and prefixes in its sorted copies. Without either,
    Daitch-Mokotoff codes and trigrams are judged for each distinct name of the records, but those of one date as they are.
    """
    names, dob, modes = request.names, request.date_of_birth, request.modes
    order = "" if "legacy" in modes else request.sort_field
    rows = records if dob is None else records.where(F.col("date_of_birth") == F.lit(dob))
    base = M.base_modes(modes) if names else []
    trigram = "trigram" in modes and bool(names)
    limit = RESULT_LIMIT - TRIGRAM_SLOTS if trigram else RESULT_LIMIT
    main = None
    if vocabulary is None and dob is None and names and V.DEAR & set(modes):
        vocabulary = V.build(records, "dm" in modes, list(names))
    if vocabulary is not None and names and V.FUZZY & set(modes):
        nearest = trigram and "levenshtein" not in modes and not base
        return _through(records.columns, V.joined(records, vocabulary, request, nearest=nearest), request, order, limit, base, trigram)
    if isinstance(vocabulary, NameIndex) and base == ["prefix"]:
        rows = vocabulary.starting(names).select(records.columns)
        rows = rows if dob is None else rows.where(F.col("date_of_birth") == F.lit(dob))
        return Plan(rows.withColumn("match_source", F.lit(BITS["prefix"])), None, order, limit)
    if base:
        flags = {m: M.mode_filter(m, names) for m in base}
        main = rows
        if "levenshtein" in modes:
            main = main.where(M.edits_filter(names))
        main = main.withColumn("match_source", M.match_source(flags)).where(F.col("match_source") != 0)
    elif "levenshtein" in modes and names:
        main = rows.where(M.edits_filter(names)).withColumn("match_source", F.lit(0))
    elif "trigram" not in modes and dob is not None and not names:
        main = rows.withColumn("match_source", F.lit(0))
    near = None
    if trigram:
        near = rows
        for column, value in names.items():
            near = near.withColumn(f"_{column}", N.similarity_to(N.trigrams(F.col(column)), value))
        for column in names:
            near = near.where(F.col(f"_{column}") >= LEAST_SIMILARITY)
        near = _by_distance(near, names)
    return Plan(main, near, order, limit)


def _by_distance(near: DataFrame, names: dict[str, str]) -> DataFrame:
    far = [F.lit(1.0) - F.col(f"_{c}") for c in ("last_name", "first_name") if c in names]
    return near.withColumn("_far", F.struct(*[f.alias(f"d{i}") for i, f in enumerate(far)])).withColumn("match_source", F.lit(BITS["trigram"]))


def _through(columns: list[str], joined: DataFrame, request: SearchRequest, order: str, limit: int, base: list[str], trigram: bool) -> Plan:
    """The same two parts from records that are joined to their names' bits."""
    has = lambda bit: F.col("_bits").bitwiseAND(F.lit(bit)) != 0
    edits = "levenshtein" in request.modes
    main = None
    if base or edits:
        main = joined.where(has(EDITS_BIT)) if edits else joined
        main = main.withColumn("match_source", F.col("_bits").bitwiseAND(F.lit(sum(BITS[m] for m in base))))
        main = (main.where("match_source != 0") if base else main).select(*columns, "match_source")
    near = _by_distance(joined.where(has(BITS["trigram"])), request.names) if trigram else None
    return Plan(main, near, order, limit)


def search(records: DataFrame, request: SearchRequest, *, vocabulary: DataFrame | NameIndex | None = None, ordered: bool = True) -> DataFrame:
    """The result page: the record's columns, match_source, and position from 1.

    At most 200 rows. With trigrams the main part has 120 at most, and the nearest 200 neighbours that
    it lacks follow until there are 200; only they have the trigram bit. A sort orders the page that
    the limits left. Every limit has a total order (id last). Both parts end in a top-k of 200 rows,
    so what meets in the anti join and the window is 400 rows at most.
    """
    columns = records.columns
    built = plan(records, request, vocabulary)
    parts = []
    if built.main is not None:
        top = built.main.orderBy(*_sort(built.order), "id").limit(built.limit)
        parts.append(top.select(*columns, "match_source", F.lit(0).alias("_part"), F.row_number().over(W.orderBy(*_sort(built.order), "id")).alias("_rank")))
    if built.trigram is not None:
        near = built.trigram.orderBy("_far", "id").limit(RESULT_LIMIT)
        ranked = near.select(*columns, "match_source", F.lit(1).alias("_part"), F.row_number().over(W.orderBy("_far", "id")).alias("_rank"))
        parts.append(ranked.join(parts[0].select("id"), "id", "left_anti") if parts else ranked)
    if not parts:
        return records.where(F.lit(False)).select(*columns, F.lit(0).alias("match_source"), F.lit(0).alias("position"))
    page = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(parts[0].columns))
    page = page.withColumn("_at", F.row_number().over(W.orderBy("_part", "_rank"))).where(F.col("_at") <= RESULT_LIMIT)
    page = page.withColumn("position", F.row_number().over(W.orderBy(*_sort(built.order), "_at"))).select(*columns, "match_source", "position")
    return page.orderBy("position") if ordered else page


def search_unified(records: DataFrame, modes: list[str], first_name: str, last_name: str, date_of_birth=None, sort_field: str = "") -> DataFrame:
    return search(records, SearchRequest(modes, first_name, last_name, date_of_birth, sort_field))


def phonetic_codes(first: Column, last: Column) -> Column:
    """A struct of the Soundex codes and the joined Daitch-Mokotoff codes of both names; '' where there are none."""
    joined = lambda c: F.array_join(F.coalesce(dm.codes(c), F.array().cast("array<string>")), ", ")
    return F.struct(N.soundex(first).alias("soundex_fn"), N.soundex(last).alias("soundex_ln"), joined(first).alias("dm_fn"), joined(last).alias("dm_ln"))


def decorated(page: DataFrame, codes: bool = True) -> DataFrame:
    """A result page with a flag for each mode and the records' phonetic codes, computed on its 200 rows only."""
    out = page.withColumns(M.flags_of(F.col("match_source")))
    return out.withColumn("phonetic_codes", phonetic_codes(F.col("first_name"), F.col("last_name"))) if codes else out


def query_codes(first_name: str, last_name: str) -> dict[str, str]:
    """The codes of the names asked for; '' where nothing can be coded."""
    out = {}
    for key, name in (("fn", first_name), ("ln", last_name)):
        if name:
            out[f"soundex_{key}"] = N.soundex_of(name)
            out[f"dm_{key}"] = ", ".join(dm.codes_of(name) or [])
    return out


@dataclass(frozen=True)
class SearchResult:
    """A page with its figures; queries: what each mode asks for, for display; ran: the final plans of all that ran, in order; executions: the same with times."""

    df: DataFrame
    rows: list
    count: int
    elapsed_ms: float
    full_page: bool
    label: str
    codes: dict[str, str]
    queries: dict[str, str]
    ran: list[str]
    executions: list


def page_label(count: int) -> str:
    """What is said of a page's size: a full one may leave rows out."""
    return f"top {RESULT_LIMIT}" if count >= RESULT_LIMIT else str(count)


def run(records: DataFrame, request: SearchRequest, *, vocabulary: DataFrame | NameIndex | None = None) -> SearchResult:
    """Runs a search and reports its time and all that ran, a vocabulary's and an index's executions too; the page, of 200 rows at most, is all that reaches the driver."""
    from kinname.plans.explain import mode_sql
    from kinname.plans.figures import recorded

    with recorded(records.sparkSession) as did:
        began = time.perf_counter()
        df = decorated(search(records, request, vocabulary=vocabulary), codes="soundex" in request.modes or "dm" in request.modes)
        rows = df.collect()
        took, n = (time.perf_counter() - began) * 1e3, len(rows)
    return SearchResult(
        df, rows, n, took, n >= RESULT_LIMIT, page_label(n), query_codes(request.first_name, request.last_name),
        {m: mode_sql(m, request.first_name, request.last_name) for m in request.modes}, [e.plan for e in did.executions], did.executions,
    )


def admin_search(records: DataFrame, text: str) -> DataFrame:
    """Records that hold the text in any of the three names, in any case."""
    hit = [F.contains(F.upper(F.coalesce(F.col(c), F.lit(""))), F.upper(F.lit(text))) for c in ("first_name", "last_name", "middle_name") if c in records.columns]
    return records.where(N.any_of(hit))


def by_ids(records: DataFrame, ids: list[int]) -> DataFrame:
    """The records of some ids, a page of them at most."""
    return records.where(F.col("id").isin(ids))
