"""The name vocabulary in the place of indexes: modes are judged once for each distinct name, then joined.

Names recur, so fuzzy predicates on the vocabulary cost little beside a scan of all records. Each
record's bits are the bits that all its given names share, which is the same as the direct search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.operators import modes as M
from kinname.operators.index import COPIES, NameIndex
from kinname.operators.request import SearchRequest
from kinname.schema import BITS, EDITS_BIT, LEAST_SIMILARITY

#: Matching names of one column up to which they are a local table that is broadcast; beyond, the join shuffles.
BROADCAST_NAMES = 500_000
_ALL = sum(BITS.values()) | EDITS_BIT
#: Modes that are dear on every record, so that a search goes through the vocabulary if it has one.
FUZZY = frozenset({"soundex", "dm", "levenshtein", "trigram"})
#: Modes that are so dear that a search without a vocabulary makes one of the names it asks for first.
DEAR = frozenset({"dm", "trigram"})


def distinct_names(records: DataFrame, columns: Sequence[str] = ("first_name", "last_name")) -> DataFrame:
    """(name) of all distinct values of the columns, null included.

    What is asked of a name is asked once of each: a filter on the plain result of ``distinct`` would be moved
    below it, onto every record, so the name that is given depends on its count, which only the aggregate has.
    """
    each = records.select(F.explode(F.array(*columns)).alias("name")) if len(columns) > 1 else records.select(F.col(*columns).alias("name"))
    counted = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("n") > 0, F.col("name")).alias("name"))


def build(records: DataFrame, with_dm: bool = True, columns: Sequence[str] = ("first_name", "last_name")) -> DataFrame:
    """(name, name_upper, soundex, trigrams[, dm]) of all distinct first and last names; to be written as Parquet."""
    return coded(distinct_names(records, columns), with_dm)


def coded(names: DataFrame, with_dm: bool = True) -> DataFrame:
    """The vocabulary's columns of distinct names."""
    out = names.select("name", F.upper("name").alias("name_upper"), N.soundex(F.col("name")).alias("soundex"), N.trigrams(F.col("name")).alias("trigrams"))
    return out.withColumn("dm", dm.codes(F.col("name"))) if with_dm else out


def name_bits(vocabulary: DataFrame, request: SearchRequest, value: str) -> DataFrame:
    """(name, bits, similarity) of the names that match ``value`` in any enabled mode, each once; edit distance has a bit of its own.

    A vocabulary may hold a name several times, as streams that append at once can add one; without stored codes
    those of its names are made.
    """
    tests = {
        "prefix": F.startswith("name_upper", F.upper(F.lit(value))),
        "legacy": F.contains("name_upper", F.upper(F.lit(value))),
        "soundex": F.col("soundex") == N.soundex_of(value),
    }
    if "dm" in request.modes:
        own = dm.codes_of(value) or []
        known = F.col("dm") if "dm" in vocabulary.columns else dm.codes(F.col("name"))
        tests["dm"] = F.coalesce(F.arrays_overlap(known, F.array(*map(F.lit, own)).cast("array<string>")), F.lit(False))
    near = N.similarity_to(F.col("trigrams"), value) if "trigram" in request.modes else F.lit(0.0)
    tested = vocabulary.withColumn("similarity", near)
    tests["trigram"] = F.col("similarity") >= LEAST_SIMILARITY
    bits = M.match_source({m: tests[m] for m in [*M.base_modes(request.modes), *["trigram"] * ("trigram" in request.modes)]})
    if "levenshtein" in request.modes:
        bits = bits.bitwiseOR(F.when(N.within_edits(F.col("name"), value), EDITS_BIT).otherwise(0))
    return tested.select("name", bits.alias("bits"), "similarity").where(F.col("bits") != 0).dropDuplicates(["name"])


def joined(records: DataFrame, vocabulary: DataFrame | NameIndex, request: SearchRequest, *, nearest: bool = False) -> DataFrame:
    """The records all of whose given names match in one mode at least: with _bits, the bits that they share, and each name's similarity.

    The matching names of a value are judged once and kept, as a table of BROADCAST_NAMES rows at most. An
    index finds them by its postings, and their records by the copy that is sorted by the name with fewer matches.
    nearest: of trigram matches only as many names as the nearest page needs.
    """
    spark, indexed = records.sparkSession, isinstance(vocabulary, NameIndex)
    tables, few = {}, {}
    for column, value in request.names.items():
        one = nearest and len(request.names) == 1 and request.date_of_birth is None
        table = vocabulary.name_bits(request.modes, value, column, one) if indexed else name_bits(vocabulary, request, value)
        met = table.limit(BROADCAST_NAMES + 1).toArrow()
        if met.num_rows <= BROADCAST_NAMES:
            few[column] = met.column("name").to_pylist()
            table = F.broadcast(spark.createDataFrame(met, table.schema) if met.num_rows else table.where(F.lit(False)))
        tables[column] = table
    out = records
    if indexed:
        copied = [c for t, c in COPIES.items() if c in request.names and vocabulary.has(t)]
        least = min(copied, key=lambda c: len(few[c]) if c in few else BROADCAST_NAMES + 1)
        out = vocabulary.records_of(least, few.get(least)).select(records.columns)
    if request.date_of_birth is not None:
        out = out.where(F.col("date_of_birth") == F.lit(request.date_of_birth))
    bits = F.lit(_ALL)
    for column, table in tables.items():
        out = out.join(table.select(F.col("name").alias(column), F.col("bits").alias(f"_bits_{column}"), F.col("similarity").alias(f"_{column}")), column)
        bits = bits.bitwiseAND(F.col(f"_bits_{column}"))
    return out.withColumn("_bits", bits).where(F.col("_bits") != 0)


def matches(records: DataFrame, vocabulary: DataFrame | NameIndex, request: SearchRequest) -> DataFrame:
    """The main part of a search with base modes: the records that match, with match_source."""
    out = joined(records, vocabulary, request)
    if "levenshtein" in request.modes:
        out = out.where(F.col("_bits").bitwiseAND(F.lit(EDITS_BIT)) != 0)
    source = F.col("_bits").bitwiseAND(F.lit(_ALL & ~EDITS_BIT & ~BITS["trigram"]))
    return out.withColumn("match_source", source).where(F.col("match_source") != 0).select(*records.columns, "match_source")
