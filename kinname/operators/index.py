"""Stored access paths to names and records, one for each mode, in the place of a database's indexes.

Each is a table whose rows are dealt out by ranges of its key and sorted, in small row groups and pages, so an
equality or starts-with filter reaches Parquet and what does not hold the key is not read:

names    by upper-case name, for prefixes; with Soundex code and number of trigrams
sounds   Soundex code -> name
codes    Daitch-Mokotoff code -> name
grams    trigram -> name, with the name's number of trigrams
edits    hash of what is left of a name's first letters without up to two of them -> name
by_last, by_first: the records by upper-case name, so that those of some names are found without a scan

A search through an index gives the rows that it gives without one. It needs ``names``, the tables of its modes (TABLE_OF)
and a copy of the records by one of the names it asks for; the others may be left out and written later, from the index alone.
``append`` adds records; names that two appends add at once stand there twice, which no result shows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.schema import BITS, EDITS_BIT, LEAST_SIMILARITY, MOST_EDITS, RESULT_LIMIT
from kinname.sources.records import exists
from kinname.sources.shared import no_shuffles_left, remove

#: The table that answers a mode, the copies of the records by their names, and all tables.
TABLE_OF = {"prefix": "names", "legacy": "names", "soundex": "sounds", "dm": "codes", "levenshtein": "edits", "trigram": "grams"}
COPIES = {"by_last": "last_name", "by_first": "first_name"}
TABLES = (*dict.fromkeys(TABLE_OF.values()), *COPIES)
#: Bytes of a row group and rows of a page: a probe reads some of them.
ROW_GROUP, PAGE_ROWS = 1 << 20, 2_000
#: First letters whose deletions are kept. Names within two edits have first letters that two deletions each make
#: equal, so this bounds the rows a name (29) without losing any.
EDIT_LETTERS = 7
#: Values up to which a filter is a chain of equalities, which reach the row groups' statistics one by one.
MOST_PUSHED = 256
#: Names that a nearest-names search keeps on the driver, at most.
MOST_LOCAL = 10_000
#: Similarities that a nearest-names search tries in turn, until the names found have a page of records.
FALLING = (0.5, LEAST_SIMILARITY)


def one_of(column: str, values: Iterable[str | int]) -> Column:
    """Equality with any value, as a chain that is pushed down whatever its length; false of none. One SQL text, as each call of the JVM costs."""
    literal = lambda v: str(v) + "L" if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(" OR ".join(f"`{column}` = {literal(v)}" for v in values) or "false")


def without_one(word: Column) -> Column:
    """All texts that a word leaves without one of its letters."""
    at = F.when(F.length(word) > 0, F.sequence(F.lit(0), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))))


def deletions(name: Column) -> Column:
    """Hashes of the first letters of a name in upper case, whole and without one or two of them."""
    head = F.substring(F.upper(name), 1, EDIT_LETTERS)
    words = F.transform(F.array(head), lambda w: F.concat(F.array(w), without_one(w), F.flatten(F.transform(without_one(w), without_one))))
    return F.array_distinct(F.transform(F.flatten(words), lambda w: F.xxhash64(w)))


def deletions_of(name: str) -> list[int]:
    """The same hashes of a Python string."""
    found, words = [], [name.upper()[:EDIT_LETTERS]]
    for _ in range(MOST_EDITS + 1):
        found += words
        words = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    return [h - (1 << 64) if h >> 63 else h for w in dict.fromkeys(found) for h in [xxhash.xxh64_intdigest(w.encode(), 42)]]


_schemas: dict[str, T.StructType] = {}


@dataclass(frozen=True)
class NameIndex:
    """The tables of an index in a folder; see the module."""

    spark: SparkSession
    folder: str

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        path = f"{self.folder}/{table}"
        if path not in _schemas:  # asking files for it is a job, at each probe
            _schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path]).parquet(path)

    def has(self, table: str) -> bool:
        return exists(self.spark, f"{self.folder}/{table}")

    def _write(self, rows: DataFrame, table: str, *keys: str, append: bool = False) -> None:
        self._put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), table, append)

    def _put(self, dealt: DataFrame, table: str, append: bool) -> None:
        writer = dealt.write.mode("append" if append else "overwrite").option("compression", "zstd")
        with no_shuffles_left(self.spark):
            writer.option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(f"{self.folder}/{table}")

    def _copy(self, records: DataFrame, table: str, append: bool = False) -> None:
        """The records by a name; the key is made again after the shuffle, as it costs more to send."""
        upper = F.upper(COPIES[table])
        self._put(records.repartitionByRange(upper, "id").withColumn("_upper", upper).sortWithinPartitions("_upper", "id"), table, append)

    def _postings(self, names: DataFrame, tables: Iterable[str], append: bool = False) -> None:
        posted = {
            "names": (names, ("name_upper", "name")),
            "sounds": (names.select(F.col("soundex").alias("code"), "name"), ("code", "name")),
            "codes": (names.select(F.explode(dm.codes(F.col("name"))).alias("code"), "name"), ("code", "name")),
            "grams": (names.select(F.explode(N.trigrams(F.col("name"))).alias("gram"), "n_grams", "name"), ("gram", "n_grams", "name")),
            "edits": (names.select(F.explode(deletions(F.col("name"))).alias("hash"), "name"), ("hash", "name")),
        }
        for table in tables:
            self._write(posted[table][0], table, *posted[table][1], append=append)

    def build(self, records: DataFrame, *, append: bool = False, tables: Iterable[str] = TABLES) -> NameIndex:
        """Writes ``tables`` from ``records``, ``names`` always, in the place of all that was there; or adds those records to the tables
        that are there, names that are there already not again."""
        append = append and self.has("names")
        if append:
            tables = [t for t in TABLES if self.has(t)]
        else:
            tables = [t for t in TABLES if t == "names" or t in set(tables)]
            for table in set(TABLES) - set(tables):
                remove(self.spark, f"{self.folder}/{table}")
        copies = [t for t in tables if t in COPIES]
        for table in copies:
            self._copy(records, table, append)
        if copies and not append:  # cheaper than the records again
            records = getattr(self, copies[0])
        names = records.select(F.col("first_name").alias("name"), F.lit(1).alias("f"), F.lit(0).alias("l")).union(records.select("last_name", F.lit(0), F.lit(1)))
        names = names.where("name IS NOT NULL").groupBy("name").agg(F.sum("f").alias("n_first"), F.sum("l").alias("n_last"))
        fresh = names.join(self.names.select("name"), "name", "left_anti") if append else names
        # the names that are new are written first, as all postings come from them
        made = f"{self.folder}/fresh"
        with no_shuffles_left(self.spark):
            fresh.select("name", F.upper("name").alias("name_upper"), N.soundex(F.col("name")).alias("soundex"), F.size(N.trigrams(F.col("name"))).alias("n_grams"), "n_first", "n_last").write.mode("overwrite").parquet(made)
        self._postings(self.spark.read.parquet(made), [t for t in tables if t not in COPIES], append)
        return self

    def add(self, tables: Iterable[str]) -> NameIndex:
        """Writes tables that ``build`` was not asked for, from the names and the records that the index has."""
        there = [t for t in COPIES if t not in set(tables) and self.has(t)]
        for table in tables:
            if table in COPIES:
                self._copy(getattr(self, there[0]).drop("_upper"), table)
            else:
                self._postings(self.names, [table])
        return self

    # names that match a value

    def gram_counts(self, grams: list[str]) -> dict[str, int]:
        """How many names have each gram: a read of those postings' keys alone, of one row a gram on the driver."""
        found = self.grams.where(one_of("gram", grams)).groupBy("gram").count().collect() if grams else []
        return {g: 0 for g in grams} | {r["gram"]: r["count"] for r in found}

    def candidates(self, value: str, least: float, counts: dict[str, int] | None = None) -> DataFrame:
        """(name, n_grams, hits) of the names that may be as similar to ``value`` as ``least``, by their postings alone.

        A name that is shares ceil(least * m) of the value's m grams at least, so it is among the postings of
        any m - ceil(least * m) + 1 of them: the rarest are read. A name of n grams needs
        least / (1 + least) * (n + m) common ones; ``hits`` of those that were read and what is left of both must reach that.
        """
        own = N.trigrams_of(value)
        m = len(own)
        few = m - max(math.ceil(least * m - 1e-9), 1) + 1
        counts = self.gram_counts(own) if counts is None else counts
        rare = sorted(own, key=lambda g: (counts[g], g))[:few]
        met = self.grams.where(one_of("gram", rare) & F.col("n_grams").between(*_sizes(value, least)))
        hits = met.distinct().groupBy("name", "n_grams").agg(F.count(F.lit(1)).alias("hits"))
        reach = F.col("hits") + F.least(F.lit(m - few), F.col("n_grams") - F.col("hits"))
        return hits.where(reach >= F.ceil(F.lit(least / (1 + least)) * (F.col("n_grams") + m) - 1e-6))

    def near(self, value: str, least: float = LEAST_SIMILARITY, counts: dict[str, int] | None = None) -> DataFrame:
        """(name, similarity) of all names as similar to ``value`` as ``least``; only the candidates are compared."""
        alike = N.similarity_to(N.trigrams(F.col("name")), value)
        return self.candidates(value, least, counts).select("name", alike.alias("similarity")).where(F.col("similarity") >= least)

    def nearest(self, value: str, column: str, rows: int = RESULT_LIMIT) -> DataFrame:
        """(name, similarity) of the names with the nearest ``rows`` records at least, or all as similar as LEAST_SIMILARITY.

        All names of a similarity are in or out, so the nearest records are those of a search over all names.
        """
        count, counts = "n_first" if column == "first_name" else "n_last", self.gram_counts(N.trigrams_of(value))
        for least in FALLING[:-1]:
            found = self.near(value, least, counts)
            held = self.names.where(F.col("n_grams").between(*_sizes(value, least))).select("name", count)
            met = found.join(held, "name").dropDuplicates(["name"]).limit(MOST_LOCAL + 1).toArrow()
            # counts of the time when a name was added: records that came later only make more
            if sum(met.column(count).to_pylist()) >= rows:
                return found if met.num_rows > MOST_LOCAL else self.spark.createDataFrame(met.select(["name", "similarity"]))
        return self.near(value, FALLING[-1], counts)

    def within_edits(self, value: str) -> DataFrame:
        """(name) within the bound of edits: names that share a deletion are compared."""
        met = self.edits.where(one_of("hash", deletions_of(value))).select("name").distinct()
        return met.where(N.within_edits(F.col("name"), value))

    def matched(self, mode: str, value: str) -> DataFrame:
        """(name) that match in one mode; of the substring mode, by reading all names."""
        if mode == "prefix":
            return self.names.where(F.startswith("name_upper", F.upper(F.lit(value)))).select("name").distinct()
        if mode == "legacy":
            return self.names.where(F.contains("name_upper", F.upper(F.lit(value)))).select("name").distinct()
        if mode == "soundex":
            return self.sounds.where(F.col("code") == N.soundex_of(value)).select("name").distinct()
        if mode == "dm":
            return self.codes.where(one_of("code", dm.codes_of(value) or [])).select("name").distinct()
        if mode == "levenshtein":
            return self.within_edits(value)
        raise ValueError(f"no mode {mode}")

    def name_bits(self, modes: list[str], value: str, column: str = "", nearest: bool = False) -> DataFrame:
        """(name, bits, similarity) of the names that match ``value`` in any of the modes."""
        parts = [self.matched(m, value).select("name", F.lit(EDITS_BIT if m == "levenshtein" else BITS[m]).alias("bits"), F.lit(0.0).alias("similarity")) for m in dict.fromkeys(modes) if m != "trigram"]
        if "trigram" in modes:
            near = self.nearest(value, column) if nearest else self.near(value)
            parts.append(near.select("name", F.lit(BITS["trigram"]).alias("bits"), "similarity"))
        return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.bit_or("bits").alias("bits"), F.max("similarity").alias("similarity"))

    # records of names

    def records_of(self, column: str, names: list[str] | None) -> DataFrame:
        """The records by one of their names; of some names in any case, if they are few, without reading the others."""
        table = self.by_first if column == "first_name" else self.by_last
        if names is not None and len(names) <= MOST_PUSHED:
            table = table.where(one_of("_upper", sorted({n.upper() for n in names})) if all(n.isascii() for n in names) else one_of(column, sorted(set(names))))
        return table.drop("_upper")

    def starting(self, names: dict[str, str]) -> DataFrame:
        """The records all of whose given names start so: the copy by the first of them is read where it does."""
        column = "last_name" if "last_name" in names else "first_name"
        table = self.by_last if column == "last_name" else self.by_first
        out = table.where(F.startswith("_upper", F.upper(F.lit(names[column]))))
        for other, value in names.items():
            out = out.where(F.startswith(F.upper(other), F.upper(F.lit(value)))) if other != column else out
        return out.drop("_upper")


def _sizes(value: str, least: float) -> tuple[int, int]:
    """The least and the greatest number of grams that a name so similar to ``value`` can have."""
    m = len(N.trigrams_of(value))
    return math.ceil(least * m - 1e-9), math.floor(m / least + 1e-9)
