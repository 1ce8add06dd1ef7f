"""Record tables: files in and out, and records derived from a corpus of texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinname.schema import NICKNAMES, RECORD


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a table: the files that were written in bulk and the folders of the streams."""
    return spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(path)


#: Persons that a row group's Bloom filter is made for, and bytes of a row group.
PERSONS_A_GROUP, ROW_GROUP = 200_000, 16 << 20
#: How records are packed: the dictionary holds the names and persons of a whole row group, which take a multiple one by one.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def write_records(records: DataFrame, path: str, *, append: bool = False, rows_a_file: int = 5_000_000, row_group: int = ROW_GROUP, persons: int = PERSONS_A_GROUP, counts: str | None = None, part: str = "bulk") -> None:
    """Appends, or replaces the table and so restarts its ids.

    Sorted within files by date, so that row groups prune on it; each row group has a Bloom filter of its person ids, or a dictionary of
    all of them, so that a lookup of one skips those that surely lack it, for no more persons than a file has rows. counts: a folder of day counts that the rows are
    added to as ``part``, the same name when the write runs again.
    """
    from kinname.operators.day_counts import DayCounts

    names = [f.name for f in RECORD]
    out = records.select(names).sortWithinPartitions("date_of_birth")
    writer = out.write.mode("append" if append else "overwrite").options(**PACKED).option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", str(row_group))
    writer = writer.option("parquet.bloom.filter.enabled#person_id", "true").option("parquet.bloom.filter.expected.ndv#person_id", str(min(persons, rows_a_file)))
    writer.parquet(path)
    if counts:
        kept = DayCounts(records.sparkSession, counts)
        (kept.add if append else kept.restart)(records, part)


def of_person(records: DataFrame, person_id: str) -> DataFrame:
    """The records of a person; of a stored table, from the row groups that may have the id."""
    return records.where(F.col("person_id") == F.lit(person_id))


def block_sample(spark: SparkSession, path: str, fraction: float, seed: int = 0) -> DataFrame:
    """The records of about ``fraction`` of a table's files, one at least; the others are not opened.

    Each file is in or out by a draw of the seed and its name. Rows of a file come together, as those of
    a page do, so counts vary more than of a sample of rows. Files hold whatever dates their writes had, sorted within
    the file only, so dates are as in the table as long as writes mix them; a table whose writes go by date
    gives whole stretches of dates or none. Blocks are as fine as write_records made files (rows_a_file).
    """
    files = sorted(read_records(spark, path).inputFiles())
    drawn = {f: int(hashlib.md5(f"{seed}|block|{f.rsplit('/', 1)[-1]}".encode()).hexdigest()[:13], 16) / (1 << 52) for f in files}
    chosen = [f for f in files if drawn[f] < fraction] or sorted(files, key=drawn.get)[:1]
    return spark.read.schema(RECORD).parquet(*chosen) if chosen else read_records(spark, path)


def read_name_weights(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(column, gender, count) from a CSV with a header; FileNotFoundError with a hint if it is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no name weights at {path}: prepare the file with write_country_names first")
    schema = T.StructType([T.StructField(column, T.StringType()), T.StructField("gender", T.StringType()), T.StructField("count", T.LongType())])
    return spark.read.schema(schema).csv(path, header=True).dropna(subset=[column])


def write_country_names(names: DataFrame, path: str, country: str = "US") -> None:
    """One country's names, without the country column, as CSV with a header."""
    names.where(F.col("country") == country).drop("country").write.mode("overwrite").csv(path, header=True)


def export(records: DataFrame, most: int = 5_000_000):
    """An Arrow table for data-frame libraries, person ids as text; ValueError beyond ``most`` rows, which belong into files."""
    table = records.withColumn("person_id", F.col("person_id").cast("string")).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} records: write them as files instead")
    return table


def export_files(records: DataFrame, path: str) -> None:
    """Any number of records for data-frame libraries: Parquet files in a new folder that they open as they are, person ids as text."""
    records.withColumn("person_id", F.col("person_id").cast("string")).write.parquet(path)


def from_documents(documents: DataFrame) -> DataFrame:
    """(id, first_name, last_name, date_of_birth): every two neighbouring words of a whole text are a record."""
    # the pairs are cut out whole and exploded by themselves: a row that took the words of its text along
    # would cost their square, and a filter on them would cut the text once more
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")
    each = documents.select("doc_id", F.posexplode(F.regexp_extract_all(spaced, F.lit("[A-Za-z]+ [A-Za-z]+"), F.lit(0))).alias("k", "pair"))
    return each.select(
        (F.col("doc_id") * 1_000_000 + F.col("k")).alias("id"), F.substring_index("pair", " ", 1).alias("first_name"), F.substring_index("pair", " ", -1).alias("last_name"),
        F.date_add(F.lit("1940-01-01").cast("date"), ((F.col("doc_id") * 37 + F.col("k")) % 20_000).cast("int")).alias("date_of_birth"),
    )


#: The same relation in DuckDB.
DOCUMENTS_SQL = """
court_words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
court_record AS (
  SELECT doc_id * 1000000 + k AS id, w[2 * k + 1] AS first_name, w[2 * k + 2] AS last_name,
         DATE '1940-01-01' + CAST((doc_id * 37 + k) % 20000 AS INTEGER) AS date_of_birth
  FROM (SELECT doc_id, w, unnest(range(0, len(w) // 2)) AS k FROM court_words WHERE len(w) >= 2))"""


def clustered(records: DataFrame) -> DataFrame:
    """Records whose first name decides person and date."""
    name = F.lower("first_name")
    return records.select("id", "first_name", "last_name", F.date_add(F.lit("1940-01-01").cast("date"), ((F.length("first_name") * 997 + F.ascii(name) * 31) % 20_000).cast("int")).alias("date_of_birth"), F.md5(name).alias("person_id"))


CLUSTERED_SQL = """
clustered AS (
  SELECT id, first_name, last_name, md5(lower(first_name)) AS person_id,
         DATE '1940-01-01' + CAST((length(first_name) * 997 + ascii(lower(first_name)) * 31) % 20000 AS INTEGER) AS date_of_birth
  FROM court_record)"""

_CALLED = sorted({*list(NICKNAMES)[:12], *[n for c in list(NICKNAMES)[:12] for n in NICKNAMES[c]]})


def nicknamed(records: DataFrame) -> DataFrame:
    """Records whose first names are canonical names and nicknames in turn, last names in upper case with few repeats."""
    names = F.array(*map(F.lit, _CALLED))
    return records.select("id", F.get(names, (F.col("id") % len(_CALLED)).cast("int")).alias("first_name"), F.upper(F.concat("first_name", "last_name")).alias("last_name"), "date_of_birth")


NICKNAMED_SQL = f"""
nicknamed AS (
  SELECT id, ([{", ".join(repr(x) for x in _CALLED)}])[CAST(id % {len(_CALLED)} AS INTEGER) + 1] AS first_name, upper(first_name || last_name) AS last_name, date_of_birth
  FROM court_record)"""


def complete(records: DataFrame) -> DataFrame:
    """Derived records with all columns: missing and empty middle names, nicknames of some, persons by first name."""
    nicks = F.array(*[F.array(*map(F.lit, n)) for n in NICKNAMES.values()])
    hexes = F.md5(F.lower("first_name"))
    return records.select(
        "id", "first_name", "last_name", F.when(F.col("id") % 3 == 1, F.lit("")).when(F.col("id") % 3 == 2, F.substring("last_name", 1, 1)).alias("middle_name"), "date_of_birth",
        F.when(F.col("id") % 4 == 0, F.get(nicks, (F.col("id") % len(NICKNAMES)).cast("int"))).otherwise(F.array().cast("array<string>")).alias("nicknames"),
        F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("person_id"),
    )


COMPLETE_SQL = f"""
complete AS (
  SELECT id, first_name, last_name, CASE id % 3 WHEN 1 THEN '' WHEN 2 THEN substr(last_name, 1, 1) END AS middle_name, date_of_birth,
         CASE WHEN id % 4 = 0 THEN ({[list(n) for n in NICKNAMES.values()]})[CAST(id % {len(NICKNAMES)} AS INTEGER) + 1] ELSE [] END AS nicknames,
         substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS person_id
  FROM (SELECT *, md5(lower(first_name)) AS h FROM court_record))"""


def with_nicknames(records: DataFrame) -> DataFrame:
    return records.where(F.size("nicknames") > 0)


def without_middle_name(records: DataFrame, *, empty: bool = False) -> DataFrame:
    """Records whose middle name is missing; with ``empty``, or empty."""
    return records.where(F.col("middle_name").isNull() | (F.lit(empty) & (F.col("middle_name") == "")))
