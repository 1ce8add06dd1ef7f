"""What is written takes little disk: no table that no one asks, no rows twice, no shuffle files beyond their write."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from kinname import queries
from kinname.operators.index import TABLES, NameIndex
from kinname.operators.request import SearchRequest
from kinname.operators.search import search
from kinname.plans import figures
from kinname.sources import records
from kinname.sources.shared import shared_dir

DATA = "/root/testdata/sf0.001"


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


@pytest.fixture(scope="module")
def rows(spark):
    names = F.array(*map(F.lit, ["Smith", "smyth", "Schmidt", "Thing", "Éric", None]))
    made = spark.range(3_000).select("id", F.concat(F.lit("Jo"), F.col("id") % 13).alias("first_name"), F.element_at(names, (F.col("id") % 6 + 1).cast("int")).alias("last_name"), F.lit(date(1990, 1, 1)).alias("date_of_birth"))
    return made.cache()


def _same(rows, index, modes, first="", last="Smith"):
    asked = SearchRequest(modes, first, last)
    assert search(rows, asked, vocabulary=index).collect() == search(rows, asked).collect() != []


def _tables(spark, modes, monkeypatch):
    """The tables that a query's index is written with."""
    monkeypatch.setattr(queries, "_indexes", {})
    index = queries._index(spark, DATA, modes)
    return {t for t in TABLES if index.has(t)}


def test_an_index_has_the_tables_that_are_asked(spark, rows):
    index = NameIndex(spark, f"{shared_dir(spark)}/index").build(rows, tables=["by_last", "sounds"])
    assert {t for t in TABLES if index.has(t)} == {"names", "by_last", "sounds"}
    _same(rows, index, ["soundex"])
    _same(rows, index, ["soundex"], "J", "Smith")  # by the copy that is there
    index.add(["grams", "by_first"])
    _same(rows, index, ["prefix", "trigram"])
    _same(rows, index, ["trigram"], "Jo1", "")
    index.build(rows.select((F.col("id") + 3_000).alias("id"), "first_name", F.concat("last_name", F.lit("s")).alias("last_name"), "date_of_birth"), append=True)
    assert not index.has("edits") and index.by_last.count() == index.by_first.count() == 6_000
    assert index.by_last.select("id").distinct().count() == 6_000
    index.build(rows, tables=["by_first", "codes"])
    assert {t for t in TABLES if index.has(t)} == {"names", "by_first", "codes"}
    _same(rows, index, ["dm"], "Jo1", "")


def test_a_soundex_query_writes_what_it_asks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "_kept", lambda *a: kept.append(a))
    assert _tables(spark, ["soundex"], monkeypatch) == {"names", "sounds", "by_last"} and not kept


def test_a_merged_query_writes_what_it_asks(spark, monkeypatch):
    assert _tables(spark, ["prefix", "trigram"], monkeypatch) == {"names", "grams", "by_last"}


def test_a_trigram_query_adds_what_an_earlier_one_has_not(spark, monkeypatch):
    assert _tables(spark, ["trigram"], monkeypatch) == {"names", "grams", "by_last"}
    written = []
    monkeypatch.setattr(NameIndex, "_put", lambda self, rows, table, append: written.append(table))
    queries._index(spark, DATA, ["trigram", "soundex"])
    queries._index(spark, DATA, ["soundex"])
    assert written == ["sounds"]


def test_an_index_leaves_no_shuffle_files(spark, rows):
    before = _shuffles(spark)
    index = NameIndex(spark, f"{shared_dir(spark)}/index").build(rows)
    index.build(rows.where("id < 5"), append=True)
    assert _shuffles(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stored_records_are_packed(spark, tmp_path):
    """Persons of many rows stand once in a row group, not once a row; the rows are those that were written."""
    made = records.complete(spark.range(60_000).select("id", F.concat(F.lit("N"), F.col("id") % 30_000).alias("first_name"), F.lit("L").alias("last_name"), F.lit(date(1990, 1, 1)).alias("date_of_birth"))).coalesce(1)
    records.write_records(made, str(tmp_path / "t"))
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < 35 * 60_000
    table = records.read_records(spark, str(tmp_path / "t"))
    assert table.orderBy("id").collect() == made.orderBy("id").collect()
    person = made.where("id = 7").first()["person_id"]
    assert sorted(r["id"] for r in records.of_person(table, person).collect()) == [7, 30_007]
    df = records.of_person(table, "nobody")
    assert df.collect() == [] and figures.scanned(df)[0] == 0


def test_stored_records_are_sorted_where_they_are_made(spark, monkeypatch):
    plans, write = [], records.write_records

    def seen(rows, *args, **more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() <= 32 << 20
        write(rows, *args, **more)

    monkeypatch.setattr(records, "write_records", seen)
    before = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    assert queries.stored_records(spark, DATA).count() == queries.record_count(spark, DATA).first()[0]
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)
    assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() == before


def test_streamed_records_keep_nothing_twice(spark, monkeypatch, tmp_path):
    """No second table of all records, and what a stream has read goes; each batch leaves no shuffle files."""
    folder = tmp_path / "streamed"
    monkeypatch.setattr(queries, "shared_dir", lambda s: str(folder))
    monkeypatch.setattr(queries, "_kept", None)
    before = _shuffles(spark)
    got = queries.streamed_records(spark, DATA)
    assert _shuffles(spark) <= before
    want = queries._flat(records.complete(queries._records(spark, DATA)).select(got.columns))
    assert got.orderBy("id").collect() == want.orderBy("id").collect()
    assert {p.name for p in folder.iterdir()} == {"records", "names", "in", "checkpoint1", "checkpoint2"}
    assert not list((folder / "in").glob("**/part-*"))
    files = list(folder.glob("records/**/*.parquet"))
    assert sum(f.stat().st_size for f in files) < 25 * got.count() and any("stream=" in str(f) for f in files)
