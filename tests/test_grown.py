"""What grows with the table stays cheap: texts are cut once, a name is judged once, nothing whole passes the driver."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from kinname import queries
from kinname.operators import reports, request, search, vocabulary
from kinname.operators.request import SearchRequest
from kinname.sources import records
from kinname.streaming import ingest

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _people(spark, n=400):
    return spark.range(n).select("id", F.concat(F.lit("A"), F.col("id") % 7).alias("first_name"), F.element_at(F.array(*map(F.lit, ["Schander", "Schandler", "Smith", "Jones", None])), (F.col("id") % 5 + 1).cast("int")).alias("last_name"), F.lit(date(1990, 1, 1)).alias("date_of_birth"))


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, None), (2, "a"), (3, "a b c"), (4, " 12 x--y\nz'q é w 9"), (None, "p q r s")], "doc_id long, text string")
    got = records.from_documents(docs)
    assert [tuple(r)[:3] for r in got.collect()] == [(3_000_000, "a", "b"), (4_000_000, "x", "y"), (4_000_001, "z", "q"), (None, "p", "q"), (None, "r", "s")]
    assert _plan(got.where("last_name > 'a'")).count("regexp_replace") == 1


def test_vocabulary_judges_each_name_once(spark):
    rows = _people(spark)
    for modes in (["prefix", "trigram"], ["soundex", "dm", "levenshtein"]):
        plan = _plan(vocabulary.name_bits(vocabulary.build(rows), SearchRequest(modes, "", "schander"), "schander"))
        below = plan[plan.rindex("HashAggregate") :]
        assert "levenshtein" not in below and "array_intersect" not in below and "arrays_overlap" not in below
    assert {r.name for r in vocabulary.distinct_names(rows, ["last_name"]).collect()} == {"Schander", "Schandler", "Smith", "Jones", None}


@pytest.mark.parametrize("modes", [["dm"], ["trigram"], ["prefix", "trigram"], ["dm", "levenshtein"], ["legacy", "dm"]])
@pytest.mark.parametrize("first", ["", "A1"])
def test_dear_modes_judge_each_name_once(spark, modes, first):
    rows, asked = _people(spark), SearchRequest(modes, first, "schander")
    built = search.plan(rows, asked)
    assert all("arrays_overlap" not in _plan(p) and "array_intersect" not in _plan(p) for p in (built.main, built.trigram) if p is not None)
    one_date = search.search(rows, SearchRequest(modes, first, "schander", date(1990, 1, 1)))  # judges records as they are
    assert search.search(rows, asked).collect() == one_date.collect() != []


def test_display_sql_asks_each_name_once(spark):
    assert "array_intersect" not in _plan(queries.display_sql(spark, DATA))


def test_export_files_have_no_bound(spark, tmp_path, monkeypatch):
    made = records.complete(_people(spark).where("last_name IS NOT NULL"))
    records.export_files(made, str(tmp_path / "out"))
    assert records.read_records(spark, str(tmp_path / "out")).orderBy("id").collect() == made.orderBy("id").collect()
    monkeypatch.setattr(records, "export", None)  # what passes the driver
    assert queries.exported_records(spark, DATA).count() == queries.record_count(spark, DATA).first()[0]


def test_dates_that_recur_are_parsed_once():
    request._strict_date.cache_clear()
    for _ in range(50):
        assert request.parse_reference_date("1990-02-28") == date(1990, 2, 28)
        with pytest.raises(ValueError, match="does not match"):
            request.parse_reference_date("1990-02-30")
    assert request._strict_date.cache_info().misses == 2
    a, b = request.parse_modes("prefix,dm"), request.parse_modes("prefix,dm")
    assert a == b == ["prefix", "dm"] and a is not b


def test_nickname_page_reads_the_records_once_a_side(spark, tmp_path):
    rows = spark.range(60).select("id", F.element_at(F.array(*map(F.lit, ["DANIEL", "DAN", "DANNY"])), (F.col("id") % 3 + 1).cast("int")).alias("first_name"), F.lit("N").alias("last_name"), F.lit(date(1990, 1, 1)).alias("date_of_birth"))
    rows.write.parquet(str(tmp_path / "rows"))
    page = reports.nickname_page(spark.read.parquet(str(tmp_path / "rows")), 7)
    assert _plan(page).count("FileScan") == 2  # equal ones, of which one runs
    assert [(r.canonical, r.nickname, r.canonical_id, r.nickname_id) for r in page.collect()] == [("DANIEL", "DAN", 0, 1 + 3 * i) for i in range(7)]


def test_small_files_have_small_filters(spark, tmp_path):
    records.write_records(records.complete(_people(spark).where("last_name IS NOT NULL")).coalesce(1), str(tmp_path / "t"), rows_a_file=100)
    assert max(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < 32_000


def test_vocabulary_of_a_batch_is_that_of_its_files(spark, tmp_path):
    """The batch itself, of which each run differs here, runs once."""
    batch = records.complete(_people(spark, 50).withColumn("last_name", F.uuid()))
    ingest.append(batch, str(tmp_path / "t"), str(tmp_path / "n"))
    table, names = records.read_records(spark, str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "n"))
    assert {r.name for r in names.collect()} == {r[0] for r in table.select(F.explode(F.array("first_name", "last_name"))).collect()}
    ingest.append(table, str(tmp_path / "u"), str(tmp_path / "n"))
    assert names.count() == spark.read.parquet(str(tmp_path / "n")).count()


def test_stored_records_are_dealt_while_narrow(spark):
    plan = _plan(queries._dealt(spark, DATA))
    assert "md5" in plan[: plan.index("Exchange")] and "md5" not in plan[plan.index("Exchange") :]


def test_texts_of_dates_are_parsed_apart_from_records(spark):
    assert "MapInArrow" not in _plan(queries.reference_dates(spark, DATA))
