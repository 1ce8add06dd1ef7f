"""Stored tables: Bloom filters, block samples, day counts; and nickname pairs on one very common last name."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from kinname.operators import reports
from kinname.operators.day_counts import DayCounts
from kinname.plans import figures
from kinname.schema import RECORD
from kinname.sources import records
from kinname.streaming import ingest


@pytest.fixture(scope="module")
def rows(spark):
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 97).cast("int"))
    names = F.when(F.col("id") % 5 == 0, "ROBERT").when(F.col("id") % 5 == 1, "BOB").when(F.col("id") % 7 == 2, "ROB").otherwise("ANN")
    made = spark.range(40_000).select(
        "id", names.alias("first_name"), F.when(F.col("id") % 3 == 0, "COMMON").otherwise(F.concat(F.lit("N"), (F.col("id") % 11).cast("string"))).alias("last_name"), F.lit(None).cast("string").alias("middle_name"),
        F.when(F.col("id") % 1_000 != 7, day).alias("date_of_birth"), F.array().cast("array<string>").alias("nicknames"), F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("person_id"),
    )
    return made.cache()


def test_bloom_filters_skip_row_groups(spark, rows, tmp_path):
    records.write_records(rows, str(tmp_path), rows_a_file=4_000, row_group=1 << 18, persons=5_000)
    table = records.read_records(spark, str(tmp_path))
    for k in (0, 77, 19_999):
        df = records.of_person(table, spark.range(1).select(F.sha2(F.lit(str(k)), 256)).first()[0])
        assert sorted(r["id"] for r in df.collect()) == [k, k + 20_000]
        assert figures.scanned(df)[0] < 0.4 * 40_000
    none = records.of_person(table, "nobody")
    assert none.collect() == [] and figures.scanned(none)[0] == 0  # by the statistics and filters alone


def test_block_samples_read_their_files_alone(spark, rows, tmp_path):
    records.write_records(rows.repartition(20), str(tmp_path), rows_a_file=1_000)
    files = len(records.read_records(spark, str(tmp_path)).inputFiles())
    shares = []
    for seed in range(3):
        df = records.block_sample(spark, str(tmp_path), 0.25, seed)
        n = len(df.collect())
        read, _, opened = figures.scanned(df)
        assert read == n and opened == len(df.inputFiles()) and 0 < opened < 0.5 * files
        assert sorted(df.inputFiles()) == sorted(records.block_sample(spark, str(tmp_path), 0.25, seed).inputFiles())
        shares.append(n / 40_000)
    assert 0.1 < sum(shares) / 3 < 0.45
    assert records.block_sample(spark, str(tmp_path), 0.0).count() == 1_000  # one block at least
    assert records.block_sample(spark, str(tmp_path), 1.0).count() == 40_000


def test_examples_of_a_stored_table_do_not_scan_it(spark, rows, tmp_path):
    few = rows.where("id < 1000").withColumn("date_of_birth", F.coalesce("date_of_birth", F.lit(date(1990, 1, 1))))
    records.write_records(few.repartition(5), str(tmp_path / "table"), counts=str(tmp_path / "counts"))
    table = records.read_records(spark, str(tmp_path / "table"))
    days = DayCounts(spark, str(tmp_path / "counts")).days()
    assert len(reports.sample_dobs(table, path=str(tmp_path / "table"), most=10)) == 10
    assert len(reports.sample_dobs(table, path=str(tmp_path / "table"), most=500)) == 97  # all that there are
    got = reports.generate_examples(table, path=str(tmp_path / "table"), counted=days)
    assert len(got["groups"]) == 7 and 5 <= table.where(F.col("date_of_birth") == F.lit(date.fromisoformat(got["dob"]))).count() <= 20
    empty = spark.createDataFrame([], RECORD)
    records.write_records(empty, str(tmp_path / "none"), counts=str(tmp_path / "no_counts"))
    assert reports.generate_examples(empty, path=str(tmp_path / "none"))["groups"] == []


def test_day_counts_count_each_write_once(spark, rows, tmp_path):
    table, names, counts = (str(tmp_path / x) for x in ("table", "names", "counts"))
    kept = DayCounts(spark, counts)
    assert kept.days().count() == 0 and kept.total().first()[0] == 0
    records.write_records(rows, table, counts=counts, part="old")
    records.write_records(rows.where("id % 2 = 0"), table, counts=counts, part="bulk")
    for _ in range(2):  # a batch that runs again
        ingest.append(rows.where("id % 4 = 1"), table, names, 0, "a", counts)
    rows.where("id % 4 = 3").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a stream that starts again
        stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.start(stream, table, names, str(tmp_path / "checkpoint"), counts).awaitTermination()
    want = {r[0]: r[1] for r in rows.groupBy("date_of_birth").count().collect()}
    assert {r[0]: r[1] for r in kept.days().collect()} == want and None in want
    assert kept.total().first()[0] == 40_000 == records.read_records(spark, table).count()
    days = [date(1990, 1, 1), date(1990, 1, 2) + timedelta(days=400)]
    assert {tuple(r) for r in kept.of(days).collect()} == {tuple(r) for r in reports.dob_counts(rows, days).collect()}
    assert {tuple(r) for r in kept.in_window(300, 410).collect()} == {tuple(r) for r in reports.dobs_in_window(rows, 300, 410).collect()}
    for level in ("year", "month", "day"):
        assert {tuple(r) for r in kept.hierarchy(level).collect()} == {tuple(r) for r in reports.date_hierarchy(rows, level).collect()}
    within = F.month("date_of_birth") == 2
    assert {tuple(r) for r in kept.hierarchy("day", within).collect()} == {tuple(r) for r in reports.date_hierarchy(rows, "day", within).collect()}


def test_folded_nickname_pairs_are_the_pairs(rows):
    small = rows.where("id < 900")
    pairs = reports.nickname_pairs(small).collect()
    groups = reports.nickname_pair_groups(small).collect()
    assert sum(g["pairs"] for g in groups) == len(pairs) and len({(g["canonical"], g["nickname"], g["last_name"]) for g in groups}) == len(groups)
    for g in groups:
        mine = [p for p in pairs if (p["canonical"], p["nickname"], p["last_name"]) == (g["canonical"], g["nickname"], g["last_name"])]
        assert (g["pairs"], g["first_canonical"], g["first_nickname"]) == (len(mine), min(p["canonical_id"] for p in mine), min(p["nickname_id"] for p in mine))
    order = lambda p: (p["canonical"], p["nickname"], p["last_name"], p["canonical_id"], p["nickname_id"])
    for most in (1, 20, 3_000):
        page = reports.nickname_page(small, most)
        assert [order(p) for p in page.collect()] == sorted(map(order, pairs))[:most]
    # on all rows a third has one last name: counted, not listed
    hot = reports.nickname_pair_groups(rows).where("last_name = 'COMMON' AND nickname = 'BOB'")
    assert hot.first()["pairs"] == rows.where("last_name = 'COMMON' AND first_name = 'BOB'").count() * rows.where("last_name = 'COMMON' AND first_name = 'ROBERT'").count()
