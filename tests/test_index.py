"""The stored index gives the rows of a scan, reads little of itself, and what ran is told in figures."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.functions import sql
from kinname.operators import index, vocabulary
from kinname.operators.index import NameIndex
from kinname.operators.request import SearchRequest
from kinname.operators.search import run, search
from kinname.plans import figures
from kinname.plans.explain import explain

SCHEMA = "id long, first_name string, last_name string, date_of_birth date"
ODD = ["", "A", "bc", "THE", "the", "Éric", "straße", "O'Neil", "van der Berg", "123", "😀a", "x" * 50, "SM1TH", "Smith", "Smyth", "smith"]


def fuzzed(rng, n, letters="abcdeiklmnorstu"):
    return ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n)]


def people(spark, names, days=30):
    rng = random.Random(len(names))
    rows = [(i, rng.choice(names), name, date(1990, 1, 1 + i % days)) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rows = people(spark, fuzzed(random.Random(1), 12_000)).cache()
    return rows, NameIndex(spark, str(tmp_path_factory.mktemp("index"))).build(rows)


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    rows = people(spark, ODD * 3 + fuzzed(random.Random(2), 300, "aeinrstSMITHé' "))
    extra = spark.createDataFrame([(9_000, None, "Smith", None), (9_001, "Jon", None, None)], SCHEMA)
    rows = rows.union(extra).cache()
    return rows, NameIndex(spark, str(tmp_path_factory.mktemp("index"))).build(rows)


def test_phonetics_have_one_rule(spark):
    """Column, SQL and Python forms agree on letters, digits, marks, accents and clusters."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" * 2 + "schtzrdw" * 4 + "ßàçćłęąţéÉŻ'- 0129İ😀"
    names = [None, *ODD, "O2BRIEN", "OBRIEN", "ękß", *fuzzed(rng, 3_000, letters)]
    sql.register(spark)
    c = F.col("name")
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", N.soundex(c).alias("s"), F.expr("soundex_code(name)").alias("t"), dm.codes(c).alias("d"), F.expr("daitch_mokotoff(name)").alias("e"))
    for r in df.collect():
        assert r.d == r.e == dm.codes_of(r.name), r.name
        if r.name is not None:
            assert r.s == r.t == N.soundex_of(r.name), r.name
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert N.soundex_of("SM1TH") == "S530" and N.soundex_of("O2BRIEN") == "O165"


def test_deletions_have_one_rule(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(n,) for n in [*ODD, *fuzzed(rng, 200, "abcé😀")]], "n string")
    for n, got in df.select("n", index.deletions(F.col("n"))).collect():
        if n.upper() == n.upper().lower().upper() and "ß" not in n:
            assert sorted(got) == sorted(index.deletions_of(n)) and len(got) <= 29


def test_similar_and_near_names_are_those_of_all_pairs(spark, many):
    rows, ix = many
    names = rows.select(F.col("first_name").alias("name")).union(rows.select("last_name")).distinct().cache()
    for value in ("sanderik", "abc", "tessa", "x", "a", "lion rain", ""):
        want = {r[0]: r[1] for r in names.select("name", N.similarity_to(N.trigrams(F.col("name")), value).alias("s")).where("s >= 0.3").collect()}
        assert {r[0]: r[1] for r in ix.near(value).collect()} == want, value
        assert {r[0] for r in ix.within_edits(value).collect()} == {r[0] for r in names.where(N.within_edits(F.col("name"), value)).collect()}, value


MODES = [["prefix"], ["soundex"], ["dm"], ["levenshtein"], ["trigram"], ["prefix", "trigram"], ["soundex", "levenshtein"], ["legacy", "dm", "levenshtein", "trigram"], ["trigram", "levenshtein"], ["prefix", "legacy"]]


@pytest.mark.parametrize("modes", MODES)
def test_a_search_through_the_index_is_the_search(few, modes):
    rows, ix = few
    for first, last, dob, sort in (("", "Smith", None, ""), ("th", "s", None, "date_of_birth"), ("", "Éric", date(1990, 1, 3), "-date_of_birth"), ("123", "SM1TH", None, "")):
        request = SearchRequest(modes, first, last, dob, sort)
        assert search(rows, request, vocabulary=ix).collect() == search(rows, request).collect(), request


def test_pages_of_many_matches(many):
    rows, ix = many
    for modes, last in ((["trigram"], "tarin"), (["prefix", "trigram"], "tar"), (["levenshtein"], "a"), (["soundex"], "tarin"), (["prefix"], "s")):
        request = SearchRequest(modes, "", last)
        assert search(rows, request, vocabulary=ix).collect() == search(rows, request).collect(), request


def test_appended_records_are_found(spark, few, tmp_path):
    rows, _ = few
    half = NameIndex(spark, str(tmp_path)).build(rows.where("id % 2 = 0"))
    half.build(rows.where("id % 2 = 1"), append=True)
    half._write(half.grams, "more", "gram")  # names that two appends add at once stand there twice
    half._write(spark.read.parquet(f"{tmp_path}/more"), "grams", "gram", append=True)
    half._write(half.names.withColumn("x", F.lit(1)).drop("x").limit(50), "names2", "name")
    half._write(spark.read.parquet(f"{tmp_path}/names2"), "names", "name", append=True)
    for modes in (["trigram"], ["prefix", "dm"], ["levenshtein"], ["soundex", "trigram"]):
        request = SearchRequest(modes, "", "Smith")
        assert search(rows, request, vocabulary=half).collect() == search(rows, request).collect()


def test_a_probe_reads_little(many):
    rows, ix = many
    n = ix.names.count()
    assert ix.candidates("tarinse", 0.3).count() < 0.05 * n  # those that are compared
    for mode, value, table, most in (("dm", "sandersmi", "codes", 0.35), ("soundex", "sandersmi", "sounds", 0.35), ("prefix", "tarin", "names", 0.35), ("levenshtein", "tarinse", "edits", 0.35)):
        df = ix.matched(mode, value)
        df.collect()
        assert figures.scanned(df)[0] <= most * getattr(ix, table).count(), mode
    df = ix.starting({"last_name": "tarin"})
    df.collect()
    assert figures.scanned(df)[0] < 0.4 * rows.count()
    assert "StringStartsWith(_upper,TARIN)" in df._jdf.queryExecution().executedPlan().toString()


def test_doubled_and_bare_vocabularies(spark, few):
    rows, _ = few
    names = vocabulary.build(rows)
    for modes in (["dm"], ["trigram", "soundex"], ["levenshtein"]):
        request = SearchRequest(modes, "", "Smith")
        want = search(rows, request).collect()
        assert search(rows, request, vocabulary=names.union(names)).collect() == want
        assert search(rows, request, vocabulary=vocabulary.build(rows, with_dm=False)).collect() == want


def test_figures_of_each_node(many):
    rows, _ = many
    df = rows.where("id % 3 = 0").groupBy("date_of_birth").count()
    df.collect()
    found = figures.nodes(df)
    assert found[0].depth == 0 and max(n.depth for n in found) >= 3
    assert {n.name: n.rows for n in found}["Filter"] == 4_000
    assert [n.rows for n in found if n.name == "HashAggregate"][0] == 10
    assert "4,000" in figures.table(found)


def test_explained_searches_have_figures(spark, many, tmp_path):
    rows, ix = many
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    for modes, names in ((["prefix"], None), (["soundex"], None), (["dm"], ix), (["trigram"], ix), (["legacy"], None)):
        e = explain(stored, SearchRequest(modes, "", "tarin"), analyze=True, vocabulary=names)
        assert e["error"] is None and e["rows"] == search(stored, SearchRequest(modes, "", "tarin")).count()
        assert any(n.rows == e["rows"] for n in e["figures"]) or e["rows"] == 200
        assert len(e["executions"]) == 1 if names is None else len(e["executions"]) > 1
        assert any(n.files for n in e["figures"]) and "Physical Plan" in e["plan"]
    assert explain(stored, SearchRequest(["prefix"], "", "t"))["figures"] is None


def test_concurrent_searches_tell_their_executions_apart(many):
    rows, ix = many
    asked = [(["prefix"], None, 1), (["trigram"], ix, 3), (["dm"], ix, 2), (["legacy"], None, 1)] * 2
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda a: run(rows, SearchRequest(a[0], "", "tarin"), vocabulary=a[1]), asked))
    for (_, _, least), r in zip(asked, got, strict=True):
        assert len(r.executions) >= least and (least > 1 or len(r.executions) == 1)
        assert sum(e.ms for e in r.executions) <= r.elapsed_ms * 1.05 + 50 and all("Scan" in p or "Relation" in p for p in r.ran[-1:])
    ids = [e.id for r in got for e in r.executions]
    assert len(ids) == len(set(ids))
