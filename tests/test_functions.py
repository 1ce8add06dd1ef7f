"""Name functions against published and pinned values, and the phonetic coder against the codec on Spark's class path."""

import itertools
import random
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinname.functions import daitch_mokotoff as dm
from kinname.functions import names as N
from kinname.operators.request import SearchRequest, parse_date, parse_explain_modes, parse_modes, parse_reference_date


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_soundex(spark):
    known = {"John": "J500", "Smith": "S530", "Smyth": "S530", "Smythe": "S530", "Smidt": "S530", "Schmidt": "S530", "resyes": "R220", "rosas": "R220", "Waller": "W460", "Ashcraft": "A226", "": "", "123": "", "'Neil": "N400"}
    assert values(spark, N.soundex, known) == list(known.values())
    assert [N.soundex_of(k) for k in known] == list(known.values())


def test_similarity_pins(spark):
    pins = [("Smit", "Smith", 0.571), ("Smitz", "Smith", 0.5), ("BEJNAMIN", "BENJAMIN", 0.385), ("Smyth", "Smith", 0.333), ("Smythe", "Smith", 0.182), ("Geraldine", "Gerardine", 0.538), ("Morgan", "Morrison", 0.231), ("car", "truck", 0.0), ("postgres", "postgres", 1.0), ("John", "Jane", 0.111), ("", "", 0.0), ("", "x", 0.0)]
    df = spark.createDataFrame(pins, "a string, b string, s double")
    for r in df.withColumn("got", N.similarity(F.col("a"), F.col("b"))).withColumn("back", N.similarity(F.col("b"), F.col("a"))).collect():
        assert r.got == pytest.approx(r.s, abs=6e-4) and r.got == r.back


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB c-'é", max_size=12))
def test_python_trigrams_are_a_set(text):
    grams = N.trigrams_of(text)
    assert len(grams) == len(set(grams)) and all(len(g) == 3 for g in grams)


def test_trigrams_agree_with_python(spark):
    rng = random.Random(1)
    names = ["".join(rng.choices("abcXY -'é1", k=rng.randint(0, 10))) for _ in range(200)]
    for got, name in zip(values(spark, N.trigrams, names), names, strict=True):
        assert sorted(got) == sorted(N.trigrams_of(name)), name


def test_edits(spark):
    rows = [("michael", "mikael", 2), ("resyes", "rosas", 3), ("SMITH", "SMYTH", 1), ("Smith", "SMITH", 0), ("WILLIAM", "BILL", 4), ("J", "JOHN", 3)]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for r in df.select("d", "b", N.edits(F.col("a"), F.col("b")).alias("full"), N.edits(F.col("a"), F.col("b"), 2).alias("bounded")).collect():
        assert r.full == r.d and r.bounded == min(r.d, 3)
    near = spark.createDataFrame([("abc",), ("xyz",)], "x string").where(N.within_edits(F.col("x"), "abd")).collect()
    assert [r.x for r in near] == ["abc"]  # beyond the bound the function gives -1, which must not pass


def test_small_functions(spark):
    assert values(spark, N.without_double, ["WALLER", "AABB", "SMITH", ""]) == ["WALER", "ABB", "SMITH", ""]
    dates = ["1990-05-15", "1990-5-15", " 1990-05-15 ", "invalid", "1990-05-15 10:00:00", "", "1990-02-30"]
    day = date(1990, 5, 15)
    assert values(spark, N.parsed_date, dates) == [day, day, day, None, None, None, None]
    assert [parse_date(d) for d in dates] == [day, day, day, None, None, None, None]
    names = spark.createDataFrame([("A", "B", "C"), ("A", "", "C"), ("A", None, "C")], "a string, b string, c string")
    assert [r[0] for r in names.select(N.full_name(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["A B C", "A C", "A C"]
    with pytest.raises(ValueError):
        parse_reference_date("1990-13-01")


def test_daitch_mokotoff(spark):
    assert dm.codes_of("BOB") == ["770000"] and dm.codes_of("ROBERT") == ["979300"]
    assert set(dm.codes_of("michael")) & set(dm.codes_of("mikael"))
    assert dm.codes_of("") is None and dm.codes_of("123") is None and dm.codes_of(None) is None
    codec = spark.sparkContext._jvm.org.apache.commons.codec.language.DaitchMokotoffSoundex()
    rng = random.Random(2)
    parts = ["sch", "cz", "tz", "mn", "nm", "rs", "ch", "ei", "au", "j", "x", "zh", "d", "t", "h", "a", "e", "o", "l", "k", "s", "b"]
    names = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(1_500)]
    both = [(dm.codes_of(n), codec.soundex(n).split("|")) for n in names]
    # the codec drops a branch whose digits so far equal another's, though their next codes can differ
    assert all(set(theirs) <= set(own) for own, theirs in both) and sum(own != theirs for own, theirs in both) < 15
    assert values(spark, dm.codes, ["Smith", "", None]) == [dm.codes_of("Smith"), None, None]


def test_parsing():
    for text in (None, "", "bogus"):
        assert parse_modes(text) == ["prefix"]
    assert parse_modes("prefix, soundex") == ["prefix"]
    assert parse_modes("prefix,prefix") == ["prefix", "prefix"] and parse_modes("prefix,soundex") == ["prefix", "soundex"]
    assert parse_explain_modes(" legacy , soundex ") == ["legacy", "soundex"]
    assert parse_explain_modes("", "legacy") == ["legacy"] and parse_explain_modes("dm", "legacy") == ["dm"] and parse_explain_modes(None) == ["prefix"]
    r = SearchRequest.parse({"first_name": " John ", "last_name": "   ", "date_of_birth": "1990-5-15", "sort": "dob_desc"})
    assert (r.first_name, r.last_name, r.date_of_birth, r.sort_field) == ("John", "", date(1990, 5, 15), "-date_of_birth")
    assert SearchRequest.parse({"sort": " dob_asc"}).sort_field == "" == SearchRequest.parse({"sort": "bogus"}).sort_field
    assert list(itertools.chain(r.names)) == ["first_name"]
