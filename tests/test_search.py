"""Search semantics on small tables: modes, their algebra, limits, order, explanation, and the vocabulary path."""

import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from kinname.operators import reports, vocabulary
from kinname.operators.request import SearchRequest
from kinname.operators.search import decorated, query_codes, run, search, search_unified
from kinname.plans.explain import explain, mode_sql, quoted

DAY = date(1990, 5, 15)


def table(spark, *rows):
    data = [(i + 1, r[0], r[1], r[2] if len(r) > 2 else date(1990, 1, 1)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id long, first_name string, last_name string, date_of_birth date")


def found(df, modes, first="", last="", dob=None, sort=""):
    return [(r.first_name, r.last_name) for r in search_unified(df, modes, first, last, dob, sort).collect()]


def test_modes(spark):
    df = table(spark, ("John", "Smith", DAY), ("Jonh", "Smyth"), ("Alice", "Jones"), ("Johnathon", "Smithsonian"), ("Jon", "Schmidt"))
    assert found(df, ["prefix"], "John", "Smith") == [("John", "Smith"), ("Johnathon", "Smithsonian")]
    assert found(df, ["legacy"], "OHN", "mith") == [("John", "Smith"), ("Johnathon", "Smithsonian")]
    assert found(df, ["soundex"], "John", "Smyth") == [("John", "Smith"), ("Jonh", "Smyth"), ("Jon", "Schmidt")]
    assert found(df, ["soundex", "levenshtein"], "John", "Smith") == [("John", "Smith"), ("Jonh", "Smyth")]
    assert found(df, ["dm"], last="Smith") == [("John", "Smith"), ("Jonh", "Smyth"), ("Jon", "Schmidt")]
    assert found(df, ["trigram"], last="Smith")[0] == ("John", "Smith")
    for modes in (["prefix"], ["soundex"], ["legacy", "levenshtein"], ["dm"], ["trigram"]):
        assert found(df, modes, "John", "Smith", DAY) == [("John", "Smith")], modes


def test_levenshtein_alone_and_on_top(spark):
    df = table(spark, ("John", "Smith", DAY), ("Robert", "Jones", DAY))
    assert found(df, ["levenshtein"], "Jahn", "Smith", DAY) == [("John", "Smith")]
    assert found(df, ["levenshtein"], "Qzzz", "Zzzz", DAY) == []
    assert len(found(df, ["levenshtein"], dob=DAY)) == 2
    assert len(found(df, ["legacy", "levenshtein"], "Joh", "Smith")) == 1
    assert found(df, ["legacy", "levenshtein"], "J", "Smith") == []
    assert len(found(df, ["legacy"], "J", "Smith")) == 1
    assert {r.match_source for r in search_unified(df, ["levenshtein"], "Jahn", "").collect()} == {0}


def test_no_nicknames(spark):
    df = table(spark, ("William", "Smith", DAY), ("Robert", "Smith", DAY), ("Bill", "Smith", DAY))
    assert found(df, ["legacy", "levenshtein"], "Bill", "Smith") == [("Bill", "Smith")]
    assert found(df, ["dm"], "Bob", "Smith") == []


def test_sort_and_empty(spark):
    df = table(spark, ("Zed", "Smith", date(1992, 6, 15)), ("Ike", "Smith", date(1988, 1, 1)), ("Amy", "Smith", date(1995, 12, 31)), ("Bob", "Smith", DAY))
    names = lambda sort, modes=("prefix",): [n for n, _ in found(df, list(modes), last="Smith", sort=sort)]
    assert names("date_of_birth") == ["Ike", "Bob", "Zed", "Amy"]
    assert names("-date_of_birth") == ["Amy", "Zed", "Bob", "Ike"]
    assert names("-date_of_birth", ("legacy",)) == ["Zed", "Ike", "Amy", "Bob"]  # a sort is dropped beside the substring mode
    assert names("first_name") == ["Amy", "Bob", "Ike", "Zed"]
    assert found(df, ["prefix"]) == []
    assert found(df, ["trigram"], dob=DAY) == []  # a date alone has no neighbours
    assert found(df, [], "Zed") == []


def test_limits(spark):
    df = table(spark, *[(f"First{i}", "Last", DAY) for i in range(250)])
    assert len(found(df, ["prefix"], dob=DAY)) == 200
    assert len(found(df, ["prefix"], last="Last")) == 200
    assert run(df, SearchRequest(["prefix"], "", "Last")).full_page


def test_trigram_top_up(spark):
    near = [("Mary", "Smit"), ("Tom", "Smitz"), ("Pat", "Smity"), ("Lee", "Smita"), ("Kim", "Smits")]
    df = table(spark, *[("John", "Smith")] * 150, *near)
    rows = search_unified(df, ["legacy", "trigram"], "", "Smith").collect()
    assert len(rows) == 155
    assert [r.match_source for r in rows] == [2] * 120 + [32] * 35
    assert rows[120].last_name == "Smith" and {r.last_name for r in rows[150:]} == {n for _, n in near}
    assert all(n == "Smith" for _, n in found(df, ["legacy"], last="Smith"))


def test_bits_and_codes(spark):
    df = table(spark, ("John", "Smith"), ("Johnny", "Smythe"), ("", "Smith"))
    rows = {r.id: r for r in decorated(search(df, SearchRequest(["prefix", "soundex", "dm"], "", "Smith"))).collect()}
    assert rows[1].match_source == 1 | 4 | 16 and rows[2].match_source == 4 | 16
    assert rows[1].has_prefix and not rows[2].has_prefix and rows[2].has_dm and not rows[2].has_trigram
    assert rows[3].phonetic_codes.dm_fn == "" == rows[3].phonetic_codes.soundex_fn and rows[3].phonetic_codes.dm_ln
    assert query_codes("123", "Smith") == {"soundex_fn": "", "dm_fn": "", "soundex_ln": "S530", "dm_ln": "463000"}


def test_wildcards_are_literal(spark):
    df = table(spark, ("A%b", "x"), ("Axb", "y"), ("A_b", "z"))
    assert found(df, ["prefix"], "A%") == [("A%b", "x")]
    assert found(df, ["legacy"], "_b") == [("A_b", "z")]


@pytest.mark.parametrize("modes", [["prefix"], ["legacy"], ["soundex"], ["dm"], ["prefix", "legacy", "soundex", "dm"], ["legacy", "soundex", "levenshtein"]])
@pytest.mark.parametrize("names", [("", "Smith"), ("John", ""), ("Jon", "Smyth")])
def test_vocabulary_is_the_direct_search(spark, modes, names):
    df = table(spark, ("John", "Smith"), ("Jon", "Smyth"), ("Johnny", "Smithson"), ("Jane", "Schmidt"), ("Smith", "John"), ("Jo", "Smi"))
    request = SearchRequest(modes, *names)
    direct = {(r.id, r.match_source) for r in search(df, request).collect()}
    assert {(r.id, r.match_source) for r in vocabulary.matches(df, vocabulary.build(df), request).collect()} == direct


def test_explain(spark):
    df = table(spark, ("John", "Smith", DAY))
    assert explain(df, SearchRequest())["error"] and explain(df, SearchRequest(["trigram"], dob := "", "", DAY))["error"] and dob == ""
    got = explain(df, SearchRequest(["prefix"], "", "Smith"), analyze=True)
    assert "Filter" in got["plan"] and got["kind"] == "main" and got["error"] is None
    both = explain(df, SearchRequest(["prefix", "trigram"], "", "Smith"))
    assert both["kind"] == "trigram" and "prefix, trigram" in both["subject"] and set(both) == set(got)
    assert "TakeOrderedAndProject" in both["plan"]


def test_mode_sql_is_quoted():
    assert quoted("O'Neil") == "'O\\'Neil'"
    assert "O\\'Neil" in mode_sql("prefix", "", "O'Neil") and mode_sql("prefix", "", "") == ""
    assert mode_sql("trigram", "A", "B").index("'B'") < mode_sql("trigram", "A", "B").rindex("'A'")


def test_examples_find_their_bearers(spark):
    people = [("TONY", "WALLER"), ("JAMES", "SMITH"), ("PATRICIA", "JOHNSON"), ("BRENDA", "TUCKER"), ("JEFFREY", "WATSON")]
    df = table(spark, *people).cache()
    for first, last in people:
        for g in reports.example_groups(first, last):
            assert (first, last) in found(df, g["mode"].split(","), g["fn"], g["ln"]), g


def test_generated_examples(spark):
    d1, d2 = date(1991, 1, 10), date(1991, 2, 20)
    df = table(spark, *[("In", "Range", d1)] * 20, *[("Out", "Sider", d2)] * 21)
    got = reports.generate_examples(df)
    assert got["dob"] == "1991-01-10" and len(got["groups"]) == 7 and got["groups"][0]["ln"] == "Rang"
    assert reports.generate_examples(df.where(F.col("date_of_birth") == F.lit(d2))) == {"dob": "1990-01-01", "groups": []}
    empty = reports.generate_examples(df.where("id < 0"))
    assert empty["groups"] == []


def test_timed_cache():
    made = []
    cache = reports.TimedCache(60)
    make = lambda: made.append(1) or len(made)
    assert cache.get("k", make) == 1 == cache.get("k", make) and cache.get("k", make, refresh=True) == 2


def test_admin_search_and_hierarchy(spark):
    df = table(spark, ("John", "Smith", DAY), ("Amy", "Jones", date(1991, 1, 1)))
    assert reports.date_hierarchy(df).count() == 2
    assert reports.date_hierarchy(df, "day", F.year("date_of_birth") == 1990).collect()[0].cnt == 1


@pytest.mark.parametrize("modes", [["soundex"], ["dm"], ["levenshtein"], ["trigram"], ["prefix", "trigram"], ["soundex", "levenshtein"], ["legacy", "dm", "levenshtein", "trigram"], ["prefix"]])
@pytest.mark.parametrize("names", [("", "Smith"), ("Jon", "Smyth"), ("Zq", "Smith")])
def test_search_through_the_vocabulary(spark, modes, names):
    """The same page, in the same order, as the direct search, also with matching names beyond the broadcast bound."""
    df = table(spark, ("John", "Smith", DAY), ("Jon", "Smyth"), ("Johnny", "Smithson", DAY), ("Jane", "Schmidt"), ("Smith", "John"), ("Jo", "Smi"), ("Jon", "Smith", DAY))
    for dob, sort in ((None, ""), (DAY, "-date_of_birth")):
        request = SearchRequest(modes, *names, dob, sort)
        assert search(df, request, vocabulary=vocabulary.build(df)).collect() == search(df, request).collect()


def test_large_vocabularies_join_by_shuffle(spark, monkeypatch):
    df = table(spark, ("John", "Smith"), ("Jon", "Smyth"), ("Jane", "Schmidt"), ("Ann", "Jones"))
    request = SearchRequest(["soundex", "trigram"], "", "Smith")
    want = search(df, request).collect()
    monkeypatch.setattr(vocabulary, "BROADCAST_NAMES", 1)
    assert search(df, request, vocabulary=vocabulary.build(df)).collect() == want


def test_cache_has_no_stampede():
    """Of many threads one computes; a value of another key does not wait for it; a refresh renews."""
    cache, made, busy = reports.TimedCache(60), [], threading.Event()

    def slow():
        made.append(1)
        busy.wait(1)
        return len(made)

    with ThreadPoolExecutor(6) as pool:
        got = [pool.submit(cache.get, "k", slow) for _ in range(5)]
        assert pool.submit(cache.get, "other", lambda: "x").result(timeout=1) == "x"
        busy.set()
        assert [g.result() for g in got] == [1] * 5 and cache.get("k", slow, refresh=True) == 2


def test_caches_tell_tables_apart(spark):
    a, b = table(spark, ("A", "B")), table(spark, ("A", "B"), ("C", "D"))
    cache = reports.TimedCache(60)
    assert (reports.record_count(a, cache), reports.record_count(b, cache), reports.record_count(a, cache)) == (1, 2, 1)
