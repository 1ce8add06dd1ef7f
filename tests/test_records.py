"""Sources, the generator's properties, reports, the stream, and every query against its SQL."""

import collections
import hashlib
import os
import random
import shutil
from datetime import date, timedelta
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinname import queries
from kinname.operators import reports
from kinname.sources import alias, generate, records
from kinname.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(f"NAME{i % 300}", "MF"[i % 2], 1000 - i % 97) for i in range(400)]
    return spark.createDataFrame(rows, "forename string, gender string, count long"), spark.createDataFrame(rows, "surname string, gender string, count long")


def test_weights(spark, tmp_path):
    path = str(tmp_path / "names")
    spark.createDataFrame([("alice", "M", 1000, "US"), ("alice", "F", 500, "US"), ("Bob", "M", 100, "US"), ("Carol", "F", 50, "US"), (None, "M", 7, "US"), ("X" * 51, "M", 3, "US"), ("Dora", "F", 9, "FR")], "forename string, gender string, count long, country string").createOrReplaceTempView("n")
    records.write_country_names(spark.table("n"), path)
    got = generate.weights_cdf(records.read_name_weights(spark, path, "forename"), "forename").collect()
    assert [(r.name, r["count"]) for r in got] == [("ALICE", 1500), ("BOB", 100), ("CAROL", 50)]
    assert [r.cdf for r in got] == [1500 / 1650, 1600 / 1650, 1.0]
    with pytest.raises(FileNotFoundError, match="write_country_names"):
        records.read_name_weights(spark, path + "-none", "forename")


def test_generator(spark, weights):
    made = lambda n=3_000, **k: generate.generate(spark, n, *weights, **k)
    a = [tuple(map(str, r)) for r in made(seed=1).orderBy("id").collect()]
    assert len(a) == 3_000 and [int(r[0]) for r in a] == list(range(1, 3_001))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert [tuple(map(str, r)) for r in made(seed=1).orderBy("id").collect()] == a
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(map(str, r)) for r in made(seed=2).orderBy("id").collect()] != a
    moved = made(seed=1, as_of=date(2025, 1, 1)).orderBy("id").collect()
    assert all(date.fromisoformat(r[4]) - m.date_of_birth == timedelta(days=365) for r, m in zip(a, moved, strict=True))
    df = made(seed=1)
    assert df.groupBy("person_id").agg(F.countDistinct("date_of_birth").alias("n")).agg(F.max("n")).first()[0] == 1
    share = lambda c: df.where(c).count() / 3_000
    assert share("middle_name IS NOT NULL") > 0.8 and 0.1 < share("size(nicknames) > 0") < 0.6
    ages = df.select(F.min("date_of_birth"), F.max("date_of_birth")).first()
    assert date(2026, 1, 1) - timedelta(days=85 * 365) < ages[0] and ages[1] <= date(2026, 1, 1) - timedelta(days=18 * 365)


def test_names_are_made_ready_once(spark, weights):
    ready = [generate.draws(names, c) for names, c in zip(weights, ("forename", "surname"), strict=True)]
    assert [generate.draws(x, "forename") is x for x in ready] == [True, True]
    want = generate.generate(spark, 300, *weights, seed=4).orderBy("id").collect()
    assert generate.generate(spark, 300, *ready, seed=4).orderBy("id").collect() == want


def test_typos(spark):
    rows = [("SMITH", 0, 0.0, "D"), ("SMITH", 1, 0.5, "D"), ("SMITH", 2, 0.25, "D"), ("AB", 0, 0.9, "D"), ("AAA", 0, 0.2, "D"), ("A", 1, 0.0, "D"), ("ZZ", 0, 0.0, "D"), ("SMITH", 2, 0.25, "M")]
    df = spark.createDataFrame(rows, "n string, k int, w double, l string")
    got = [r[0] for r in df.select(generate.typo(F.col("n"), F.col("k"), F.col("w"), F.col("l"))).collect()]
    assert got == ["MSITH", "SMTH", "SDITH", "BA", "AAB", "A", "ZA", "SMITI"]


def test_batches():
    assert [generate.batch_identities(n) for n in (54_000_000, 3_000_000, 15_000, 1, 1_500)] == [2_000_000, 2_000_000, 10_000, 1_000, 1_000]


def test_seed_table(spark, weights, tmp_path):
    path = str(tmp_path / "table")
    out = generate.seed_table(spark, path, 2_000, *weights, flush=True)
    assert set(out) == {"large_clusters", "collisions", "nickname_pairs"}
    generate.seed_table(spark, path, 500, *weights, seed=5, cases=False)
    table = records.read_records(spark, path)
    assert (table.count(), table.agg(F.min("id"), F.max("id")).first()) == (2_500, (1, 2_500))
    assert generate.seed_table(spark, path, 100, *weights, flush=True, cases=False) == {}
    assert records.read_records(spark, path).agg(F.max("id")).first()[0] == 100
    assert records.export(records.read_records(spark, path)).num_rows == 100


def test_reports(spark):
    day = date(1990, 1, 1)
    rows = [(1, "Robert", "Smith", day), (2, "Bob", "Smith", date(1991, 1, 1)), (3, "Bobby", "Jones", day), (4, "William", "Smith", day), (5, "Bill", "Smyth", day)]
    df = spark.createDataFrame(rows, "id long, first_name string, last_name string, date_of_birth date")
    assert [(r.canonical_first, r.nickname_first) for r in reports.first_nickname_pairs(df).collect()] == [("Robert", "Bob")]
    assert {(r.canonical, r.nickname) for r in reports.nickname_pairs(df).collect()} == {("ROBERT", "BOB")}
    groups = reports.collision_groups(df.union(spark.createDataFrame([(6, "Rupert", "Smyth", date(1995, 1, 1))], df.schema))).collect()
    assert [[s.id for s in g.sample] for g in groups] == [[1, 6]]


def test_stream(spark, tmp_path, weights):
    source, table, names = (str(tmp_path / x) for x in ("in", "table", "names"))
    made = generate.generate(spark, 400, *weights)
    made.where("id <= 200").write.parquet(source)
    stream = lambda: spark.readStream.schema(made.schema).parquet(source)
    ingest.start(stream(), table, names, str(tmp_path / "check")).awaitTermination()
    made.where("id > 200").write.mode("append").parquet(source)
    ingest.start(stream(), table, names, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(table).select("id").distinct().count() == 400
    vocabulary = spark.read.parquet(names)
    assert vocabulary.count() == vocabulary.select("name").distinct().count() == made.select("first_name").union(made.select("last_name")).distinct().count()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def shown(df):
    def one(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams_and_bulk_writes_share_a_table(spark, tmp_path, weights):
    """Batches are numbered anew by each checkpoint, also by a new one in the place of an old one; no row is lost."""
    table, names, made = str(tmp_path / "table"), str(tmp_path / "names"), generate.generate(spark, 400, *weights)
    records.write_records(made.where("id <= 100"), table)
    for k in (1, 2, 3):
        source, check = str(tmp_path / f"in{k}"), str(tmp_path / f"check{min(k, 2)}")
        made.where(f"id > {k * 100} AND id <= {k * 100 + 100}").write.parquet(source)
        if k == 3:
            shutil.rmtree(check)
        ingest.start(spark.readStream.schema(made.schema).parquet(source), table, names, check).awaitTermination()
    assert sorted(r.id for r in records.read_records(spark, table).collect()) == list(range(1, 401))
    records.write_records(made.where("id <= 7"), table)
    assert records.read_records(spark, table).count() == 7


def test_export_is_bounded(spark, weights):
    made = generate.generate(spark, 50, *weights)
    assert records.export(made, 50).num_rows == 50
    with pytest.raises(ValueError, match="files"):
        records.export(made, 49)


def test_alias_table_gives_every_name_its_weight(spark):
    """Exactly, for one name, equal counts, heavy tails, counts at the mean, many of one count and counts beyond 64 bits of units."""
    rng = random.Random(5)
    cases = [[7], [3, 3, 3], [1, 2, 3], [9_000, 1_000, 0], [2, 2, 1, 3, 2], [1] * 9_000 + [50_000, 700, 700, 3], [10**13, 10**12 + 1, *[10**9 + i for i in range(5_000)]]]
    cases += [[int(rng.paretovariate(1.1)) for _ in range(n)] for n in (2, 5, 40, 3_000)] + [[rng.randint(1, 4) for _ in range(200)]]
    for case in cases:
        names = spark.createDataFrame([(f"N{i:05}", c) for i, c in enumerate(case)], "name string, count long")
        table = alias.alias_table(names).collect()
        some, w = sum(c > 0 for c in case), sum(case)
        order = sorted((-c, hashlib.md5(f"N{i:05}".encode()).hexdigest()[:3], f"N{i:05}") for i, c in enumerate(case) if c > 0)
        assert {r.slot: r.name for r in table} == {i: x[-1] for i, x in enumerate(order)} and len(table) == some
        units = collections.Counter()
        for r in table:
            own = round(Fraction(r.share) * w)
            assert 0 <= r.share <= 1 and (w > 10**12 or abs(own - Fraction(r.share) * w) < Fraction(1, 10**3))
            units[r.name] += own
            units[r.other] += w - own
        wrong = {name: units[name] - c * some for name, c in ((f"N{i:05}", c) for i, c in enumerate(case)) if abs(units[name] - c * some) > (len(case) * w // 2**52)}
        assert not wrong, (case[:9], wrong)


def test_alias_table_without_names(spark):
    empty = spark.createDataFrame([(None, 5), ("A", 0), ("B", None)], "name string, count long")
    draws = alias.Draws(empty)
    assert draws.slots == 0 and draws.drawn(spark.range(5), F.lit(0.5), "n").count() == 0


def test_sampled_names_follow_their_weights(spark):
    names = spark.createDataFrame([("ALPHA", 9_000), ("BETA", 1_000), ("NONE", 0)], "name string, count long")
    draws = alias.Draws(names)
    got = draws.drawn(spark.range(40_000), generate.uniform(3, "x", F.col("id")), "n").groupBy("n").count().collect()
    counts = {r.n: r["count"] for r in got}
    assert set(counts) == {"ALPHA", "BETA"} and sum(counts.values()) == 40_000 and 3_400 <= counts["BETA"] <= 4_600
    edges = spark.createDataFrame([(0.0,), (0.4999,), (0.5,), (0.5999,), (0.6001,), (1 - 2**-52,)], "u double")
    assert [r.n for r in draws.drawn(edges, F.col("u"), "n").orderBy("u").collect()] == ["ALPHA"] * 2 + ["BETA"] * 2 + ["ALPHA"] * 2
