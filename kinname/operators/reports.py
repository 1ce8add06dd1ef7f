"""Entity-level reports on records: large clusters, Soundex collisions, nickname pairs, date counts, examples."""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinname.functions import names as N
from kinname.schema import NICKNAMES
from kinname.sources.generate import uniform
from kinname.sources.records import block_sample


def large_clusters(records: DataFrame, least: int = 20, top: int = 10) -> DataFrame:
    """The ``top`` largest groups of one person and date with ``least`` records or more, with their count."""
    groups = records.groupBy("person_id", "date_of_birth").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)
    return groups.orderBy(F.desc("cnt"), "person_id", "date_of_birth").limit(top)


def cluster_samples(records: DataFrame, clusters: DataFrame, size: int = 5) -> DataFrame:
    """``size`` records of each cluster, by id; the clusters are a top-k and thus few."""
    few = F.broadcast(clusters.select("person_id"))
    picked = W.partitionBy("person_id").orderBy("id")
    return records.join(few, "person_id").withColumn("_n", F.row_number().over(picked)).where(F.col("_n") <= size).drop("_n")


def soundex_collisions(records: DataFrame) -> DataFrame:
    """Every pair of Soundex codes that several records of several dates share: codes, records, dates."""
    coded = records.select(N.soundex(F.col("first_name")).alias("fn_soundex"), N.soundex(F.col("last_name")).alias("ln_soundex"), "date_of_birth")
    return coded.groupBy("fn_soundex", "ln_soundex").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("date_of_birth").alias("n_dobs")).where("n_records >= 2 AND n_dobs > 1")


def collision_groups(records: DataFrame, groups: int = 3, rows: int = 5, scan: int = 10_000) -> DataFrame:
    """The first collision groups among the first ``scan`` records in code order, ``rows`` records each."""
    coded = records.select("id", "first_name", "last_name", "date_of_birth", N.soundex(F.col("first_name")).alias("fn_soundex"), N.soundex(F.col("last_name")).alias("ln_soundex"))
    head = coded.orderBy("fn_soundex", "ln_soundex", "id").limit(scan)
    found = head.groupBy("fn_soundex", "ln_soundex").agg(F.countDistinct("date_of_birth").alias("d"), F.slice(F.sort_array(F.collect_list(F.struct("id", "first_name", "last_name", "date_of_birth"))), 1, rows).alias("sample")).where("d > 1")
    return found.orderBy("fn_soundex", "ln_soundex").limit(groups).select("fn_soundex", "ln_soundex", "sample")


def nickname_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n) for c, nicks in NICKNAMES.items() for n in nicks], "canonical string, nickname string")


def nickname_pairs(records: DataFrame) -> DataFrame:
    """All pairs of a record with a canonical name and one with its nickname and the same last name.

    The name table is small by definition; the records of either side are found by broadcast, and only
    those meet on the last name.
    """
    pairs = F.broadcast(nickname_table(records.sparkSession))
    upper = records.select("id", F.upper("first_name").alias("name"), "last_name", "date_of_birth")
    canonical = upper.join(pairs, upper.name == pairs.canonical).select(F.col("id").alias("canonical_id"), "canonical", "nickname", "last_name", F.col("date_of_birth").alias("canonical_dob"))
    nicks = F.broadcast(nickname_table(records.sparkSession).select(F.col("nickname").alias("name")).distinct())
    other = upper.join(nicks, "name").select(F.col("id").alias("nickname_id"), F.col("name").alias("nickname"), "last_name", F.col("date_of_birth").alias("nickname_dob"))
    return canonical.join(other, ["nickname", "last_name"])


def nickname_pair_groups(records: DataFrame) -> DataFrame:
    """The pairs of :func:`nickname_pairs` folded by names: canonical, nickname, last_name, pairs, first_canonical, first_nickname.

    Either side is counted by first and last name before the two meet, so a last name that very many records share
    is two rows a name, and no pair is listed.
    """
    pairs = F.broadcast(nickname_table(records.sparkSession))
    used = sorted({x for c, nicks in NICKNAMES.items() for x in (c, *nicks)})
    sides = records.select("id", F.upper("first_name").alias("name"), "last_name").where(F.col("name").isin(used))
    sides = sides.groupBy("name", "last_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    left = sides.join(pairs, sides.name == pairs.canonical).select("canonical", "nickname", "last_name", F.col("n").alias("n_canonical"), F.col("least").alias("first_canonical"))
    right = sides.select(F.col("name").alias("nickname"), "last_name", F.col("n").alias("n_nickname"), F.col("least").alias("first_nickname"))
    return left.join(right, ["nickname", "last_name"]).select("canonical", "nickname", "last_name", (F.col("n_canonical") * F.col("n_nickname")).alias("pairs"), "first_canonical", "first_nickname")


def nickname_page(records: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` pairs by canonical name, nickname, last name and ids: only the groups that a page needs are unfolded.

    A group has one pair at least, so the first ``most`` groups suffice, and of each the first ``most`` records a side.
    """
    found = nickname_pair_groups(records).orderBy("canonical", "nickname", "last_name").limit(most).select("canonical", "nickname", "last_name")
    groups = records.sparkSession.createDataFrame(found.collect(), found.schema)  # ``most`` rows, found once
    keys = F.broadcast(groups.select(F.explode(F.array("canonical", "nickname")).alias("name"), "last_name").distinct())
    rows = records.select("id", F.upper("first_name").alias("name"), "last_name", "date_of_birth").join(keys, ["name", "last_name"], "left_semi")
    first = F.row_number().over(W.partitionBy("name", "last_name").orderBy("id"))
    heads = rows.withColumn("_n", first).where(F.col("_n") <= most)

    def side(of: str) -> DataFrame:
        return heads.select(F.col("name").alias(of), "last_name", F.col("id").alias(f"{of}_id"), F.col("date_of_birth").alias(f"{of}_dob"))

    pairs = groups.join(side("canonical"), ["canonical", "last_name"]).join(side("nickname"), ["nickname", "last_name"])
    return pairs.orderBy("canonical", "nickname", "last_name", "canonical_id", "nickname_id").limit(most)


def first_nickname_pairs(records: DataFrame, canonicals: int = 20, rows: int = 2, most: int = 3) -> DataFrame:
    """The report's short form: the first canonical names, two records a side, the first three pairs."""
    order = {c: i for i, c in enumerate(list(NICKNAMES)[:canonicals])}
    spark = records.sparkSession
    wanted = spark.createDataFrame([(i, j, c, n) for c, i in order.items() for j, n in enumerate(NICKNAMES[c])], "i int, j int, canonical string, nickname string")
    name = F.upper("first_name")
    head = records.select("id", name.alias("name"), "first_name", "last_name", "date_of_birth").withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy("id")))
    used = sorted({x for c in order for x in (c, *NICKNAMES[c])})
    head = head.where(F.col("name").isin(used)).where(F.col("_n") <= rows).drop("_n")
    left = head.select(F.col("name").alias("canonical"), F.col("first_name").alias("canonical_first"), "last_name", F.col("date_of_birth").alias("canonical_dob"), F.col("id").alias("cid"))
    right = head.select(F.col("name").alias("nickname"), F.col("first_name").alias("nickname_first"), "last_name", F.col("date_of_birth").alias("nickname_dob"), F.col("id").alias("nid"))
    found = wanted.join(left, "canonical").join(right, ["nickname", "last_name"])
    one = found.withColumn("_n", F.row_number().over(W.partitionBy("i", "j").orderBy("last_name", "cid", "nid"))).where("_n = 1")
    return one.orderBy("i", "j").limit(most).select("canonical_first", "nickname_first", "last_name", "canonical_dob", "nickname_dob")


def dob_counts(records: DataFrame, dates: Sequence[date]) -> DataFrame:
    """How many records each of the dates has."""
    return records.where(F.col("date_of_birth").isin(list(dates))).groupBy("date_of_birth").agg(F.count(F.lit(1)).alias("cnt"))


def dobs_in_window(records: DataFrame, low: int = 5, high: int = 20) -> DataFrame:
    """The dates with ``low`` to ``high`` records."""
    return records.groupBy("date_of_birth").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt").between(low, high))


def date_hierarchy(records: DataFrame, level: str = "year", within: Column | None = None) -> DataFrame:
    """Record counts by year, month or day, as far as ``within`` allows."""
    rows = records if within is None else records.where(within)
    return rows.groupBy(F.trunc("date_of_birth", level).alias("period") if level != "day" else F.col("date_of_birth").alias("period")).agg(F.count(F.lit(1)).alias("cnt"))


def page_sample(records: DataFrame, fraction: float, seed: int = 0, salt: str = "page") -> DataFrame:
    """About ``fraction`` of the records, each by a draw of its id: the same ones whatever the partitions."""
    return records.where(uniform(seed, salt, F.col("id")) < fraction)


def in_random_order(records: DataFrame, most: int, seed: int = 0, salt: str = "order") -> DataFrame:
    """The first ``most`` records by a draw of their ids."""
    return records.orderBy(uniform(seed, salt, F.col("id")), "id").limit(most)


def sample_dobs(records: DataFrame, seed: int = 0, fraction: float = 1e-4, most: int = 100, path: str | None = None) -> list[date]:
    """Up to ``most`` distinct dates from a row sample, topped up by a random sort where the table is small.

    path: of a stored table, whose files are sampled instead, more of them as long as dates are too few.
    """
    seen: dict[date, None] = {}
    if path:
        share = fraction
        while True:
            rows = block_sample(records.sparkSession, path, share, seed).select("date_of_birth")
            for r in rows.distinct().orderBy(uniform(seed, "day", F.col("date_of_birth")), "date_of_birth").limit(most).collect():
                if len(seen) < most:
                    seen.setdefault(r[0])
            if len(seen) >= most or share >= 1:
                return list(seen)
            share *= 8
    for attempt in range(3):
        for r in page_sample(records, fraction, seed + attempt).select("date_of_birth").limit(1_000).collect():
            if len(seen) < most:
                seen.setdefault(r[0])
    if len(seen) < most:
        for r in in_random_order(records, most, seed).select("date_of_birth").collect():
            seen.setdefault(r[0])
    return list(seen)


def example_groups(first: str, last: str) -> list[dict]:
    """Seven example searches around one name; each finds its bearer."""
    double = next((i for i in range(len(last) - 1) if last[i] == last[i + 1]), None)
    sounds = last if double is None else last[:double] + last[double + 1 :]
    # fixed values: the seven groups, their labels and modes
    rows = [
        ("Exact", "prefix", first[: max(2, len(first) - 1)], last[: max(2, len(last) - 1)]), ("Phonetic", "soundex", first, sounds), ("Phonetic", "dm", first, last),
        ("Fuzzy", "legacy,levenshtein", first[: max(1, len(first) - 1)], last), ("Fuzzy", "trigram", first, last), ("Combo", "soundex,levenshtein", first, sounds), ("Combo", "dm,levenshtein", first, last),
    ]
    return [{"label": label, "mode": mode, "fn": fn, "ln": ln} for label, mode, fn, ln in rows]


def generate_examples(records: DataFrame, seed: int = 0, path: str | None = None, counted: DataFrame | None = None) -> dict:
    """A date with 5 to 20 records and example searches for one of its names; a fallback date with none otherwise.

    path: of a stored table, see :func:`sample_dobs`; counted: (date_of_birth, cnt) of all days, as day counts have
    them. With both, files of the sample and row groups of one date are all that is read of the records.
    """
    dates = sample_dobs(records, seed, path=path)
    found = dob_counts(records, dates) if counted is None else counted.where(F.col("date_of_birth").isin(dates))
    counts = {r["date_of_birth"]: r["cnt"] for r in found.collect()} if dates else {}
    day = next((d for d in dates if 5 <= counts.get(d, 0) <= 20), date(1990, 1, 1))
    names = records.where(F.col("date_of_birth") == F.lit(day))
    names = in_random_order(names, 5, seed).select("first_name", "last_name").collect()
    return {"dob": day.isoformat(), "groups": example_groups(*names[0]) if names else []}


class TimedCache:
    """Values that are kept for some seconds on the driver; ``refresh`` computes anew.

    Of several threads that ask for one missing key, one computes and the others wait for its value.
    """

    def __init__(self, seconds: float):
        self.seconds, self.kept, self.guard, self.guards = seconds, {}, threading.Lock(), {}

    def get(self, key, make, refresh: bool = False):
        asked = time.monotonic()
        with self.guard:
            lock = self.guards.setdefault(key, threading.Lock())
        with lock:
            until, made, value = self.kept.get(key, (-1.0, -1.0, None))
            if until <= time.monotonic() or refresh and made < asked:
                value = make()
                now = time.monotonic()
                self.kept[key] = (now + self.seconds, now, value)
            return value


_counts, _examples = TimedCache(300), TimedCache(3_600)


def _table_key(records: DataFrame) -> int:
    """Equal for equal plans over the same tables."""
    return records.semanticHash()


def record_count(records: DataFrame, cache: TimedCache = _counts) -> int:
    return cache.get(_table_key(records), records.count)


def help_examples(records: DataFrame, refresh: str = "", seed: int = 0, cache: TimedCache = _examples, path: str | None = None, counted: DataFrame | None = None) -> dict:
    """The cached examples; any text in ``refresh`` renews them."""
    return cache.get((_table_key(records), seed), lambda: generate_examples(records, seed, path, counted), bool(refresh))
