"""Generated records: weighted names, heavy-tailed clusters of one person, nicknames, typos.

Every draw is a hash of the seed, the row and what is drawn, so the same seed gives the same records
however the rows are partitioned, and a lost executor's rows come back the same.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinname.schema import MAX_NAME_LENGTH, NICKNAMES
from kinname.sources.alias import Draws

#: The rates of the generator.
NICKNAME_RATE, MIDDLE_NAME_RATE, TYPO_RATE, CLUSTER_RATE = 0.30, 0.90, 0.20, 0.20
LARGEST_CLUSTER, TAIL = 80, 1.5
LEAST_BATCH, MOST_BATCH, MEAN_CLUSTER = 1_000, 2_000_000, 1.5
REPORT_LIMIT = 1_000_000


def batch_identities(remaining: int, mean: float = MEAN_CLUSTER) -> int:
    """Identities for about ``remaining`` records, within bounds."""
    return min(max(int(remaining / mean), LEAST_BATCH), MOST_BATCH)


def uniform(seed: int, salt: str, *of: Column) -> Column:
    """A uniform number in [0, 1) that depends on its arguments alone: 52 bits of an MD5 digest, so any engine can draw it again."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in of]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _weights(names: DataFrame, column: str) -> DataFrame:
    """(name, count): names in upper case and summed, without those that are too long for a record."""
    return names.dropna(subset=[column]).groupBy(F.upper(column).alias("name")).agg(F.sum("count").alias("count")).where(F.length("name") <= MAX_NAME_LENGTH)


def draws(names: DataFrame | Draws, column: str) -> Draws:
    """The names ready to be drawn from, as often as one likes."""
    return names if isinstance(names, Draws) else Draws(_weights(names, column))


def weights_cdf(names: DataFrame, column: str) -> DataFrame:
    """(name, count, cdf): names in upper case and summed, most frequent first; the last cdf is 1.

    Running sums are over groups of names of one count and first two letters, and within each group by
    itself: no task sorts the whole vocabulary, and names that occur once are dealt out, too.
    """
    kept = _weights(names, column).withColumn("_part", F.substring("name", 1, 2))
    parts = kept.groupBy("count", "_part").agg(F.sum("count").alias("_sum"))
    until = F.sum("_sum").over(W.orderBy(F.desc("count"), "_part").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.select("count", "_part", (until - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_total"))
    within = F.row_number().over(W.partitionBy("count", "_part").orderBy("name"))
    running = kept.join(parts, ["count", "_part"]).withColumn("_running", F.col("_before") + within * F.col("count"))
    return running.select("name", "count", (F.col("_running") / F.col("_total")).alias("cdf")).orderBy(F.desc("count"), "name")


def choice(options: list[str], draw: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.floor(draw * len(options)).cast("int"))


def cluster_size(seed: int, identity: Column) -> Column:
    """1 for most persons, 2 to LARGEST_CLUSTER with a heavy tail for the others."""
    tail = F.floor(F.pow(1 - uniform(seed, "tail", identity), F.lit(-1 / TAIL)) - 1) + 2
    tail = F.greatest(F.lit(2), F.least(F.lit(LARGEST_CLUSTER), tail))
    return F.when(uniform(seed, "cluster", identity) < CLUSTER_RATE, tail).otherwise(F.lit(1)).cast("int")


def identities(spark: SparkSession, n: int, first: Draws, last: Draws, seed: int, as_of: date) -> DataFrame:
    """``n`` persons: names, date 18 to 85 years before as_of, person id, cluster size, middle name, nicknames."""
    i = F.col("identity")
    u = lambda salt: uniform(seed, salt, i)
    rows = spark.range(n).select(F.col("id").alias("identity"))
    rows = first.drawn(rows, u("first"), "_first")
    rows = last.drawn(rows, u("last"), "last_name")
    rows = first.drawn(rows, u("middle name"), "_full")
    table = F.array(*[F.array(*map(F.lit, nicks)) for nicks in NICKNAMES.values()])
    hexes = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit("person"), i.cast("string")))
    initial = choice([chr(c) for c in range(65, 91)], u("initial"))
    rows = rows.select(
        "identity", "_first", "last_name",
        F.date_sub(F.lit(as_of), (F.floor(u("dob") * (67 * 365)) + 18 * 365).cast("int")).alias("date_of_birth"),
        F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("person_id"),
        cluster_size(seed, i).alias("cluster_size"),
        F.when(u("middle") < MIDDLE_NAME_RATE, F.when(u("full") < 0.5, F.col("_full")).otherwise(initial)).alias("middle_name"),
        F.when(u("nickname") < NICKNAME_RATE, F.get(table, F.floor(u("canonical") * len(NICKNAMES)).cast("int"))).alias("_nicks"),
    )
    nick = F.get("_nicks", F.floor(u("which") * F.size("_nicks")).cast("int"))
    return rows.withColumn("first_name", F.coalesce(nick, "_first")).withColumn("nicknames", F.coalesce("_nicks", F.array().cast("array<string>"))).drop("_nicks", "_first")


def expanded(people: DataFrame) -> DataFrame:
    """One row for each member of a cluster; member 0 is the canonical one."""
    return people.withColumn("member", F.explode(F.sequence(F.lit(0), F.col("cluster_size") - 1)))


def typo(name: Column, kind: Column, where: Column, letter: Column) -> Column:
    """One typo: kind 0 swaps two neighbours, 1 drops a letter, 2 puts another letter; where: 0 to 1.

    A name of one letter stays; where the draw changes nothing, the last letter moves on by one.
    """
    n = F.length(name)
    at = F.floor(where * F.when(kind == 0, n - 1).otherwise(n)).cast("int")
    part = lambda a, k: F.substr(name, a, k)
    before = part(F.lit(1), at)
    swap = F.concat(before, part(at + 2, F.lit(1)), part(at + 1, F.lit(1)), part(at + 3, n))
    drop = F.concat(before, part(at + 2, n))
    put = F.concat(before, letter, part(at + 2, n))
    made = F.when(kind == 0, swap).when(kind == 1, drop).otherwise(put)
    last = F.char(F.lit(65) + F.pmod(F.ascii(part(n, F.lit(1))) - 64, F.lit(26)))
    return F.when(n < 2, name).when(made != name, made).otherwise(F.concat(part(F.lit(1), n - 1), last))


def with_typos(rows: DataFrame, seed: int) -> DataFrame:
    """Typos in TYPO_RATE of the rows that are not canonical, in the first or the last name."""
    key = (F.col("identity"), F.col("member"))
    u = lambda salt: uniform(seed, salt, *key)
    hit = (F.col("member") > 0) & (u("typo") < TYPO_RATE)
    kind = F.floor(u("kind") * 3)
    letter = choice([chr(c) for c in range(65, 91)], u("letter"))
    made = lambda c: typo(F.col(c), kind, u("where"), letter)
    first = u("which name") < 0.5
    return rows.withColumns({"first_name": F.when(hit & first, made("first_name")).otherwise(F.col("first_name")), "last_name": F.when(hit & ~first, made("last_name")).otherwise(F.col("last_name"))})


def generate(spark: SparkSession, count: int, forenames: DataFrame | Draws, surnames: DataFrame | Draws, *, seed: int = 42, as_of: date = date(2026, 1, 1)) -> DataFrame:
    """Exactly ``count`` records with ids from 1, in the order of identities.

    Ids come from running sums of cluster sizes over blocks of identities, not from one sort of all rows. The
    alias tables of the names are written when this is called; names given as ``draws`` have theirs already.
    """
    first, last = draws(forenames, "forename"), draws(surnames, "surname")
    block = 4_096
    people = identities(spark, max(count, 1), first, last, seed, as_of).withColumn("_block", F.floor(F.col("identity") / block))
    sizes = spark.range(max(count, 1)).groupBy(F.floor(F.col("id") / block).alias("_block")).agg(F.sum(cluster_size(seed, F.col("id"))).alias("n"))
    starts = sizes.select("_block", (F.sum("n").over(W.orderBy("_block")) - F.col("n")).alias("_before")).where(F.col("_before") < count)
    within = F.sum("cluster_size").over(W.partitionBy("_block").orderBy("identity")) - F.col("cluster_size")
    placed = people.join(starts, "_block").withColumn("_start", F.col("_before") + within).where(F.col("_start") < count)
    rows = with_typos(expanded(placed), seed)
    rows = rows.withColumn("id", F.col("_start") + F.col("member") + 1).where(F.col("id") <= count)
    return rows.select("id", "first_name", "last_name", "middle_name", "date_of_birth", "nicknames", "person_id")


def seed_table(spark: SparkSession, path: str, count: int, forenames: DataFrame | Draws, surnames: DataFrame | Draws, *, seed: int = 42, as_of: date = date(2026, 1, 1), flush: bool = False, cases: bool | None = None) -> dict:
    """Generates into a table, in place of what is there with ``flush``, and gives the reports; large seeds skip them unless asked."""
    from kinname.operators import reports
    from kinname.sources.records import exists, read_records, write_records

    made = generate(spark, count, forenames, surnames, seed=seed, as_of=as_of)
    if exists(spark, path) and not flush:
        top = read_records(spark, path).agg(F.max("id")).first()[0] or 0
        write_records(made.withColumn("id", F.col("id") + top), path, append=True)
    else:
        write_records(made, path)
    if not (count <= REPORT_LIMIT if cases is None else cases):
        return {}
    table = read_records(spark, path)
    return {"large_clusters": reports.large_clusters(table).collect(), "collisions": reports.collision_groups(table).collect(), "nickname_pairs": reports.first_nickname_pairs(table).collect()}
