"""Sessions of clicks by gaps, final clicks and a longest length, without a task that holds all of a client.

Whether a session must start at a click for what its predecessor was (none, a final one, one too long ago)
is known from the two of them; such clicks are heads of islands. Where else sessions start depends on where the
last one did: if one starts at a click, the next one starts at the first click beyond the longest length, or at the
next head. That is the click's next-start pointer. Sessions start at the heads and wherever pointers lead
from them, which joins of the pointer table with itself find in a logarithmic number of rounds.

Order matters, but no task sees a whole client: rows are dealt out by ranges of (client, time), windows run
within a range, and what a range needs from the others comes as one row for each range and client that
both have: no more than two rows a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinname.llm.common import cut

MINUTE = 60_000_000
GAP, LONGEST, LATENESS = 15 * MINUTE, 60 * MINUTE, 15 * MINUTE
FINAL_KINDS, FINAL_VALUE = ("purchase", "signup"), 60.0
#: Values beyond this have no exact cents and count as 0.
_MOST_VALUE = 9e13


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 UTC; a time without a zone is taken as UTC, whatever the session's zone."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (day * 24 + F.hour(c)) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("long")


def _over(function: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """lag or lead that passes over nulls."""
    return F.expr(f"{function} IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})")


def _ranges(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` dealt out by ranges of ``by``, with the number of their range as pid."""
    return rows.repartitionByRange(*by).withColumn("pid", F.spark_partition_id())


def timely(clicks: DataFrame, lateness: int, kinds: Sequence[str], value: float) -> DataFrame:
    """(client_id, ts, click_id, late, final, cents), once for each click_id."""
    amount = F.col("value").cast("double")
    known = F.when(F.abs(amount) <= _MOST_VALUE, amount)
    rows = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL").select(
        "client_id", micros(clicks, "ts").alias("ts"), "click_id",
        F.coalesce(micros(clicks, "arrived_at") - micros(clicks, "ts") > lateness, F.lit(False)).alias("late"),
        F.coalesce((amount >= value) & F.col("kind").isin(list(kinds)), F.lit(False)).alias("final"),
        F.coalesce(F.floor(known * 100 + 0.5).cast("long"), F.lit(0)).alias("cents"),
    )
    copy = F.sum(F.lit(1)).over(W.partitionBy("click_id").orderBy("ts", "client_id", "late", "final", "cents").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_copy", copy).where("_copy = 1").drop("_copy")


def islands(clicks: DataFrame, gap: int) -> DataFrame:
    """``clicks`` with head_ts, head_id (of the last island head up to the row, null if none) and next_ts (of the client's next timely click).

    A late row belongs where its time puts it, behind the clicks of the same time.
    """
    keys, order = ["pid", "client_id"], ["ts", "late", "click_id"]
    rows = _ranges(clicks, ["client_id", *order]).withColumn("mark", F.when(~F.col("late"), F.struct("ts", "final")))
    seen = rows.withColumns({"prev": _over("lag(mark)", keys, order), "next_ts": _over("lead(mark.ts)", keys, order)})
    begins = ~F.col("late") & (F.col("prev").isNull() | F.col("prev.final") | (F.col("ts") - F.col("prev.ts") >= gap))
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = seen.withColumn("head", F.last(F.when(begins, F.struct("ts", "click_id")), True).over(so_far))
    local = cut(found.select("pid", "client_id", "ts", "click_id", "late", "final", "cents", "next_ts", F.col("prev").isNull().alias("first"), F.col("head.ts").alias("head_ts"), F.col("head.click_id").alias("head_id")))
    # within a range the first click of a client counts as a head; whether it is one, the ranges before it tell
    on_time = lambda *of: F.when(~F.col("late"), F.struct(*of))
    ends = local.where("first OR next_ts IS NULL").groupBy(*keys).agg(F.min(on_time("ts", "click_id")).alias("least"), F.max(on_time("ts", "click_id", "final", "head_ts", "head_id")).alias("most"))
    across = W.partitionBy("client_id").orderBy("pid")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumns({"prev": F.last("most", True).over(before), "later": _over("lead(least.ts)", ["client_id"], ["pid"])})
    goes_on = F.coalesce(F.col("prev").isNotNull() & ~F.col("prev.final") & (F.col("least.ts") - F.col("prev.ts") < gap), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    own = F.when(~(F.col("goes_on") & (F.col("most.head_id") == F.col("least.click_id"))), F.struct(F.col("most.head_ts").alias("ts"), F.col("most.head_id").alias("id")))
    carry = ends.withColumn("head", F.last(own, True).over(before)).where("head IS NOT NULL OR later IS NOT NULL")
    carry = cut(carry.select(*keys, F.col("head.ts").alias("c_ts"), F.col("head.id").alias("c_id"), "later", F.when(F.col("goes_on"), F.col("least.click_id")).alias("c_first")))
    joined = local.join(F.broadcast(carry), keys, "left")  # two rows a range at most
    moves = F.col("head_id").isNull() | F.coalesce(F.col("head_id") == F.col("c_first"), F.lit(False))
    return joined.select(
        "client_id", "ts", "click_id", "late", "final", "cents", F.coalesce("next_ts", "later").alias("next_ts"),
        F.when(moves, F.col("c_ts")).otherwise(F.col("head_ts")).alias("head_ts"), F.when(moves, F.col("c_id")).otherwise(F.col("head_id")).alias("head_id"),
    )


def reached(seeds: DataFrame, pointers: DataFrame) -> DataFrame:
    """(node): the seeds and all nodes that ``pointers`` (source, target) lead to from them; each node has one pointer at most.

    After k rounds the table holds pointers over 2^k steps and every node within that many is found, so a
    chain of n nodes takes about log2(n) rounds. Chains do not meet, so nothing is found twice.
    """
    found, jumps = cut(seeds.select("node")), cut(pointers)
    while not jumps.isEmpty():
        fresh = cut(found.join(jumps, found.node == jumps.source).select(F.col("target").alias("node")))
        found = found.unionByName(fresh)
        onward = jumps.select(F.col("source").alias("middle"), F.col("target").alias("end"))
        jumps = cut(jumps.join(onward, jumps.target == onward.middle).select("source", F.col("end").alias("target")))
    return found


def _split(beyond: DataFrame, longest: int) -> DataFrame:
    """``beyond``, the rows over ``longest`` after their island's head, with start_ts, start_id of their session; null before the first of them."""
    payload = ["client_id", "late", "final", "cents", "next_ts", "head_ts"]
    # 0: a click, 1: the time that a session which starts at this click cannot reach, 2: a late row
    rows = beyond.select("head_id", F.col("ts").alias("t"), F.when(F.col("late"), 2).otherwise(0).alias("sort"), "click_id", *payload)
    probes = beyond.where("NOT late").select("head_id", (F.col("ts") + longest).alias("t"), F.lit(1).alias("sort"), "click_id")
    keys, order = ["pid", "head_id"], ["t", "sort", "click_id"]
    dealt = _ranges(rows.unionByName(probes, allowMissingColumns=True), ["head_id", *order]).withColumn("here", F.when(F.col("sort") == 0, F.col("click_id")))
    placed = cut(dealt.withColumns({"target": _over("lead(here)", keys, order), "first": _over("lag(here)", keys, order).isNull()}).drop("here"))
    click = F.when(F.col("sort") == 0, F.struct("t", "click_id"))
    groups = placed.where("first").groupBy(*keys).agg(F.min(click).alias("least"))
    across = W.partitionBy("head_id").orderBy("pid")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumns({"later": _over("lead(least.click_id)", ["head_id"], ["pid"]), "had": F.count("least").over(before) > 0, "n": F.count(F.lit(1)).over(W.partitionBy("head_id"))})
    borders = cut(groups.where("n > 1").select(*keys, "later", "had"))  # two rows a range at most
    told = placed.join(F.broadcast(borders), keys, "left")
    pointers = told.where("sort = 1").select(F.col("click_id").alias("source"), F.coalesce("target", "later").alias("target")).where("target IS NOT NULL")
    seeds = told.where("sort = 0 AND first AND NOT coalesce(had, false)").select(F.col("click_id").alias("node"))
    starts = reached(seeds, pointers)
    marked = placed.where("sort <> 1").join(starts, (F.col("click_id") == F.col("node")) & (F.col("sort") == 0), "left")
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("node").isNotNull(), F.struct(F.col("t").alias("ts"), F.col("click_id").alias("id"))), True).over(so_far)
    filled = cut(marked.withColumn("start", last).drop("target", "first"))
    lasts = filled.where("node IS NOT NULL").groupBy(*keys).agg(F.max(F.struct(F.col("t").alias("ts"), F.col("click_id").alias("id"))).alias("own"))
    carry = cut(borders.select(*keys).join(lasts, keys, "left").withColumn("carried", F.last("own", True).over(before)).where("carried IS NOT NULL").select(*keys, "carried"))
    return filled.join(F.broadcast(carry), keys, "left").withColumn("start", F.coalesce("start", "carried")).select(
        "client_id", F.col("t").alias("ts"), "click_id", "late", "final", "cents", "next_ts", "head_ts", "head_id", F.col("start.ts").alias("start_ts"), F.col("start.id").alias("start_id"))


def sessions(clicks: DataFrame, *, gap: int = GAP, longest: int = LONGEST, lateness: int = LATENESS, kinds: Sequence[str] = FINAL_KINDS, value: float = FINAL_VALUE) -> DataFrame:
    """One row for each session: client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256.

    Times and bounds are in microseconds. A click is final if its kind is one of ``kinds`` and its value is
    ``value`` at least. A session goes on with the client's next timely click, by time and id, unless its last
    one is final, ``gap`` or more earlier, or its first is over ``longest`` earlier; closed_by says which held
    first (end, gap, length), and without a next click end or none. Late clicks (arrived over ``lateness`` after
    their time) are in no session; n_late counts those from the session's start on, up to the next one's.

    Rows without click_id, client_id or ts are left out; of rows of one click_id the earliest stays. A null
    arrived_at is timely; a null kind or value is not final; a null, infinite or unusably large value counts 0 cents. Clicks of
    one time follow each other by id. Other columns play no part. An empty table gives no sessions.

    Windows run within ranges of (client, time) or (island, time), so a client with a third of all rows is
    dealt out like the others. The clicks of one session meet in one row, as its digest is of all of them.
    """
    rows = islands(timely(clicks, lateness, kinds, value), gap).where("head_id IS NOT NULL")
    far = F.col("ts") - F.col("head_ts") > longest
    beyond = rows.where(far)
    whole = rows.where(~far).select("*", F.lit(None).cast("long").alias("start_ts"), F.lit(None).cast(rows.schema["click_id"].dataType).alias("start_id"))
    if not beyond.where("NOT late").isEmpty():
        whole = whole.unionByName(_split(beyond, longest))
    else:
        whole = whole.unionByName(beyond, allowMissingColumns=True)
    of = whole.select(
        "client_id", F.coalesce("start_id", "head_id").alias("session_id"), F.coalesce("start_ts", "head_ts").alias("start_us"),
        F.when(~F.col("late"), F.struct("ts", "click_id", "final", "cents", "next_ts")).alias("click"), "late",
    )
    found = of.groupBy("client_id", "session_id", "start_us").agg(F.sort_array(F.collect_list("click")).alias("clicks"), F.count_if("late").alias("n_late"))
    end = F.element_at("clicks", -1)
    closed = F.when(end["final"], "end").when(end["next_ts"].isNull(), "none").when(end["next_ts"] - end["ts"] >= gap, "gap").otherwise("length")
    return found.select(
        "client_id", "session_id", "start_us", end["ts"].alias("end_us"), F.size("clicks").cast("long").alias("n_clicks"), "n_late",
        F.aggregate("clicks", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["cents"]).alias("value_cents"), closed.alias("closed_by"),
        F.sha2(F.array_join(F.transform("clicks", lambda c: c["click_id"].cast("string")), ","), 256).alias("path_sha256"),
    )
