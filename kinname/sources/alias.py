"""Weighted draws at one look-up: an alias table of names, made by arithmetic on their distinct counts.

Of n names that occur w times together each has a slot of w units and brings n units for each time that
it occurs. In the order of falling counts, names above the mean have units to give, those below it have
a slot to fill. One sweep gives: each slot below the mean is filled by the first name that still has
units to give, and a name that gave more than it had to spare is filled up itself by the next one. So a
slot holds its own name and at most one other, and a draw looks at one slot, however many names there are.

Names of one count stand at equal distances on the line of units. Who fills whom follows from where the
distinct counts begin on that line, so the sweep is over counts, and slots are dealt out in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinname.sources.shared import shared_dir

#: Slots that one row of a chunk stands for.
CHUNK = 4_096
_UNITS = "decimal(38,0)"


def _written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: what is used several times is computed once."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _counts(names: DataFrame) -> DataFrame:
    """(count, first, gap, low, w) of each distinct count: its first slot, a name's units above (below) a slot, and where its names begin to give (lack)."""
    sizes = names.groupBy("count").agg(F.count(F.lit(1)).cast(_UNITS).alias("k")).withColumn("c", F.col("count").cast(_UNITS))
    everything = W.partitionBy()
    sizes = sizes.withColumn("n", F.sum("k").over(everything)).withColumn("w", F.sum((F.col("c") * F.col("k")).cast(_UNITS)).over(everything))
    falling = W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, 0)
    sizes = sizes.withColumn("first", (F.sum("k").over(falling) - F.col("k")).cast("long")).withColumn("gap", (F.col("c") * F.col("n") - F.col("w")).cast(_UNITS))
    given = (F.abs("gap") * F.col("k")).cast(_UNITS)
    low = lambda side: (F.sum(F.when(side, given).otherwise(F.lit(0).cast(_UNITS))).over(falling) - given).cast(_UNITS)
    return sizes.select("count", "first", F.col("k").cast("long").alias("k"), F.abs("gap").alias("gap"), F.signum("gap").cast("int").alias("side"), F.when(F.col("gap") > 0, low(F.col("gap") > 0)).otherwise(low(F.col("gap") < 0)).alias("low"), "w")


def _places(counts: DataFrame) -> DataFrame:
    """(slot, share, other): how much of a slot is its own name's, and the slot of the name that has the rest."""
    one = F.struct("first", "gap", "low")
    starts = counts.where("side != 0").groupBy(F.col("low").alias("from")).agg(F.max(F.when(F.col("side") > 0, one)).alias("up"), F.max(F.when(F.col("side") < 0, one)).alias("down"), F.max("w").alias("w"))
    until = counts.where("side > 0").agg(F.sum((F.col("gap") * F.col("k")).cast(_UNITS)).cast(_UNITS).alias("end"))
    along = W.orderBy("from")
    # between two starts one count gives and one count lacks
    pieces = starts.select("from", "w", F.last("up", True).over(along).alias("up"), F.last("down", True).over(along).alias("down"), F.lead("from").over(along).alias("to"))
    pieces = pieces.withColumn("to", F.coalesce("to", until.scalar()))
    lacking = pieces.select("*", F.lit(-1).alias("side"), F.expr("(`from` - down.low + down.gap - 1) div down.gap").alias("lo"), F.expr("(`to` - down.low + down.gap - 1) div down.gap - 1").alias("hi"))
    giving = pieces.select("*", F.lit(1).alias("side"), F.expr("(`from` - up.low) div up.gap").alias("lo"), F.expr("(`to` - up.low) div up.gap - 1").alias("hi"))
    full = counts.where("side = 0").select(F.col("low").alias("from"), "w", one.alias("up"), one.alias("down"), F.col("low").alias("to"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("lo"), (F.col("k") - 1).alias("hi"))
    chunks = lacking.unionByName(giving).unionByName(full).where("lo <= hi").withColumn("at", F.explode(F.expr(f"sequence(lo, hi, {CHUNK}L)")))
    each = chunks.repartition("side", "from", "at").withColumn("i", F.explode(F.expr(f"sequence(at, least(hi, at + {CHUNK - 1}L))")))
    # the i-th name that lacks stands at x; the i-th that gives has given all at x
    x = F.expr(f"CAST(CASE side WHEN 1 THEN up.low + (i + 1) * up.gap WHEN -1 THEN down.low + i * down.gap END AS {_UNITS})")
    each = each.withColumn("x", x).withColumn("slot", F.expr("CASE side WHEN 1 THEN up.first ELSE down.first END + i"))
    lack = F.expr(f"CAST(CASE side WHEN 1 THEN down.low + ((x - down.low + down.gap - 1) div down.gap) * down.gap - x WHEN -1 THEN down.gap ELSE 0 END AS {_UNITS})")
    each = each.withColumn("lack", lack)
    other = F.expr("CASE WHEN lack = 0 THEN slot WHEN side = 1 THEN slot + 1 ELSE up.first + (x - up.low) div up.gap END")
    return each.select("slot", (F.col("w") - F.col("lack")).cast("double").alias("own"), F.col("w").cast("double").alias("w"), other.alias("other")).select("slot", (F.col("own") / F.col("w")).alias("share"), "other")


def alias_table(names: DataFrame) -> DataFrame:
    """(slot, name, share, other) for ``names`` (name, count), each name once: slot 0 has the most frequent name, equal counts go by digest and name.

    A draw that falls on a slot is the slot's own name with the probability ``share``, else ``other``. Names that
    are null or occur no times (or null times) have no slot; an empty table gives an empty one. Ranks
    are counted within 4,096 parts of each count, dealt out by digests, so that no task sorts the many names that are rare. Names, counts and ranks are written when this is called.
    """
    kept = _written(names.where("count > 0 AND name IS NOT NULL").select("name", F.col("count").cast("long").alias("count"), F.substring(F.md5("name"), 1, 3).alias("_part")))
    counts = _written(_counts(kept))
    parts = kept.groupBy("count", "_part").agg(F.count(F.lit(1)).alias("_k"))
    parts = parts.withColumn("_before", F.sum("_k").over(W.partitionBy("count").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_k"))
    parts = parts.join(counts.select("count", "first"), "count").select("count", "_part", (F.col("first") + F.col("_before")).alias("_before"))
    within = F.row_number().over(W.partitionBy("count", "_part").orderBy("name"))
    named = _written(kept.join(parts, ["count", "_part"]).select((F.col("_before") + within - 1).alias("slot"), "name"))
    others = named.select(F.col("slot").alias("_other"), F.col("name").alias("other"))
    return _places(counts).withColumnRenamed("other", "_other").join(named, "slot").join(others, "_other").select("slot", "name", "share", "other")


class Draws:
    """Names to draw from: their alias table, written once to the shared folder."""

    def __init__(self, names: DataFrame):
        self.table = _written(alias_table(names))
        self.slots = self.table.count()

    def drawn(self, rows: DataFrame, draw: Column, to: str) -> DataFrame:
        """``rows`` with the name that a number in [0, 1) draws, as column ``to``; none are left where there are no names.

        One equality join on the slot; draws fall on all slots alike, so none is hot. Spark broadcasts a table of
        small files and shuffles a large one.
        """
        table = self.table.select(F.col("slot").alias("_slot"), F.col("name").alias("_name"), F.col("share").alias("_share"), F.col("other").alias("_other"))
        place = F.col("_draw") * F.lit(float(self.slots))
        placed = rows.withColumn("_draw", draw).withColumn("_draw", place).withColumn("_slot", F.floor("_draw"))
        got = F.when(F.col("_draw") - F.col("_slot") < F.col("_share"), F.col("_name")).otherwise(F.col("_other"))
        return placed.join(table, "_slot").withColumn(to, got).drop("_draw", "_slot", "_name", "_share", "_other")
