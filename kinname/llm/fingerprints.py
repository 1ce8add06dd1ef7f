"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range.

Sketches of any two documents compare directly, however unequal their sizes, as both kept the same part
of the hash range; the sketch of a union is the union of the sketches. A short text has few hashes below
the threshold or none, so it keeps all of its hashes: short texts compare exactly, and a short and a long
one by the hashes below the threshold. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinname.llm.common import text_or_empty

WORDS = 5
#: One of so many hashes is kept.
SCALE = 4
#: Runs of words up to which a text keeps all hashes.
SHORT = 64
#: Ranges of ids that neighbours are looked up in, at most; the table of their ends is broadcast.
MOST_RANGES = 65_536
_COARSE = 4_096


def _hashes(words: Column) -> Column:
    """Hashes of all runs of WORDS words; of all words, if there are fewer."""
    run = F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))
    return F.transform(run, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))


def _top(scale: int) -> int:
    """The threshold: hashes below it are kept."""
    return -(1 << 63) + (1 << 64) // scale


def with_sketch(df: DataFrame, text_col: str, to: str, scale: int = SCALE) -> DataFrame:
    """``df`` with the sorted sketch of a text column. All texts without words have one sketch, that of no words."""
    words, hashes, low = f"_{to}_words", f"_{to}_hashes", f"_{to}_low"
    split = df.withColumn(words, F.array_remove(F.split(text_or_empty(text_col), r"\s+"), "")).withColumn(hashes, _hashes(F.col(words))).drop(words)
    below = split.withColumn(low, F.when(F.size(hashes) > SHORT, F.filter(hashes, lambda h: h < _top(scale))))
    kept = F.when(F.size(low) > 0, F.col(low)).otherwise(F.col(hashes))
    return below.withColumn(to, F.array_sort(F.array_distinct(kept))).drop(hashes, low)


def _whole(sketch: Column, scale: int) -> Column:
    """Whether a sketch has all hashes of its text, as one above the threshold tells."""
    return F.array_max(sketch) >= _top(scale)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimate of how much of the smaller document's shingles the other one has, 0 to 1.

    Exact of two texts that kept all hashes. Otherwise over the hashes below the threshold that both
    kept; a text of n shingles beside a long one has none of them with a probability of (1 - 1/scale)^n,
    which is 18 % for 6 shingles and 1 % for 16 at a scale of 4; then nothing tells of it and the result is 0.
    """
    both = _whole(a, scale) & _whole(b, scale)
    x, y = (F.when(both, s).otherwise(F.filter(s, lambda h: h < _top(scale))) for s in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y)).cast("double")), F.lit(0.0))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together: all hashes if both kept theirs, else those below the threshold."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < _top(scale))
    return F.when(_whole(a, scale) & _whole(b, scale) | (F.size(low) == 0), both).otherwise(low)


def as_string(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), ",")


def with_next(rows: DataFrame, id_col: str, carried: list[str], range_rows: int = 512) -> DataFrame:
    """``rows`` with the columns ``carried`` of the next row by descending id, as next_<name>; the last row's next is the first.

    Ids are cut into ranges of about equal numbers of rows, MOST_RANGES at most, by two passes over
    the id column alone; each range is sorted by itself. The first row of a range also visits the
    range before it, so no neighbours are lost at the ends and no task sees all rows. Rows that share
    an id follow each other by descending text columns; rows without id come last.
    """
    ids = rows.select(F.col(id_col).cast("double").alias("x"))
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    spark = rows.sparkSession
    low, span = low or 0.0, max((high or 0.0) - (low or 0.0), 1.0)
    at = (F.col(id_col).cast("double") - low) / span * (_COARSE - 1)
    # denser parts of the id range are cut more finely; both tables have a bounded number of rows
    dense = rows.select(F.floor(at).alias("_c")).where("_c IS NOT NULL").groupBy("_c").count().select("_c", F.ceil(F.col("count") / F.lit(max(range_rows, n / (MOST_RANGES - _COARSE - 1)))).alias("_n"))
    found = rows.withColumn("_c", F.floor(at)).join(F.broadcast(dense), "_c", "left")
    found = found.withColumn("_range", F.coalesce(F.col("_c") * MOST_RANGES + F.floor((at - F.col("_c")) * F.col("_n")), F.lit(-1))).drop("_c", "_n")
    heads = found.groupBy("_range").agg(F.max(id_col).alias("_head")).orderBy(F.desc("_range")).collect()
    visits = [(h["_head"], heads[i - 1]["_range"]) for i, h in enumerate(heads)]  # the first range's head visits the last
    table = spark.createDataFrame(visits or [(None, 0)], "_head long, _visit long")
    own = F.struct(F.col("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_visit").alias("_range"), F.lit(True).alias("_guest"))
    seated = found.join(F.broadcast(table), F.col(id_col).eqNullSafe(F.col("_head")), "left")
    seated = seated.withColumn("_seat", F.explode(F.when(F.col("_visit").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    seated = seated.select(*rows.columns, "_seat.*")
    order = W.partitionBy("_range").orderBy(F.col("_guest"), F.desc_nulls_last(id_col), *[F.desc_nulls_last(c) for c in carried])
    return seated.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_guest")).drop("_range", "_guest")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has its last half of code points replaced by as many first ones of the next
    document by descending id, or by all of it where it is shorter. near_*: containment estimates. A
    null text is the empty text; repeated rows give a row each and are neighbours of each other;
    an empty table gives an empty one; other columns are left out, whatever their names. Texts of any
    length are sketched whole, in expressions that hold one text at a time.
    """
    text = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    ahead = with_next(with_sketch(text, "_text", "_print", scale), "_id", ["_text", "_print"])
    half = F.floor(F.length("_text") / 2).cast("int")
    mixed = ahead.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("next__text", F.lit(1), half)))
    mixed = mixed.select("_id", "_print", "next__print", F.length("_text").cast("long").alias("n_chars"), "_edited")
    both = with_sketch(mixed, "_edited", "_edited_print", scale)
    return both.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        as_string(F.col("_print")).alias("fingerprint"), as_string(F.col("_edited_print")).alias("edited_fingerprint"),
        containment(F.col("_print"), F.col("_edited_print"), scale).alias("near_edited"), containment(F.col("_print"), F.col("next__print"), scale).alias("near_next"),
    )
