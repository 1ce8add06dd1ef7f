"""Packing of token pieces into sequences of bounded length: dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinname.llm.common import bound_batches, claim, cut, few_rows, spread, text_or_empty
from kinname.llm.tokens import encoder

#: A bin's content as (length, how many of it), longest first.
Pattern = tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Takes from ``counts`` the sets that an optimal packing may hold, by Martello and Toth's criterion.

    A set dominates when whatever else could share a bin with its longest item would also fit in the
    place of the partner it got. So, for a length taken from the longest down, fixed are: the item
    alone if nothing fits beside it; with the partner that fills the bin to the brim; with the longest
    partner that fits, if no two items fit beside it. Works on how many items each length has, so its
    cost depends on the capacity alone, not on the number of documents.
    """
    fixed: list[tuple[Pattern, int]] = []

    def take(*lengths: int, times: int) -> None:
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
        same = len(lengths) == 2 and lengths[0] == lengths[1]
        fixed.append((((lengths[0], 2),) if same else tuple((x, 1) for x in lengths), times))

    for longest in sorted(counts, reverse=True):
        while counts.get(longest):
            room = capacity - longest
            have = counts[longest]
            if room in counts and (room != longest or have > 1):
                take(longest, room, times=have // 2 if room == longest else min(have, counts[room]))
                continue
            # what may stand beside one of the longest: at most two of the shortest tell what fits
            short = []
            for x in sorted(counts):
                short += [x] * min(2, counts[x] - (x == longest))
                if len(short) >= 2:
                    break
            if not short or short[0] > room:
                take(longest, times=1 if longest <= room else have)
                continue
            if len(short) > 1 and short[0] + short[1] <= room:
                break  # not decided here
            partner = max(x for x in counts if x <= room and (x != longest or have > 1))
            if partner == longest:
                take(longest, longest, times=have // 2)
            else:
                # every partner of this length serves as well, and none of the shorter ones is longer
                take(longest, partner, times=min(have, counts[partner]))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit of the lengths from the longest down; bins of equal content are handled as one."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by the room left

    def put(pattern: Pattern, room: int, length: int, each: int, times: int) -> None:
        if times:
            open_bins[room - length * each].append((((*pattern, (length, each))), times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            each = room // length
            while left and open_bins[room]:
                pattern, bins = open_bins[room].pop()
                full = min(bins, left // each)
                put(pattern, room, length, each, full)
                left -= full * each
                bins -= full
                if bins and left:  # fewer are left than one bin takes
                    put(pattern, room, length, left, 1)
                    left, bins = 0, bins - 1
                if bins:
                    open_bins[room].append((pattern, bins))
            if not left:
                break
        each = capacity // length
        put((), capacity, length, each, left // each)
        if left % each:
            put((), capacity, length, left % each, 1)
    return [x for same in open_bins.values() for x in same]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    counts = {x: n for x, n in counts.items() if n}
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def slots(packed: list[tuple[Pattern, int]]) -> tuple[np.ndarray, int]:
    """Where the n-th piece of each length goes, and how many bins there are.

    Rows (length, first rank, pieces a bin, first bin, offset), sorted; their number is bounded by the
    capacity, as best fit splits at most two groups of bins for each length.
    """
    rank: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, times in packed:
        offset = 0
        for length, each in pattern:
            rows.append((length, rank[length], each, first, offset))
            rank[length] += each * times
            offset += each * length
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), first


def pieces(docs: DataFrame, path: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids binary]) of every whole text's ids with a separator after them."""
    bound_batches(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")))
    kind = source.schema["id"].dataType
    fields = [T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    end, step = separator.to_bytes(4, "little"), capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        encode = encoder(path).encode_batch
        for batch in few_rows(batches):
            row, number, start, length, crc, parts = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column("text").to_pylist())):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row.append(i)
                    number.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def pack(items: DataFrame, *, capacity: int = 2048, bucket_rows: int = 500) -> DataFrame:
    """``items`` (with a column ``length`` of 1 to capacity) and their sequence_id and offset.

    Only how many items each length has comes to the driver: capacity rows at most. The packing of
    those counts is a table of bounded size; each item then finds its place by its rank among the
    items of its length. Ranks are made in buckets of about ``bucket_rows`` items, so a length that a
    third of all items share is dealt out too. The items are checkpointed first: places do not change
    when a lost executor's tasks run again. Items of the full capacity are sequences of their own and
    need no rank. Repeated items are placed each by itself; an empty table gives an empty one.
    """
    spark = items.sparkSession
    columns = items.columns
    kept = cut(items.withColumn("_item", F.monotonically_increasing_id()))
    counted = kept.where(F.col("length") < capacity).groupBy("length").count()
    counts = {r["length"]: r["count"] for r in counted.collect()}
    table, bins = slots(pack_lengths(dict(counts), capacity))
    full = kept.where(F.col("length") >= capacity).select(*columns, (F.col("_item") + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return full
    dealt = F.broadcast(counted.select("length", F.ceil(F.col("count") / bucket_rows).alias("_buckets")))  # capacity rows at most
    keyed = kept.where(F.col("length") < capacity).join(dealt, "length").withColumn("_bucket", F.pmod(F.xxhash64("_item"), F.col("_buckets"))).drop("_buckets")
    before = keyed.groupBy("length", "_bucket").count().select("length", "_bucket", (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    within = keyed.withColumn("_row", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_item")))
    ranked = within.join(before, ["length", "_bucket"]).select(*columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    fields = [T.StructField(c, items.schema[c].dataType) for c in columns]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    wide = np.int64(1) << np.int64(44)
    keys = table[:, 0] * wide + table[:, 1]  # by length, then by rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            n = rank - row[:, 1]
            places = [pa.array(row[:, 3] + n // row[:, 2]), pa.array(row[:, 4] + n % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + places, schema.names)

    return ranked.mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): all whole texts in few sequences.

    A document's ids are those of its text and the separator; only documents longer than the capacity
    are cut. A null or empty text is the separator alone; a null id stays null; repeated rows are
    packed each; very long texts become many full pieces; other columns are left out.
    """
    return pack(pieces(docs, path, capacity=capacity, separator=separator, id_col=id_col, text_col=text_col), capacity=capacity)
