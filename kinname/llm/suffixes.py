"""A sparse suffix array in ranges: suffixes and what is before them are sorted, neighbours compared, equal beginnings named.

A suffix starts at the run of a minimiser; after has the words behind the run and before the words in
front of it, the nearest first. Rows are sorted by run and after, and again by run and before, each time by
ranges, so the rows of one run can be any number of tasks. In either order the rows that share a run and
the next n words stand together, whatever stands around them: the length of the beginning that neighbours
share tells for each n where such a stretch starts. The row it starts at is the stretch's name. Of each
range its first and its last row are compared with the ranges beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import claim, cut, few_rows, settle

#: Rows of a range at most, as a power of two; a name is the number of its range and the place there.
_PLACES = 33
_ROWS = 2_048
_BORDER = pa.struct([("pid", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("names", pa.list_(pa.int64()))])
_BORDER_DDL = "struct<pid:long,first:array<long>,last:array<long>,names:array<long>>"


def _padded(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as the rows of a matrix, and their lengths."""
    lengths = lists.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out, lengths


def shared_beginnings(runs: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many words each row but the first shares with the one before it; -1 where not even the run."""
    same = (words[1:] == words[:-1]) & (np.arange(words.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None])
    return np.where(runs[1:] == runs[:-1], np.logical_and.accumulate(same, axis=1).sum(axis=1), -1)


def _named(rows: DataFrame, words: str, keep: list[str], out: str, width: int, rising: bool) -> DataFrame:
    """keep, and in ``out`` the names of the row's stretches: of size(before) words and one less for each next passage, or of the rest of width if rising; one more row for each range has its border."""
    kept = rows.select(*keep).schema
    dealt = rows.repartitionByRange("run", words, "kind").sortWithinPartitions("run", words, "kind").withColumn("pid", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffixes")
        names = None  # of the row before, for every number of words
        first = last = pid = None
        at = 0
        for batch in few_rows(batches, _ROWS):
            n = batch.num_rows
            if not n:
                continue
            runs = batch.column("run").to_numpy()
            matrix, lengths = _padded(batch.column(words), width)
            pid = batch.column("pid")[0].as_py()
            if names is None:
                first, carried, shared = [int(runs[0]), *matrix[0, : lengths[0]].tolist()], np.full((1, width + 1), -1), np.array([-1])
            else:
                carried, shared = names[None, :], shared_beginnings(np.array([last[0], runs[0]]), np.stack([tail, matrix[0]]), np.array([len(last) - 1, lengths[0]]))
            shared = np.concatenate([shared, shared_beginnings(runs, matrix, lengths)])
            starts = np.where(shared[:, None] < np.arange(width + 1), (pid << _PLACES) + at + np.arange(n)[:, None], -1)
            every = np.maximum.accumulate(np.concatenate([carried, starts]), axis=0)[1:]
            names, tail, last, at = every[-1], matrix[-1], [int(runs[-1]), *matrix[-1, : lengths[-1]].tolist()], at + n
            count, front = (batch.column(c).to_numpy().astype(np.int64) for c in ("count", "front"))
            offsets = np.concatenate([[0], np.cumsum(count)])
            row = np.repeat(np.arange(n), count)
            level = front[row] - (np.arange(len(row)) - offsets[row])
            chosen = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(every[row, width - level if rising else level]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), chosen, pa.nulls(n, _BORDER)], [*keep, out, "border"])
        if names is not None:
            border = pa.array([{"pid": pid, "first": first, "last": last, "names": names.tolist()}], _BORDER)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, batch.column(c).type) for c in keep), pa.nulls(1, pa.list_(pa.int64())), border], [*keep, out, "border"])
        settle()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return cut(dealt.mapInArrow(run, f"{columns}, {out} array<long>, border {_BORDER_DDL}"))


def across(borders: list, width: int) -> list[tuple[int, int, int]]:
    """(level, name, true name) of the stretches that began in an earlier range, from the borders of all ranges."""
    out, told, before = [], {}, None
    for b in sorted(borders, key=lambda b: b.pid):
        told = {"name": b.pid << _PLACES, "was": told}
        shared = -1
        if before is not None and before.last[0] == b.first[0]:
            pairs = list(zip(before.last[1:], b.first[1:], strict=False))
            shared = next((i for i, (x, y) in enumerate(pairs) if x != y), len(pairs))
        true = {}
        for level in range(shared + 1):
            name = before.names[level]
            true[level] = told["was"]["true"].get(level, name) if name == told["was"]["name"] else name
            out.append((level, told["name"], true[level]))
        told = {"name": told["name"], "true": true}
        before = b
    return out


def named_passages(suffixes: DataFrame, reach: int) -> DataFrame:
    """(run, kind, first, id, last, at, level, left_name, right_name), one for each passage of each suffix.

    ``suffixes`` has run, kind, first, id, last, count, before and after; a passage is the run with level words
    in front of it and reach - level behind; the suffix's own passages have size(before) words in front,
    and one less each time. Two passages are equal just if level and both names are. The driver gets one
    row for each range; none that grows with the rows of a run.
    """
    spark = suffixes.sparkSession
    of = ["run", "kind", "first", "id", "last", "count", "front"]
    rows = suffixes.withColumn("front", F.size("before"))
    right = _named(rows, "after", [*of, "before"], "rights", reach, True)
    left = _named(right.where("border IS NULL").drop("border"), "before", [*of, "rights"], "lefts", reach, False)
    each = left.where("border IS NULL").select(*of, F.posexplode(F.arrays_zip("lefts", "rights")).alias("at", "p"))
    each = each.select("run", "kind", "first", "id", "last", "at", (F.col("front") - F.col("at")).alias("level"), F.col("p.lefts").alias("left_name"), F.col("p.rights").alias("right_name"))
    for table, name, level in ((left, "left_name", F.col("level")), (right, "right_name", reach - F.col("level"))):
        moved = across(table.where("border IS NOT NULL").select("border.*").collect(), reach)
        if moved:
            fix = spark.createDataFrame(moved, "_level int, _name long, _true long")  # reach + 1 rows a range at most
            each = each.join(F.broadcast(fix), (level == F.col("_level")) & (F.col(name) == F.col("_name")), "left")
            each = each.withColumn(name, F.coalesce("_true", name)).drop("_level", "_name", "_true")
    return each
