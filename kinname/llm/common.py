"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinname.sources.shared import shared_dir

#: Rows that Python works on at once, and bytes of a batch that goes to Python; a longer text goes alone.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20
#: Characters of a key that a memo keeps: texts without spaces are long keys that never recur.
LONGEST_KEY = 64
#: Keys that are broadcast at most, of 8 bytes each.
MOST_KEYS = 2_000_000


class Memo(dict):
    """A memo of ``make(key)`` in two generations that holds at most ``2 * limit`` entries, of LONGEST_KEY characters each.

    When the young generation is full it becomes the old one; what is used again moves back. So
    frequent keys stay and memory is bounded, whatever the number of distinct keys. A Python worker
    serves many stages: ``claim`` empties the memos of the operators that ran in it before.
    """

    _all: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, make, limit: int, group: str = ""):
        super().__init__()
        self.make, self.limit, self.group, self.old = make, limit, group, {}
        Memo._all.add(self)

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST_KEY:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def knows(self, key) -> bool:
        return key in self or key in self.old


def claim(group: str) -> None:
    """Empties the memos of other groups in this process and gives their memory back to the system."""
    others = [memo for memo in list(Memo._all) if memo.group != group and (memo or memo.old)]
    for memo in others:
        memo.clear()
        memo.old = {}
    if others:
        settle()


def settle() -> None:
    """Gives free memory of this process back to the system; executors count what their workers hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_alphabet() -> dict[int, str]:
    """The sign of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values of that format
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage that outlives executors, and sizes that the planner knows.

    Not compressed: it is mostly hashes, and the codecs' buffers outside the heap stay until a full collection.
    """
    folder = shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "uncompressed").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of the bytes of Arrow batches to BATCH_BYTES, never raises it.

    Plans read it when they run, after the operator has returned, so it stays. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows; at their end the worker settles."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    settle()


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def parted(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may have their key in ``keys``, which is written already, and the rest, which surely have not.

    Up to MOST_KEYS keys, 64-bit hashes of them are broadcast, so the rest is not shuffled; beyond, all
    rows are in the first part and there is no rest. Which of the first part have a key is for a join to tell.
    """
    if keys.count() > MOST_KEYS:
        return rows, None
    wanted = F.broadcast(keys.select(F.xxhash64(*on).alias("_hash")))
    hashed = rows.withColumn("_hash", F.xxhash64(*on))
    return hashed.join(wanted, "_hash", "left_semi").drop("_hash"), hashed.join(wanted, "_hash", "left_anti").drop("_hash")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it has fewer partitions than there are cores: a small table in one file. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def boxed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct named doc, so that no name of theirs meets a helper column's."""
    return df.select(F.struct("*").alias("doc"))


def of_doc(name: str) -> Column:
    return F.col("doc").getField(name)


def unboxed(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The boxed columns again, in order; those in ``new`` replaced."""
    return df.select(*[(new or {}).get(c, of_doc(c)).alias(c) for c in columns])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, component).

    ``component`` is the smallest node that links reach. Every node of an edge is in the result;
    null ends are ignored. Each round relinks the larger neighbours of a node to the smallest
    node near it and then shortens the pointers, so chains of n nodes end in O(log n) rounds.
    Minima are aggregated before each shuffle and written before they are joined to the links, so
    both sides of a join are plain tables: the planner broadcasts a small one and splits the links of
    a node that has very many. Only links travel, never texts, and one count a round comes to the driver.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    # u > v always: u points at v; a node alone keeps itself
    point = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    was = None
    for _ in range(max_rounds):
        now = point.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()  # equal sets of links give equal sums
        if now == was or not now[0]:
            break
        was = now
        # large star: every neighbour above a node points at the least of its neighbours and itself
        near = point.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o")), F.struct(F.col("v").alias("n"), F.col("u").alias("o")))).alias("e")).select("e.n", "e.o")
        least = cut(near.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m")))
        large = cut(near.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every neighbour below a node, and the node, point at the least of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        point = cut(small.where("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(point, nodes.node == point.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what a block's links connect, at most one for each row and column."""
    rows, columns = linked.shape
    seen_r, seen_c, out = np.zeros(rows, bool), np.zeros(columns, bool), []
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen_r[start]:
            continue
        seen_r[start] = True
        stack = [start]
        while stack:
            r = stack.pop()
            for c in np.flatnonzero(linked[r] & ~seen_c):
                seen_c[c] = True
                out.append((r, c))
                fresh = np.flatnonzero(linked[:, c] & ~seen_r)
                seen_r[fresh] = True
                out += [(x, c) for x in fresh]
                stack += fresh.tolist()
    return out
