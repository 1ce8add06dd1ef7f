"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

A vector takes part in its own cell and, so that no link across a border is lost, in every other cell
that can hold a vector within the threshold's angle of it. Both tests are exact bounds: a neighbour that
is nearer to another centre lies beyond the plane half way to it, and within the other cell's radius.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinname.llm.common import bound_batches, components, cut, few_rows, forest

LEAST = 0.93
#: Vectors of a cell, in the mean, and cells of a label at most.
CELL, MOST_CELLS = 2_048, 8_192
#: Cells are fitted on so many sampled vectors each, SAMPLE a label at least, and on so many numbers of all labels together
#: at most; all vectors are assigned and compared.
A_CELL, SAMPLE, SAMPLE_NUMBERS = 4, 4_096, 16_000_000
#: Vectors of one block of a product: as many as a cell has, so that few vectors go to several blocks.
BLOCK = 2_048


def spherical_k_means(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), size=min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own := vectors[near == j]).size and (norm := np.linalg.norm(total := own.sum(axis=0))) > 0:
                centres[j] = total / norm
    return centres


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def block_links(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two arrays of raw vectors have a cosine of ``least`` or more, in double precision."""
    return (left @ right.T) >= least * np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]


def _fit(vectors: DataFrame, label_counts: dict) -> dict:
    """Centres for each label and dimension, from a bounded sample of its distinct vectors, chosen by hash in one pass."""
    cells = {key: min(MOST_CELLS, math.ceil(n / CELL)) for key, n in label_counts.items()}
    cells = {key: k for key, k in cells.items() if k > 1}
    if not cells:
        return {}
    wanted = {key: max(SAMPLE, A_CELL * k) for key, k in cells.items()}
    part = min(1.0, SAMPLE_NUMBERS / sum(n * key[1] for key, n in wanted.items()))
    kind = vectors.schema["label"].dataType.simpleString()
    share = vectors.sparkSession.createDataFrame([(label, dim, min(1.0, part * wanted[label, dim] / label_counts[label, dim])) for label, dim in wanted], f"label {kind}, dim int, share double")
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 31)) / float(1 << 31)
    table = vectors.join(F.broadcast(share), ["label", "dim"]).where(draw < F.col("share")).select("node", "label", "dim", "vector").toArrow().sort_by("node")
    keys, out = list(zip(table["label"].to_pylist(), table["dim"].to_pylist(), strict=True)), {}
    for key in dict.fromkeys(keys):
        own = _matrix(table["vector"].take(pa.array([i for i, x in enumerate(keys) if x == key])))
        if len(own) > 1:
            out[key] = spherical_k_means(_unit(own), cells[key])
    return out


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    return pc.list_flatten(vectors).to_numpy().astype(np.float64).reshape(len(vectors), -1)


def _prepared(raw: pa.Array, labels: pa.Array) -> tuple[list, list]:
    """Of each vector its numbers, and the digest of label and numbers; None and None of one that links with nothing.

    Numbers whose squares would leave the range of doubles are scaled by a power of two, which changes no cosine.
    """
    values, keys = [None] * len(raw), [None] * len(raw)
    flat, ends = pc.list_flatten(raw), np.cumsum(np.nan_to_num(pc.list_value_length(raw).to_numpy(zero_copy_only=False).astype(float))).astype(int)
    numbers, known = flat.to_numpy(zero_copy_only=False).astype(np.float64), ~flat.is_null().to_numpy(zero_copy_only=False)
    sizes = np.diff([0, *ends])
    usable = (sizes > 0) & ~labels.is_null().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(numbers)))])
    usable &= bad[ends] == bad[ends - sizes]
    names = labels.cast(pa.string()).to_pylist()
    for i in np.flatnonzero(usable):
        v = numbers[ends[i] - sizes[i] : ends[i]]
        top = np.abs(v).max()
        if top == 0:
            continue
        if not 1e-140 < top < 1e140:
            v = np.ldexp(v, -int(np.frexp(top)[1]))
        values[i], keys[i] = v, hashlib.sha256(f"{names[i]}|".encode() + v.tobytes()).digest()
    return values, keys


def visits(unit: np.ndarray, centres: np.ndarray, radius: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit vector's own cell; and (row, cell) of the cells of a higher number that can hold a neighbour of it.

    A neighbour that is nearer to another centre lies beyond the plane half way to it, and within that cell's radius.
    """
    near, theta, slack = unit @ centres.T, math.acos(least), 1e-7
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
    plane = near - near[np.arange(len(unit)), own][:, None] >= -math.sin(theta) * apart - slack
    reach = np.arccos(np.clip(near, -1, 1)) <= theta + slack + radius[None, :]
    return own, *np.nonzero(plane & reach & (np.arange(len(centres))[None, :] > own[:, None]))


def _rows_of(batch: pa.RecordBatch, centres: dict) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """For each label and dimension that has centres: the rows of a batch and their unit vectors."""
    keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
    for key in set(keys) & set(centres):
        at = np.array([i for i, x in enumerate(keys) if x == key])
        yield key, at, _unit(_matrix(batch.column("vector").take(pa.array(at))))


def near_vectors(table: DataFrame, *, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``table``.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is ``least`` or more. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. n_links counts other rows;
    component_id is the least id that links reach; kept: the row's id is that id.

    Rows of equal label and vector are one node with a weight, aggregated before the shuffle, so a
    vector that a third of all rows repeat costs one. Cells and their visitors are cut into blocks,
    and each pair of blocks is one group of work, BLOCK vectors a side whatever the size of the cell.
    A block sends back one count for each vector and the edges of a spanning forest, never its pairs.
    The centres, MOST_CELLS for a label at most, go to the tasks; only labels of more than CELL
    vectors have any, so there is one centre for CELL vectors at most.
    Rows without an id take part and have their group's least id; repeated rows are linked copies;
    an empty table gives an empty one; other columns are left out, whatever their names.
    """
    bound_batches(table.sparkSession)
    element = table.schema[vector_col].dataType
    numbers = "float" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "double"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{numbers}>").alias("vector"))
    label_type, kind = rows.schema["label"].dataType.simpleString(), pa.list_(pa.float32() if numbers == "float" else pa.float64())

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            values, keys = _prepared(batch.column("vector"), batch.column("label"))
            dim = [None if v is None else len(v) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(values, kind), pa.array(dim, pa.int32()), pa.array(keys, pa.binary())], ["id", "label", "vector", "dim", "key"])

    rows = cut(rows.mapInArrow(prepare, f"id long, label {label_type}, vector array<{numbers}>, dim int, key binary").withColumn("row", F.monotonically_increasing_id()))
    weights = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("weight")))
    # a node is looked up by the number of its first row, so copies by the million are no hot key
    nodes = cut(rows.select(F.col("row").alias("node"), "label", "dim", "vector").join(weights.select("node", "weight"), "node"))

    counts = {(r["label"], r["dim"]): r["count"] for r in nodes.groupBy("label", "dim").count().where(F.col("count") > CELL).collect()}
    centres = _fit(nodes, counts)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The widest angle of each cell's vectors, a batch at a time."""
        for batch in few_rows(batches):
            for (label, dim), _, unit in _rows_of(batch, centres):
                near = unit @ centres[label, dim].T
                cell, angle = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
                widest = np.full(len(centres[label, dim]), -1.0)
                np.maximum.at(widest, cell, angle)
                some = np.flatnonzero(widest >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), batch.schema.field("label").type), pa.array([dim] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(widest[some])], ["label", "dim", "cell", "angle"])

    radius: dict = {key: np.full(len(c), -np.inf) for key, c in centres.items()}
    if centres:
        for r in nodes.select("label", "dim", "vector").mapInArrow(angles, f"label {label_type}, dim int, cell int, angle double").groupBy("label", "dim", "cell").agg(F.max("angle").alias("angle")).collect():
            radius[r["label"], r["dim"]][r["cell"]] = r["angle"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its own cell and in those of a higher number that can hold a neighbour of it."""
        for batch in few_rows(batches):
            own = np.zeros(batch.num_rows, np.int32)
            row, cell, guest = [np.arange(batch.num_rows)], [own], [np.zeros(batch.num_rows, bool)]
            for key, at, unit in _rows_of(batch, centres):
                own[at], r, j = visits(unit, centres[key], radius[key], least)
                row.append(at[r])
                cell.append(j.astype(np.int32))
                guest.append(np.ones(len(r), bool))
            picked = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*[picked.column(x) for x in ("node", "weight", "label", "dim", "vector")], pa.array(np.concatenate(cell)), pa.array(np.concatenate(guest))], ["node", "weight", "label", "dim", "vector", "cell", "guest"])

    seated = nodes.select("node", "weight", "label", "dim", "vector").mapInArrow(visit, f"node long, weight long, label {label_type}, dim int, vector array<{numbers}>, cell int, guest boolean")
    seated = cut(seated)
    sizes = cut(seated.groupBy("label", "dim", "cell").count().select("label", "dim", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = seated.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("node", "weight", "vector", "guest", "label", "dim", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(part: pa.Table) -> pa.Table:
        lo, hi = part["lo"][0].as_py(), part["hi"][0].as_py()
        block, every = part["block"].to_numpy(), _matrix(part["vector"])
        node, weight, guest = (part[x].to_numpy() for x in ("node", "weight", "guest"))
        left, right = block == lo, block == hi
        a, b, counted = [], [], []
        if left.any() and right.any():
            linked = block_links(every[left], every[right], least)
            linked &= ~(guest[left][:, None] & guest[right][None, :])  # two guests meet in a cell of their own
            if lo == hi:
                np.fill_diagonal(linked, False)
            for side, n in ((left, linked @ weight[right]), (right, weight[left] @ linked))[: 1 + (lo != hi)]:
                a.append(node[side][n > 0])
                counted.append(n[n > 0])
            b = list(a)
            edges = np.array(forest(linked), dtype=np.int64).reshape(-1, 2)
            a.append(node[left][edges[:, 0]])
            b.append(node[right][edges[:, 1]])
            counted.append(np.zeros(len(edges), np.int64))
        columns = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b, counted)]
        return pa.table(columns, names=["a", "b", "links"])

    found = cut(pairs.groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(compare, "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    group = components(found.where("a != b").select("a", "b"))
    whole = cut(weights.join(links, "node", "left").join(group, "node", "left").select("key", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least_id = cut(whole.groupBy("component").agg(F.min("least_id").alias("component_id")))
    by_key = cut(whole.join(least_id, "component").select("key", "n_links", "component_id"))
    out = rows.select("id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
