"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Each shingle of a document is an element whose weight grows with how often it occurs. It makes a
Poisson process with its weight as the rate; each arrival falls on one of the signature's components,
and a component keeps the element that arrived first. Two documents agree in a component with the
probability Jaccard similarity of their weights. A document is done once no further arrival can come
before the latest of its components' first arrivals, so most elements need one arrival only.

Documents are near copies by the similarity of their sets of shingles. So a document whose shingles
repeat has a second signature, of equal weights, and is found by the bands of either.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import bound_batches, boxed, claim, components, cut, digest_of, few_rows, forest, of_doc, parted, settle, spread, text_or_empty, unboxed
from kinname.llm.shingles import mix, shingles

#: Bands and components a band: at a similarity of 0.8 a pair shares no band once in 20,000 times.
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Documents of one side of a block comparison.
BLOCK = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(documents: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """The ProbMinHash signatures of documents given by the hashes of their shingles, repeats included."""
    owner, element, weight = [], [], []
    for i, found in enumerate(documents):
        kinds, times = np.unique(found, return_counts=True)
        owner.append(np.full(len(kinds), i))
        element.append(kinds)
        weight.append(1 + np.log(times))
    first = np.full(len(documents) * size, np.inf)
    winner = np.zeros(len(documents) * size, dtype=np.uint64)
    if not documents:
        return winner.reshape(0, size)
    owner, element, weight = np.concatenate(owner).astype(np.int64), np.concatenate(element), np.concatenate(weight)
    time, done = np.zeros(len(owner)), 0
    while len(owner):
        # several arrivals at once where few elements are left; arrivals that come too late change nothing
        n = int(np.clip(40_000 // len(owner), 1, 64))
        bits = mix(element[:, None] + _STEP * np.arange(done + 1, done + n + 1, dtype=np.uint64))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
        arrival = time[:, None] + np.cumsum(gap, axis=1) / weight[:, None]
        part = ((mix(bits ^ _STEP) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        place = (owner[:, None] * size + part).ravel()
        flat = arrival.ravel()
        np.minimum.at(first, place, flat)
        won = np.flatnonzero(first[place] == flat)
        winner[place[won]] = element[won // n]
        done += n
        last = first.reshape(-1, size).max(axis=1)
        time = arrival[:, -1]
        more = time < last[owner]
        owner, element, weight, time = owner[more], element[more], weight[more], time[more]
    return winner.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]) + np.uint64(1)
    for i in range(rows):
        key = mix(key * _STEP + parts[:, :, i])
    return key.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest, keys): the band keys of each row's whole text, those of equal weights too where shingles repeat; a text without words has none."""
    bound_batches(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))).withColumn("digest", digest_of(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in few_rows(batches):
            found = [shingles(x) for x in batch.column("text").to_pylist()]
            some = [i for i, x in enumerate(found) if len(x)]
            keys: list = [[]] * len(found)
            for i, key in zip(some, band_keys(signatures([found[i] for i in some])), strict=True):
                keys[i] = key
            # links are between sets; where no shingle repeats the weights are equal anyway
            sets = {i: np.unique(found[i]) for i in some}
            uneven = [i for i in some if len(sets[i]) < len(found[i])]
            for i, key in zip(uneven, band_keys(signatures([sets[i] for i in uneven])), strict=True):
                keys[i] = np.union1d(keys[i], key)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "keys"])

    return source.mapInArrow(run, "id long, digest binary, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of word shingles of ``least`` or more, exactly."""
    whole = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def kinds(node: int, text: str) -> np.ndarray:
            if node not in recent:
                recent[node] = np.unique(shingles(text))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for batch in few_rows(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, s, y, t) in enumerate(zip(a, batch.column("text_a"), b, batch.column("text_b"), strict=True)):
                p, q = kinds(x, s.as_py()), kinds(y, t.as_py())
                if min(len(p), len(q)) >= least * max(len(p), len(q)):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if shared >= least * (len(p) + len(q) - shared):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return whole.mapInArrow(run, "a long, b long")


def jaccard_blocks(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarities of all documents of two blocks, given by their distinct shingles."""
    sizes = [len(x) for x in (*left, *right)]
    kinds, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    common = times[column] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2_048):
        a, b = np.searchsorted(column, [at, at + 2_048])
        part = np.zeros((len(sizes), 2_048), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        shared += part[: len(left)] @ part[len(left) :].T
    total = np.array(sizes[: len(left)])[:, None] + np.array(sizes[len(left) :])[None, :]
    return shared / np.maximum(total - shared, 1)


def _across(hits: DataFrame, links: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links (a, b) between components of ``links`` whose documents share a bucket; enough of them to join what they join.

    Buckets with several components hang together in pools. A pool of at most BLOCK documents is compared
    as a whole; of a larger one each bucket by itself, in blocks of about BLOCK documents, so chains of
    buckets do not add up. Blocks are compared from texts, without listing their pairs.
    """
    found = hits.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = cut(found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("least")).where("low < high").select("key", "least"))
    open_hits = cut(found.join(mixed, "key"))
    pools = cut(components(open_hits.select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "pool"))
    pooled = cut(open_hits.select("key", "node", "component").join(pools, "node"))
    large = pools.groupBy("pool").count().where(F.col("count") > BLOCK).select("pool", F.lit(True).alias("large"))
    grouped = pooled.join(cut(large), "pool", "left").select(F.when(F.col("large"), F.col("key")).alias("bucket"), "pool", "node", "component").distinct()
    members = cut(grouped.withColumn("group", F.struct("bucket", "pool")).drop("bucket", "pool"))
    sizes = cut(members.groupBy("group").count().select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "text")

    def compare(part: pa.Table) -> pa.Table:
        block, node, component = (part[x].to_numpy() for x in ("block", "node", "component"))
        left, right = (np.flatnonzero(block == part[x][0].as_py()) for x in ("lo", "hi"))
        edges = np.zeros((0, 2), np.int64)
        if len(left) and len(right):
            claim("shingles")
            sides = [[np.unique(shingles(t)) for t in part["text"].take(at).to_pylist()] for at in (left, right)]
            alike = jaccard_blocks(*sides)
            linked = alike >= least - 1e-6  # the bound itself is settled in integers
            linked &= component[left][:, None] != component[right][None, :]
            for i, j in zip(*np.nonzero(linked & (alike < least + 1e-6)), strict=True):
                shared = len(np.intersect1d(sides[0][i], sides[1][j], assume_unique=True))
                linked[i, j] = shared >= least * (len(sides[0][i]) + len(sides[1][j]) - shared)
            edges = np.array(forest(linked), np.int64).reshape(-1, 2)
            del sides, alike, linked
            settle()  # a task compares many blocks
        return pa.table({"a": node[left][edges[:, 0]], "b": node[right][edges[:, 1]]})

    return pairs.groupBy("group", "lo", "hi").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, class_id, class_size, kept), one for each row of ``docs``; the class is a component of the similarity graph.

    Rows of equal texts are one node from the start, aggregated before they are shuffled, so copies
    by the million cost one node. Nodes that share a band are candidates. First each is compared with
    the least node of its buckets; then, where buckets still hold several components, their nodes are
    compared in blocks across components. So every candidate pair is either within one component or
    compared, while a group of copies costs a few comparisons a member, and pairs of a group are never
    listed. Comparisons are exact, on whole texts.

    Texts without words equal only their like. class_id: the least id in the class (null if all are
    null); kept: whether the row is the one row that stays for its class, the least id and of equal
    rows one. A null text is the empty text. Rows that share an id but not a text are different rows.
    """
    sketched = cut(sketch(docs, id_col, text_col))
    nodes = sketched.groupBy("digest").agg(F.min(F.struct("row", "id", "keys")).alias("of")).select("digest", F.col("of.row").alias("node"), F.col("of.id").alias("id"), F.col("of.keys").alias("keys"))
    nodes = cut(nodes)
    banded = nodes.select(F.explode("keys").alias("key"), "node")
    buckets = cut(banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most"))
    hits = cut(banded.join(buckets, "key").select("key", "node", "least"))
    needed = cut(hits.select("node").distinct().join(nodes.select("node", "digest", F.col("id").alias("_id")), "node"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest_of(F.col("text")))
    text, _ = parted(text, needed.select("digest", F.col("_id").alias("id")), ["digest", "id"])
    texts = cut(text.join(needed.withColumnRenamed("digest", "_digest"), (text.digest == F.col("_digest")) & text.id.eqNullSafe(F.col("_id"))).groupBy("node").agg(F.first("text").alias("text")))

    stars = hits.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(similar(stars, texts, similarity))
    links = cut(links.unionByName(_across(hits.select("key", "node"), links, texts, similarity)))

    # what is joined to all rows is written first, so the planner can split a class or a text that very many rows share
    classed = cut(nodes.select("digest", "node").join(components(links), "node", "left").select("digest", F.coalesce("component", "node").alias("class")))
    rows = cut(sketched.select("row", "id", "digest").join(classed, "digest"))
    heads = cut(rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"), F.count(F.lit(1)).alias("class_size")))
    out = rows.join(heads, "class")
    return out.select("row", "id", "digest", F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, kept) for each row; see :func:`classes`."""
    return classes(docs, similarity=similarity, id_col=id_col, text_col=text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def without_near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class.

    Only rows that share id and text with one that goes are shuffled, as long as those that go are few
    enough for a broadcast of their hashes. Null and empty texts, null ids and repeated rows as in
    :func:`classes`; of rows equal in id and text one stays; an empty table gives an empty one.
    """
    found = cut(classes(docs, similarity=similarity, id_col=id_col, text_col=text_col).select("id", "digest", "kept"))
    # rows equal in id and text cannot be told apart, so their key is looked at as a whole
    keys = found.groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1")
    keys = cut(keys.select(F.col("id").alias("key_id"), F.col("digest").alias("key_digest"), "kept"))
    marked = boxed(docs).select("doc", digest_of(text_or_empty(of_doc(text_col))).alias("digest"), of_doc(id_col).cast("long").alias("id"))
    met, rest = parted(marked, keys.select(F.col("key_digest").alias("digest"), F.col("key_id").alias("id")), ["digest", "id"])
    joined = met.join(keys, (F.col("digest") == F.col("key_digest")) & F.col("id").eqNullSafe(F.col("key_id")), "left")
    stay = joined.where("kept IS NULL").select("doc")
    once = joined.where("kept").groupBy("id", "digest").agg(F.first("doc").alias("doc")).select("doc")
    out = stay.unionByName(once)
    return unboxed(out if rest is None else rest.select("doc").unionByName(out), docs.columns)
