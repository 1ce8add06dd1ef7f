"""Conversations as prefix trees: turns that several of them start with are emitted once, depth first.

A turn is formatted with its role, escaped so that no control string is left in it, and encoded. A node of a tree
is a turn after certain turns, known by a chain of digests. Conversations are sorted by their chains, so those
that share first turns follow each other and depth-first order is the order of the sorted conversations: each
emits the turns that its predecessor has not. Offsets are running sums over ranges of that order, so no
task sees a whole tree, however many conversations one first turn has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinname.llm.bpe import codec
from kinname.llm.common import bound_batches, claim, cut, few_rows, spread, text_or_empty

OPEN, SAYS, END = "<|", "|>\n", "<|end|>\n"
#: The role whose texts are trained on.
LEARNT = "assistant"
#: Control strings of usual templates; texts hold none of them once they are escaped.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = "|".join(f"{re.escape(first)}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)})" for first in dict.fromkeys(c[0] for c in CONTROLS))


def escaped(text: Column) -> Column:
    r"""Backslashes doubled, and one put behind the first sign of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def with_conversation(turns: DataFrame, conv_id: int, said: Sequence[tuple[str, str]]) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) and one more conversation, of (role, text) in order."""
    own = turns.select("conv_id", "turn", "role", "text")
    more = turns.sparkSession.createDataFrame([(conv_id, i, role, text) for i, (role, text) in enumerate(said)], "conv_id long, turn long, role string, text string")
    return own.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in own.schema]))


def _encoded(turns: DataFrame, path: str) -> DataFrame:
    """(row, conv_id, turn, role, digest, ids, n, low, high): each turn formatted and encoded; low to high are the tokens to learn. Written."""
    bound_batches(turns.sparkSession)
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    source = spread(turns.select("conv_id", "turn", role.alias("role"), digest.alias("digest"), escaped(role).alias("opened"), escaped(text).alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        code = codec(path)
        end = code.encode(END)
        for batch in few_rows(batches):
            ids, low, high = [], [], []
            for of, opened, body in zip(*(batch.column(c).to_pylist() for c in ("role", "opened", "body")), strict=True):
                before, said = code.encode(OPEN + opened + SAYS), code.encode(body)  # parts of their own, so that the mask is exact
                ids.append(before + said + end)
                low.append(len(before) // 4 if of == LEARNT else 0)
                high.append(low[-1] + (len(said) // 4 if of == LEARNT else 0))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))
            kept = [batch.column(c) for c in ("conv_id", "turn", "role", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(np.diff(ends)), pa.array(low, pa.int32()), pa.array(high, pa.int32())], list(schema.names))

    schema = T.StructType([*source.schema.fields[:4], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.IntegerType()) for c in ("n", "low", "high")]])
    return cut(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _chains(turns: DataFrame) -> DataFrame:
    """(conv_id, rows, path, at): a conversation's rows in order, the digests of its first k turns together, the tokens before each turn and in all."""
    order = F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "digest", "row", "n")))
    lists = turns.groupBy("conv_id").agg(order.alias("t")).select("conv_id", F.col("t.row").alias("rows"), F.col("t.digest").alias("digests"), F.col("t.n").alias("ns"))
    schema = T.StructType([lists.schema["conv_id"], *[T.StructField(c, T.ArrayType(k)) for c, k in (("rows", T.LongType()), ("path", T.BinaryType()), ("at", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1_024):
            paths = []
            for digests in batch.column("digests").to_pylist():
                last, path = b"", []
                for digest in digests:
                    last = hashlib.blake2b(last + digest, digest_size=16).digest()
                    path.append(last)
                paths.append(path)
            at = [[0, *np.cumsum(ns).tolist()] for ns in batch.column("ns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("rows"), pa.array(paths, pa.list_(pa.binary())), pa.array(at, pa.list_(pa.int64()))], ["conv_id", "rows", "path", "at"])

    return lists.mapInArrow(run, schema)


def _placed(chains: DataFrame) -> DataFrame:
    """``chains`` with tree_id, shared (turns that an earlier conversation emits) and start, the offset of its first own token in the tree.

    What goes across ranges is one row a range; those rows alone are in one task.
    """
    dealt = chains.repartitionByRange("path", "conv_id").withColumn("pid", F.spark_partition_id())
    order = W.partitionBy("pid").orderBy("path", "conv_id", "rows")
    common = lambda a, b: F.size(F.array_intersect(a, b))  # noqa: E731  (digests of a chain differ, and are equal from the first turn on)
    sorted_ = cut(dealt.withColumn("shared", common(F.col("path"), F.lag("path").over(order))))
    ranges = sorted_.groupBy("pid").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    across = W.orderBy("pid")
    heads = cut(ranges.select("pid", F.coalesce(common(F.col("first"), F.lag("last").over(across)), F.lit(0)).alias("head")))
    known = sorted_.join(F.broadcast(heads), "pid").withColumn("shared", F.coalesce("shared", "head")).drop("head")
    fresh = F.element_at("at", -1) - F.get("at", F.col("shared"))
    before = F.coalesce(F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = known.withColumn("fresh", fresh).withColumn("before", before)
    placed = cut(summed.withColumn("tree", F.max(F.when(F.col("shared") == 0, F.col("before"))).over(order.rowsBetween(W.unboundedPreceding, 0))))
    sums = placed.groupBy("pid").agg(F.sum("fresh").alias("fresh"), F.max("tree").alias("tree"))
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    based = sums.select("pid", F.coalesce(F.sum("fresh").over(earlier), F.lit(0)).alias("base"), "tree")
    bases = cut(based.select("pid", "base", F.last(F.col("base") + F.col("tree"), True).over(earlier).alias("open")))
    whole = placed.join(F.broadcast(bases), "pid")
    start = F.col("base") + F.col("before") - F.coalesce(F.col("base") + F.col("tree"), "open")
    return whole.select("conv_id", "rows", "path", "at", "shared", F.hex(F.get("path", F.lit(0))).alias("tree_id"), start.alias("start"))


def _merged(spans: Column) -> Column:
    """Spans in order, those that follow each other without a gap as one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))
    return F.aggregate(
        spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, s: F.when(last(done)["stop"] == s["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), s["stop"].alias("stop"))))).otherwise(F.concat(done, F.array(s))),
    )


def chat_trees(turns: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Formats conversations, rows (conv_id, turn, role, text), as prefix trees; two tables.

    Nodes: tree_id, start, stop (the turn's offsets in the tree's depth-first sequence of tokens, gapless from 0), depth,
    position (of its first token: the tokens of the turns before it), attends (spans of the sequence that its tokens
    see besides the earlier ones of the turn: its ancestors', neighbouring ones merged), role, ids, learn_start and learn_stop (offsets
    of what is trained on: an assistant's text, without its marks).
    Conversations: conv_id, tree_id, spans: the start and stop of each of its turns, in order.

    path: a byte-level BPE file that every executor has. A conversation's turns are ordered by turn, null last, then by role and
    digest; repeated rows are turns, too. Null roles and texts are empty; rows without conv_id are one conversation; other columns
    play no part; an empty table gives empty ones. Texts are encoded where they are, and tokens are shuffled
    once, to their nodes; trees are laid out by digests and counts. The rows of one conversation meet in one task, without texts.
    """
    rows = _encoded(turns, path)
    placed = cut(_placed(_chains(rows)))
    start = lambda k: F.col("start") + F.get("at", k) - F.get("at", F.col("shared"))
    span = lambda k: F.struct(start(k).alias("start"), start(k + 1).alias("stop"))
    until = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    size, none = F.size("rows"), F.lit(0)
    own = placed.select("*", F.explode(until(F.col("shared"), size)).alias("k")).select(F.get("path", F.col("k")).alias("node"), span(F.col("k")).alias("span"))
    asked = placed.select("conv_id", "path", F.explode(until(none, F.col("shared"))).alias("k")).select("conv_id", "k", F.get("path", F.col("k")).alias("node"))
    found = asked.join(own, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "span"))).alias("f")).select(F.col("conv_id").alias("_conv"), F.col("f.span").alias("above"))
    above = F.coalesce("above", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    laid = cut(placed.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn("above", above).withColumn("seen", _merged(F.col("above"))))
    conversations = laid.select("conv_id", "tree_id", F.concat("above", F.transform(until(F.col("shared"), size), span)).alias("spans"))
    each = laid.select("*", F.explode(until(F.col("shared"), size)).alias("k"))
    run = F.array(F.struct(F.col("start"), start(F.col("k")).alias("stop")))
    nodes = each.select(
        F.get("rows", F.col("k")).alias("row"), "tree_id", span(F.col("k")).alias("s"), F.col("k").alias("depth"), F.get("at", F.col("k")).alias("position"),
        F.when(F.col("k") == F.col("shared"), F.col("seen")).otherwise(_merged(F.concat("seen", run))).alias("attends"),
    )
    tokens = rows.select("row", "role", "ids", "low", "high")
    out = nodes.join(tokens, "row").select("tree_id", "s.*", "depth", "position", "attends", "role", "ids", (F.col("s.start") + F.col("low")).alias("learn_start"), (F.col("s.start") + F.col("high")).alias("learn_stop"))
    return out, conversations


def read_back(nodes: DataFrame, conversations: DataFrame, path: str) -> DataFrame:
    """What a training run would read of each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    Nodes are decoded and parsed once; conversations look up their spans among them.
    """
    bound_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in few_rows(batches):
            ids = [x.values.to_numpy() for x in batch.column("ids")]
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            texts = [code.decode(x) for x in ids]
            learnt = [code.decode(x[a:b]) for x, a, b in zip(ids, low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), batch.column("start"), pa.array([len(x) for x in ids], pa.int64()), pa.array(texts, pa.string()), pa.array(learnt, pa.string())], ["tree_id", "start", "n", "text", "learnt"])

    source = nodes.select("tree_id", "start", "ids", (F.col("learn_start") - F.col("start")).alias("low"), (F.col("learn_stop") - F.col("start")).alias("high"))
    read = source.mapInArrow(run, "tree_id string, start long, n long, text string, learnt string")
    role = F.substring_index(F.substring("text", len(OPEN) + 1, 1 << 30), SAYS, 1)
    at = len(OPEN) + len(SAYS) + F.length("role")
    body = F.substring(F.col("text"), at + 1, F.length("text") - at - len(END))
    parsed = read.withColumn("role", role).select(
        "tree_id", "start", "n", F.length("text").cast("long").alias("chars"), unescaped(F.col("learnt")).alias("learnt"),
        F.concat(unescaped(F.col("role")), F.lit("\n"), unescaped(body), F.lit("\n")).alias("turn"),
    )
    asked = conversations.select("conv_id", "tree_id", F.posexplode("spans").alias("k", "s")).select("conv_id", "tree_id", "k", F.col("s.start").alias("start"))
    met = asked.join(parsed, ["tree_id", "start"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "n", "chars", "learnt", "turn"))).alias("t"))
    total = lambda c: F.aggregate(F.col(f"t.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    learnt = F.array_join("t.learnt", "")
    return met.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.array_join("t.turn", ""), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"), total("n").alias("n_tokens"),
    )
