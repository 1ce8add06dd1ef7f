"""Passages that repeat across documents, by a sparse suffix array.

A passage is a run of PASSAGE words. Each has one minimiser: of the WINDOW runs of RUN words in it, the
one with the least hash. The content alone selects it, so equal passages have it at the same place, and
only suffixes at minimisers are kept. The passages of one minimiser follow each other and make its place;
places with equal passages are one kind and one suffix. Places whose run of RUN words no other document
has are dropped at once. Of a run that has one kind only, the kind tells all. The suffixes of all others
are sorted and their neighbours compared, extended to the right in one order and to the left in another
(see suffixes.py): passages are equal where both sides are in one stretch. So it is known of each passage
of each document which document is the first that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import bound_batches, boxed, claim, cut, digest_of, few_rows, of_doc, parted, spread, text_or_empty, unboxed
from kinname.llm.shingles import mix, run_hashes, word_hashes
from kinname.llm.suffixes import named_passages

#: Words of a passage, of a run, and runs of a window: every passage of PASSAGE words has a minimiser.
PASSAGE, RUN = 50, 20
WINDOW = PASSAGE - RUN + 1
#: Rows of one key from which on its partners are sent to them by broadcast, and keys that are broadcast at most.
GROUP, MOST_HOT = 1_000, 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(runs: np.ndarray) -> np.ndarray:
    """The position of each passage's minimiser, from the hashes of a text's runs."""
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).argmin(axis=1)
    return least + np.arange(len(least))


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers, and the hashes of their runs; none in fewer than PASSAGE words."""
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(hashes, RUN)
    at = np.unique(_windows(runs))
    return at, runs[at]


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each minimiser the hash of its run, its kind, its first passage and how many passages it has; and the hashes of all passages."""
    if len(hashes) < PASSAGE:
        return *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64)
    runs = run_hashes(hashes, RUN)
    at, start, count = np.unique(_windows(runs), return_index=True, return_counts=True)
    n = len(hashes) - PASSAGE + 1
    # three runs cover a passage
    passages = mix(mix(mix(runs[:n]) * _STEP + runs[RUN : RUN + n]) * _STEP + runs[PASSAGE - RUN :])
    # a place has fewer passages than a passage has words, so the first and the last one cover it
    kinds = mix(mix(passages[start] * _STEP + passages[start + count - 1]) * _STEP + count.astype(np.uint64))
    return runs[at], kinds, start, count, passages


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([x.view(np.int64) for x in parts], pa.list_(kind))


def _anchors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))).withColumn("digest", digest_of(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in few_rows(batches):
            words, found = [], []
            for text in batch.column("text").to_pylist():
                hashes = word_hashes(text.split())
                words.append(len(hashes))
                found.append(places(hashes)[:4])
            lists = [_lists([f[i] for f in found], pa.int64() if i < 2 else pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(words, pa.int32()), *lists], ["id", "digest", "words", "run", "kind", "start", "count"])

    return source.mapInArrow(run, "id long, digest binary, words int, run array<long>, kind array<long>, start array<int>, count array<int>").withColumn("row", F.monotonically_increasing_id())


def _suffixes(texts: DataFrame) -> DataFrame:
    """From (text, first, id, kinds): each kind's run with the words around it that its passages have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in few_rows(batches):
            own: list = []
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist(), strict=True)):
                hashes = word_hashes(text.split())
                at, kind, start, count = minimisers(hashes)[0], *places(hashes)[1:4]
                lasts = {k["kind"]: k["last"] for k in wanted}
                each, place = np.unique(kind.view(np.int64), return_index=True)
                words = hashes.view(np.int64)
                for k, p in zip(each.tolist(), place, strict=True):
                    if k in lasts:
                        own.append(i)
                        end = start[p] + count[p] - 1 + PASSAGE
                        run_of = run_hashes(hashes[at[p] : at[p] + RUN], RUN).view(np.int64)[0]
                        for column, value in zip(out, (run_of, k, lasts[k], count[p], words[start[p] : at[p]][::-1], words[at[p] + RUN : end]), strict=True):
                            column.append(value)
            first, last = (batch.column(c).take(pa.array(own, pa.int64())) for c in ("first", "id"))
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), first, last, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), _lists(out[4], pa.int64()), _lists(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["run", "kind", "first", "id", "last", "count", "before", "after"])

    return texts.mapInArrow(run, "run long, kind long, first long, id long, last long, count int, before array<long>, after array<long>")


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``table``, which has each key once and in n how many rows it has about.

    Keys of more than GROUP rows, the MOST_HOT largest of them, are broadcast, so their rows stay where they are.
    """
    hot = cut(table.where(F.col("n") > GROUP).orderBy(F.desc("n"), *keys).limit(MOST_HOT))
    if hot.isEmpty():
        return rows.join(table.drop("n"), keys)
    names = F.broadcast(hot.select(keys))
    cold = rows.join(names, keys, "left_anti").join(table.join(names, keys, "left_anti").drop("n"), keys)
    return rows.join(F.broadcast(hot.drop("n")), keys).unionByName(cold)


def _stretches(node: int, words: int, copied: bool, found: list) -> list[dict]:
    """The stretches of one document, apart and in order, from its places and the first documents of their passages.

    Words of passages that the document is the first to have stay, so that every passage is whole in its
    first document; of the other words of found passages each goes with a document that has it.
    """
    own, gone = [], []
    for place in found if found is not None else ():
        for part in place["parts"]:
            bits = [part["mask"] >> j & 1 for j in range(place["count"])]
            edges = np.flatnonzero(np.diff([0, *bits, 0])) + place["start"]
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if part["first"] == node:
                    own.append((a, b + PASSAGE - 1))
                else:
                    gone.append((a, b + PASSAGE - 1, part["first"], part["id"]))
    stay: list[list] = []
    for a, b in sorted(own):
        if stay and a <= stay[-1][1]:
            stay[-1][1] = max(stay[-1][1], b)
        else:
            stay.append([a, b])
    go: list[list] = []
    for a, b, first, other in sorted(gone, key=lambda g: g[:3]):
        if go and a <= go[-1][1] and first == go[-1][2]:
            go[-1][1] = max(go[-1][1], b)
        elif not go or b > go[-1][1]:
            go.append([max(a, go[-1][1]) if go else a, b, first, other])
    rows, at = [], 0
    for a, b, first, other in go:
        while at < len(stay) and stay[at][1] <= a:
            at += 1
        k = at
        while a < b:
            x, y = stay[k] if k < len(stay) else (b, b)
            if x > a:
                rows.append({"start": a, "stop": min(x, b), "kept": False, "first": first, "other": other})
            a, k = max(a, y), k + 1
    if copied and found is None:  # only its copies share words with it
        stay = [[0, words]]
    rows += [{"start": a, "stop": b, "kept": True, "first": node, "other": None} for a, b in stay]
    return sorted(rows, key=lambda r: r["start"])


_STRETCHES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kept", pa.bool_()), ("first", pa.int64()), ("other", pa.int64())]))


def _merged(node: pa.Array, words: pa.Array, copied: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([_stretches(*x) for x in zip(*(c.to_pylist() for c in (node, words, copied, found)), strict=True)], _STRETCHES)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, start, stop, kept, other): every word of a run of PASSAGE words that another document has too, in stretches.

    start and stop count words, stop is beyond the last; kept marks words of a run of which this
    document is the first, that of the least id: they stay, so each repeated run stays whole in its
    first document. Each other stretch is one whose words the document with the id other has; it can
    be shorter than PASSAGE words, where the words beside it stay or are found in yet another document.
    digest is the text's SHA-256.

    Rows of equal texts are one document from the start, and its copies' whole texts are stretches if
    they have PASSAGE words; of the first of them, those that it shares with other texts, if there are any. Documents, kinds and passages are grouped by aggregation alone, combined
    before each shuffle, so no task holds a group, however many documents share a run; nothing is
    dropped or thinned.

    A null text is the empty text; texts of fewer than PASSAGE words have no stretches; a passage that
    repeats within one document only is left alone; rows that share an id but not a text are different
    documents, null ids come after all others; very long texts are read whole; other columns are left out; an empty
    table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    scanned = cut(_anchors(docs, id_col, text_col))
    keyed = F.struct(F.col("id").isNull().alias("none"), "id", "row", "words", "run", "kind", "start", "count")
    nodes = scanned.groupBy("digest").agg(F.min(keyed).alias("of"), F.count(F.lit(1)).alias("copies")).select("digest", "of.*", (F.col("copies") > 1).alias("copied"))
    # nodes are numbered by id, so the least node of a group is its first document and has its least id
    nodes = cut(nodes.orderBy("none", "id", "row").withColumn("node", F.monotonically_increasing_id()))
    each = nodes.select("node", "id", F.explode(F.arrays_zip("run", "kind", "start", "count")).alias("p")).select("node", "id", "p.*")
    shared = cut(each.groupBy("run").agg(F.min("node").alias("low"), F.max("node").alias("high"), (F.min("kind") < F.max("kind")).alias("mixed"), F.count(F.lit(1)).alias("n")).where("low < high").select("run", "mixed", "n"))
    members = cut(_met(each, shared, ["run"]))
    kinds = cut(members.groupBy("run", "kind").agg(F.min("node").alias("first"), F.min("id").alias("id"), F.max("node").alias("last"), F.first("mixed").alias("mixed"), F.count(F.lit(1)).alias("n")))

    # runs of several kinds: each kind is a suffix, with the words around it from the kind's first document
    wanted = kinds.where("mixed").groupBy(F.col("first").alias("node")).agg(F.collect_list(F.struct("kind", "last")).alias("kinds"))
    wanted = cut(wanted.join(nodes.select("node", F.col("digest").alias("_digest"), F.col("id").alias("_id")), "node"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest_of(F.col("text")))
    text, _ = parted(text, wanted.select(F.col("_digest").alias("digest"), F.col("_id").alias("id")), ["digest", "id"])
    text = text.join(wanted, (text.digest == wanted["_digest"]) & text.id.eqNullSafe(wanted["_id"])).select("text", F.col("node").alias("first"), "id", "kinds")
    passages = named_passages(cut(_suffixes(text)), PASSAGE - RUN)
    name = ["level", "left_name", "right_name"]
    firsts = cut(passages.groupBy(*name).agg(F.min("first").alias("first"), F.min("id").alias("id"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"))
    parts = _met(passages.select("run", "kind", "at", *name), firsts, name)
    parts = parts.groupBy("run", "kind", "first", "id").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    part = F.struct("first", "id", "mask")
    parts = parts.groupBy("run", "kind").agg(F.collect_list(part).alias("parts")).join(kinds.select("run", "kind", "n"), ["run", "kind"])
    single = kinds.where("NOT mixed AND first < last").withColumn("mask", F.lit(-1).cast("long")).select("run", "kind", F.array(part).alias("parts"), "n")
    spans = _met(members.drop("id", "mixed"), cut(parts.unionByName(single)), ["run", "kind"])

    merge = F.arrow_udf(_merged, "array<struct<start:int,stop:int,kept:boolean,first:long,other:long>>")
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", "count", "parts")).alias("found"))
    spans = nodes.select("node", "id", "digest", "row", "words", "copied").join(spans, "node", "left").where(f"found IS NOT NULL OR copied AND words >= {PASSAGE}")
    of_first = spans.select("id", "digest", "row", F.explode(merge("node", "words", "copied", "found")).alias("s"))
    of_first = of_first.select("id", "digest", "s.start", "s.stop", "s.kept", F.when(F.col("s.kept"), F.col("id")).otherwise(F.col("s.other")).alias("other"), "row")

    copies = nodes.where(f"copied AND words >= {PASSAGE}").select("digest", F.col("id").alias("other"), F.col("row").alias("first"))
    later = scanned.join(copies, "digest").where("row != first").select("id", "digest", F.lit(0).alias("start"), F.col("words").alias("stop"), F.lit(False).alias("kept"), "other", "row")
    return of_first.unionByName(later)


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; the white space before a word goes with it."""

    def one(t: str, gone: list | None) -> str:
        if not gone:
            return t
        ends = [0, *(m.end() for m in re.finditer(r"\S+", t))]
        parts, at = [], 0
        for s in sorted(gone, key=lambda s: s["start"]):
            parts.append(t[at : ends[s["start"]]])
            at = ends[s["stop"]]
        return "".join([*parts, t[at:]])

    return pa.array([one(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the later copies of repeated passages; documents of which nothing is left go.

    All columns stay; chars_col, if the table has it, is counted anew for changed texts. Rows that are
    equal in id and text count as copies of each other like any others; null and empty texts stay as
    they are; an empty table gives an empty one. Only rows that share id and text with one that is cut
    are shuffled, as long as those are few enough for a broadcast of their hashes.
    """
    bound_batches(docs.sparkSession)
    found = cut(repeated_passages(docs, id_col=id_col, text_col=text_col).select("id", "digest", "row", "start", "stop", "kept"))
    gone = found.where("NOT kept").groupBy("id", "digest", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # equal rows cannot be told apart: of rows equal in id and text all get what the first of them gets
    cutting = cut(gone.groupBy(F.col("id").alias("key_id"), F.col("digest").alias("key_digest")).agg(F.min_by("spans", "row").alias("spans")))
    marked = boxed(docs).select("doc", digest_of(text_or_empty(of_doc(text_col))).alias("digest"), of_doc(id_col).cast("long").alias("id"))
    met, rest = parted(marked, cutting.select(F.col("key_digest").alias("digest"), F.col("key_id").alias("id")), ["digest", "id"])
    joined = met.join(cutting, (F.col("digest") == F.col("key_digest")) & F.col("id").eqNullSafe(F.col("key_id")), "left")
    changed = F.col("spans").isNotNull()
    out = joined.withColumn("new", F.when(changed, F.arrow_udf(_without, "string")(text_or_empty(of_doc(text_col)), F.col("spans"))))
    out = out.where(~changed | F.col("new").rlike(r"\S"))
    new = {text_col: F.when(changed, F.col("new")).otherwise(of_doc(text_col))}
    if chars_col and chars_col in docs.columns:
        new[chars_col] = F.when(changed, F.length("new")).otherwise(of_doc(chars_col)).cast(docs.schema[chars_col].dataType)
    out = unboxed(out, docs.columns, new)
    return out if rest is None else unboxed(rest, docs.columns).unionByName(out)
