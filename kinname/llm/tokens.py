"""Tokens of whole texts by the tokenizers and sentencepiece libraries, and a digest cache of their counts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinname.llm.common import MOST_KEYS, Memo, bound_batches, byte_alphabet, claim, cut, few_rows, parted, spread, text_or_empty


#: Letters that lower to one letter each, and ASCII marks but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class PieceEncoder:
    """The ids of whole texts from a .json file whose tokenizer drops white space.

    Such a tokenizer treats every run between white space by itself, so a text's ids are those of
    its runs between spaces and line ends, in order, and most runs recur. The library encodes each
    run; runs of plain letters and marks by their words.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode_one = library.encode
        spec = json.loads(library.to_str())
        # plain letters and the marks after them are separate runs to any such tokenizer, which lowers them
        self.lowers = any(p.get("type") == "Lowercase" for p in spec["normalizer"]["normalizers"])
        self.merge = library.model.tokenize
        self.signs = byte_alphabet()
        self.marks = Memo(self.encode_run, 1_000, "tokens")
        self.ids = Memo(self.encode_piece if self.lowers else self.encode_run, limit, "tokens")

    def encode_run(self, run: str) -> bytes:
        return array("I", self.encode_one(run, add_special_tokens=False).ids).tobytes()

    def encode_piece(self, run: str) -> bytes:
        if run.isascii() and run.isalpha() and run.islower():
            return array("I", [t.id for t in self.merge(run)]).tobytes()
        plain = _PLAIN.fullmatch(run)
        if not plain:
            return self.encode_run(run)
        word = plain[1].lower()
        if word == run:
            return self.encode_word(word)
        return self.ids[word] + self.marks[plain[2]] if plain[2] else self.ids[word]

    def encode_word(self, word: str) -> bytes:
        """One lowered word of plain letters, which is one pretoken: the library's model alone tells its ids."""
        signs = word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.merge(signs)]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids = self.ids
        return [b"".join([ids[run] for run in text.replace("\n", " ").split(" ")]) for text in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


class WholeEncoder:
    """Any other tokenizer: each text goes to its library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids_of = model.encode
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.ids_of = lambda text: library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return array("I", self.ids_of(text)).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def count(self, text: str) -> int:
        return len(self.ids_of(text))


_encoders: dict[str, PieceEncoder | WholeEncoder] = {}


def drops_white_space(path: str) -> bool:
    """Whether the file's tokenizer collapses white space to single spaces and then drops it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    removes = any(c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert") and "[^\\s" in c["pattern"].get("Regex", "") for c in cuts)
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return removes and plain and any(p.get("type") == "Replace" and p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " " for p in parts)


def encoder(path: str) -> PieceEncoder | WholeEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if drops_white_space(path) else WholeEncoder(path)
    return _encoders[path]


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """The content that decides the count: where the tokenizer drops white space, runs of it become one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " ")) if drops_white_space(path) else text


CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


def open_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; a folder that is not there yet has none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, path: str, cache: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text, through a cache of counts by digest.

    cache: a folder that driver and executors share, with rows (tokenizer, content, n_tokens), where
    both are SHA-256 digests. One pass makes the digests; by them alone the distinct misses are found.
    Of the misses, those that one row has are encoded where they are read; only texts that several rows
    have, or whose digest the cache may know, are shuffled, combined before, so each is encoded once.
    Where too many contents recur to broadcast their hashes, all misses are shuffled. The counts are
    appended; then every row joins its count by digest. A lost executor repeats only its own tasks; a
    run that dies before the append has written nothing that counts, and rows that two runs append
    twice are equal and count once.

    A null text is the empty text (0 bytes, 0 tokens); very long texts are encoded whole, as any; a
    null id stays null; repeated rows give repeated results; an empty table gives an empty one; other
    columns are left out.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = text_or_empty(text_col)
    rows = cut(docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(normalised(text, path), 256).alias("content")))
    whole = docs.select(normalised(text, path).alias("text")).select("text", F.sha2("text", 256).alias("content"))
    stored = lambda: open_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    distinct = cut(rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")))
    misses = cut(distinct.join(stored(), "content", "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        encode = encoder(path).encode_batch
        for batch in few_rows(batches):
            n = pa.array([len(x) // 4 for x in encode(batch.column("text").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), batch.column("content"), n], ["tokenizer", "content", "n_tokens"])

    n_misses = misses.count()
    if n_misses <= MOST_KEYS < distinct.count():  # most are known: the few misses are picked out
        met, alone = parted(whole, misses, ["content"])[0], None
    else:
        met, alone = parted(whole, cut(distinct.join(misses.where("n = 1"), "content", "left_anti")), ["content"])
    once = met.groupBy("content").agg(F.first("text").alias("text")).join(misses.select("content"), "content", "left_semi").select("text", "content")
    if n_misses:
        (once if alone is None else spread(alone).unionByName(once)).mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = cut(stored().join(distinct.select("content"), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return rows.join(counts, "content").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
