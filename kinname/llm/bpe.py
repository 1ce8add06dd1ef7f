"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A pretoken is first cut greedily at its longest vocabulary matches (one Aho-Corasick pass). A cut is
the exact result of the merges if and only if every two neighbouring tokens are compatible, that is,
the merges would not join anything across their border. Where a pair is not, the encoder backtracks:
it tries shorter matches, and marks positions from which nothing fits, so each position is settled
once and time stays linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kinname.llm.common import Memo, bound_batches, byte_alphabet, claim, few_rows, spread, text_or_empty

_NEVER = 1 << 60
#: A space that starts a pretoken whatever stands around: neither neighbour is white space.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a space; only in texts without any may every space be taken as a border.
_RUN = re.compile(r" \s|[^\S ] ")
#: The commonest pieces, which the library would cut just so: ASCII letters, then marks.
_PLAIN = re.compile(r"([A-Za-z]+)([.,!?;:]*)")


class PairTable:
    """Whether two tokens may stand side by side; answers are kept."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.split = {a + b: (a, b) for a, b in reversed(merges)}
        self.merge = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.known = Memo(lambda pair: self.apart(*pair), 400_000, "bpe")

    def apart(self, left: str, right: str, until: int = _NEVER) -> bool:
        """Undoes the later merge of the facing ends, again and again. At no time may the parts that
        face each other have a merge that comes before the merge that consumed one of them; of equal
        merges the left one comes first. until: the merge that consumes both."""
        rank, left_end, right_end = self.rank, until, until
        while True:
            m = self.merge.get((left, right))
            if m is not None and m < left_end and m <= right_end:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left > of_right:
                left, left_end = self.split[left][1], of_left
            elif of_right >= 0:
                right, right_end = self.split[right][0], of_right
            else:
                return True


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_str(json.dumps(spec))
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        vocab, self.special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = PairTable(merges)
        self.ids = vocab
        auto = ahocorasick.Automaton()
        for token in vocab:
            # a token that its own bytes do not merge to is never the result of an encoding
            if token not in self.pairs.split or self.pairs.apart(*self.pairs.split[token], until=self.pairs.rank[token]):
                if token in self.pairs.split or len(token) == 1:
                    auto.add_word(token, token)
        auto.make_automaton()
        self.auto = auto
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = Memo(self.encode_word, 150_000, "bpe")
        self.first = Memo(self.encode_piece, 20_000, "bpe")
        self.later = Memo(self.encode_later, 250_000, "bpe")
        self._table(vocab)

    def _table(self, vocab: dict[str, int]) -> None:
        """The bytes of all tokens in one array; token i lies at offset[i], size[i] bytes long."""
        byte = {sign: b for b, sign in byte_alphabet().items()}
        top = max([*vocab.values(), *self.special.values()]) + 1
        texts = [b""] * top
        for token, i in [*vocab.items(), *self.special.items()]:
            texts[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.size = np.array([len(x) for x in texts], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def encode_word(self, word: str) -> bytes:
        """The ids of one pretoken, given in the byte alphabet, as little-endian unsigned 32-bit integers."""
        tokens = [token for _, token in self.auto.iter_long(word)]
        if not all(map(self.pairs.known.__getitem__, zip(tokens, tokens[1:]))):
            tokens = self.backtrack(word)
        return array("I", [self.ids[t] for t in tokens]).tobytes()

    def backtrack(self, word: str) -> list[str]:
        n, known = len(word), self.pairs.known
        at: list[list[str]] = [[] for _ in range(n)]
        for end, token in self.auto.iter(word):
            at[end + 1 - len(token)].append(token)  # by length, as ends only grow
        fits, tokens, chosen, pos, k = [True] * (n + 1), [], [], 0, len(at[0]) - 1
        while pos < n:
            here = at[pos]
            while k >= 0 and not (fits[pos + len(here[k])] and (not tokens or known[tokens[-1], here[k]])):
                k -= 1
            if k >= 0:
                tokens.append(here[k])
                chosen.append(k)
                pos += len(here[k])
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                fits[pos] = False
                pos -= len(tokens.pop())
                k = chosen.pop() - 1
        return tokens

    def encode_piece(self, piece: str) -> bytes:
        word = self.word
        return b"".join([word[w] for w, _ in self.pieces(piece)])

    def encode_later(self, piece: str) -> bytes:
        """A piece that a space goes before."""
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.encode_piece(" " + piece)
        ids = self.word["Ġ" + plain[1]]  # the space's sign in the byte alphabet
        return ids + self.word[plain[2]] if plain[2] else ids

    def encode_plain(self, text: str) -> bytes:
        first, *rest = text.split(" ") if not _RUN.search(text) else _BORDER.split(text)
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; the strings of special tokens in it get their ids, as the library does by default."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self.encode_plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if i % 2 else self.encode_plain(x) for i, x in enumerate(self.cut_special.split(text)) if x)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        start = np.cumsum(size) - size
        return self.blob[np.repeat(self.offset[ids] - start, size) + np.arange(int(size.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters. Ids the vocabulary lacks are left out."""
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_bytes(ids[(ids >= 0) & (ids < len(self.size))]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker; its memos serve all tasks of the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text, as the tokenizers library encodes it without added tokens.

    path: a byte-level BPE file that every executor has. One narrow pass, no shuffle; long texts and
    hot keys only cost their length. A null text is the empty text and gives no ids; a null id stays
    null; repeated rows give repeated results; an empty table gives an empty one; other columns are
    left out, whatever their names.
    """
    bound_batches(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")))
    kind = source.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        code = codec(path)
        for batch in few_rows(batches):
            found = [code.encode(x) for x in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), ids)], [id_col, "ids"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, text) of token lists, by gathering from an offset table.

    Null token lists give nulls, a null id stays null, repeated rows are decoded each, an empty table gives
    an empty one; other columns are left out. An empty list gives the empty text; ids that the vocabulary
    lacks count and are digested but add no text. The digest is of the ids as little-endian unsigned 32-bit integers.
    """
    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in few_rows(batches):
            texts, digests, counts = [], [], []
            for x in batch.column("ids"):
                ids = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<u4")
                counts.append(None if ids is None else len(ids))
                digests.append(None if ids is None else hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(None if ids is None else code.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids_sha256", "text"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("text", T.StringType())]))
