"""Encoders against their libraries, exactly; round trips; the digest cache."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinname.llm import bpe, common, tokens
from kinname.llm.common import Memo

BYTES, WORDS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"
library = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def want(path, text):
    return library[path].encode(text, add_special_tokens=False).ids


def got(path, text):
    return np.frombuffer((bpe.codec if path == BYTES else tokens.encoder)(path).encode(text), "<u4").tolist()


PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "the", "ing", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'", "1", "23", "!", "　", "\x85", "\x1c", "😀", "aaaaaaa", "ΑΣ", "<|", "--", "ʼ", "́", "İ", "word.", "Word,"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=600, deadline=None)
@given(pieces=st.lists(st.sampled_from(PIECES), max_size=25))
def test_mixed_pieces(path, pieces):
    text = "".join(pieces)
    assert got(path, text) == want(path, text)
    if path == BYTES:
        assert bpe.codec(path).decode(np.array(want(path, text), dtype=np.int64)) == library[path].decode(want(path, text), skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(path, text):
    assert got(path, text) == want(path, text)


def test_all_tokens_and_random_joins():
    code, rng = bpe.codec(BYTES), random.Random(3)
    words = [library[BYTES].decode([i], skip_special_tokens=False) for i in range(0, 50_000, 7)]
    for text in [*words[:2_000], *("".join(rng.choices(words, k=4)) for _ in range(1_500))]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == want(BYTES, text)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000, " " * 9_000, "0" * 900, "\n" * 500])
def test_long_runs(text):
    assert got(BYTES, text) == want(BYTES, text)


def test_decoding_of_any_ids():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50_257, 12)
        text = bpe.codec(BYTES).decode(ids)
        assert isinstance(text, str) and bpe.codec(BYTES).decode_bytes(ids).decode("utf-8", "replace") == text
    assert bpe.codec(BYTES).decode(np.array([-1, 10**6])) == ""


def test_memo_is_bounded():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, limit=10)
    for i in range(1_000):
        assert memo[i] == 2 * i and memo[0] == 0
        assert len(memo) + len(memo.old) <= 20
    assert made.count(0) == 1  # what is used again and again stays


def test_encode_and_decode_tables(spark, odd, nothing):
    ids = bpe.encode(odd, BYTES)
    texts = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=str) == sorted(((i, want(BYTES, t)) for i, t in texts), key=str)
    back = bpe.decode(ids, BYTES).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(texts, key=str)
    for r, t in ((r, dict(texts)[r.doc_id]) for r in back if r.doc_id == 8):
        assert r.ids_sha256 == hashlib.sha256(np.array(want(BYTES, t), "<u4").tobytes()).hexdigest() and r.n_tokens == len(want(BYTES, t))
    assert bpe.encode(nothing, BYTES).count() == bpe.decode(bpe.encode(nothing, BYTES), BYTES).count() == 0
    nulls = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), BYTES).collect()
    assert [(r.n_tokens, r.text) for r in nulls] == [(None, None), (0, "")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_through_the_cache(spark, odd, nothing, tmp_path, name):
    path, cache = f"/opt/tokenizers/{name}", str(tmp_path / "cache")
    count = tokens.WholeEncoder(path).count
    expect = sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 100) for r in odd.select("doc_id", "text").collect()), key=str)
    run = lambda df: sorted((tuple(r) for r in tokens.token_counts(df, path, cache, limit=100).collect()), key=str)
    assert run(odd.where("doc_id < 5")) == [r for r in expect if r[0] is not None and r[0] < 5]
    first = tokens.open_cache(spark, cache).count()
    assert run(odd) == expect
    grown = tokens.open_cache(spark, cache).count()
    assert run(odd) == expect and tokens.open_cache(spark, cache).count() == grown > first  # nothing is encoded again
    assert tokens.open_cache(spark, cache).select("content").distinct().count() == grown
    assert run(nothing) == []


def test_a_stored_count_is_used(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), WORDS
    docs = spark.createDataFrame([(1, "some  words")], "doc_id long, text string")
    spark.createDataFrame([(tokens.tokenizer_digest(path), hashlib.sha256(b"some words").hexdigest(), 99), ("other version", "x", 1)], tokens.CACHE_SCHEMA).write.parquet(cache)
    assert tokens.token_counts(docs, path, cache).first().n_tokens == 99


def test_memos_keep_no_long_keys():
    """Texts without spaces are long keys that never recur: they are encoded and forgotten."""
    path = "/opt/tokenizers/word_bpe_49k.json"
    words, code = tokens.PieceEncoder(path), bpe.Codec("/opt/tokenizers/byte_bpe_50k.json")
    library = [Tokenizer.from_file(f"/opt/tokenizers/{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k")]
    rng = random.Random(3)
    for text in ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(10_000)), "x" * 5_000, "".join(rng.choices("abcXYZ0123+/=", k=20_000)), "word " * 50):
        for encoder, lib in zip((words, code), library, strict=True):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    kept = [k for m in (words.ids, words.marks, code.word, code.first, code.later) for k in (*m, *m.old)]
    assert kept and max(map(len, kept)) <= 64


def test_counts_by_every_way(spark, odd, tmp_path, monkeypatch):
    """The same counts, and one row of the cache for each text, whether keys are broadcast or texts shuffled, with a cold, a partial and a warm cache."""
    path = "/opt/tokenizers/word_bpe_49k.json"
    want = None
    for k, most in enumerate((2_000_000, 6, 0)):
        monkeypatch.setattr(tokens, "MOST_KEYS", most)
        monkeypatch.setattr(common, "MOST_KEYS", most)
        for part in (odd.where("doc_id < 6"), odd, odd):
            got = Counter(tuple(r) for r in tokens.token_counts(part, path, str(tmp_path / f"cache{k}")).collect())
        want = want or got
        assert got == want and sum(got.values()) == odd.count()
        cache = spark.read.parquet(str(tmp_path / f"cache{k}"))
        assert cache.count() == cache.select("content").distinct().count()
