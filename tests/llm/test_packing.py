"""Packing: against the optimum of small instances, and the contract of packed tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinname.llm import packing
from kinname.llm.tokens import encoder

WORDS = "/opt/tokenizers/word_bpe_49k.json"


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_the_optimum(seed):
    rng, worse = random.Random(seed), 0
    for _ in range(300):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        counts = Counter(items)
        fixed = packing.reduce_by_dominance(rest := dict(counts), capacity)
        best = optimum(items, capacity)
        assert sum(n for _, n in fixed) + optimum(list(Counter(rest).elements()), capacity) == best
        packed = packing.pack_lengths(dict(counts), capacity)
        got = Counter()
        for pattern, times in packed:
            assert times > 0 and sum(a * b for a, b in pattern) <= capacity
            for a, b in pattern:
                got[a] += b * times
        assert got == counts
        worse += sum(n for _, n in packed) > best
    assert worse <= 6


def test_many_lengths_stay_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6, 1, 200_000), 1, 2048).astype(int)
    packed = packing.pack_lengths(Counter(lengths.tolist()), 2048)
    table, bins = packing.slots(packed)
    assert bins <= lengths.sum() / 2048 * 1.01 + 1 and len(table) < 400_000


def packs(rows, capacity):
    """Checks places; returns the number of sequences."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_documents(spark, odd, nothing):
    encode = encoder(WORDS).encode
    for capacity in (64, 2048):
        rows = packing.pack_documents(odd, WORDS, capacity=capacity).collect()
        want = Counter()
        for r in odd.select("doc_id", "text").collect():
            ids = encode(r.text or "") + b"\0\0\0\0"
            for p in range(0, len(ids), capacity * 4):
                part = ids[p : p + capacity * 4]
                want[r.doc_id, p // (capacity * 4), p // 4, len(part) // 4, zlib.crc32(part)] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        total = sum(r.length for r in rows)
        assert packs(rows, capacity) <= -(-total // capacity) + 2
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_hot_length_in_buckets(spark):
    items = spark.range(5_000).selectExpr("id", "if(id < 4000, 700, 1 + id % 2048) AS length")
    rows = packing.pack(items, bucket_rows=100).collect()
    assert len(rows) == 5_000 and len({(r.sequence_id, r.offset) for r in rows}) == 5_000
    counts = Counter(r.length for r in rows)
    assert packs(rows, 2048) == sum(n for _, n in packing.pack_lengths(dict(counts), 2048))


def test_ids_come_along(spark, odd):
    rows = packing.pieces(odd, WORDS, capacity=2048, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
