"""Names of stretches in both suffix orders against plain comparison."""

import random

import numpy as np
import pytest

from kinname.llm import suffixes

SCHEMA = "run long, kind long, first long, id long, last long, count int, before array<long>, after array<long>"


def made(rng, n, reach, signs):
    rows = []
    for k in range(n):
        front = rng.randint(0, reach)
        count = rng.randint(1, front + 1)
        words = lambda size: [rng.choice(signs) for _ in range(size)]
        rows.append((rng.choice([-5, 7, 7, 7]), k, k, k, k, count, words(front), words(reach - front + count - 1)))
    return rows


@pytest.mark.parametrize(("partitions", "signs"), [(1, [0, 1]), (7, [0, 1]), (23, [0, 1, -3]), (40, [4])])
def test_names_against_plain_comparison(spark, partitions, signs):
    """Stretches over many ranges, ranges of one row and runs that all rows share: names are equal just where the words are."""
    reach, rows = 6, made(random.Random(partitions), 300, 6, signs)
    rows += [(7, 300 + i, 0, 0, 0, 7, [0] * 6, [0] * 6) for i in range(60)]  # equal rows fill whole ranges
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = suffixes.named_passages(spark.createDataFrame(rows, SCHEMA), reach).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    of = {r[1]: r for r in rows}
    assert len(found) == sum(r[5] for r in rows)
    names, words = {}, {}
    for r in found:
        run, _, _, _, _, _, before, after = of[r.kind]
        assert r.level == len(before) - r.at
        told = (run, tuple(before[: r.level]), tuple(after[: reach - r.level]))
        name = (r.level, r.left_name, r.right_name)
        assert names.setdefault(told, name) == name and words.setdefault(name, told) == told


def test_an_empty_table(spark):
    assert suffixes.named_passages(spark.createDataFrame([], SCHEMA), 30).count() == 0


def test_shared_beginnings():
    words = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 0], [1, 0, 0], [1, 0, 0]])
    assert suffixes.shared_beginnings(np.array([1, 1, 1, 1, 2]), words, np.array([3, 3, 2, 2, 2])).tolist() == [2, 2, 1, -1]
