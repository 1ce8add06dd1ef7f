"""Sharding, fingerprints, embeddings and secrets against plain versions."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinname.llm import common, embeddings, fingerprints, secrets, sharding
from kinname.llm.common import components
from tests.llm.conftest import make, prose


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 211)
    sizes = Counter(table)
    assert len(table) == 211 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.35 * 211  # most slots stay with their shards
    # by turns: each shard claims its first preferred slot that is free at its turn
    free, turn, owner, steps = set(range(211)), 0, {}, Counter()
    while free:
        start, stride = sharding.preference(shards[turn % 7], 211)
        while (slot := (start + steps[turn % 7] * stride) % 211) not in free:
            steps[turn % 7] += 1
        owner[slot] = turn % 7
        free.remove(slot)
        turn += 1
    assert [owner[i] for i in range(211)] == table
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 210)


def test_place(spark, odd, nothing):
    rows = sharding.place(odd, ["doc_id"], ["a", "b", "c"], slots=211)
    table = sharding.lookup_table(["a", "b", "c"], 211)
    want = odd.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(211)).alias("s")).collect()
    assert Counter((r.doc_id, r.slot, r.shard) for r in rows.collect()) == Counter((r.doc_id, r.s, table[r.s]) for r in want)
    assert sharding.place(nothing, ["doc_id"], ["a"], slots=211).count() == 0


def neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
    return [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)]


def check_prints(rows, docs):
    want = Counter()
    for (i, a), (_, b) in neighbours(docs):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        want[i, len(a), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_fingerprints(spark, odd, nothing):
    docs = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    rows = fingerprints.fingerprints(odd).collect()
    check_prints(rows, docs)
    by = {r.doc_id: r for r in rows}
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0 and by[7].fingerprint
    assert fingerprints.fingerprints(nothing).count() == 0
    one = fingerprints.fingerprints(make(spark, [(3, "alone in here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("ids", [list(range(0, 4_000, 3)), [i * i * 10**6 for i in range(900)], [2**62 - i for i in range(700)], [5] * 300 + [10**15 + i for i in range(300)]])
def test_neighbours_over_many_ranges(spark, ids):
    docs = [(i, f"text {k} of {i}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(docs, "id long, text string")
    got = fingerprints.with_next(df, "id", ["text"], range_rows=16).collect()
    assert Counter((r.id, r.text, r.next_text) for r in got) == Counter((i, a, b) for (i, a), (_, b) in neighbours(docs))


def test_sketch_estimates(spark):
    rng = random.Random(1)
    long = prose(rng, 6_000).split()
    rows = [(1, " ".join(long)), (2, " ".join(long[:1_500])), (3, prose(rng, 1_500)), (4, " ".join(long[3_000:]) + " " + prose(rng, 3_000))]
    df = fingerprints.with_sketch(make(spark, rows), "text", "s").select("doc_id", "s")
    s = {r.doc_id: set(r.s) for r in df.collect()}
    top = -(2**63) + 2**64 // fingerprints.SCALE
    assert all(max(x) < top for x in s.values())
    pair = df.alias("a").join(df.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("o"), fingerprints.containment(F.col("a.s"), F.col("b.s")).alias("c"), fingerprints.merge(F.col("a.s"), F.col("b.s")).alias("m")).collect()
    c = {(r.doc_id, r.o): r.c for r in pair}
    assert c[1, 2] > 0.98 and c[1, 3] < 0.02 and abs(c[1, 4] - 0.5) < 0.12
    assert all(r.m == sorted(s[r.doc_id] | s[r.o]) for r in pair)
    plan = fingerprints.fingerprints(make(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_links(rows, least=0.93):
    good = [(i, v, lab) for i, v, lab in rows]
    unit = []
    for _, v, lab in good:
        a = None if v is None or lab is None or not len(v) or any(x is None for x in v) else np.array(v, float)
        unit.append(a / np.linalg.norm(a) if a is not None and np.isfinite(a).all() and np.linalg.norm(a) > 0 else None)
    n, links, root = len(rows), Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def vectors(rng, n, dim=8, labels=2):
    centres = rng.normal(size=(max(n // 9, 1), dim))
    return [(int(i), (centres[rng.integers(len(centres))] + rng.normal(size=dim) * 0.2).tolist(), int(rng.integers(labels))) for i in rng.permutation(n)]


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 500)
    hot = rows[7][1]
    rows += [(1_000 + i, hot, rows[7][2]) for i in range(200)] + [(2_000, None, 0), (2_001, [0.0] * 8, 0), (2_002, [float("nan")] * 8, 0), (2_003, [None] + [1.0] * 7, 0), (2_004, hot, None), (2_005, [], 0), (2_006, [1.0, 2.0], 0), (2_007, [2.0, 4.0], 0), (2_008, [float("inf")] * 8, 1)]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("k")).withColumn("node", F.lit(1))
    got = lambda r: Counter(tuple(x) for x in embeddings.near_vectors(df(r)).collect())
    assert got(rows) == plain_links(rows)
    # with many small cells and blocks, as in large tables
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    assert got(rows) == plain_links(rows)
    assert embeddings.near_vectors(df(rows).where("false")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1_000 + rng.randrange(200), 1_000 + rng.randrange(200)) for _ in range(90)] + [(5_000, 5_000 + i) for i in range(200)] + [(7, 7), (9_999, 9_999)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.where("false")).count() == 0


def test_secret_forest_on_held_out_findings():
    forest = secrets.train(secrets.made_findings(3_000, seed=5))
    held = secrets.made_findings(1_500, seed=99)
    score = forest.score(np.array([secrets.features(*f[:4]) for f in held]))
    assert ((score >= 0.5) == np.array([f[4] == 1 for f in held])).mean() > 0.95
    assert forest.score(np.zeros((0, 19))).shape == (0,)


def test_secret_scans(spark, odd, nothing):
    forest = secrets.train(secrets.made_findings())
    hexes = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'my token = "{hexes}" here'), (2, f"see commit {hexes} for it"), (3, "card 4845168114407329 and a@mail7.example.com"), (4, f'{"é" * 50} TOKEN = "{hexes.upper()}"'), (5, None), (6, "api_key: your_token_here_123 end"), (7, f'token = "{hexes}" token = "{hexes[::-1]}"')]
    docs = make(spark, rows)
    found = secrets.find_secrets(docs, forest).collect()
    assert {(r.doc_id, r.is_secret) for r in found} >= {(1, True), (2, False), (3, False), (4, True)}
    texts = dict(rows)
    for r in found:
        value = texts[r.doc_id][r.start : r.end]
        assert r.length == len(value) and r.value_sha256 == hashlib.sha256(value.encode()).hexdigest()
    clean = {r.doc_id: r for r in secrets.without_secrets(docs, forest).collect()}
    assert clean[1].text == 'my token = "[secret]" here' and clean[1].n_chars == len(clean[1].text)
    assert clean[7].text == 'token = "[secret]" token = "[secret]"' and clean[2].text == rows[1][1] and clean[5].text is None
    assert secrets.without_secrets(docs, forest).columns == docs.columns and secrets.without_secrets(odd, forest).count() == odd.count()
    assert secrets.find_secrets(nothing, forest).count() == secrets.without_secrets(nothing, forest).count() == 0


def test_candidates_of_all_names_of_secrets():
    """Short values without digits are candidates after every name that the forest knows, and in addresses."""
    value = "tRvb!qLwZ"
    for name in ("key", "secret_key", "private_key", "private-token", "client_secret", "secret-token", "bearer", "credential", "credentials", "password", "api_key"):
        for text in (f"here {name} = {value} end", f'"{name.upper()}": "{value}"'):
            assert [text[a:b] for a, b in secrets.candidates(text)] == [value], text
    for text in (f"Authorization: Bearer {value}", f"see postgres://admin:{value}@host/db", f"redis://:{value}@host:6379"):
        assert [text[a:b] for a, b in secrets.candidates(text)] == [value], text
    assert not secrets.candidates("http://host:8080/a see monkey: banana and 10:30 mail me@host.org")


def test_containment_is_that_of_the_shingles(spark):
    """Short in short and short in long exactly or nearly, whatever the lengths; leading white space adds no word."""
    rng = random.Random(21)
    pieces, rows = [prose(rng, n) for n in (5, 9, 12, 30, 60, 68, 69, 200, 1_500)], []
    for i, piece in enumerate(pieces):
        for j, rest in enumerate((0, 3, 25, 400)):
            rows.append((i * 10 + j, piece, f"\t {prose(rng, rest // 2)} {piece} {prose(rng, rest)}\n", prose(rng, 300)))
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    for name in "abc":
        df = fingerprints.with_sketch(df, name, f"s{name}")
    got = df.select("id", "a", "b", *[fingerprints.containment(F.col(x), F.col(y)).alias(x + y) for x, y in (("sa", "sb"), ("sb", "sa"), ("sa", "sc"), ("sa", "sa"))]).collect()
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for r in got:
        a, b = grams(r.a), grams(r.b)
        true = len(a & b) / min(len(a), len(b))
        assert r.sasb == r.sbsa and r.sasa == 1.0 and r.sasc == 0.0
        short = max(len(a), len(b)) <= fingerprints.SHORT
        # a short text of which no hash is below the threshold is not estimated beside a long one
        assert r.sasb == true == 1.0 or not short and len(a) < 16 and r.sasb == 0.0
    assert sum(r.sasb == 1.0 for r in got) >= len(got) - 4


def plain_print(spark, texts):
    """Sketches by a plain version: Spark hashes each run, Python picks."""
    out = {}
    for t in texts:
        w = t.split()
        runs = [[*w[i : i + 5], *[None] * 5][:5] for i in range(max(len(w) - 4, 1))]
        hashes = [r[0] for r in spark.createDataFrame([tuple(r) for r in runs], "a string, b string, c string, d string, e string").select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
        low = [h for h in hashes if h < -(2**63) + 2**64 // fingerprints.SCALE]
        out[t] = ",".join(map(str, sorted(set(hashes if len(hashes) <= fingerprints.SHORT or not low else low))))
    return out


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(22)
    docs = [(i, prose(rng, n)) for i, n in enumerate((0, 1, 4, 5, 20, 68, 69, 300, 900, 2))] + [(20, "again and " * 100)]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(make(spark, docs)).collect()}
    edited = {a[0]: a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in neighbours(docs)}
    want = plain_print(spark, {*dict(docs).values(), *edited.values()})
    for i, t in docs:
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (want[t], want[edited[i]])


def test_vectors_of_extreme_size(spark):
    """Squares beyond the range of doubles change nothing; -0.0 is 0.0."""
    rows = [(1, [1e-170, 2e-170], 0), (2, [1e180, 2e180], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0), (5, [0.0, 5.0], 0), (6, [-0.0, 7.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_many_cells_in_little_memory():
    """A batch of 384 dimensions over 1,024 cells: no array of cells, cells and dimensions is made."""
    rng = np.random.default_rng(1)
    centres, near = embeddings._unit(rng.normal(size=(1_024, 384))), embeddings._unit(rng.normal(size=(512, 384)))
    tracemalloc.start()
    mine, row, cell = embeddings.visits(near, centres, np.full(1_024, 0.1), 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000 and not len(row)
    assert (mine == (near @ centres.T).argmax(axis=1)).all()
    # a neighbour in a cell of a higher number is never missed
    v = embeddings._unit(centres[mine] + rng.normal(size=near.shape) / np.sqrt(384))
    w = embeddings._unit(v + 0.3 * rng.normal(size=near.shape) / np.sqrt(384))
    homes = (w @ centres.T).argmax(axis=1)
    mine, row, cell = embeddings.visits(v, centres, np.full(1_024, np.pi), 0.93)
    seen, near = set(zip(row.tolist(), cell.tolist(), strict=True)), [i for i in range(512) if v[i] @ w[i] >= 0.93]
    assert near and all((i, homes[i]) in seen for i in near if homes[i] > mine[i])


def test_secrets_of_whole_tables(spark):
    """All rows: every value that is given to a token's name is found, and nothing else."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = entry.queries()["op5_secret_scan"](spark, path).where("is_secret").collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or ""):
            want[r.doc_id, m.start(1), m.end(1)] += 1
    assert want and Counter((r.doc_id, r.start, r.end) for r in found) == want


def test_forms_that_issuers_give():
    for value in ("glpat-AbCdEfGhIjKlMnOpQrSt", "xoxb-AbCdEfGhIjKlMnOp", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2Q", "SG.abcdefghijk.lmnopqrstuvwx"):
        assert secrets.candidates(f"see {value} here") == [(4, 4 + len(value))], value


def test_forest_on_kinds_that_it_has_not_seen():
    for kind in ("hex 40", "issued", "letters", "password", "address", "signed", "uuid", "number", "commit"):
        forest = secrets.train(secrets.made_findings(1_500, seed=5, without=[kind]))
        ours = kind in secrets.SECRET_KINDS
        held = [f for f in secrets.made_findings(300, seed=99, without=[k for k in (secrets.SECRET_KINDS if ours else secrets.OTHER_KINDS) if k != kind]) if f[4] == ours]
        score = forest.score(np.array([secrets.features(*f[:4]) for f in held]))
        assert ((score >= 0.5) == ours).mean() > 0.9, kind


def test_large_training_tables_are_sampled_at_random(monkeypatch):
    seen = []
    monkeypatch.setattr(secrets, "TRAIN_ROWS", 100)
    monkeypatch.setattr(secrets, "fit_forest", lambda x, y: seen.append(y))
    findings = [("a" * 20, "", "", "", 0)] * 500 + [("b" * 20, "", "", "", 1)] * 500
    secrets.train(findings)
    assert len(seen[0]) == 100 and 30 < seen[0].sum() < 70


def test_parted(spark, monkeypatch):
    rows = spark.range(100).selectExpr("id", "cast(id % 10 as string) AS k")
    keys = spark.createDataFrame([("3",), ("7",)], "k string")
    met, rest = common.parted(rows, keys, ["k"])
    assert {r.k for r in met.collect()} == {"3", "7"} and rest.count() == 80 and rest.columns == rows.columns
    monkeypatch.setattr(common, "MOST_KEYS", 1)
    met, rest = common.parted(rows, keys, ["k"])
    assert rest is None and met.count() == 100
