"""The classifier chain, the pipeline's stages, and the registered queries on whole tables."""

import hashlib
import random
from collections import Counter, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from kinname.llm import common, queries, sharding, toxicity
from tests.llm.conftest import make, prose
from tests.llm.test_duplicates import brute_classes, check_firsts, covered, repeated_words
from tests.llm.test_packing import packs
from tests.llm.test_small_operators import check_prints, plain_links

DATA = "/root/testdata/sf0.001"
Span = namedtuple("Span", "id start stop")
Stretch = namedtuple("Stretch", "id start stop kept other")


def labelled(seed, n=1_500):
    """Texts with planted categories: b depends on a and on words of its own; a few labels are wrong."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(10, 80)).split()
        a, b = rng.random() < 0.3, rng.random() < 0.2
        if a:
            words.insert(rng.randrange(len(words)), rng.choice(["Zork,", "blarg.", "ZORK"]))
        if b:
            words += [rng.choice(["vex" + s for s in ("umol", "andor", "itive", "oneer")]) for _ in range(3)]
        rows.append((i, " ".join(words), int(a), int((a and rng.random() < 0.8) or b)))
    return rows


def test_chain_on_held_out_texts(spark):
    rows = labelled(1)
    docs = make(spark, [(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows] + [(1, None, 1), (10**9, 1, 1)], "doc_id long, a int, b int")
    chain = toxicity.train(docs, labels, {"a": F.col("a"), "b": F.col("b")})
    held = labelled(2, 800)
    got = {r.doc_id: r for r in toxicity.score_documents(make(spark, [(i, t) for i, t, _, _ in held]), chain, category="b").collect()}
    assert np.mean([(got[i].p_a >= 0.5) == a for i, _, a, _ in held]) > 0.97
    assert np.mean([got[i].rejected == b for i, _, _, b in held]) > 0.9
    assert chain.weights[1][len(chain.words)] > 0.1  # the earlier category tells on the later one
    assert all(got[i].rejected == (got[i].p_b >= 0.5) for i in got)


def test_chain_edges(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, a int")
    chain = toxicity.train(odd, none, {"a": F.col("a")})
    rows = toxicity.score_documents(odd, chain, category="a").collect()
    assert len(rows) == odd.count() and not any(r.rejected for r in rows)
    one_kind = toxicity.train(odd, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, a int"), {"a": F.col("a")})
    assert toxicity.score_documents(odd, one_kind, category="a").where("NOT rejected").count() == 0
    left = toxicity.without_toxic(odd, chain, category="a")
    assert left.columns == odd.columns and left.count() == odd.count()
    assert toxicity.score_documents(nothing, chain, category="a").count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_toxic_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = entry.queries()["op9_toxicity"](spark, path).withColumnRenamed("toxic", "flagged")
    both = rows.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.flagged for r in both if r.toxic]) > 0.8
    assert np.mean([r.flagged for r in both if not r.toxic]) < 0.02


def test_queries_against_brute_force(spark, corpus):
    run = lambda name: next(f for k, f in entry.queries().items() if k.startswith(f"{name}_"))(spark, DATA).collect()
    texts = {i: t or "" for i, t in corpus}
    lib = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op1")} == {
        (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()}
    words = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    counts = {i: len(words.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run("op4")} == {(i, len(t.encode()), counts[i], counts[i] > 2048) for i, t in texts.items()}
    packed = run("op2")
    assert packs(packed, 2048) <= sum(c + 1 for c in counts.values()) / 2048 * 1.02 + 2
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == {i: c + 1 for i, c in counts.items()}
    firsts = {t: i for i, t in reversed(list(texts.items()))}
    want = repeated_words(texts.values())
    spans = [Span(r.doc_id, r.start_word, r.stop_word) for r in run("op3") if firsts[texts[r.doc_id]] == r.doc_id and want[texts[r.doc_id]].any()]
    assert all((got == want[t]).all() for t, got in covered(spans, [(i, t) for t, i in firsts.items()]).items())
    check_prints(run("op8"), [(i, t) for i, t in texts.items()])
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in run("op10")) == brute_classes(list(texts.items()))
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in run("op6")) == plain_links(vectors)
    assert {r.doc_id for r in run("op7")} == set(texts)
    assert all(r.value_sha256 and 0 <= r.score <= 1 for r in run("op5"))


def test_pipeline(spark, corpus):
    texts = {i: t or "" for i, t in corpus}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, folder = docs.columns, common.shared_dir(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    ids = {k: {r.doc_id for r in d.select("doc_id").collect()} for k, d in seen.items()}
    assert ids["minhash_near_dedup"] == {low for _, low, _ in brute_classes([(i, texts[i]) for i in ids["toxicity"]])}
    after = {r.doc_id: r for r in seen["suffix_array_dedup"].collect()}
    assert set(after) <= ids["minhash_near_dedup"] and all(r.n_chars == len(r.text) or r.text == texts[i] for i, r in after.items())
    assert ids["secret_scans"] == set(after)
    out = entry.queries()["pipeline"](spark, DATA).collect()
    assert {r.doc_id for r in out} == set(after) and packs(out, 2048) <= sum(r.length for r in out) / 2048 * 1.02 + 2
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, nothing, stage):
    last = stage is corpus_pipeline.STAGES[-1][1]
    for table in (odd, nothing):
        out = stage(spark, table, DATA)
        assert last or out.columns == table.columns
        rows = out.collect()
        assert bool(rows) == (table is odd)


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(names) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_training_sample_is_bounded_in_rows(spark, monkeypatch):
    """An id of very many rows sends one of them to the driver, and ids above it are in the sample, too."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, y, groups, names: seen.append((len(rows), y.ravel().tolist())))
    docs = make(spark, [(1, f"text number {k}") for k in range(300)] + [(i, f"document {i}") for i in range(2, 10)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, toxic int")
    toxicity.train(docs, labels, {"toxic": F.col("toxic")}, rows=9)
    assert seen == [(9, [1, 0, 1, 0, 1, 0, 1, 0, 1])]


def test_passages_of_a_whole_table(spark, corpus):
    """All rows and all columns of op3's result: what stays, what goes, and a document that has each stretch that goes."""
    found = [Stretch(r.doc_id, r.start_word, r.stop_word, r.kept, r.first_doc_id) for r in entry.queries()["op3_repeated_passages"](spark, DATA).collect()]
    texts = {i: t or "" for i, t in corpus}
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(texts[i], i)
    own = [(i, t) for t, i in firsts.items()]
    words = repeated_words(firsts)
    shared = {i for i, t in own if words[t].any()}
    # copies of a text go whole, and name the first of them
    for i, t in texts.items():
        if firsts[t] != i:
            n = len(t.split())
            assert [r for r in found if r.id == i] == ([Stretch(i, 0, n, False, firsts[t])] if n >= 50 else [])
    check_firsts([r for r in found if r.id in shared], [x for x in own if x[0] in shared])
    left = [r for r in found if r.id not in shared and firsts[texts[r.id]] == r.id]
    assert all(r.kept and (r.start, r.stop) == (0, len(texts[r.id].split())) and list(texts.values()).count(texts[r.id]) > 1 for r in left)


def test_shards_of_a_whole_table(spark, corpus):
    """Every row's slot by the hash of its id, and its shard by the table that the shards filled."""
    rows = entry.queries()["op7_sharding"](spark, DATA)
    table = sharding.lookup_table([f"shard-{i:04d}" for i in range(256)])
    want = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SLOTS)).alias("at")).collect()
    assert Counter((r.doc_id, r.slot, r.shard) for r in rows.collect()) == Counter((r.doc_id, r["at"], table[r["at"]]) for r in want)
    assert Counter(r.doc_id for r in want) == Counter(i for i, _ in corpus)


def test_contradicting_labels(spark):
    """An id that is labelled twice is in a category if any label says so, whatever the order of rows."""
    docs = make(spark, [(i, f"{'zork ' * 3 if i % 2 else 'calm '} text {i}") for i in range(60)])
    rows = [(i, i % 2) for i in range(60)] + [(i, 0) for i in range(60)]
    got = []
    for order in (rows, rows[::-1]):
        chain = toxicity.train(docs, spark.createDataFrame(order, "doc_id long, toxic int"), {"toxic": F.col("toxic")})
        got.append({r.doc_id: r.p_toxic for r in toxicity.score_documents(docs, chain).collect()})
    assert got[0] == got[1] and all((p > 0.5) == (i % 2 == 1) for i, p in got[0].items())


def test_training_texts_are_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 1_000)
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, y, groups, names: seen.append(len(rows)))
    docs = make(spark, [(i, "word " * 60) for i in range(40)])
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), {"toxic": F.col("toxic")})
    assert seen == [3]


def test_workers_do_without_pandas(spark):
    """Executors count what their workers hold: the operators' modules do not load it."""
    import subprocess
    import sys

    code = "import sys, kinname.llm.queries, corpus_pipeline, kinname.llm.bpe, kinname.llm.embeddings, kinname.llm.tokens; assert 'pandas' not in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0
