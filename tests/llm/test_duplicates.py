"""Near duplicates and repeated passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinname.llm import near_duplicates as nd
from kinname.llm import repeats
from kinname.llm.shingles import run_hashes, shingles, word_hashes
from tests.llm.conftest import make, prose


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def grams(text):
    w = text.split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_classes(rows, least=0.8):
    """The least id of each row's component, by all pairs."""
    texts = [t or "" for _, t in rows]
    sets, root = [grams(t) for t in texts], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((rows[i][0], low[find(i)], len(ids[find(i)])) for i in range(len(rows)))


def corpus(seed, n=60):
    """Groups of copies that are exact, near, or near to some of the group only, and unlike texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 8, 40, 120, 300]))
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            texts.append(edited(rng, base, rng.choice([0, 1, 1, 2, 6])))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    for n, j in ((300, 0.8), (30, 0.8), (500, 0.4)):
        got = []
        for _ in range(40):
            c = round(2 * n * j / (1 + j))
            pool = rng.integers(0, 2**63, 2 * n - c).astype(np.uint64)
            a, b = nd.signatures([pool[:n], np.concatenate([pool[:c], pool[n:]])])
            got.append((a == b).mean())
        assert abs(np.mean(got) - c / (2 * n - c)) < 0.03
    # weights: a document of one element many times is near one in which it weighs most
    x = np.array([5] * 400 + [6, 7], dtype=np.uint64)
    y = np.array([5] * 400 + [8, 9], dtype=np.uint64)
    heavy, flat = nd.signatures([x, y]), nd.signatures([np.unique(x), np.unique(y)])
    assert (heavy[0] == heavy[1]).mean() > (flat[0] == flat[1]).mean() + 0.2
    assert nd.signatures([]).shape == (0, 125)
    alone = nd.signatures([np.array([3], dtype=np.uint64)])
    assert set(alone[0].tolist()) == {3}
    # a batch gives each document what it gets alone
    docs = [rng.integers(0, 2**63, k).astype(np.uint64) for k in (1, 2, 5, 40, 700)]
    assert (nd.signatures(docs) == np.concatenate([nd.signatures([d]) for d in docs])).all()


def test_block_similarities():
    rng = random.Random(2)
    a, b = ([np.unique(shingles(edited(rng, t, 3))) for t in [prose(random.Random(9), 60)] * 20] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in b] for x in a]
    assert np.allclose(nd.jaccard_blocks(a, b), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    rows = corpus(seed)
    got = nd.near_duplicates(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_a_cloud_near_the_bound(spark, monkeypatch):
    """A group whose pairs are about as similar as the bound: no link may be lost."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(8)
    base = prose(rng, 100)
    rows = list(enumerate([edited(rng, base, rng.randint(0, 4)) for _ in range(150)] + [base] * 50))
    got = nd.near_duplicates(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == brute_classes(rows)


def test_near_duplicate_edges(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = nd.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == brute_classes(rows)
    left = nd.without_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == sum(r.kept for r in got)
    assert [r.text for r in left.where("doc_id = 7").collect()] == ["same row"]
    assert nd.near_duplicates(nothing).count() == nd.without_near_duplicates(nothing).count() == 0


def test_without_near_duplicates(spark):
    rows = corpus(5, 30)
    left = {r.doc_id for r in nd.without_near_duplicates(make(spark, rows)).collect()}
    assert left == {low for _, low, _ in brute_classes(rows)}


def repeated_words(texts, n=repeats.PASSAGE):
    """For each distinct text, which words lie in a run of n words that another text has."""
    texts = list(dict.fromkeys(texts))
    runs = {t: [tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)] for t in texts}
    holders = defaultdict(set)
    for t, rs in runs.items():
        for r in rs:
            holders[r].add(t)
    out = {}
    for t, rs in runs.items():
        hit = np.zeros(len(t.split()), bool)
        for i, r in enumerate(rs):
            if len(holders[r]) > 1:
                hit[i : i + n] = True
        out[t] = hit
    return out


def passages(seed, n=120):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (50, 51, 60, 90, 200, 49)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 120))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            parts += [rng.choice(shared), prose(rng, rng.randint(1, 60))]
        rows.append((i, " ".join(p for p in parts if p)))
    rows += [(n, "filler " * 300), (n + 1, "filler " * 200 + prose(rng, 30))]
    return rows


def covered(found, rows):
    by = defaultdict(list)
    for r in found:
        by[r.id].append(r)
    out = {}
    for i, t in rows:
        hit = np.zeros(len(t.split()), bool)
        for r in by[i]:
            assert 0 <= r.start < r.stop <= len(hit)
            hit[r.start : r.stop] = True
        out[t] = hit
    return out


def test_minimisers_cover_every_passage():
    rng = random.Random(3)
    h = word_hashes(prose(rng, 2_000).split())
    at, runs = repeats.minimisers(h)
    assert (runs == run_hashes(h, repeats.RUN)[at]).all()
    for s in range(len(h) - repeats.PASSAGE + 1):
        assert ((at >= s) & (at + repeats.RUN <= s + repeats.PASSAGE)).any()
    inside = repeats.minimisers(h[100:180])[0] + 100
    assert set(inside) <= set(at) | {x for x in inside if x < 100 + repeats.WINDOW or x > 180 - repeats.PASSAGE}
    assert not len(repeats.minimisers(h[:49])[0])


@pytest.mark.parametrize("group", [1_000, 5])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 5: common runs are dealt out and meet again
    rows = passages(7)
    found = repeats.repeated_passages(make(spark, rows)).collect()
    want, got = repeated_words([t for _, t in rows]), covered(found, rows)
    # dealt-out groups may miss a chance match of a word or two beyond a passage's end, never the passage
    assert all((got[t] == want[t]).all() or group < 1_000 and not (got[t] & ~want[t]).any() and (want[t] & ~got[t]).sum() <= 2 for t in want)
    # what is cut is still there: every word of a repeated run is in a stretch that stays, or its text is a first copy elsewhere
    kept = " ".join(" ".join(dict(rows)[r.id].split()[r.start : r.stop]) for r in found if r.kept)
    rng = random.Random(7)
    for k in (50, 51, 60, 90, 200):
        p = prose(rng, k)
        assert p in kept or not any(p in t for _, t in rows)


def test_without_repeats(spark):
    rng = random.Random(1)
    shared = prose(rng, 70)
    a, b, c = prose(rng, 30), prose(rng, 40), prose(rng, 20)
    rows = [(1, f"{a}\n{shared} {b}"), (2, f"{c} \n {shared}\tend  of it"), (3, shared), (4, b), (5, None), (6, prose(rng, 60)), (7, "lone  words\n")]
    docs = make(spark, rows)
    left = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert 3 not in left  # nothing of it is left
    assert left[1].text == rows[0][1] and left[2].text == f"{c}\tend  of it" and left[2].n_chars == len(left[2].text)
    assert all(left[i].text == dict(rows)[i] for i in (4, 5, 6, 7))
    assert repeats.without_repeats(docs).columns == docs.columns


def test_repeat_edges(spark, odd, nothing):
    found = {(r.id, r.start, r.stop, r.kept, r.other) for r in repeats.repeated_passages(odd).collect()}
    assert {(5, 0, 12_000, True, 5), (6, 0, 12_000, False, 5), (11, 60, 140, True, 11), (12, 0, 80, False, 11)} == found
    left = repeats.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1  # the copy of the long text
    assert repeats.repeated_passages(nothing).count() == repeats.without_repeats(nothing).count() == 0


def first_documents(rows):
    """By brute force: of each run of PASSAGE words that several texts have, the first document; and each document's words that stay and go."""
    n, first, texts, out = repeats.PASSAGE, {}, defaultdict(set), {}
    split = [(i, t.split()) for i, t in sorted(rows)]
    for i, w in split:
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
            texts[tuple(w[k : k + n])].add(i)
    for i, w in split:
        stay, go = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if len(texts[run]) > 1:
                (stay if first[run] == i else go)[k : k + n] = True
        out[i] = stay, go & ~stay
    return {r: i for r, i in first.items() if len(texts[r]) > 1}, out


def check_firsts(found, rows):
    """Each repeated run stays whole in its first document, and each stretch that goes is held by the document it names."""
    first, want = first_documents(rows)
    words = {i: t.split() for i, t in rows}
    for i, (stay, go) in want.items():
        for mask, kept in ((stay, True), (go, False)):
            got = np.zeros(len(mask), int)
            for r in found:
                if r.id == i and r.kept == kept:
                    got[r.start : r.stop] += 1
            assert (got == mask).all(), (i, kept)
    texts = {i: f" {' '.join(w)} " for i, w in words.items()}
    for r in found:
        assert r.kept and r.other == r.id or not r.kept and f" {' '.join(words[r.id][r.start : r.stop])} " in texts[r.other]
    left = {i: [" ".join(words[i])] for i in words}
    for i in words:
        gone, parts, at = sorted((r.start, r.stop) for r in found if r.id == i and not r.kept), [], 0
        for a, b in gone:
            parts.append(words[i][at:a])
            at = b
        left[i] = [" ".join(p) for p in [*parts, words[i][at:]]]
    assert all(any(" ".join(run) in p for p in left[i]) for run, i in first.items())


@pytest.mark.parametrize("group", [1_000, 3])
def test_nested_and_overlapping_passages(spark, monkeypatch, group):
    """Words that only later documents share are not cut with those that the first one has."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(11)
    p, q, o = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    a, b, c = (x.split() for x in (p, q, o))
    fresh = lambda: prose(rng, rng.randint(20, 60))
    rows = [(1, f"{fresh()} {p} {fresh()}")] + [(i, f"{fresh()} {p} {q} {fresh()}") for i in (2, 3)] + [(i, f"{fresh()} {o} {p} {q} {fresh()}") for i in (4, 5, 6)]
    rows += [(i, " ".join([fresh(), *c[30:], *a[:40], fresh()])) for i in (7, 8)] + [(9, f"{q} {p}"), (10, f"{q} {p} {fresh()}"), (11, " ".join([*a[10:], *b[:30]]))]
    check_firsts(repeats.repeated_passages(make(spark, rows)).collect(), rows)


def test_rare_pairs_in_a_hot_run(spark, monkeypatch):
    """A document that is chained to a common variant still meets the one document that shares more with it."""
    monkeypatch.setattr(repeats, "GROUP", 20)
    rng = random.Random(12)
    before, core = prose(rng, 8), prose(rng, 44)
    texts = [f"{prose(rng, 40)} {before} {core} {prose(rng, 40)}" for _ in range(200)]
    for _ in range(30):
        after = prose(rng, 12)
        texts += [f"{prose(rng, 40)} {before} {core} {after} {prose(rng, 40)}", f"{prose(rng, 48)} {core} {after} {prose(rng, 40)}"]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    found = repeats.repeated_passages(make(spark, rows)).collect()
    want, got = repeated_words([t for _, t in rows]), covered(found, rows)
    assert all((got[t] == want[t]).all() for t in want)
    check_firsts(found, rows)


def test_no_python_task_gathers_a_run(spark, monkeypatch):
    """A line of 35 words in many documents with different words around: nothing repeats, and Python sees documents, not runs."""
    monkeypatch.setattr(repeats, "GROUP", 20)
    rng = random.Random(13)
    line, passage = prose(rng, 35), prose(rng, 55)
    rows = [(i, f"{prose(rng, 40)} {line} {prose(rng, 40)}") for i in range(150)] + [(i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in (150, 151)]
    inputs, docs = [], make(spark, rows)
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *a, **k: inputs.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a, **k))
    found = repeats.repeated_passages(docs).collect()
    assert {r.id for r in found} == {150, 151}
    check_firsts(found, rows)
    assert inputs and not any("hashpartitioning(run" in plan for plan in inputs)


def test_near_duplicates_with_repeated_lines(spark):
    """Links are by sets of shingles, however often lines repeat on one side or on both."""
    rng = random.Random(15)
    texts = []
    for k in range(40):
        shared, lines = prose(rng, 164), [prose(rng, 13) for _ in range(2)]
        times = [(50, 50), (50, 1), (10, 10), (1, 300)][k % 4]
        texts += [f"{shared} " + f"{line} " * n + " ".join(line.split()[:4]) for line, n in zip(lines, times, strict=True)]
    rows = list(enumerate(texts))
    want = brute_classes(rows)
    assert sum(size == 2 for _, _, size in want) == 80
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in nd.near_duplicates(make(spark, rows)).collect()) == want


def test_passages_that_sort_neighbours_hide(spark):
    """Two texts share 52 words; in both suffix orders texts that share 48 words with either stand between them."""
    rng = random.Random(21)
    rows, pairs = [], []
    for _ in range(4):
        core, left, right = prose(rng, 40), prose(rng, 6), prose(rng, 6)
        group = []
        for side in range(2):
            before, after = prose(rng, 20).split(), prose(rng, 20).split()
            group.append(" ".join([*before, left, core, right, *after]))
            for _ in range(12):
                group.append(" ".join([prose(rng, 18), *before[-2:], left, core, prose(rng, 26)]))
                group.append(" ".join([prose(rng, 26), core, right, *after[:2], prose(rng, 18)]))
        a, b = group[0], group[25]
        for p in range(26, 47):  # wherever in the core a minimiser is
            sides = [(t.split()[p:], t.split()[:p][::-1]) for t in group]
            for order in (sorted(range(50), key=lambda i: sides[i]), sorted(range(50), key=lambda i: sides[i][::-1])):
                assert abs(order.index(0) - order.index(25)) > 1
        pairs.append((len(rows) + group.index(a), len(rows) + group.index(b)))
        rows += [(len(rows) + i, t) for i, t in enumerate(group)]
    got = repeats.repeated_passages(make(spark, rows)).collect()
    check_firsts(got, rows)
    assert Counter((r.id, r.start, r.stop, r.kept, r.other) for r in got) == Counter(x for a, b in pairs for x in ((a, 20, 72, True, a), (b, 20, 72, False, a)))
