"""The classifier chain against a plain version: features by counting, dense matrices, Newton steps to the optimum."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from kinname.llm import queries, toxicity
from kinname.llm.shingles import mix, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def plain_features(text):
    """The features of a whole text as a set: words, and levels of the words that share a beginning."""
    words = [toxicity.plain(w) for w in text.split()]
    found = set(words)
    for size in toxicity.BEGINNINGS:
        for start, n in Counter(w[:size] for w in words if len(w) > size).items():
            found |= {f"{start}*{t}" for t in toxicity.TIMES if n >= t}
            found |= {f"{start}%{t}" for t in toxicity.SHARES if n >= 2 and n >= t * len(words)}
    return found


def plain_fit(x, y, vote, ridge=0.03):
    """The minimum of the weighted logistic loss with its ridge; the constant is the last column and next to free."""
    penalty = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    loss = lambda v: (vote * (np.logaddexp(0, x @ v) - y * (x @ v))).sum() + (penalty * v * v).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (vote * (p - y)) + penalty * w
        if np.abs(gradient).max() < 1e-9:
            break
        step = np.linalg.solve(x.T @ (x * (vote * p * (1 - p))[:, None]) + np.diag(penalty), -gradient)
        size = 1.0
        while size > 1e-9 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return w


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: (1 - r.quality, r.toxic) for r in labels.collect()}, toxicity.train(docs, labels, queries.toxicity_categories())


def test_features_that_tell(tables):
    """The chain's features are those whose share in a category is LEAST_Z standard errors above the rest, near copies sharing one vote."""
    texts, labels, chain = tables
    sets = {i: plain_features(texts[i]) for i in labels}
    least = {i: int(shingles(texts[i]).min()) >> 1 if texts[i].split() else 0 for i in labels}
    size = Counter(least.values())
    want = set()
    for j in range(2):
        total, n = [0.0, 0.0], defaultdict(lambda: [0.0, 0.0])
        for i, y in labels.items():
            total[y[j]] += 1 / size[least[i]]
            for f in sets[i]:
                n[f][y[j]] += 1 / size[least[i]]
        for f, (n0, n1) in n.items():
            share = (n0 + n1) / sum(total)
            error = (max(share * (1 - share), 1e-12) * (1 / total[0] + 1 / total[1])) ** 0.5
            if (n1 / total[1] - n0 / total[0]) / error >= toxicity.LEAST_Z:
                want.add(f)
    assert set(chain.words) == want and want


def test_scores_of_all_documents(spark, tables):
    """The query's probabilities are those of the chain's weights summed over each text's set of features."""
    texts, _, chain = tables
    n = len(chain.words)
    got = {r.doc_id: r for r in entry.queries()["op9_toxicity"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        earlier = []
        for w in chain.weights:
            x = w[-1] + sum(w[chain.words[f]] for f in plain_features(text) if f in chain.words) + sum(a * b for a, b in zip(earlier, w[n:], strict=False))
            earlier.append(1 / (1 + np.exp(-x)))
        assert [got[i].p_low_quality, got[i].p_toxic] == pytest.approx(earlier, abs=1e-9)
        assert got[i].toxic == (earlier[-1] >= toxicity.REJECT)


def test_weights_against_dense_optima(tables):
    """Each model of the chain gives the probabilities of the dense optimum; the later one's earlier column is out of fold."""
    texts, labels, chain = tables
    ids = sorted(labels)
    x = np.zeros((len(ids), len(chain.words)))
    for k, i in enumerate(ids):
        x[k, [chain.words[f] for f in plain_features(texts[i]) if f in chain.words]] = 1
    least = np.array([int(shingles(texts[i]).min()) >> 1 if texts[i].split() else 0 for i in ids])
    size = Counter(least.tolist())
    vote = np.array([1 / size[g] for g in least.tolist()])
    fold = mix(least.astype(np.uint64)) % np.uint64(toxicity.FOLDS)
    y = np.array([labels[i] for i in ids], float)
    one = np.ones((len(ids), 1))
    held = np.zeros(len(ids))
    first = np.hstack([x, one])
    for f in range(toxicity.FOLDS):
        w = plain_fit(first, y[:, 0], np.where(fold == f, 0.0, vote))
        held[fold == f] = 1 / (1 + np.exp(-(first @ w)))[fold == f]
    second = np.hstack([x, held[:, None], one])
    for design, want, w in ((first, y[:, 0], chain.weights[0]), (second, y[:, 1], chain.weights[1])):
        best = plain_fit(design, want, vote)
        p, q = (1 / (1 + np.exp(-(design @ v))) for v in (w, best))
        assert np.abs(p - q).max() < 0.01, np.abs(p - q).max()
