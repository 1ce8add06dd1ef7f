"""Toxicity by a classifier chain: linear models in sequence, each fed with the categories before it.

Each category's model is a logistic regression on the presence of words, on how often and how densely
words of one beginning occur, and on the probabilities of the earlier categories. Models are trained with out-of-fold predictions of the earlier ones: a row's
earlier probabilities come from models that did not see it, so a later model learns how far they can
be trusted on new documents. Folds keep near copies together, and near copies share one vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import Memo, bound_batches, boxed, claim, few_rows, of_doc, spread, text_or_empty, unboxed
from kinname.llm.shingles import mix, shingles

#: Labelled rows that the models are fitted on, and characters of their texts, at most; every document is scored.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 200_000_000
FOLDS = 4
#: Features whose share among a category's rows is above that of the rest by so many standard errors are used; of all
#: categories together so many at most.
LEAST_Z, MOST_WORDS = 5.0, 20_000
REJECT = 0.3

_EDGE = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    return _EDGE.sub("", word.lower())


#: Features of word beginnings: of so many letters, in words that are longer, at so many words or at so high a share.
BEGINNINGS, TIMES, SHARES = (4, 6), (2, 3, 5), (0.01, 0.02, 0.04)


def beginning_features(times: dict[str, int], n_words: int) -> list[str]:
    """The names of the levels that the counts of word beginnings reach in a text of n_words words."""
    return [f"{b}*{t}" for b, c in times.items() for t in TIMES if c >= t] + [f"{b}%{t}" for b, c in times.items() for t in SHARES if c >= max(2, t * n_words)]


def features(words: Sequence[str], counts: Sequence[int]) -> list[str]:
    """The features of a text with these distinct plain words, so often each."""
    times: dict[str, int] = {}
    for w, c in zip(words, counts, strict=True):
        for k in BEGINNINGS:
            if len(w) > k:
                times[w[:k]] = times.get(w[:k], 0) + c
    return [*words, *beginning_features(times, sum(counts))]


@dataclass
class Chain:
    """The features, and for each category its weights: features, earlier probabilities, constant."""

    categories: list[str]
    words: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.beginnings = {w[:k] for w in self.words for k in BEGINNINGS if w[k : k + 1] in ("*", "%") and w[:k].isalnum()}

    def known(self, raw: str) -> tuple[int, tuple[str, ...]] | None:
        """The number of a word's feature, or -1, and its beginnings that are in features; None if it has neither."""
        w = plain(raw)
        number, starts = self.words.get(w, -1), tuple(w[:k] for k in BEGINNINGS if len(w) > k and w[:k] in self.beginnings)
        return (number, starts) if number >= 0 or starts else None

    def numbers(self, text: str, known) -> np.ndarray:
        """The numbers of a text's features; known: a memo of self.known."""
        words = text.split()
        hits = [x for x in map(known, words) if x]
        found = {n for n, _ in hits if n >= 0}
        times: dict[str, int] = {}
        for _, starts in hits:
            for start in starts:
                times[start] = times.get(start, 0) + 1
        if times:
            found.update(self.words[f] for f in beginning_features(times, len(words)) if f in self.words)
        return np.fromiter(sorted(found), np.int64, len(found))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """From each row's word numbers; a column a category."""
        n = len(self.words)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        out = np.zeros((len(rows), len(self.categories)))
        for j, w in enumerate(self.weights):
            out[:, j] = w[-1] + np.bincount(owner, weights=w[flat], minlength=len(rows)) + _sigmoid(out[:, :j]) @ w[n : n + j]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(owner: np.ndarray, word: np.ndarray, n_words: int, dense: np.ndarray, y: np.ndarray, vote: np.ndarray, ridge: float = 0.03, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps with conjugate gradients; weights of words, dense columns and the constant."""
    rows, d = len(y), n_words + dense.shape[1] + 1
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6
    by_word = np.argsort(word, kind="stable")

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=v[word], minlength=rows) + dense @ v[n_words:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(word[by_word], weights=r[owner[by_word]], minlength=n_words), dense.T @ r, [r.sum()]])

    def loss(v: np.ndarray) -> float:
        x = forward(v)
        return float((vote * (np.logaddexp(0, x) - y * x)).sum() + 0.5 * (penalty * v * v).sum())

    w = np.zeros(d)
    base = np.clip((vote * y).sum() / max(vote.sum(), 1e-9), 1e-4, 1 - 1e-4)
    w[-1] = np.log(base / (1 - base))
    for _ in range(steps):
        p = _sigmoid(forward(w))
        gradient = back(vote * (p - y)) + penalty * w
        if np.abs(gradient).max() < 1e-2:
            break
        curve = vote * p * (1 - p)
        step, residual = np.zeros(d), -gradient
        direction, norm = residual.copy(), float(residual @ residual)
        for _ in range(40):
            turned = back(curve * forward(direction)) + penalty * direction
            size = norm / float(direction @ turned)
            step += size * direction
            residual -= size * turned
            fresh = float(residual @ residual)
            if fresh < 1e-3 * float(gradient @ gradient):  # a rough step does, the next ones correct it
                break
            direction, norm = residual + fresh / norm * direction, fresh
        # a full step can overshoot where the classes are all but separate
        here, size = loss(w), 1.0
        while size > 1e-4 and loss(w + size * step) > here + 0.1 * size * float(gradient @ step):
            size /= 2
        w += size * step
    return w


def fit_chain(rows: pa.ListArray, labels: np.ndarray, groups: np.ndarray, categories: Sequence[str], *, ridge: float = 0.03) -> Chain:
    """A chain from each row's features, its labels (0, 1; a column a category) and its group of near copies."""
    n = len(rows)
    coded = rows.flatten().dictionary_encode()
    texts, flat = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(rows.offsets.to_numpy()))
    kind = np.unique(groups, return_inverse=True, return_counts=True)
    vote = 1 / kind[2][kind[1]] if n else np.zeros(0)
    found: set[int] = set()
    for j in range(len(categories)):
        y = labels[:, j]
        total_1, total_0 = (vote * y).sum(), (vote * (1 - y)).sum()
        if not total_1 or not total_0:
            continue
        n1 = np.bincount(flat, weights=(vote * y)[owner], minlength=len(texts))
        n0 = np.bincount(flat, weights=(vote * (1 - y))[owner], minlength=len(texts))
        share = (n1 + n0) / (total_1 + total_0)
        z = (n1 / total_1 - n0 / total_0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total_1 + 1 / total_0))
        # only what tells for the category: what tells against it is mostly the language of other texts
        best = np.argsort(-z, kind="stable")[: MOST_WORDS // len(categories)]
        found.update(best[z[best] >= LEAST_Z].tolist())
    chosen = sorted(found)
    number = np.full(len(texts), -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[flat] >= 0
    owner, word = owner[keep], number[flat[keep]]
    chain = Chain(list(categories), {texts[i].as_py(): k for k, i in enumerate(chosen)})
    fold = (mix(groups.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    earlier = np.zeros((n, 0))
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        chain.weights.append(fit_logistic(owner, word, len(chosen), earlier, y, vote, ridge))
        if j + 1 == len(categories):
            break
        held = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                w = fit_logistic(owner, word, len(chosen), earlier, y, np.where(out, 0.0, vote), ridge)
                score = np.bincount(owner, weights=w[word], minlength=n) + earlier @ w[len(chosen) : -1] + w[-1]
                held[out] = score[out]
        earlier = np.column_stack([earlier, _sigmoid(held)])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """A chain from labelled documents. categories: names and 0/1 columns over ``labels``, in the chain's order.

    Fitted on the ``rows`` labelled ids with the least hashes, whose words alone come to the driver, as
    far as their texts together have TRAIN_CHARS characters; of rows that share an id, on the text of
    the least digest, chosen on the executors. An id that is labelled twice is in a category if any of
    its labels says so. Rows with a null label are left out. Without rows, or with rows of one kind,
    the chain predicts the share it saw (of no rows, next to none).
    """
    names = list(categories)
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), *[c.cast("int").alias(f"_y{i}") for i, c in enumerate(categories.values())])
    marked = marked.dropna().where(F.greatest(*[F.col(f"_y{i}") for i in range(len(names))], F.lit(0)) <= 1)
    chosen = marked.groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(names))]).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    # which row of an id, and how long it is, is settled without the texts
    sized = texts.join(F.broadcast(chosen), "_id").select(*chosen.columns, F.struct(F.md5("_text").alias("digest"), F.length("_text").alias("n")).alias("of")).groupBy(*chosen.columns).agg(F.min("of").alias("of"))
    sized = sorted(sized.select(F.xxhash64("_id").alias("draw"), *chosen.columns, "of.*").collect())
    until = np.searchsorted(np.cumsum([r["n"] for r in sized]), TRAIN_CHARS, side="right")
    kept = [(r["digest"], *[r[c] for c in chosen.columns]) for r in sized[:until]]
    fields = ", ".join(["_digest string", "_id long", *[f"_y{i} int" for i in range(len(names))]])
    wanted = docs.sparkSession.createDataFrame(kept, fields)
    source = texts.join(F.broadcast(wanted), (texts["_id"] == wanted["_id"]) & (F.md5("_text") == F.col("_digest"))).select(*[wanted[c] for c in chosen.columns], "_text").dropDuplicates(["_id"])
    bound_batches(docs.sparkSession)
    source = source.repartition(docs.sparkSession.sparkContext.defaultParallelism)

    names_y = [f"_y{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        word = Memo(plain, 50_000, "shingles")
        for batch in few_rows(batches):
            found, groups = [], []
            for text in batch.column("_text").to_pylist():
                count = Counter(map(word.__getitem__, text.split()))
                found.append(features(list(count), list(count.values())))
                hashes = shingles(text)
                groups.append(int(hashes.min()) >> 1 if len(hashes) else 0)  # near copies mostly share their least shingle
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[batch.column(y) for y in names_y], pa.array(groups, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["_id", *names_y, "_group", "_found"])

    schema = "_id long, " + ", ".join(f"{y} int" for y in names_y) + ", _group long, _found array<string>"
    table = source.mapInArrow(run, schema).toArrow()
    table = table.sort_by("_id").combine_chunks()
    y = np.column_stack([table[k].to_numpy() for k in names_y])
    found = table["_found"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.string()))
    return fit_chain(found, y, table["_group"].to_numpy().astype(np.int64), names)


def scores(chain: Chain, text: Column) -> Column:
    """A struct of one probability a category, from a whole text."""
    names = chain.categories

    def run(texts: pa.Array) -> pa.Array:
        # the memo lives as long as the worker's copy of the function
        claim("toxicity")
        known = run.__dict__.setdefault("known", Memo(chain.known, 50_000, "toxicity"))
        found = _sigmoid(chain.logits([chain.numbers(t, known.__getitem__) for t in texts.to_pylist()]))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(names))], names)

    return F.arrow_udf(run, ", ".join(f"`{n}` double" for n in names))(text)


def score_documents(docs: DataFrame, chain: Chain, *, reject: float = REJECT, category: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., rejected) for each row's whole text: rejected if ``category`` has the probability ``reject`` or more.

    A null text is the empty text and gets the chain's constants, as any text without known words; a
    null id stays null; repeated rows get repeated scores; an empty table gives an empty one; other
    columns are left out. Very long texts are scored whole. One narrow pass with no shuffle.
    """
    bound_batches(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")))
    got = source.select("_id", scores(chain, F.col("_text")).alias("_p"))
    return got.select(F.col("_id").alias(id_col), *[F.col("_p")[c].alias(f"p_{c}") for c in chain.categories], (F.col("_p")[category] >= reject).alias("rejected"))


def without_toxic(docs: DataFrame, chain: Chain, *, reject: float = REJECT, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not reject.

    Null and empty texts have the chain's constants, as any text without known words; null ids do not
    matter, repeated rows stay or go together, columns of any names stay as they are, and an empty
    table gives an empty one. One narrow pass over whole texts with no shuffle.
    """
    bound_batches(docs.sparkSession)
    judged = boxed(docs).withColumn("p", scores(chain, text_or_empty(of_doc(text_col))))
    return unboxed(judged.where(F.col("p")[category] < reject), docs.columns)
