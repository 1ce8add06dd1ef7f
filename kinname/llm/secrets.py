"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

The forest judges a candidate by its length, its character transitions, how much of it a dictionary
covers, the path it stands in and the words next to it. It is trained from labelled findings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import bound_batches, boxed, few_rows, of_doc, spread, text_or_empty, unboxed

#: Labelled findings that the forest is fitted on, at most.
TRAIN_ROWS = 20_000
#: Share of trees from which on a candidate is a secret.
LEAST_SCORE = 0.5
#: Characters before and after a candidate that are looked at.
AROUND = 48

#: A run ends at =, so that a name is not part of what it is given; only base64 has them, at its end.
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\-]))?")
_GIVEN = re.compile(r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|(?:secret|private|client)(?:[_-]?(?:key|token))?|token|(?:api|access)[_-]?key|(?<![a-z])key|auth|bearer|credentials?)["']?\s*[:=]\s*["']?([^\s"'<>,;]{6,})""")
#: A bearer's token in a header, and the password in an address.
_BEARER = re.compile(r"""(?i)authorization["']?\s*[:=]\s*["']?bearer\s+([^\s"'<>,;]{6,})""")
_ADDRESS = re.compile(r"""://[^\s/:@"'<>]*:([^\s/@"'<>]{6,})@""")
#: Beginnings that issuers give to their tokens, and the two dots of signed ones.
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:glpat-|gh[opsu]_|github_pat_|xox[abprs]-|sk-|sk_live_|rk_live_|AKIA|ASIA|AIza|SG\.|npm_|pypi-|hf_)[A-Za-z0-9_\-.]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")
_SECRET_WORDS = frozenset("token secret password passwd pwd pass key apikey api_key access_key auth bearer credential credentials private".split())
_OTHER_WORDS = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id revision version build order invoice card iban isbn phone example sample placeholder dummy etag integrity".split())
#: What stands before data that is written out in text, digests of scripts, and the forms of account numbers and of references to a secret.
_DATA = re.compile(r"(?i)data:[a-z]+/[a-z0-9.+\-]+;base64,$|;base64,$")
_DIGEST = re.compile(r"(?i)^sha(?:1|256|384|512)[-:]")
_ACCOUNT = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_REFERENCE = re.compile(r"[$%]?\{|\(|\$|<|\.(?:env|get|config|secrets?)\b|^[A-Z]+(?:_[A-Z]+)+$|^[A-Z]+(?:-[A-Z]+)+$")
_DULL_PATH = re.compile(r"(?i)(^|[/_.\-])(tests?|examples?|fixtures?|docs?|samples?|mock|lock)([/_.\-]|$)")
#: Parts of ordinary names and placeholders, for the coverage of a candidate by a dictionary.
DICTIONARY = tuple(
    "your here example sample placeholder changeme change dummy test token secret password key value name user admin default "
    "config setting service server client request response version number string function method class object index table "
    "column order item type data file path image style button header footer content message event handler error "
    "the and for with from this that not none null true false xxxx abcdef 123456 012345".split()
)
_COVER = re.compile("|".join(sorted(map(re.escape, DICTIONARY), key=len, reverse=True)))


@lru_cache(1)
def _usual_pairs() -> np.ndarray:
    """Log odds of letter pairs in the dictionary's words against chance."""
    count = np.ones((27, 27))
    for w in DICTIONARY:
        at = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in w]
        for a, b in zip(at, at[1:], strict=False):
            count[a, b] += 1
    return np.log(count / count.sum(axis=1, keepdims=True) * 27)


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The numbers that the forest sees of one candidate."""
    n = max(len(candidate), 1)
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    lower = candidate.lower()
    at = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in lower]
    pairs = _usual_pairs()
    usual = sum(pairs[a, b] for a, b in zip(at, at[1:], strict=False)) / n
    counts = [lower.count(c) / n for c in set(lower)]
    entropy = -sum(p * math.log2(p) for p in counts)
    covered = sum(len(m) for m in _COVER.findall(lower)) / n
    near = re.findall(r"[a-z0-9_]+", before.lower())[-4:]
    return [
        len(candidate), *share, turns, usual, entropy, entropy / math.log2(n + 1), covered,
        float(all(c in "0123456789abcdef" for c in lower)), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", lower))), float(n in (32, 40, 64)),
        max((len(m[0]) for m in re.finditer(r"(.)\1*", candidate)), default=0) / n,
        float(bool(_DULL_PATH.search(path))), float(any(w in _SECRET_WORDS or w.rsplit("_", 1)[-1] in _SECRET_WORDS for w in near)), float(any(w in _OTHER_WORDS for w in near)),
        float(bool(_DATA.search(before))), float(bool(_DIGEST.match(candidate))), float(bool(_ACCOUNT.fullmatch(candidate))), float(bool(_ISSUED.match(candidate))), float(bool(_REFERENCE.search(candidate))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in ("'", '"') and after[:1] == before[-1:]),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order and apart: long runs that hold a digit, tokens of known beginnings, and what is given to a name of secrets."""
    found = [m.span() for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0])]
    found += [m.span() for m in _ISSUED.finditer(text)]
    if ":" in text or "=" in text:
        found += [m.span(1) for given in (_GIVEN, _BEARER, _ADDRESS) for m in given.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Forest:
    """Binary trees as arrays: feature (-1: leaf), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                down = np.where(x[np.arange(len(x)), f] <= threshold[node], left[node], right[node])
                node = np.where(inner, down, node)
            total += share[node]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 11) -> Forest:
    """Bootstrap samples, a random part of the features at each split, splits by Gini impurity at quantiles."""
    rng = np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        feature, threshold, left, right, share = [], [], [], [], []
        stack = [(rows, 0, -1, False)]
        while stack:
            at, level, parent, is_right = stack.pop()
            me = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            p = y[at].mean()
            feature.append(-1), threshold.append(0.0), left.append(0), right.append(0), share.append(p)
            if level >= depth or len(at) < 2 * least or p in (0.0, 1.0):
                continue
            best = (p * (1 - p) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                v = x[at, f]
                for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                    low = v <= t
                    k = int(low.sum())
                    if k < least or len(at) - k < least:
                        continue
                    a, b = y[at][low].mean(), y[at][~low].mean()
                    impurity = (k * a * (1 - a) + (len(at) - k) * b * (1 - b)) / len(at)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(t))
            if best[1] >= 0:
                feature[me], threshold[me] = best[1], best[2]
                low = x[at, best[1]] <= best[2]
                stack += [(at[~low], level + 1, me, True), (at[low], level + 1, me, False)]
        return tuple(map(np.array, (feature, threshold, left, right, share)))

    return Forest([grow(rng.integers(0, len(x), len(x))) for _ in range(trees)])


def train(findings: Sequence[tuple[str, str, str, str, int]], seed: int = 3) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, 1 if a secret); of more than TRAIN_ROWS, on a random sample of so many."""
    if len(findings) > TRAIN_ROWS:
        findings = [findings[i] for i in np.sort(np.random.default_rng(seed).choice(len(findings), TRAIN_ROWS, replace=False))]
    return fit_forest(np.array([features(*f[:4]) for f in findings]), np.array([float(f[4]) for f in findings]))


#: Kinds of secrets and of other candidates that findings are made of.
SECRET_KINDS = ("hex 40", "hex 32", "hex 64", "mixed", "access key", "issued", "base64", "sk", "password", "letters", "signed", "address", "human", "phrase")
OTHER_KINDS = ("commit", "checksum", "digest", "words", "uuid", "number", "path", "placeholder", "version", "data", "integrity", "account", "reference")
_SYLLABLES = "ba co der fin gul hor jam kel lo mer nu pol qui ras sten tor ul ver wal xen yor zim".split()


def made_findings(n: int = 4_000, seed: int = 5, without: Sequence[str] = ()) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings of common kinds, for want of a table of them: secrets as they are given to names, and
    commits, checksums, identifiers, numbers, names and placeholders as they stand in texts. without: kinds to leave out."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexes, digits, upper = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = upper + upper.lower() + digits
    word = lambda k: "".join(pick(_SYLLABLES) for _ in range(k))
    prose = ["of the", "and then", "is given in", "was here", "de la", "und der", "see also", "it"]
    paths = ["src/app.py", "config/prod.env", "main.go", "src0", "src7", "web/page", ""]
    dull = ["tests/data.py", "docs/guide.md", "examples/run.sh", "fixtures/a.json"]
    secrets_of = {
        "hex 40": lambda: chars(hexes, 40), "hex 32": lambda: chars(hexes, 32), "hex 64": lambda: chars(hexes, 64), "mixed": lambda: chars(mixed, int(rng.integers(20, 64))),
        "access key": lambda: "AKIA" + chars(upper + digits, 16), "issued": lambda: pick(["ghp_", "glpat-", "xoxb-", "npm_", "hf_"]) + chars(mixed, int(rng.integers(20, 37))),
        "base64": lambda: chars(mixed + "+/", 40), "sk": lambda: "sk-" + chars(mixed, 32), "password": lambda: chars(mixed + "!$%&", int(rng.integers(8, 24))),
        "letters": lambda: pick(["glpat-", "xoxb-", ""]) + chars(upper + upper.lower(), int(rng.integers(18, 32))), "signed": lambda: "eyJ" + ".".join(chars(mixed + "-_", int(k)) for k in rng.integers(20, 60, 3)),
        "address": lambda: chars(mixed + "!$%&", int(rng.integers(8, 24))),
        "human": lambda: pick([str, str.title])(word(2)) + chars(digits, int(rng.integers(1, 5))) + pick(["", "!", "#", "x!", "$"]), "phrase": lambda: pick("-_.").join(word(2) for _ in range(int(rng.integers(3, 5)))),
    }
    names_of = {
        "commit": ["commit ", "sha1 ", "revision "], "checksum": ["md5 ", "checksum: ", "etag = "], "digest": ["sha256 ", "digest = ", "integrity: "], "words": [""], "uuid": ["uuid ", "id = ", "guid: "],
        "data": ["src=\"data:image/png;base64,", "url(data:font/woff2;base64,", "data:image/svg+xml;base64,"], "integrity": ["integrity=\"", "integrity: ", "integrity='"], "account": ["IBAN ", "iban: ", "account ", "konto ", ""],
        "reference": ["token = ", "password: ", "api_key=", "session_key=", "secret: ", "passphrase = "],
        "number": ["order ", "card ", "invoice ", ""], "path": ["", "href="], "placeholder": ["token = ", "password: ", "api_key="], "version": ["version = ", "build ", ""],
    }
    others_of = {
        "commit": lambda: chars(hexes, 40), "checksum": lambda: chars(hexes, 32), "digest": lambda: chars(hexes, 64), "words": lambda: "_".join(pick(DICTIONARY) for _ in range(4)) + chars(digits, 2),
        "uuid": lambda: "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), "number": lambda: chars(digits, int(rng.integers(16, 20))), "path": lambda: "/".join(pick(DICTIONARY) for _ in range(4)) + "/" + chars(digits, 3),
        "placeholder": lambda: pick(["your_token_here_123", "xxxxxxxxxxxxxxxx1", "changeme123456", "example_password_1", "placeholder-key-0000", "your-password"]), "version": lambda: "v" + ".".join(chars(digits, 1) for _ in range(3)) + "-" + chars(digits, 10),
        "data": lambda: pick(["iVBORw0KGgo", "PHN2Zy", "d09GMg", ""]) + chars(mixed + "+/", int(rng.integers(24, 400))) + pick(["", "=", "=="]), "integrity": lambda: pick(["sha256-", "sha384-", "sha512-"]) + chars(mixed + "+/", int(pick([43, 64, 86]))) + pick(["", "=", "=="]),
        "account": lambda: pick(["DE", "GB", "FR", "NL", "ES", "AT"]) + chars(digits, 2) + pick([lambda: chars(digits, 18), lambda: chars(upper, 4) + chars(digits, 14), lambda: chars(digits, 23)])(),
        "reference": lambda: pick([lambda: "_".join(word(1).upper() for _ in range(2)) + pick(["_PLACEHOLDER", "_KEY", "_TOKEN", "_HERE"]), lambda: "${" + word(2).upper() + "_TOKEN}", lambda: pick(["process.env.", "os.environ.", "config.get(", "settings."]) + word(2).upper(), lambda: "get_" + word(1) + "()", lambda: "<" + word(1) + "-token>", lambda: "{{" + word(2) + "}}"])(),
    }
    ours, theirs = [k for k in SECRET_KINDS if k not in without], [k for k in OTHER_KINDS if k not in without]
    out = []
    for i in range(n):
        quote, case = pick(['"', "'", ""]), pick([str, str, str.upper])
        if i % 2:
            kind = pick(ours)
            value = secrets_of[kind]()
            name = pick(["password", "passphrase", "pwd", "db_password"]) if kind in ("human", "phrase") else pick(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "key", "secret_key", "private_key", "pwd"])
            before = case(f"{pick(prose)} {name}{pick(['', ' '])}{pick(['=', ':', '= ', ': '])}") + quote
            if kind == "address":
                before, quote = f"{pick(prose)} {pick(['postgres', 'redis', 'amqp', 'https'])}://{pick(['admin', 'app', 'root', ''])}:", "@"
            elif kind in ("access key", "issued", "sk", "signed") and rng.random() < 0.4:  # forms that tell by themselves
                before, quote = pick(prose) + " ", ""
            value = case(value) if kind.startswith("hex") else value
            out.append((value, before, quote + ("host/db" if kind == "address" else " " + pick(prose)), pick(paths if rng.random() < 0.9 else dull), 1))
        else:
            kind = pick(theirs)
            out.append((others_of[kind](), pick(prose) + " " + pick(names_of[kind]) + (quote if kind in ("uuid", "placeholder", "reference") else ""), " " + pick(prose), pick(paths + dull), 0))
    return out


def _judge(texts: Sequence[str], paths: Sequence[str], forest: Forest, least: float) -> Iterator[tuple[int, int, int, float, bool]]:
    """(row, start, end, score, secret) of every candidate of a batch."""
    found = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t)]
    rows = [features(texts[i][a:b], texts[i][max(0, a - AROUND) : a], texts[i][b : b + AROUND], paths[i]) for i, a, b in found]
    for (i, a, b), s in zip(found, forest.score(np.array(rows)) if rows else [], strict=True):
        yield i, a, b, float(s), bool(s >= least)


def find_secrets(docs: DataFrame, forest: Forest, *, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, start, end, length, score, is_secret, value_sha256) of each candidate in each row's whole text.

    start and end count characters; of the value only its digest is returned. A null or empty text has
    no candidates; a null path is an empty one, as is that of a table without path_col; a null id stays
    null; repeated rows give repeated findings; an empty table gives an empty one; other columns are
    left out. Very long texts are searched whole. One narrow pass.
    """
    import hashlib

    bound_batches(docs.sparkSession)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), path.alias("path")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column("text").to_pylist()
            found = list(_judge(texts, batch.column("path").to_pylist(), forest, least))
            row, start, end, score, secret = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.subtract(end, start).tolist(), pa.int32()),
                pa.array(score, pa.float64()), pa.array(secret, pa.bool_()), pa.array([hashlib.sha256(texts[i][a:b].encode()).hexdigest() for i, a, b in zip(row, start, end, strict=True)], pa.string()),
            ], [id_col, "start", "end", "length", "score", "is_secret", "value_sha256"])

    return source.mapInArrow(run, f"`{id_col}` long, start int, end int, length int, score double, is_secret boolean, value_sha256 string")


def _cleaner(forest: Forest, least: float, mark: str):
    def run(texts: pa.Array, paths: pa.Array) -> pa.Array:
        out, where = texts.to_pylist(), paths.to_pylist()
        for i, a, b, _, secret in sorted(_judge(out, where, forest, least), key=lambda x: (x[0], -x[1])):
            if secret:  # from the end, so earlier places stay right
                out[i] = out[i][:a] + mark + out[i][b:]
        return pa.array(out, pa.string())

    return run


def without_secrets(docs: DataFrame, forest: Forest, *, least: float = LEAST_SCORE, mark: str = "[secret]", text_col: str = "text", path_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with each secret's characters replaced by ``mark``; chars_col is counted anew where texts change.

    Null texts stay null, empty ones empty; null paths count as empty; null ids and repeated rows stay
    as they are; an empty table gives an empty one. One narrow pass over whole texts.
    """
    bound_batches(docs.sparkSession)
    path = text_or_empty(of_doc(path_col)) if path_col in docs.columns else F.lit("")
    marked = boxed(docs).withColumn("text", text_or_empty(of_doc(text_col)))
    out = marked.withColumn("clean", F.arrow_udf(_cleaner(forest, least, mark), "string")("text", path))
    changed = F.col("clean") != F.col("text")
    new = {text_col: F.when(changed, F.col("clean")).otherwise(of_doc(text_col))}
    if chars_col and chars_col in docs.columns:
        new[chars_col] = F.when(changed, F.length("clean")).otherwise(of_doc(chars_col)).cast(docs.schema[chars_col].dataType)
    return unboxed(out, docs.columns, new)
