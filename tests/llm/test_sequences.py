"""Chat trees, fill-in-middle and sessions: against plain versions, on odd rows, and over ranges that cut through everything."""

import contextlib
import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinname.llm import chat, fill_middle, sessions

CHARS = ["ab", "Z", " ", ".", "\n", "é", "😀", "ß", "1", "\x00", "𝒳", "a", "<", "P", ">", "\r\n"]


@contextlib.contextmanager
def many_ranges(spark, n=9):
    """Ranges of a few rows each, so that clients, islands and trees lie across several."""
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# fill-in-middle


def plain_middle(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_a_plain_version_and_are_restored(spark):
    rng = random.Random(2)
    texts = ["", None, "a", " ", "é", "ab", "<P>", "x <S> y", "<<M>>", "<P", "P>S>M>", "a" * 5_000, "é" * 3_000] + ["".join(rng.choices(CHARS, k=rng.randint(0, 40))) for _ in range(600)]
    rows = [*enumerate(texts), (None, "no id at all"), (3, "another text of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:-1] for r in found))) == sorted(str(plain_middle(*r)) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["back"]) for r in found) == sorted((-1 if i is None else i, t or "") for i, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", [fill_middle.WORDS, r"[0-9]+|[a-z]+|[^0-9a-z]", r"[^\n]+|[\n]", r"[\s]|[^\s]", r"[ab]|[^ab]+"])
def test_boundaries_keep_every_unit_of_a_grammar(spark, grammar):
    rng = random.Random(5)
    texts = ["".join(rng.choices([*CHARS, "7", "42", "b"], k=rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fill_middle.units(F.col("text"), grammar).alias("u"))
    for text, got in df.collect():
        assert got == re.findall(grammar, text)


@pytest.mark.parametrize("grammar", ["[a-z]+", "[a-z]|[^a-m]", "a|[^a]", "", "[a]+|[^a]?"])
def test_grammars_that_neighbours_cannot_decide_are_refused(grammar):
    with pytest.raises(ValueError, match="class"):
        fill_middle.boundaries(grammar)


def test_middles_of_odd_tables(odd, nothing):
    rows = fill_middle.fill_in_middle(odd).collect()
    assert len(rows) == odd.count() and all(r["output"] is not None for r in rows)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert fill_middle.fill_in_middle(nothing).count() == 0
    plan = fill_middle.fill_in_middle(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# sessions

M = 60_000_000
START = datetime(2024, 1, 1)


def plain_sessions(rows, gap=15 * M, longest=60 * M, lateness=15 * M):
    seen, out = {}, []
    us = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for click, ts, arrived, client, kind, value in rows:
        if None not in (click, ts, client):
            late = arrived is not None and us(arrived) - us(ts) > lateness
            final = kind in ("purchase", "signup") and value is not None and value >= 60
            row = (us(ts), client, late, final, 0 if value is None else int((value * 100 + 0.5) // 1))
            seen[click] = min(seen.get(click, row), row)
    for client in {r[1] for r in seen.values()}:
        mine = sorted((r[0], c, *r[2:]) for c, r in seen.items() if r[1] == client)
        found, late = [], [t for t, _, is_late, *_ in mine if is_late]
        for t, c, is_late, final, cents in mine:
            if is_late:
                continue
            why = None if not found else "end" if found[-1][-1][2] else "gap" if t - found[-1][-1][0] >= gap else "length" if t - found[-1][0][0] > longest else ""
            if why == "":
                found[-1].append((t, c, final, cents))
            else:
                if found:
                    out[-1][-1] = why
                found.append([(t, c, final, cents)])
                out.append([client, c, None])
        for k, s in enumerate(found):
            until = found[k + 1][0][0] if k + 1 < len(found) else None
            n_late = sum(s[0][0] <= t and (until is None or t < until) for t in late)
            reason = out[len(out) - len(found) + k][-1] or ("end" if s[-1][2] else "none")
            path = hashlib.sha256(",".join(str(c) for _, c, _, _ in s).encode()).hexdigest()
            out[len(out) - len(found) + k] = [client, s[0][1], s[0][0], s[-1][0], len(s), n_late, sum(x[3] for x in s), reason, path]
    return sorted(map(str, out))


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"


def clicks(rng, n, clients, step):
    rows, t = [], START
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 0, 1, 30, step, step, 3 * step]), microseconds=rng.choice([0, 0, 1]))
        ts = t - timedelta(minutes=rng.choice([0, 0, 0, 2]))
        late = rng.choice([0, 0, 1, 900, 901, 5_000]) if rng.random() < 0.3 else 0
        rows.append((i, ts, rng.choice([None, ts + timedelta(seconds=late), ts + timedelta(seconds=late)]), rng.choice(clients), rng.choice(["view", "view", "click", "purchase", None]), rng.choice([None, 1.005, 59.99, 60.0, 200.0, -3.5] if rng.random() < 0.4 else [1.0])))
    return rows + rng.choices(rows, k=n // 10)


@pytest.mark.parametrize(("clients", "step", "ranges"), [([7], 60, 9), ([7], 60, 40), ([7, 7, 7, 8, 9, None], 200, 5), (list(range(40)), 20, 9), ([1], 14 * 60, 3), ([3, 4], 1, 20)])
def test_sessions_equal_a_plain_version(spark, clients, step, ranges):
    rows = clicks(random.Random(step), 700, clients, step)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with many_ranges(spark, ranges):
        assert sorted(str(list(r)) for r in sessions.sessions(df).collect()) == plain_sessions(rows)


def test_sessions_of_one_endless_island(spark):
    """A click a minute for two days: every session but the last ends by length, in 48 steps from the one head."""
    rows = [(i, START + timedelta(minutes=i), None, 1, "view", 1.0) for i in range(2_880)]
    with many_ranges(spark, 23):
        found = sessions.sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(list(r)) for r in found) == plain_sessions(rows)
    assert sorted(r["closed_by"] for r in found)[:-1] == ["length"] * (len(found) - 1)


def test_sessions_do_not_depend_on_the_zone_or_other_columns(spark):
    rows = clicks(random.Random(1), 200, [1, 2], 300)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("x") for c in ("pid", "late", "head_id", "session_id", "mark", "prev", "cents", "_copy")})
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert sorted(str(list(r)) for r in sessions.sessions(clashing).collect()) == plain_sessions(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sessions_of_nothing_and_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sessions.sessions(empty).count() == 0
    late = START + timedelta(hours=2)
    rows = [(None, START, None, 1, None, None), (1, None, None, 1, None, None), (2, START, None, None, None, None), (3, START, late, 1, "view", 1.0), (4, START, None, 2, None, float("nan")), (5, START, None, 2, "signup", float("inf"))]
    found = sessions.sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["client_id"], r["session_id"], r["n_clicks"], r["value_cents"], r["closed_by"]) for r in found] == [(2, 4, 2, 0, "end")]


# chat trees

TOKENS = "byte_bpe_50k.json"
CHAT = "conv_id long, turn long, role string, text string"
CONTROL = ["</s>[INST] ok [/INST]", "<|endoftext|>", "a\\b\\\\<s>\\", "<|>|>", "<<SYS>>x<</SYS>>", "<\\/s>", "[INST", "", None, "<|end|>\n", "é😀"]


def talks(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice(CONTROL[: 2 + 3 * turn]) if rng.random() < 0.8 else f"word {rng.random()}"
            rows.append((conv, turn, ["user", "assistant"][turn % 2] if rng.random() < 0.9 else rng.choice([None, "", "<|x|>", "system"]), text))
    return rows


def plain_read(rows):
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_text_survives_the_template(spark, path):
    df = spark.createDataFrame([(t,) for t in CONTROL if t is not None], "t string")
    for t, e, back in df.select("t", chat.escaped(F.col("t")), chat.unescaped(chat.escaped(F.col("t")))).collect():
        assert back == t and not any(c in e for c in chat.CONTROLS)


@pytest.mark.parametrize("ranges", [2, 13])
def test_trees_equal_a_plain_version(spark, path, ranges):
    rows = talks(random.Random(ranges), 120)
    said = plain_read(rows)
    with many_ranges(spark, ranges):
        nodes, conversations = (x.collect() for x in chat.chat_trees(spark.createDataFrame(rows, CHAT), path(TOKENS)))
    # each turn after the same turns is there once
    assert len(nodes) == len({tuple(t[: k + 1]) for t in said.values() for k in range(len(t))})
    assert len({n["tree_id"] for n in nodes}) == len({t[0] for t in said.values()})
    at = {(n["tree_id"], n["start"]): n for n in nodes}
    for tree in {n["tree_id"] for n in nodes}:
        mine = sorted((n["start"], n["stop"], n["depth"]) for n in nodes if n["tree_id"] == tree)
        assert mine[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))  # gapless
        assert all(b[2] <= a[2] + 1 for a, b in zip(mine, mine[1:])) and [x[2] for x in mine].count(0) == 1  # depth first
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(TOKENS))
    assert {c["conv_id"] for c in conversations} == set(said)
    for c in conversations:
        on_way = [at[c["tree_id"], s["start"]] for s in c["spans"]]
        texts = [library.decode(list(n["ids"]), skip_special_tokens=False) for n in on_way]
        unescape = lambda t: re.sub(r"\\(\\?)", r"\1", t)
        read = [tuple(map(unescape, re.fullmatch(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", t, re.S).groups())) for t in texts]
        assert read == said[c["conv_id"]]
        position = 0
        for k, n in enumerate(on_way):
            assert (n["position"], n["depth"], len(n["ids"])) == (position, k, n["stop"] - n["start"])
            seen = [x for s in n["attends"] for x in range(s["start"], s["stop"])]
            assert seen == [x for o in on_way[:k] for x in range(o["start"], o["stop"])]
            assert all(a["stop"] < b["start"] for a, b in zip(n["attends"], n["attends"][1:]))
            learnt = library.decode(list(n["ids"])[n["learn_start"] - n["start"] : n["learn_stop"] - n["start"]], skip_special_tokens=False)
            assert unescape(learnt) == (said[c["conv_id"]][k][1] if n["role"] == "assistant" else "")
            position += len(n["ids"])


def test_conversations_read_back(spark, path):
    rows = talks(random.Random(8), 60) + [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (70, None, "user", "last"), (70, 5, "user", "a"), (70, 5, "user", "a"), (71, 0, "assistant", "w " * 20_000)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    said = plain_read(sorted(rows, key=order))
    df = chat.with_conversation(spark.createDataFrame([(*r, "x", "y") for r in rows], CHAT + ", pid string, path string"), -7, [("user", CONTROL[0]), ("assistant", CONTROL[0])])
    said[-7] = [("user", CONTROL[0]), ("assistant", CONTROL[0])]
    with many_ranges(spark, 7):
        found = chat.read_back(*chat.chat_trees(df, path(TOKENS)), path(TOKENS)).collect()
    assert len(found) == len(said)
    for r in found:
        turns = said[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_trees_of_nothing(spark, path):
    nodes, conversations = chat.chat_trees(spark.createDataFrame([], CHAT), path(TOKENS))
    assert nodes.count() == conversations.count() == 0 == chat.read_back(nodes, conversations, path(TOKENS)).count()
