"""The queries of the corpus operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(name: str) -> str:
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import bpe

    path = _path("byte_bpe_50k.json")
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), path)
    return bpe.decode(tokens, path).select("doc_id", F.col("n_tokens"), "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import repeats

    found = repeats.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), "kept", F.col("other").alias("first_doc_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import common, tokens

    # each run starts with an empty cache, so a run's figures hold the encoding of all its texts
    return tokens.token_counts(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), f"{common.shared_dir(spark)}/token-counts")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import secrets

    return secrets.find_secrets(_table(spark, sf_dir, "documents"), secrets.train(secrets.made_findings()))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import embeddings

    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import sharding

    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], [f"shard-{i:04d}" for i in range(256)])


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import fingerprints

    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity_categories()))
    return scored.withColumnRenamed("rejected", "toxic")


def toxicity_categories() -> dict:
    """The categories that the labels have, in the chain's order."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import near_duplicates

    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import chat

    turns = chat.with_conversation(_table(spark, sf_dir, "conversations"), -7, [("user", _CONTROL), ("assistant", _CONTROL)])
    path = _path("byte_bpe_50k.json")
    return chat.read_back(*chat.chat_trees(turns, path), path).drop("n_tokens")


#: What the added conversation says: strings that templates use as controls.
_CONTROL = "</s>[INST] ok [/INST]"


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import fill_middle

    moved = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinname.llm import sessions

    return sessions.sessions(_table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Links as pairs of ids (x, y) to the least id that links reach.
_REACH = """
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)"""

_VECTORS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
{_REACH},
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.y, vec_id)) AS component_id, vec_id <= coalesce(least.y, vec_id) AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id"""

_DUPLICATES_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.t = b.t AND a.doc_id < b.doc_id),
{_REACH},
classed AS (SELECT doc_id, least(doc_id, coalesce(y, doc_id)) AS class_id FROM d LEFT JOIN least ON x = doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classed"""


# the template in SQL: backslashes doubled, and one behind the first sign of each control string
_ESCAPED_SQL = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce({c}, ''), '\\', '\\\\'), '<(\||s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\|>', '|\\>', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
_CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'),
f AS (SELECT *, '<|' || {_ESCAPED_SQL.format(c='role')} || '|>' || chr(10) || {_ESCAPED_SQL.format(c='text')} || '<|end|>' || chr(10) AS formatted FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

_MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
e AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (
  SELECT *, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""

_SESSIONS_SQL = """
WITH RECURSIVE once AS (
  SELECT * FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, arrived_at) = 1),
c AS (
  SELECT client_id, click_id, epoch_us(ts) AS t, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late,
    coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final, CAST(coalesce(floor(value * 100 + 0.5), 0) AS BIGINT) AS cents FROM once),
timely AS (
  SELECT *, row_number() OVER w AS k, lag(t) OVER w AS before, lag(final) OVER w AS before_final, lead(t) OVER w AS after FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY t, click_id)),
broken AS (SELECT *, before IS NULL OR before_final OR t - before >= 900000000 AS head FROM timely),
island AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY k) AS i FROM broken),
times AS (SELECT client_id, i, t, min(k) AS k FROM island GROUP BY ALL),
pointer AS MATERIALIZED (SELECT a.client_id, a.k, b.k AS next FROM island a ASOF JOIN times b ON a.client_id = b.client_id AND a.i = b.i AND a.t + 3600000000 < b.t),
starts AS (SELECT client_id, k FROM island WHERE head UNION SELECT s.client_id, p.next FROM starts s JOIN pointer p ON p.client_id = s.client_id AND p.k = s.k),
placed AS (SELECT island.*, max(s.k) OVER (PARTITION BY island.client_id ORDER BY island.k) AS s FROM island LEFT JOIN starts s ON s.client_id = island.client_id AND s.k = island.k),
found AS (
  SELECT client_id, s, arg_min(click_id, k) AS session_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents, arg_max(final, k) AS final, arg_max(coalesce(after, -1), k) AS after,
    sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY k)) AS path_sha256 FROM placed GROUP BY client_id, s),
spans AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY s) AS until FROM found),
lates AS (SELECT f.client_id, f.s, count(*) AS n FROM c JOIN spans f ON f.client_id = c.client_id AND c.t >= f.start_us AND (f.until IS NULL OR c.t < f.until) WHERE c.late GROUP BY ALL)
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n, 0) AS n_late, value_cents,
  CASE WHEN final THEN 'end' WHEN after < 0 THEN 'none' WHEN after - end_us >= 900000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM spans LEFT JOIN lates USING (client_id, s)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op6_near_vectors": _VECTORS_SQL, "op10_near_duplicates": _DUPLICATES_SQL, "op11_chat_trees": _CHAT_SQL, "op12_fill_in_middle": _MIDDLE_SQL, "op13_gap_sessions": _SESSIONS_SQL}
