"""The name functions for ad-hoc SQL: SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kinname.functions import daitch_mokotoff as dm
from kinname.functions.names import SOUNDEX_DIGITS

_FUNCTIONS = {
    "soundex_code(name STRING) RETURNS STRING": rf"""
        CASE WHEN regexp_replace(upper(name), '^[^A-Z]+', '') = '' THEN '' ELSE
          rpad(substr(concat(substr(regexp_replace(upper(name), '^[^A-Z]+', ''), 1, 1),
            regexp_replace(substr(regexp_replace(translate(regexp_replace(regexp_replace(upper(name), '^[^A-Z]+', ''), '[^A-Z]', 'A'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{SOUNDEX_DIGITS}'), '([0-9])\\1+', '$1'), 2), '[^1-6]', '')), 1, 4), 4, '0') END""",
    "trigrams(name STRING) RETURNS ARRAY<STRING>": r"""
        array_distinct(flatten(transform(filter(split(lower(name), '[^\\p{L}\\p{N}]+'), w -> w <> ''),
          w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))""",
    "similarity(a STRING, b STRING) RETURNS DOUBLE": """
        coalesce(try_divide(CAST(size(array_intersect(trigrams(a), trigrams(b))) AS DOUBLE), CAST(size(array_union(trigrams(a), trigrams(b))) AS DOUBLE)), 0.0D)""",
    "daitch_mokotoff(name STRING) RETURNS ARRAY<STRING>": dm.codes_sql("name"),
    "within_edits(a STRING, b STRING, most INT) RETURNS BOOLEAN": "levenshtein(upper(a), upper(b)) <= most",
}


def register(spark: SparkSession) -> None:
    """soundex_code, trigrams, similarity, within_edits and daitch_mokotoff, for this session."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
