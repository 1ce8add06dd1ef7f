"""The functions in SQL are those of the column API; the display SQL of every mode runs and finds the same rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from kinname.functions import names as N
from kinname.functions import sql
from kinname.operators.search import search_unified
from kinname.plans.explain import mode_sql
from kinname.schema import MODES

NAMES = ["John", "Smith", "Smyth", "O'Neil", "", "123", "Ashcraft", "van der Berg", "Éric", "AABB"]


def test_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string")
    df.createOrReplaceTempView("pairs")
    own = df.select(N.soundex(F.col("a")).alias("s"), N.similarity(F.col("a"), F.col("b")).alias("t"), (N.edits(F.col("a"), F.col("b")) <= 2).alias("e")).collect()
    assert spark.sql("SELECT soundex_code(a) s, similarity(a, b) t, within_edits(a, b, 2) e FROM pairs").collect() == own


@pytest.mark.parametrize("mode", list(MODES))
def test_display_sql_runs(spark, mode):
    sql.register(spark)
    df = spark.createDataFrame([(i, a, b, date(1990, 1, 1)) for i, (a, b) in enumerate((a, b) for a in NAMES for b in NAMES)], "id long, first_name string, last_name string, date_of_birth date")
    df.createOrReplaceTempView("people")
    where = mode_sql(mode, "John", "O'Neil").removeprefix(MODES[mode].description).split(" ORDER BY ")[0]  # Spark sorts by no SQL function
    found = {r.id for r in spark.sql(f"SELECT id FROM people WHERE {where}").collect()}
    assert found == {r.id for r in search_unified(df, [mode], "John", "O'Neil").collect()} and found
