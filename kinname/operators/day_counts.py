"""Counts of records by day that grow with the table: totals, days, months, years and windows without reading records.

Each write adds one part with the counts of its rows, in a folder of its own name, so a write that runs again
replaces its part and counts once. Counts add up, so parts are summed when they are read; a table's
parts have as many rows together as its writes have days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "date_of_birth date, cnt long"


@dataclass(frozen=True)
class DayCounts:
    """The counts of one table, in a folder."""

    spark: SparkSession
    folder: str

    def add(self, records: DataFrame, part: str) -> None:
        """Counts the rows of one write; ``part`` names it, the same when it runs again."""
        found = records.groupBy("date_of_birth").agg(F.count(F.lit(1)).alias("cnt"))
        found.write.mode("overwrite").parquet(f"{self.folder}/part={part}")

    def restart(self, records: DataFrame, part: str) -> None:
        """Counts a write that replaces the table: other parts go."""
        from kinname.sources.shared import remove

        remove(self.spark, self.folder)
        self.add(records, part)

    def days(self) -> DataFrame:
        """(date_of_birth, cnt) of every day; records without a date are a row, too."""
        from kinname.sources.records import exists

        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], _SCHEMA)
        parts = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)
        return parts.groupBy("date_of_birth").agg(F.sum("cnt").alias("cnt"))

    def total(self) -> DataFrame:
        return self.days().agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))

    def of(self, dates: Sequence[date]) -> DataFrame:
        """How many records each of the dates has; dates without any are left out."""
        return self.days().where(F.col("date_of_birth").isin(list(dates)))

    def in_window(self, low: int = 5, high: int = 20) -> DataFrame:
        """The dates with ``low`` to ``high`` records."""
        return self.days().where(F.col("cnt").between(low, high))

    def hierarchy(self, level: str = "year", within: Column | None = None) -> DataFrame:
        """Counts by year, month or day, as far as ``within`` allows."""
        rows = self.days() if within is None else self.days().where(within)
        period = F.col("date_of_birth") if level == "day" else F.trunc("date_of_birth", level)
        return rows.groupBy(period.alias("period")).agg(F.sum("cnt").alias("cnt"))
