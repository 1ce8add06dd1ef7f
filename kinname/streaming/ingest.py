"""Records that arrive as a stream: appended to the table, with the vocabulary grown by new names only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from kinname.operators import vocabulary
from kinname.operators.day_counts import DayCounts
from kinname.schema import RECORD
from kinname.sources.records import PACKED, ROW_GROUP, exists
from kinname.sources.shared import no_shuffles_left


def append(batch: DataFrame, table: str, names: str, batch_id: int = 0, stream: str = "once", counts: str | None = None) -> None:
    """One micro-batch of a stream; a batch that runs again replaces its own files, so it is appended once.

    Batches are numbered anew by each stream, so a batch's folder has the stream's name in it, too.
    ``read_records`` reads such folders and plain files of one table together. counts: a folder of day counts
    that the batch is added to, from the files that were written, once under the batch's name.
    """
    spark = batch.sparkSession
    part = f"{table}/stream={stream}/batch={batch_id}"
    writer = batch.select([f.name for f in RECORD]).write.mode("overwrite").options(**PACKED)
    writer.option("parquet.block.size", str(ROW_GROUP)).parquet(part)
    written = spark.read.schema(RECORD).parquet(part)  # cheaper than the batch again
    if counts:
        DayCounts(spark, counts).add(written, f"{stream}-{batch_id}")
    fresh = vocabulary.distinct_names(written)
    if exists(spark, names):  # before the codes, which are dear, are made
        fresh = fresh.join(spark.read.parquet(names).select("name"), "name", "left_anti")
    with no_shuffles_left(spark):  # each batch makes some
        vocabulary.coded(fresh).write.mode("append").option("compression", "zstd").parquet(names)


def start(stream: DataFrame, table: str, names: str, checkpoint: str, counts: str | None = None) -> StreamingQuery:
    """Appends all that is there now, in micro-batches, and ends.

    The stream's name is the id that its checkpoint holds: the same after a restart, another one for a new checkpoint.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        name = batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        append(batch, table, names, batch_id, name, counts)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
