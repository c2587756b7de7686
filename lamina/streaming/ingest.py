"""Incremental ingest: a message log tailed by id becomes numbered turns, each message once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.numbering import numbered

MIN_LENGTH = 2


def transform(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, date, role, content, agent_id) of messages (id, session_id, role, content, created_at) with text of two
    UTF-16 units or more (a character beyond the basic plane counts two). A message without a usable date is left to `quarantined`."""
    agents = sessions.where("agent_id is not null").groupBy(F.col("id").alias("session_id")).agg(F.min("agent_id").alias("agent_id"))
    rows = messages.withColumn("content", text.message_text(F.col("content"))).where((text.utf16_length(text.trim(F.col("content"))) >= MIN_LENGTH) & F.col("created_at").isNotNull())
    return rows.join(agents, "session_id", "left").select("id", F.substring("created_at", 1, 10).alias("date"), text.stored_role(F.col("role")).alias("role"), "content", "agent_id")


def quarantined(messages: DataFrame) -> DataFrame:
    """Messages that have no date or no content: they never stall the log."""
    return messages.where("created_at is null or content is null")


def poll(messages: DataFrame, last: int, limit: int = 50) -> DataFrame:
    """The next `limit` messages past id `last`."""
    return messages.where(F.col("id") > last).orderBy("id").limit(limit)


def watermark(batch: DataFrame, last: int) -> DataFrame:
    """One row: the id to go on from; skipped messages count too."""
    return batch.agg(F.coalesce(F.greatest(F.max("id"), F.lit(last)), F.lit(last)).cast("long").alias("last_id"))


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, sessions: DataFrame, epoch: int, now: Column | None = None) -> None:
    """Write a batch's turns to path/epoch=<epoch>, overwriting what a failed attempt left, so a replay changes nothing.
    Numbers of a date go on after its last turn in other epochs; ids seen in other epochs are left out."""
    log = f"{path}/epoch={epoch}"
    known = read_log(spark, path).where(F.col("epoch") != epoch)
    new = transform(batch.dropDuplicates(["id"]), sessions).join(known.select("id"), "id", "left_anti")
    base = known.groupBy("date").agg(F.max("seq").alias("last"))
    rows = numbered(new, ["date"], ["id"], F.col("id"), "seq", base=base)
    stamp = now if now is not None else F.current_timestamp()
    rows.select("id", "date", "seq", text.turn_id(F.col("seq")).alias("turn_id"), "role", "content", stamp.alias("timestamp"), "agent_id").write.mode("overwrite").parquet(log)


_LOG = "id long, date string, seq int, turn_id string, role string, content string, timestamp timestamp, agent_id string, epoch int"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Turns that `start` has written, with their message id and epoch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).option("basePath", path).parquet(path)


def start(spark: SparkSession, messages: DataFrame, sessions, path: str, checkpoint: str, interval: str | None = "3 seconds"):
    """A running query that turns a stream of messages into turns under path. sessions: a function that reads the
    sessions table, called for each batch. interval None: take what is there and stop."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        apply_batch(batch.sparkSession, path, batch, sessions(), epoch)
        batch.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def start_into(memory, messages: DataFrame, sessions, checkpoint: str, interval: str | None = "3 seconds"):
    """As `start`, into the turns of a `Memory`: fragments, search, listings and resources see them."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        memory.store_messages(transform(batch.dropDuplicates(["id"]), sessions()))
        batch.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
