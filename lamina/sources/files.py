"""Import and export of the file forms: JSON Lines of turns, Markdown of fragments, days and topics, JSON vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fragments, topics


def _stem(column: str = "path"):
    return F.regexp_extract(F.col(column), r"([^/]*?)(?:\.[^./]*)?$", 1)


def _folder(column: str = "path"):
    return F.regexp_extract(F.col(column), r"([^/]*)/[^/]*$", 1)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_turns(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Turns of path/<date>/turns.jsonl; seq is the number in the turn id. strict: a bad line fails the read, else it is left out."""
    schema = "turn_id string, role string, content string, timestamp string, agent_id string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(f"{path}/*/turns.jsonl").withColumn("path", F.col("_metadata.file_path"))
    if not strict:
        rows = rows.where("turn_id is not null")
    return rows.select(_folder().alias("date"), F.regexp_extract("turn_id", r"(\d+)$", 1).try_cast("int").alias("seq"), "turn_id", "role", "content", F.try_to_timestamp("timestamp").alias("timestamp"), "agent_id")


def write_turns(turns: DataFrame, path: str) -> None:
    """One folder per date, in turn order; a missing agent is left out of its line."""
    line = F.to_json(F.struct("turn_id", "role", "content", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "agent_id"))
    turns.select("date", "seq", line.alias("value")).repartition("date").sortWithinPartitions("date", "seq").drop("seq").write.partitionBy("date").text(path)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    docs = _texts(spark, f"{path}/*/*.md").select(F.concat_ws("/", _folder(), _stem()).alias("id"), "value")
    return fragments.parse_markdown(docs, "value", "id")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of path/<date>/<id>.embedding; files that are not a JSON array of numbers are left out."""
    rows = _texts(spark, f"{path}/*/*.embedding").select(F.concat_ws("/", _folder(), _stem()).alias("fragment_id"), F.from_json("value", "array<double>").alias("v"))
    return rows.where("v is not null and not exists(v, x -> x is null)").select("fragment_id", F.col("v").cast("array<float>").alias("embedding"))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return _texts(spark, f"{path}/*.md").select(_stem().alias("date"), F.col("value").alias("summary_md"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return topics.parse_markdown(_texts(spark, f"{path}/*.md"), "value")
