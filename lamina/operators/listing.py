"""Listings, counts and catalogue reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed


def dates(turns: DataFrame, daily: DataFrame) -> DataFrame:
    """(date, has_raw, has_daily) of every date with turns or a summary, each date once."""
    raw = turns.select("date", F.lit(1).alias("r"), F.lit(0).alias("d"))
    days = daily.select("date", F.lit(0).alias("r"), F.lit(1).alias("d"))
    return raw.union(days).groupBy("date").agg(F.max("r").alias("has_raw"), F.max("d").alias("has_daily"))


def date_totals(turns: DataFrame, daily: DataFrame) -> DataFrame:
    """One row: dates, count, has_raw, has_daily."""
    return dates(turns, daily).agg(F.array_join(F.array_sort(F.collect_list("date")), ",").alias("dates"), F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("has_raw"), F.lit(0)).alias("has_raw"), F.coalesce(F.sum("has_daily"), F.lit(0)).alias("has_daily"))


def resources(turns: DataFrame, fragments: DataFrame, daily: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, uri, name, mime_type); kinds in the order raw 0, fragments 1, daily 2, topics 3."""

    def kind(df: DataFrame, key: str, number: int, folder: str, label: str, mime: str) -> DataFrame:
        return df.select(F.lit(number).alias("kind"), F.concat(F.lit(f"memory://{folder}/"), F.col(key)).alias("uri"), F.concat(F.lit(f"{label} "), F.col(key)).alias("name"), F.lit(mime).alias("mime_type"))

    return (
        kind(turns.select("date").distinct(), "date", 0, "raw", fixed.RAW_NAME, "application/jsonl")
        .unionByName(kind(fragments, "fragment_id", 1, "fragments", fixed.FRAGMENT_NAME, "text/markdown"))
        .unionByName(kind(daily, "date", 2, "daily", fixed.DAILY_NAME, "text/markdown"))
        .unionByName(kind(entries.select("topic_slug").distinct(), "topic_slug", 3, "topics", fixed.TOPIC_NAME, "text/markdown"))
    )


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("cnt"))


def sessions_with_agent(sessions: DataFrame) -> DataFrame:
    return sessions.where("agent_id is not null").select("id", "agent_id")


def clipped(df: DataFrame, width: int) -> DataFrame:
    """Every column as text, null as '', cut to width."""
    return df.select(*[F.substring(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), 1, width).alias(c) for c in df.columns])


def report(spark: SparkSession, tables: list[str] | None = None, shown: int = 3, width: int = 80) -> str:
    """Schemas and a few clipped rows of the session's tables, as text."""
    out = []
    for name in sorted(tables if tables is not None else [t.name for t in spark.catalog.listTables()]):
        if name == "sqlite_sequence":
            continue
        df = spark.table(name)
        out += [f"=== {name} ===", df.schema.simpleString(), "Columns: " + ", ".join(df.columns)]
        out += ["  " + " | ".join(r) for r in clipped(df.limit(shown), width).collect()]
    return "\n".join(out)


def statements(code: str) -> list[str]:
    """Every CREATE TABLE statement in a text, from its first word to the parenthesis that closes its columns; quoted parts may hold parentheses."""
    out, low, at = [], code.lower(), 0
    while (at := low.find("create", at)) >= 0:
        words = low[at : at + 200].partition("(")[0].split()
        opens = low.find("(", at)
        if words[1:2] != ["table"] or len(words) not in (3, 6) or opens < 0:
            at += 6
            continue
        depth, quote, end = 0, "", opens
        for end in range(opens, len(code)):
            c = code[end]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
        if depth:
            break
        out.append(code[at : end + 1])
        at = end + 1
    return out


def sniffed(files: DataFrame) -> DataFrame:
    """(path, header_hex, header, create_tables) of files (path, content): the first 16 bytes and every CREATE TABLE statement in the bytes."""

    def run(batches):
        for batch in batches:
            found = [statements((c or b"").decode("latin-1")) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["path", "head", "create_tables"])

    rows = files.select("path", "content").mapInArrow(run, "path string, head binary, create_tables array<string>")
    start = F.substring("head", 1, 16)
    return rows.select("path", F.lower(F.hex(start)).alias("header_hex"), F.decode(start, "ISO-8859-1").alias("header"), "create_tables")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """`sniffed` of the files under a path."""
    return sniffed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def with_suffix(files: DataFrame, suffixes: tuple[str, ...] = (".json", ".db")) -> DataFrame:
    """The rows whose path ends with one of the suffixes."""
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    return files.where(keep)


def find_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".json", ".db")) -> DataFrame:
    return with_suffix(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"), suffixes)


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """df with `position` from 1 in the order given: listings as the interface shows them. For listings of a page's size."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def columns_of(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
