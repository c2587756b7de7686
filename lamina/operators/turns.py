"""L0: verbatim turns, numbered per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .numbering import numbered


def append_turns(new: DataFrame, existing: DataFrame | None, arrival: str, now: Column | None = None) -> DataFrame:
    """Rows of `turns` for new (date, role, content, agent_id and a long `arrival` that gives their order), numbered after the turns each date has.
    message_id, if new has it, tells which message of a log a turn comes from."""
    # Only the dates written to are looked at, so that others' partitions are pruned.
    dates = F.broadcast(new.select("date").distinct())
    base = None if existing is None else existing.join(dates, "date", "left_semi").groupBy("date").agg(F.max("seq").alias("last"))
    rows = numbered(new, ["date"], [arrival], F.col(arrival), "seq", base=base)
    return rows.select("date", "seq", text.turn_id(F.col("seq")).alias("turn_id"), "role", "content", (now if now is not None else F.current_timestamp()).alias("timestamp"), "agent_id", F.col("message_id") if "message_id" in new.columns else F.lit(None).cast("long").alias("message_id"))


def range_texts(ranges: DataFrame, turns: DataFrame) -> DataFrame:
    """ranges (date, start_turn_id, end_turn_id, ...) with turns_text: the turns from start to end of the date, as marked paragraphs; '' if either id is unknown or they are inverted."""
    ids = turns.select("date", "turn_id", "seq")
    start, end = ids.withColumnsRenamed({"turn_id": "start_turn_id", "seq": "_a"}), ids.withColumnsRenamed({"turn_id": "end_turn_id", "seq": "_b"})
    known = ranges.select("date", "start_turn_id", "end_turn_id").distinct().join(start, ["date", "start_turn_id"]).join(end, ["date", "end_turn_id"]).where("_a <= _b")
    # Only the turns inside the ranges travel: each range names its seqs, so the join is on (date, seq).
    wanted = known.withColumn("seq", F.explode(F.sequence("_a", "_b")))
    lines = wanted.join(turns.select("date", "seq", text.turn_line(F.col("role"), F.col("content")).alias("line")), ["date", "seq"])
    texts = lines.groupBy("date", "start_turn_id", "end_turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n\n").alias("turns_text"))
    return ranges.join(texts, ["date", "start_turn_id", "end_turn_id"], "left").withColumn("turns_text", F.coalesce("turns_text", F.lit("")))

