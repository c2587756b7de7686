"""L1: fragments over ranges of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import lines, text
from .numbering import numbered
from .turns import range_texts


def create_fragments(inputs: DataFrame, turns: DataFrame, existing: DataFrame | None, arrival: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `fragments` for inputs (date, start_turn_id, end_turn_id, task_desc, result_desc, tags, topic_name, agent_id, arrival), with the input columns `keep`."""
    # Only the dates written to are looked at, so that others' partitions are pruned.
    dates = F.broadcast(inputs.select("date").distinct())
    base = None if existing is None else existing.join(dates, "date", "left_semi").groupBy("date").agg(F.max("frag_no").alias("last"))
    rows = numbered(range_texts(inputs, turns), ["date"], [arrival], F.col(arrival), "frag_no", base=base)
    return rows.select(
        text.fragment_id(F.col("date"), F.col("frag_no")).alias("fragment_id"), "date", "frag_no", "start_turn_id", "end_turn_id", "task_desc", "result_desc", "tags",
        "topic_name", text.slug(F.col("topic_name")).alias("topic_slug"), "agent_id", "turns_text", *keep,
    )


def markdown() -> Column:
    """A fragment row as its Markdown document."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    label = lambda name: F.lit(f"\n**{name}**：")
    heading = lambda name: F.lit(f"\n\n## {name}\n\n")
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    agent = F.when(c("agent_id") != "", F.concat(label(fixed.AGENT), F.col("agent_id"))).otherwise("")
    head = F.concat(
        F.lit(fixed.TASK_TITLE), c("task_desc"), F.lit("\n"), label(fixed.DATE), c("date"), label(fixed.RANGE), c("start_turn_id"), F.lit(" ~ "), c("end_turn_id"),
        label(fixed.TAGS), tags, label(fixed.TOPIC), c("topic_name"), agent,
    )
    return F.concat(head, heading(fixed.SUMMARY), c("task_desc"), heading(fixed.RESULT), c("result_desc"), heading(fixed.TURNS), c("turns_text"), F.lit("\n"))


def parse_markdown(docs: DataFrame, md: str, fragment_id: str) -> DataFrame:
    """Fragments from Markdown documents: the head's labelled lines and, of repeated sections, the last. Documents without task, date or range are left out."""
    parts = F.split(F.concat(F.lit("\n"), F.col(md)), "\n## ")
    head = lines.of(parts[0])
    sections = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.struct(text.trim(F.substring_index(s, "\n", 1)).alias("name"), F.when(F.instr(s, "\n") > 0, F.substr(s, F.instr(s, "\n") + 1)).otherwise("").alias("body")))

    def section(name: str) -> Column:
        return F.coalesce(text.trim(F.try_element_at(F.filter(sections, lambda s: s["name"] == name), F.lit(-1))["body"]), F.lit(""))

    rows = docs.withColumns({"_task": text.trim(lines.after(head, fixed.TASK_TITLE)), "_date": lines.field(head, fixed.DATE), "_range": lines.field(head, fixed.RANGE)}).where("_task <> '' and _date <> '' and _range <> ''")
    ends, topic = F.split("_range", "~"), lines.field(head, fixed.TOPIC)
    return rows.select(
        F.col(fragment_id).alias("fragment_id"), F.col("_date").alias("date"), text.trim(ends[0]).alias("start_turn_id"), text.trim(F.try_element_at(ends, F.lit(2))).alias("end_turn_id"),
        F.col("_task").alias("task_desc"), section(fixed.RESULT).alias("result_desc"), lines.quoted(lines.field(head, fixed.TAGS)).alias("tags"),
        topic.alias("topic_name"), text.slug(topic).alias("topic_slug"), F.nullif(lines.field(head, fixed.AGENT), F.lit("")).alias("agent_id"), section(fixed.TURNS).alias("turns_text"),
    )


def by_date(fragments: DataFrame, date: str) -> DataFrame:
    return fragments.where(F.col("date") == date).select("fragment_id")
