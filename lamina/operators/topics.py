"""L3: topic timelines over dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import lines, text


def upsert(writes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """topic_entries after writes (name, date, fragment_id, summary, arrival): the first writer of a (slug, date) wins, and existing entries came first."""
    new = writes.select(
        text.slug(F.col("name")).alias("topic_slug"), "name", "date", "fragment_id", "summary", F.lit("active").alias("status"), F.array().cast("array<string>").alias("constraints"), "arrival", F.lit(1).alias("_new")
    )
    rows = new if existing is None else existing.withColumn("_new", F.lit(0)).select(new.columns).unionByName(new)
    first = Window.partitionBy("topic_slug", "date").orderBy("_new", "arrival")
    return rows.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at", "_new")


def index(entries: DataFrame) -> DataFrame:
    """One row per topic: name, status and constraints of its earliest entry by arrival, first and last date, entries in date order."""
    line = F.struct("date", "fragment_id", "summary")
    head = F.struct("arrival", "date", "name", "status", "constraints")
    rows = entries.groupBy("topic_slug").agg(F.min(head).alias("_head"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.array_sort(F.collect_list(line)).alias("entries"))
    return rows.select("topic_slug", F.col("_head.name").alias("name"), "start_date", "end_date", F.col("_head.status").alias("status"), F.col("_head.constraints").alias("constraints"), "entries")


def summary(entries: str = "entries") -> Column:
    """date：summary of each entry, joined by ；."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["date"], F.lit("："), e["summary"])), "；")


def markdown() -> Column:
    """An `index` row as its Markdown document."""
    days = F.array_join(F.transform("entries", lambda e: e["date"]), ", ")
    state = F.when(F.col("status") == "active", fixed.ACTIVE).otherwise(fixed.COMPLETED)
    stages = F.array_join(F.transform("entries", lambda e: F.concat(F.lit("- "), e["date"], F.lit("："), e["summary"], F.lit("（→ daily/"), e["date"], F.lit(".md → "), e["fragment_id"], F.lit("）"))), "\n")
    rules = F.when(F.size("constraints") > 0, F.concat(F.lit(f"\n## {fixed.RULES}\n\n"), F.array_join(F.transform("constraints", lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit(fixed.TOPIC_TITLE), F.col("name"), F.lit("（"), F.col("start_date"), F.lit(" ~ "), F.col("end_date"), F.lit(f"）\n\n**{fixed.COVERED}**："), days, F.lit(f"\n**{fixed.STATUS}**："), state, F.lit(f"\n\n## {fixed.STAGES}\n\n"), stages, F.lit("\n"), rules)


def _entries(items: Column) -> Column:
    """Entries from the items of the stages' list. An item without a date at its start goes on with the one before; the last arrow mark
    before the closing parenthesis separates the summary from its references, of which the last is the fragment."""

    def dated(item: Column) -> Column:
        return F.substr(item, F.lit(1), F.lit(10)).try_cast("date").isNotNull() & F.substr(item, F.lit(11), F.lit(1)).isin("：", ":")

    def merge(known: Column, item: Column) -> Column:
        grown = F.concat(F.slice(known, F.lit(1), F.size(known) - 1), F.array(F.concat(F.element_at(known, -1), F.lit("\n- "), item)))
        return F.when(dated(item), F.concat(known, F.array(item))).when(F.size(known) > 0, grown).otherwise(known)

    def entry(item: Column) -> Column:
        parts = F.split(F.substr(item, F.lit(12)), "（→")
        references = F.split(F.substring_index(F.element_at(parts, -1), "）", 1), "→")
        summary = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "（→")
        return F.when(F.size(parts) > 1, F.struct(F.substr(item, F.lit(1), F.lit(10)).alias("date"), text.trim(F.element_at(references, -1)).alias("fragment_id"), text.trim(summary).alias("summary")))

    whole = F.aggregate(items, F.array().cast("array<string>"), merge)
    return F.filter(F.transform(whole, entry), lambda e: e.isNotNull())


def parse_markdown(docs: DataFrame, md: str) -> DataFrame:
    """Topics from Markdown: name, dates, status, constraints and entries with their fragment ids. Documents without a title line that ends with dates in
    parentheses are left out."""
    whole = F.concat(F.lit("\n"), F.coalesce(F.col(md), F.lit("")))
    sections = F.split(whole, "\n## ")
    head = lines.of(sections[0])

    def section(name: str) -> Column:
        own = F.get(F.filter(sections, lambda s: s.startswith(name)), F.lit(0))
        return F.coalesce(F.substr(own, F.instr(own, "\n")), F.lit(""))

    title = text.trim(lines.after(head, fixed.TOPIC_TITLE))
    # The title's last full-width parenthesis holds the dates.
    dates = F.substring_index(F.substring_index(title, "（", -1), "）", 1)
    name = F.substr(title, F.lit(1), F.char_length(title) - F.char_length(F.substring_index(title, "（", -1)) - 1)
    ends = F.split(dates, " ~ ")
    items = F.split(section(fixed.STAGES), "\n- ")
    # The rules' list ends at the first blank line after its first item.
    rules = F.split(section(fixed.RULES), "\n- ")
    rule = lambda r: F.substring_index(r, "\n", 1)
    listed = F.when(F.size(rules) > 1, F.slice(rules, F.lit(2), F.size(rules) - 1)).otherwise(F.array().cast("array<string>"))
    stops = F.array_position(F.transform(listed, lambda r: r.contains("\n\n") | r.endswith("\n")), True)
    listed = F.when(stops > 0, F.slice(listed, F.lit(1), stops.cast("int"))).otherwise(listed)
    rows = docs.where((F.instr(title, "（") > 1) & (F.size(ends) == 2))
    return rows.select(
        text.slug(name).alias("topic_slug"), text.trim(name).alias("name"), text.trim(ends[0]).alias("start_date"), text.trim(ends[1]).alias("end_date"),
        F.when(lines.field(head, fixed.STATUS).contains(fixed.DONE), "completed").otherwise("active").alias("status"),
        F.transform(listed, rule).alias("constraints"), _entries(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))).alias("entries"),
    )
