"""The nine tools and the memory:// resources over a store. Results are text envelopes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .encode import Encoder, backfill
from .functions import text
from .operators import daily, fragments, listing, search, topics, turns
from .sources import files
from .sources.tables import Store


def _ok(body: Any) -> dict:
    return {"content": [{"type": "text", "text": body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, indent=2)}]}


def _error(message: str) -> dict:
    return _ok(message) | {"isError": True}


def parse_uri(uri: str) -> tuple[str, list[str]] | None:
    """(kind, parameters) of a memory:// address; kind 'root' without any; None for other addresses."""
    if not uri.startswith("memory://"):
        return None
    parts = [p for p in uri.removeprefix("memory://").split("/") if p]
    return (parts[0], parts[1:]) if parts else ("root", [])


class Memory:
    """One writer per store; the bulk methods take DataFrames, the tools single records."""

    def __init__(self, spark: SparkSession, root: str, encoder: Encoder | None = None):
        self.spark, self.store, self.encoder = spark, Store(spark, root), encoder or Encoder()

    # ---- bulk ----

    def store_turns(self, new: DataFrame, arrival: str) -> None:
        self.store.append("turns", turns.append_turns(new, self.store.read("turns"), arrival))

    def store_messages(self, new: DataFrame) -> None:
        """Append turns of a message log (id, date, role, content, agent_id). A message that the store holds is left out, so a batch may come again."""
        dates = F.broadcast(new.select("date").distinct())
        known = self.store.read("turns").where("message_id is not null").join(dates, "date", "left_semi").select(F.col("message_id").alias("id"))
        fresh = new.join(known, "id", "left_anti").withColumn("message_id", F.col("id"))
        self.store.append("turns", turns.append_turns(fresh, self.store.read("turns"), "id"))

    def backfill(self) -> DataFrame:
        """Make the vectors of all fragments anew in place of the stored ones; counts by status ok or skipped."""
        made, counts = backfill(self.store.read("fragments"), self.encoder)
        self.store.replace("vectors", made)
        return counts

    def import_folder(self, path: str, arrival: int = 0) -> None:
        """Take over a folder of the file forms (raw/<date>/turns.jsonl, fragments/<date>/*.md and *.embedding, daily/*.md, topics/*.md) into an empty store."""
        files_of = lambda name, form: self.store.has(f"{path}/{name}", form)
        if files_of("raw", "*/turns.jsonl"):
            self.store.replace("turns", files.read_turns(self.spark, f"{path}/raw", strict=False).withColumn("message_id", F.lit(None).cast("long")))
        if files_of("fragments", "*/*.md"):
            number = F.regexp_extract("fragment_id", r"([0-9]+)$", 1).try_cast("int")
            self.store.replace("fragments", files.read_fragments(self.spark, f"{path}/fragments").withColumn("frag_no", number))
        if files_of("fragments", "*/*.embedding"):
            self.store.replace("vectors", files.read_vectors(self.spark, f"{path}/fragments"))
        if files_of("daily", "*.md"):
            self.store.replace("daily", files.read_daily(self.spark, f"{path}/daily"))
        if files_of("topics", "*.md"):
            entry = files.read_topics(self.spark, f"{path}/topics").withColumn("e", F.explode("entries"))
            self.store.replace("topic_entries", entry.select("topic_slug", "name", "e.date", "e.fragment_id", "e.summary", "status", "constraints", F.lit(arrival).cast("long").alias("arrival")))

    def create_fragments(self, inputs: DataFrame, arrival: str) -> None:
        known = self.store.read("fragments").select("fragment_id")
        self.store.append("fragments", fragments.create_fragments(inputs, self.store.read("turns"), self.store.read("fragments"), arrival))
        if self.encoder.ready:
            self.store.append("vectors", self.encoder.vectors(self.store.read("fragments").join(known, "fragment_id", "left_anti").join(self.store.read("vectors"), "fragment_id", "left_anti")))

    def write_daily(self, writes: DataFrame, arrival: str) -> None:
        old = self.store.read("daily").select("date", "summary_md", F.lit(-1).cast("long").alias(arrival))
        self.store.replace("daily", daily.latest(old.unionByName(writes.select("date", "summary_md", F.col(arrival).cast("long"))), arrival))

    def upsert_topics(self, writes: DataFrame) -> None:
        self.store.replace("topic_entries", topics.upsert(writes, self.store.read("topic_entries")))

    def search(self, queries: list[tuple[str, str]], k: int | None = None, agent: str | None = None) -> DataFrame:
        """Hydrated hits of (query_id, text) pairs: by vector if the encoder gives one for each, else by keywords."""
        owned = self.store.read("fragments")
        vectors = [(q, self.encoder.one(t)) for q, t in queries]
        if all(v for _, v in vectors):
            hits = search.vector_search(self.store.read("vectors"), owned, vectors, k, agent)
        else:
            hits = search.keyword_search(owned, queries, k, agent)
        return search.hydrate(hits, owned, self.store.read("daily"), self.store.read("topic_entries"), search.checked_k(k) * len(queries) <= search.FEW_HITS)

    # ---- tools ----

    def _row(self, values: dict, schema: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(x.split()[0]) for x in schema.split(", "))], schema)

    def memory_store_turn(self, a: dict) -> dict:
        self.store_turns(self._row(a | {"arrival": 0}, "date string, role string, content string, agent_id string, arrival long"), "arrival")
        r = self.store.read("turns").where(F.col("date") == a["date"]).orderBy(F.desc("seq")).first()
        out = {"turn_id": r.turn_id, "role": r.role, "content": r.content, "timestamp": r.timestamp.isoformat(timespec="milliseconds") + "Z"}
        return _ok(out | ({"agent_id": r.agent_id} if r.agent_id is not None else {}))

    def memory_create_fragment(self, a: dict) -> dict:
        schema = "date string, start_turn_id string, end_turn_id string, task_desc string, result_desc string, tags array<string>, topic_name string, agent_id string, arrival long"
        self.create_fragments(self._row(a | {"arrival": 0}, schema), "arrival")
        r = self.store.read("fragments").where(F.col("date") == a["date"]).orderBy(F.desc("frag_no")).first()
        vector = self.store.read("vectors").where(F.col("fragment_id") == r.fragment_id).first()
        return _ok({"fragment_id": r.fragment_id, "task_desc": r.task_desc, "result_desc": r.result_desc, "turns_length": len(r.turns_text), "embedding_dim": len(vector.embedding) if vector else 0, "embedding_mode": self.encoder.mode})

    def memory_create_daily_summary(self, a: dict) -> dict:
        self.write_daily(self._row(a | {"arrival": 0}, "date string, summary_md string, arrival long"), "arrival")
        return _ok(fixed.DAILY_WRITTEN.format(a["date"]))

    def memory_upsert_topic(self, a: dict) -> dict:
        last = self.store.read("topic_entries").agg(F.coalesce(F.max("arrival"), F.lit(0))).first()[0]
        values = {"name": a["topic_name"], "date": a["date"], "fragment_id": a["fragment_id"], "summary": a["summary_md"], "arrival": last + 1}
        self.upsert_topics(self._row(values, "name string, date string, fragment_id string, summary string, arrival long"))
        r = self._topic(a["topic_name"])
        return _ok({"name": r.name, "date_range": {"start": r.start_date, "end": r.end_date}, "status": r.status, "entries": [e.asDict() for e in r.entries], "constraints": list(r.constraints)})

    def memory_search(self, a: dict) -> dict:
        rows = self.search([("q", a["query"])], a.get("top_k"), a.get("agent_id")).orderBy("rank").collect()
        results = []
        for r in rows:
            item = {"fragment_id": r.fragment_id, "score": r.score, "task_desc": r.task_desc, "result_desc": r.result_desc, "tags": list(r.tags or []), "date": r.date, "turns_range": r.turns_range}
            if r.agent_id is not None:
                item["agent_id"] = r.agent_id
            results.append(item | {"hierarchy": {"daily_summary": r.daily_summary, "topic_name": r.topic_name, "topic_summary": r.topic_summary}})
        return _ok({"query": a["query"], "results": results})

    def _topic(self, name: str):
        own = self.store.read("topic_entries").where(F.col("topic_slug") == text.slug(F.lit(name)))
        return topics.index(own).withColumn("md", topics.markdown()).first()

    def _fragment_md(self, fragment_id: str) -> str | None:
        r = self.store.read("fragments").where((F.col("date") == fragment_id.split("/")[0]) & (F.col("fragment_id") == fragment_id)).select(fragments.markdown().alias("md")).first()
        return r.md if r else None

    def _daily_md(self, date: str) -> str | None:
        r = self.store.read("daily").where(F.col("date") == date).first()
        return r.summary_md if r else None

    def memory_get_fragment(self, a: dict) -> dict:
        md = self._fragment_md(a["fragment_id"])
        return _ok(md) if md else _error(fixed.NO_FRAGMENT.format(a["fragment_id"]))

    def memory_get_daily(self, a: dict) -> dict:
        md = self._daily_md(a["date"])
        return _ok(md) if md else _error(fixed.NO_DAILY.format(a["date"]))

    def memory_get_topic(self, a: dict) -> dict:
        r = self._topic(a["topic_name"])
        if r:
            return _ok(r.md)
        known = [x.topic_slug for x in self.store.read("topic_entries").select("topic_slug").distinct().orderBy("topic_slug").collect()]
        return _error(fixed.NO_TOPIC.format(a["topic_name"], ", ".join(known) or fixed.NONE))

    def memory_list_dates(self, a: dict | None = None) -> dict:
        r = listing.date_totals(self.store.read("turns"), self.store.read("daily")).first()
        return _ok({"dates": r.dates.split(",") if r.dates else [], "count": r["count"], "has_raw": r.has_raw, "has_daily": r.has_daily})

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """Run a tool by name; unknown names and failures become error envelopes."""
        tool = getattr(self, name, None) if name in TOOLS else None
        if tool is None:
            return _error(fixed.UNKNOWN_TOOL.format(name))
        try:
            return tool(arguments or {})
        except Exception as e:
            return _error(fixed.TOOL_FAILED.format(name, e))

    # ---- resources ----

    def list_resources(self) -> DataFrame:
        s = self.store
        return listing.resources(s.read("turns"), s.read("fragments"), s.read("daily"), s.read("topic_entries")).orderBy("kind", "uri")

    def read_resource(self, uri: str) -> dict:
        """{uri, mimeType, text}; failures are told in the text."""

        def plain(message: str) -> dict:
            return {"uri": uri, "mimeType": "text/plain", "text": message}

        parsed = parse_uri(uri)
        if parsed is None:
            return plain(fixed.BAD_URI)
        kind, rest = parsed
        if kind not in ("raw", "fragments", "daily", "topics"):
            return plain(fixed.UNKNOWN_KIND.format(kind))
        key = "/".join(rest)
        if kind == "raw":
            fields = F.struct("turn_id", "role", "content", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "agent_id")
            lines = self.store.read("turns").where(F.col("date") == key).orderBy("seq").select(F.to_json(fields).alias("line")).toLocalIterator()
            return {"uri": uri, "mimeType": "application/jsonl", "text": "\n".join(r.line for r in lines)}
        topic = self._topic(key) if kind == "topics" else None
        md = self._fragment_md(key) if kind == "fragments" else self._daily_md(key) if kind == "daily" else topic.md if topic else None
        return {"uri": uri, "mimeType": "text/markdown", "text": md} if md else plain(fixed.READ_FAILED.format(fixed.MISSING[kind]))


TOOLS = ("memory_store_turn", "memory_create_fragment", "memory_create_daily_summary", "memory_upsert_topic", "memory_search", "memory_get_fragment", "memory_get_daily", "memory_get_topic", "memory_list_dates")
