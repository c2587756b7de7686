import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lamina.api import TOOLS, Memory, parse_uri
from lamina.encode import Encoder, backfill
from lamina.operators import daily, fragments, listing, numbering, search, topics, turns
from lamina.sources import files
from lamina.sources.sqlite import SqliteSource
from lamina.streaming import ingest


def letters():
    """Loads an encoder: counts of a, b and c."""

    def load():
        return lambda texts: [[float(t.count(c)) for c in "abc"] for t in texts]

    return load


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(3)}", i) for i in range(0, 30000, 7)]
    rng.shuffle(rows)
    base = spark.createDataFrame([("d1", 10)], "date string, last int")
    got = numbering.numbered(spark.createDataFrame(rows, "date string, k long"), ["date"], ["k"], F.col("k"), "seq", width=100, base=base).collect()
    for d in ("d0", "d1", "d2"):
        own = sorted((r.k, r.seq) for r in got if r.date == d)
        assert [s for _, s in own] == list(range(11 if d == "d1" else 1, len(own) + (11 if d == "d1" else 1)))


def test_turn_ranges(spark):
    new = spark.createDataFrame([("d", r, c, None, i) for i, (r, c) in enumerate([("user", "a"), ("assistant", "b"), ("tool", "c"), ("user", "d")])], "date string, role string, content string, agent_id string, arrival long")
    t = turns.append_turns(new, None, "arrival")
    asked = [("d", "turn_0001", "turn_0003"), ("d", "turn_0003", "turn_0001"), ("d", "turn_0002", "turn_0002"), ("d", "turn_0001", "turn_0009"), ("e", "turn_0001", "turn_0001")]
    got = {(r.date, r.start_turn_id, r.end_turn_id): r.turns_text for r in turns.range_texts(spark.createDataFrame(asked, "date string, start_turn_id string, end_turn_id string"), t).collect()}
    assert [got[a] for a in asked] == ["[用户]：a\n\n[AI]：b\n\n[AI]：c", "", "[AI]：b", "", ""]


def test_fragment_markdown_round_trip_and_last_section_wins(spark):
    rows = [("2025-06-01/frag_001", "2025-06-01", "turn_0001", "turn_0002", "task", "result\nmore", ["x", "y z"], "topic", "a1", "text"), ("2025-06-01/frag_002", "2025-06-01", "turn_0001", "turn_0002", "t", "", [], "", None, "a\n## 结论\nlate")]
    df = spark.createDataFrame(rows, "fragment_id string, date string, start_turn_id string, end_turn_id string, task_desc string, result_desc string, tags array<string>, topic_name string, agent_id string, turns_text string")
    docs = df.select("fragment_id", fragments.markdown().alias("md"))
    got = {r.fragment_id: r for r in fragments.parse_markdown(docs, "md", "fragment_id").collect()}
    assert tuple(got[rows[0][0]])[:7] == rows[0][:7] and got[rows[0][0]].turns_text == "text" and got[rows[0][0]].agent_id == "a1"
    assert got[rows[1][0]].result_desc == "late" and got[rows[1][0]].agent_id is None and got[rows[1][0]].tags == [] and got[rows[1][0]].topic_name == ""
    bad = spark.createDataFrame([("x", "# no task"), ("y", "# 任务：t\n**日期**：d\n")], "id string, md string")
    assert fragments.parse_markdown(bad, "md", "id").count() == 0


def test_daily(spark):
    writes = spark.createDataFrame([("d", "one", 1), ("d", "two", 2), ("e", "", 1)], "date string, summary_md string, arrival long")
    assert {r.date: r.summary_md for r in daily.latest(writes, "arrival").collect()} == {"d": "two", "e": ""}
    texts = spark.createDataFrame([("",), ("no line",), ("x\n**涉及主题**：`a` `b c`\n`d`",), (None,)], "t string")
    assert [r.y for r in texts.select(daily.topics(F.col("t")).alias("y")).collect()] == [[], [], ["a", "b c"], []]


def test_topics_keep_the_first_writer_and_every_id(spark):
    w = lambda rows: spark.createDataFrame(rows, "name string, date string, fragment_id string, summary string, arrival long")
    first = topics.upsert(w([("a b", "2025-06-02", "f1", "s1", 1), ("a  b!", "2025-06-02", "f2", "s2", 2)]))
    again = topics.upsert(w([("a b", "2025-06-02", "f3", "s3", 0), ("other name", "2025-06-01", "x", "", 3), ("a b", "2025-06-01", "f4", "multi\nline", 4)]), first)
    r = {t.topic_slug: t for t in topics.index(again).withColumn("md", topics.markdown()).collect()}
    t = r["a-b"]
    assert (t.name, t.start_date, t.end_date, t.status) == ("a b", "2025-06-01", "2025-06-02", "active") and [e.fragment_id for e in t.entries] == ["f4", "f1"]
    back = topics.parse_markdown(spark.createDataFrame([(x.md,) for x in r.values()], "md string"), "md").collect()
    assert {b.topic_slug: [tuple(e) for e in b.entries] for b in back} == {s: [tuple(e) for e in x.entries] for s, x in r.items()}
    hand = t.md.replace("进行中", "未完成") + "\n## 关键约束\n\n- one\n- two\n\n- not\n"
    p = topics.parse_markdown(spark.createDataFrame([(hand,)], "md string"), "md").first()
    assert p.status == "completed" and p.constraints == ["one", "two"]


def _frags(spark, rows):
    return spark.createDataFrame([(i, "2025-06-01", 1, "turn_0001", "turn_0002", t, "", [], topic, topic, agent, "") for i, t, topic, agent in rows], "fragment_id string, date string, frag_no int, start_turn_id string, end_turn_id string, task_desc string, result_desc string, tags array<string>, topic_name string, topic_slug string, agent_id string, turns_text string")


def test_vector_search(spark):
    frags = _frags(spark, [("d/2", "x", "t", None), ("d/1", "x", "", "a1"), ("d/3", "x", "none", "a1"), ("d/4", "x", "", "a2")])
    vectors = spark.createDataFrame([("d/1", [1.0, 0.0]), ("d/2", [1.0, 0.0]), ("d/3", [1.0, 1.0]), ("d/4", [-1.0, 0.0]), ("gone", [1.0, 0.0]), ("d/4", None)], "fragment_id string, embedding array<float>").repartition(3)
    got = lambda *a: [(r.fragment_id, r.rank) for r in search.vector_search(vectors, frags, [("q", [1.0, 0.0])], *a).orderBy("rank").collect()]
    assert got() == [("d/1", 1), ("d/2", 2), ("d/3", 3)] and got(None, "") == got() and got(1) == [("d/1", 1)] and got(0) == []
    assert got(10, "a1") == [("d/1", 1), ("d/3", 2)] and got(10, "zzz") == []
    with pytest.raises(ValueError):
        search.checked_k(-1)
    entries = topics.upsert(spark.createDataFrame([("t", "2025-06-01", "d/2", "sum", 1)], "name string, date string, fragment_id string, summary string, arrival long"))
    days = spark.createDataFrame([("2025-06-01", "")], "date string, summary_md string")
    rows = {r.fragment_id: r for r in search.hydrate(search.vector_search(vectors, frags, [("q", [1.0, 0.0])]), frags, days, entries).collect()}
    assert rows["d/2"].topic_summary == "2025-06-01：sum" and rows["d/1"].topic_summary is None and rows["d/3"].topic_summary is None and rows["d/1"].daily_summary is None
    assert rows["d/3"].score == 0.7071 and rows["d/1"].turns_range == "turn_0001 ~ turn_0002"


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rng = random.Random(2)
    data = [(f"f{i:03d}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    frags = _frags(spark, [(i, "", "", None) for i, _ in data])
    asked = [(str(k), [rng.gauss(0, 1) for _ in range(4)]) for k in range(5)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    got = search.vector_search(spark.createDataFrame(data, "fragment_id string, embedding array<double>"), frags, asked, 7).collect()
    for q, v in asked:
        want = sorted(data, key=lambda d: -cos(d[1], v))[:7]
        assert [r.fragment_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in want]


def test_keyword_search(spark):
    frags = _frags(spark, [("1", "alpha beta", "", None), ("2", "alpha", "", "a"), ("3", "gamma", "", "a"), ("4", "粒子系统", "", None)])
    got = [(r.query_id, r.fragment_id, round(r.score, 3)) for r in search.keyword_search(frags, [("q", "Alpha"), ("z", "粒子"), ("e", "")]).orderBy("query_id", "rank").collect()]
    assert got == [("q", "2", 1.0), ("q", "1", 0.5), ("z", "4", 0.429)]


def test_list_dates_and_resources(spark):
    t = spark.createDataFrame([("d1",), ("d1",), ("d2",)], "date string")
    d = spark.createDataFrame([("d2", "x"), ("d3", "y")], "date string, summary_md string")
    r = listing.date_totals(t, d).first()
    assert (r.dates, r["count"], r.has_raw, r.has_daily) == ("d1,d2,d3", 3, 2, 2)
    assert listing.date_totals(t.limit(0), d.limit(0)).first()["count"] == 0


def test_addresses():
    assert parse_uri("memory://raw/d") == ("raw", ["d"]) and parse_uri("memory://") == ("root", []) and parse_uri("http://x") is None and parse_uri("memory://zzz/1") == ("zzz", ["1"])


def test_the_nine_tools(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), Encoder(letters()))
    call = lambda name, **a: m.call(name, a)
    body = lambda r: json.loads(r["content"][0]["text"])
    assert body(call("memory_store_turn", date="2025-06-01", role="user", content="aa?"))["turn_id"] == "turn_0001"
    assert body(call("memory_store_turn", date="2025-06-01", role="assistant", content="bb", agent_id="x"))["agent_id"] == "x"
    made = body(call("memory_create_fragment", date="2025-06-01", start_turn_id="turn_0001", end_turn_id="turn_0002", task_desc="aaa", result_desc="", tags=["k"], topic_name="Big topic"))
    assert made["fragment_id"] == "2025-06-01/frag_001" and made["embedding_dim"] == 3 and made["turns_length"] == len("[用户]：aa?\n\n[AI]：bb")
    call("memory_create_fragment", date="2025-06-01", start_turn_id="turn_0002", end_turn_id="turn_0002", task_desc="ccc", result_desc="", tags=[], topic_name="")
    assert "2025-06-01" in call("memory_create_daily_summary", date="2025-06-01", summary_md="first")["content"][0]["text"]
    call("memory_create_daily_summary", date="2025-06-01", summary_md="second")
    call("memory_upsert_topic", topic_name="Big topic", date="2025-06-01", fragment_id=made["fragment_id"], summary_md="s")
    assert [e["summary"] for e in body(call("memory_upsert_topic", topic_name="Big topic", date="2025-06-01", fragment_id="z", summary_md="ignored"))["entries"]] == ["s"]
    found = body(call("memory_search", query="a", top_k=1))["results"]
    assert found[0]["fragment_id"] == made["fragment_id"] and found[0]["hierarchy"] == {"daily_summary": "second", "topic_name": "Big topic", "topic_summary": "2025-06-01：s"} and "agent_id" not in found[0]
    assert call("memory_get_fragment", fragment_id=made["fragment_id"])["content"][0]["text"].startswith("# 任务：aaa")
    assert call("memory_get_fragment", fragment_id="2025-06-01/none")["isError"] and call("memory_get_daily", date="x")["isError"]
    assert call("memory_get_daily", date="2025-06-01")["content"][0]["text"] == "second"
    assert "s（→ daily/" in call("memory_get_topic", topic_name="Big topic")["content"][0]["text"]
    missing = call("memory_get_topic", topic_name="none")
    assert missing["isError"] and "Big-topic" in missing["content"][0]["text"]
    assert body(call("memory_list_dates")) == {"dates": ["2025-06-01"], "count": 1, "has_raw": 1, "has_daily": 1}
    assert call("nope")["isError"] and call("memory_search")["isError"] and len(TOOLS) == 9
    uris = [r.uri for r in m.list_resources().collect()]
    assert uris == ["memory://raw/2025-06-01", "memory://fragments/2025-06-01/frag_001", "memory://fragments/2025-06-01/frag_002", "memory://daily/2025-06-01", "memory://topics/Big-topic"]
    for uri in uris:
        assert m.read_resource(uri)["mimeType"] != "text/plain" and m.read_resource(uri)["text"]
    assert len(m.read_resource("memory://raw/2025-06-01")["text"].splitlines()) == 2
    for uri in ("http://x", "memory://", "memory://zzz/1", "memory://daily/none"):
        assert m.read_resource(uri)["mimeType"] == "text/plain"
    plain = Memory(spark, str(tmp_path / "store"))
    assert body(plain.call("memory_search", {"query": "ccc"}))["results"][0]["fragment_id"].endswith("frag_002")


def test_backfill(spark):
    frags = _frags(spark, [("1", "a", "", None), ("2", "zzz", "", None)])
    vectors, counts = backfill(frags, Encoder(letters()))
    assert vectors.count() == 2 and {r.status: r["count"] for r in counts.collect()} == {"ok": 2}
    with pytest.raises(RuntimeError):
        backfill(frags, Encoder())


def test_file_forms(spark, tmp_path):
    day = tmp_path / "raw" / "2025-06-01"
    day.mkdir(parents=True)
    (day / "turns.jsonl").write_text('{"turn_id":"turn_0001","role":"user","content":"a","timestamp":"2025-06-01T10:00:00.000Z"}\n{"turn_id":"turn_0002","role":"assistant","content":"b","timestamp":"x","agent_id":"z"}\n')
    t = files.read_turns(spark, str(tmp_path / "raw")).orderBy("seq").collect()
    assert [(r.date, r.seq, r.agent_id) for r in t] == [("2025-06-01", 1, None), ("2025-06-01", 2, "z")]
    files.write_turns(files.read_turns(spark, str(tmp_path / "raw")), str(tmp_path / "out"))
    assert '"agent_id"' not in next((tmp_path / "out" / "date=2025-06-01").glob("*.txt")).read_text().splitlines()[0]
    (day / "turns.jsonl").write_text("broken\n")
    with pytest.raises(Exception):
        files.read_turns(spark, str(tmp_path / "raw")).collect()
    frag = tmp_path / "fragments" / "2025-06-01"
    frag.mkdir(parents=True)
    (frag / "frag_001.md").write_text("# 任务：t\n\n**日期**：2025-06-01\n**轮次**：turn_0001 ~ turn_0002\n**标签**：`x`\n**主题**：p\n\n## 摘要\n\nt\n\n## 结论\n\nr\n\n## 原文\n\n[用户]：a\n")
    for name, body in (("frag_001", "[1, 0.5]"), ("frag_002", "oops"), ("frag_003", "null"), ("frag_004", '[1, "x"]')):
        (frag / f"{name}.embedding").write_text(body)
    assert files.read_fragments(spark, str(tmp_path / "fragments")).first().fragment_id == "2025-06-01/frag_001"
    assert [(r.fragment_id, r.embedding) for r in files.read_vectors(spark, str(tmp_path / "fragments")).collect()] == [("2025-06-01/frag_001", [1.0, 0.5])]
    (tmp_path / "daily").mkdir()
    (tmp_path / "daily" / "2025-06-01.md").write_text("day")
    assert files.read_daily(spark, str(tmp_path / "daily")).first().date == "2025-06-01"


def _database(path, rows):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS sessions (id TEXT, agent_id TEXT)")
    db.execute("CREATE TABLE IF NOT EXISTS session_messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, created_at TEXT)")
    db.execute("INSERT INTO sessions SELECT 's1', 'agent' WHERE NOT EXISTS (SELECT 1 FROM sessions)")
    db.executemany("INSERT INTO session_messages VALUES (?, ?, ?, ?, ?)", rows)
    db.commit()
    db.close()


def test_the_log_is_tailed_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(SqliteSource)
    path = str(tmp_path / "log.db")
    message = lambda i: (i, "s1" if i % 2 else "s2", "assistant" if i % 3 else "system", "x" if i % 10 == 5 else f"message {i}", None if i == 7 else f"2025-06-0{1 + i % 2} 10:00:00")
    _database(path, [message(i) for i in range(1, 121)])
    sessions = lambda: spark.read.format("sqlite").option("path", path).option("table", "sessions").load()
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        stream = spark.readStream.format("sqlite").option("path", path).load()
        ingest.start(spark, stream, sessions, out, marks, None).awaitTermination(120)
        return sorted(ingest.read_log(spark, out).collect(), key=lambda r: r.id)

    first = run()
    kept = [i for i in range(1, 121) if i % 10 != 5 and i != 7]
    assert [r.id for r in first] == [i for i in kept if i <= first[-1].id]
    _database(path, [message(i) for i in range(121, 151)])
    rows = run()
    for _ in range(4):
        if rows[-1].id < 150:
            rows = run()
    assert [r.id for r in rows] == [i for i in range(1, 151) if i % 10 != 5 and i != 7]
    for d in ("2025-06-01", "2025-06-02"):
        own = [r for r in rows if r.date == d]
        assert [r.seq for r in own] == list(range(1, len(own) + 1))
    assert all((r.agent_id == "agent") == bool(r.id % 2) and r.role == ("assistant" if r.id % 3 else "user") for r in rows)
    assert ingest.quarantined(spark.read.format("sqlite").option("path", path).load()).count() == 1
    batch = spark.read.format("sqlite").option("path", path).load().where("id > 140")
    ingest.apply_batch(spark, out, batch, sessions(), 99)
    assert ingest.read_log(spark, out).count() == len(rows)
    sniffed = listing.sniff(spark, path).first()
    assert sniffed.header_hex == b"SQLite format 3\0".hex() and len(sniffed.create_tables) == 2
    assert listing.find_files(spark, str(tmp_path)).where("endswith(path, 'log.db')").count() == 1


def test_report(spark):
    spark.createDataFrame([(1, None), (2, "x" * 200)], "a int, b string").createOrReplaceTempView("shown")
    lines = listing.report(spark, ["shown", "sqlite_sequence"]).splitlines()
    assert lines[0] == "=== shown ===" and lines[2] == "Columns: a, b" and lines[3] == "  1 | " and len(lines[4]) == len("  2 | ") + 80


def test_ingested_messages_reach_the_memory(spark, tmp_path):
    spark.dataSource.register(SqliteSource)
    path = str(tmp_path / "log.db")
    _database(path, [(i, "s1", "user", f"hello {i}" if i != 3 else "😀", "2025-06-01 10:00:00") for i in range(1, 8)])
    sessions = lambda: spark.read.format("sqlite").option("path", path).option("table", "sessions").load()
    m = Memory(spark, str(tmp_path / "store"))
    m.call("memory_store_turn", {"date": "2025-06-01", "role": "user", "content": "first"})
    stream = spark.readStream.format("sqlite").option("path", path).load()
    ingest.start_into(m, stream, sessions, str(tmp_path / "marks"), None).awaitTermination(120)
    batch = spark.read.format("sqlite").option("path", path).load()
    m.store_messages(ingest.transform(batch, sessions()))  # again
    got = m.store.read("turns").orderBy("seq").collect()
    assert [(r.seq, r.message_id) for r in got] == [(1, None), *((i + 1, i) for i in range(1, 8))]
    assert len(m.read_resource("memory://raw/2025-06-01")["text"].splitlines()) == 8


def test_an_encoder_that_fails_falls_back_and_loads_once(spark, tmp_path):
    calls = []

    def load():
        calls.append(1)
        raise OSError("no model")

    m = Memory(spark, str(tmp_path / "store"), Encoder(load))
    made = m.call("memory_create_fragment", {"date": "2025-06-01", "start_turn_id": "a", "end_turn_id": "b", "task_desc": "alpha", "result_desc": "", "tags": [], "topic_name": ""})
    assert json.loads(made["content"][0]["text"])["embedding_mode"] == "fallback"
    found = m.call("memory_search", {"query": "alpha"})
    assert json.loads(found["content"][0]["text"])["results"][0]["score"] == 1 and len(calls) == 1
    with pytest.raises(RuntimeError):
        m.backfill()


def test_backfill_and_import_into_the_store(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), Encoder(letters()))
    folder = tmp_path / "old"
    for name in ("raw/2025-06-01", "fragments/2025-06-01", "daily", "topics"):
        (folder / name).mkdir(parents=True)
    (folder / "raw/2025-06-01/turns.jsonl").write_text('{"turn_id":"turn_0001","role":"user","content":"a","timestamp":"2025-06-01T10:00:00.000Z"}\n')
    (folder / "fragments/2025-06-01/frag_007.md").write_text("# 任务：aab\n\n**日期**：2025-06-01\n**轮次**：turn_0001 ~ turn_0001\n**标签**：`x`\n**主题**：p\n\n## 摘要\n\nt\n\n## 结论\n\nr\n\n## 原文\n\n[用户]：a\n")
    (folder / "daily/2025-06-01.md").write_text("day")
    (folder / "topics/p.md").write_text("# 主题：p（2025-06-01 ~ 2025-06-01）\n\n**涵盖日期**：2025-06-01\n**状态**：进行中\n\n## 各阶段\n\n- 2025-06-01：s（→ daily/2025-06-01.md → 2025-06-01/frag_007）\n")
    m.import_folder(str(folder))
    assert {r.status: r["count"] for r in m.backfill().collect()} == {"ok": 1}
    (hit,) = m.search([("q", "aa")]).collect()
    assert (hit.fragment_id, hit.daily_summary, hit.topic_summary) == ("2025-06-01/frag_007", "day", "2025-06-01：s")
    m.call("memory_create_fragment", {"date": "2025-06-01", "start_turn_id": "turn_0001", "end_turn_id": "turn_0001", "task_desc": "c", "result_desc": "", "tags": [], "topic_name": ""})
    assert sorted(r.frag_no for r in m.store.read("fragments").collect()) == [7, 8]


def test_table_statements_are_balanced():
    code = "x CREATE TABLE a (p DECIMAL(10,2), q TEXT DEFAULT ')') ; create  table if not exists b(c int) CREATE INDEX i (c) CREATE TABLE broken (a"
    assert listing.statements(code) == ["CREATE TABLE a (p DECIMAL(10,2), q TEXT DEFAULT ')')", "create  table if not exists b(c int)"]


def test_few_and_many_keyword_queries_agree(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "gamma_1", "粒子", "系统", "é", "delta"])
    frags = _frags(spark, [(f"f{i}", " ".join(word() for _ in range(rng.randrange(6))), "", None) for i in range(60)])
    asked = [("a", "alpha 粒子系"), ("b", "BETA gamma_1 gamma_1"), ("c", "é !"), ("d", "delta")]
    run = lambda: [tuple(r) for r in search.keyword_search(frags, asked, 7).select("query_id", "rank", "fragment_id", F.round("score", 9)).orderBy("query_id", "rank").collect()]
    few = run()
    monkeypatch.setattr(search, "FEW_QUERIES", 0)
    assert few == run() and len({r[0] for r in few}) == 3


def test_equal_vectors_leave_few_rows_a_batch(spark):
    rows = [(f"f{(i * 37) % 500:03d}", [1.0, 0.0]) for i in range(500)] + [("z", [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "fragment_id string, embedding array<double>").coalesce(1)
    scored = search.vector_scores(vectors, [("q", [1.0, 0.0])], 5)
    assert scored.count() <= 5 * 4 and search.vector_scores(vectors, [("q", [1.0, 0.0])], 0).count() == 0
    assert [r.fragment_id for r in search.best(scored, 5).orderBy("rank").collect()] == [f"f{i:03d}" for i in range(5)]
