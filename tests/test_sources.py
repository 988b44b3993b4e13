from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorecast.functions import extraction
from lorecast.operators import memory
from lorecast.plans.recall import Question
from lorecast.sources import chunking, parsers
from lorecast.streaming import sessions


def test_plain_text_offsets_and_lines(spark):
    text = "\n\nfirst line\nsecond\n\n\n  third  \n\n"
    df = spark.createDataFrame([("s", text), ("e", ""), ("n", None)], "source_id string, content string")
    rows = parsers.plain_text(df).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["first line\nsecond", "third"]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)
    assert [(r.line_start, r.line_end) for r in rows] == [(3, 4), (7, 7)]


def test_markdown_sections_code_and_parents(spark):
    text = "intro\n\n# One\n\npara one\n\n```py\n# no heading\n```\n\n## Two\npara two\n# Three\nlast"
    rows = parsers.parse_markdown(text)
    assert [(r[1], r[2]) for r in rows] == [("paragraph", None), ("section", None), ("paragraph", 1), ("code_block", 1), ("section", 1), ("paragraph", 4), ("section", None), ("paragraph", 6)]
    assert rows[3][4].startswith("```py")
    df = spark.createDataFrame([("s", text)], "source_id string, content string")
    got = parsers.with_parents(parsers.markdown(df)).orderBy("ordinal").collect()
    assert got[2].parent_segment_id == "SEG_s_1"
    assert got[0].parent_segment_id is None


def test_chat_lines_skip_what_is_malformed(spark):
    lines = [
        '{"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "2025-01-01T10:00:00Z"}',
        "not json", '{"type": "progress", "content": "x"}', '{"type": "user", "isMeta": true, "content": "x"}',
        '{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hello"}, {"type": "tool_use", "name": "ls", "input": "{}"}]}, "timestamp": 1735725600000}',
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source_id string, line_no int, line string")
    rows = parsers.chat_lines(df).orderBy("ordinal").collect()
    assert [(r.role, r.segment_type, r.text) for r in rows] == [("user", "message", "hi"), ("assistant", "thinking", "hm"), ("assistant", "message", "hello"), ("assistant", "tool_call", "ls {}")]
    assert rows[0].message_timestamp == rows[1].message_timestamp == datetime(2025, 1, 1, 10)


def test_running_heads_and_known_sources(spark):
    pages = spark.createDataFrame([("d", p, f"HEAD\nbody {p}\n{p}") for p in range(6)], "source_id string, page int, text string")
    assert {r.text for r in parsers.repeated_page_lines(pages).collect()} == {f"body {p}" for p in range(6)}
    new = spark.createDataFrame([("a", "t", "x"), ("b", "t", "x"), ("c", "t", "y")], "source_id string, tenant string, content string")
    known = parsers.new_sources(new.where("source_id = 'c'"), new.limit(0).withColumn("checksum", F.lit(""))).select("checksum", "tenant")
    assert parsers.new_sources(new, known).count() == 1
    with pytest.raises(ValueError, match="no reader"):
        parsers.reader_for("image/png")


def test_chunks_and_episodes(spark):
    long = "\n\n".join(f"Paragraph {i} " + "word " * 150 for i in range(12))
    df = spark.createDataFrame([("a", long, 2), ("b", "short", 3), ("c", None, 4)], "id string, text string, ordinal int")
    rows = chunking.chunks(df, "id", "text", "ordinal").collect()
    big = [r for r in rows if r.id == "a"]
    assert len(big) > 1
    assert all(len(r.text) // 4 <= 810 for r in big)
    assert "".join("".join(r.text.split()) for r in sorted(big, key=lambda r: r.ordinal)) == "".join(long.split())
    assert [(r.ordinal, r.chunk_total) for r in rows if r.id == "b"] == [(3, 1)]
    at = lambda m: datetime(2025, 1, 1, 10 + m // 60, m % 60)
    talk = [("s", 0, at(0), "user", "Alpha Beta is slow"), ("s", 1, at(5), "assistant", "Alpha Beta was rebuilt"), ("s", 2, at(6), "user", "Gamma Delta failed"), ("s", 3, at(50), "user", "ok"), ("s", 4, at(51), "user", "now let's deploy")]
    df = spark.createDataFrame(talk, "source string, o int, ts timestamp, role string, text string")
    found = chunking.episodes(df, "source", "o", "ts", "role", "text")
    assert [r.episode for r in found.orderBy("o").collect()] == [1, 1, 2, 3, 4]
    assert {r.episode: r.title for r in chunking.episode_titles(found, "source", "o", "role", "text").collect()}[2] == "Gamma Delta failed"


def test_extraction(spark):
    df = spark.createDataFrame([(1, "The index broke because the disk was full. Restarting led to lost rows!"), (2, None), (3, "")], "id int, text string")
    got = {(r.relation, r.cause, r.effect) for r in extraction.causes(df, "id", "text").collect()}
    assert got == {("because", "the disk was full", "The index broke"), ("led_to", "Restarting", "lost rows")}
    row = df.where("id = 1").select(extraction.claim(F.lit("The store uses two disks.")).alias("c"), extraction.steps(F.lit("1. open it\n2. close it")).alias("s"), extraction.dates(F.lit("on 2025-03-04 and March 2, 2025, not 2025-13-40")).alias("d")).first()
    assert (row.c.subject, row.c.predicate, row.c.object) == ("The store", "uses", "two disks")
    assert row.s == ["open it", "close it"]
    assert [str(d) for d in row.d] == ["2025-03-02", "2025-03-04"]


def test_streams_agree_with_batches(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = sessions.drain(sessions.session_windows(sessions.read_events(spark, folder)), "t_sessions", str(tmp_path / "a")).collect()
    from lorecast.operators.relational import sessions as batch

    whole = {(r.user_id, r.started, r.events) for r in batch(events, "user_id", "ts", 3600, "event_id").collect()}
    assert closed
    assert {(r.user_id, r.started, r.events) for r in closed} <= whole
    changes = sessions.drain(sessions.state_changes(sessions.read_events(spark, folder)), "t_changes", str(tmp_path / "b"))
    assert changes.where("before = after").count() == 0
    assert changes.count() > 0


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = sessions.upsert_sink(str(tmp_path / "t"), ["k"], "v")
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    two = spark.createDataFrame([("a", 2), ("b", 0)], "k string, v int")
    for number, batch in ((0, one), (1, two), (1, two)):
        write(batch, number)
    last = sorted((tmp_path / "t").glob("v*"))[-1]
    assert {(r.k, r.v) for r in spark.read.parquet(str(last)).collect()} == {("a", 2), ("b", 1)}


def test_leader_clusters_and_proposals(spark):
    rows = [("t", "a", [1.0, 0.0]), ("t", "b", [0.99, 0.1]), ("t", "c", [0.0, 1.0]), (None, "d", [1.0, 0.0]), ("t", "e", None)]
    df = spark.createDataFrame(rows, "tenant string, id string, v array<float>")
    got = {r.member: r.leader for r in memory.leader_clusters(df, "tenant", "id", "v").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}
    ent = spark.createDataFrame([("x", 5), ("y", 9), ("z", 1)], "id string, m int")
    pairs = spark.createDataFrame([("x", "y", 0.8), ("x", "z", 0.7)], "a string, b string, similarity double")
    assert {(r.keep, r["drop"]) for r in memory.merge_proposals(pairs, ent, "id", ["m"]).collect()} == {("y", "x"), ("x", "z")}


def test_questions_are_checked():
    with pytest.raises(ValueError, match="question"):
        Question(())
    with pytest.raises(ValueError, match="100"):
        Question(("a",), k=101)
