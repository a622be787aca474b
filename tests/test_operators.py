"""Hand-made rows for operators: edges that the fixture tables don't hold."""

from __future__ import annotations

import datetime as dt
import json
import random
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.functions import dates, text, vectors
from threadloom.operators import archive, cluster, graph, knowledge, library, rounds, similarity, temporal
from threadloom.sources import documents as docs
from threadloom.sources import keyvalue, logs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("day", "iso", "calendar"), [("2024-12-30", "2025-W01", "2024-W01"), ("2024-03-05", "2024-W10", "2024-W10"), ("2021-01-03", "2020-W53", "2021-W53")])
def test_week_labels_at_year_ends(spark, day, iso, calendar):
    d = F.to_date(F.lit(day))
    assert (one(spark, dates.iso_week_label(d)), one(spark, dates.calendar_week_label(d))) == (iso, calendar)


@pytest.mark.parametrize(("given", "seconds"), [("1:02:03", 3723), ("02:03", 123), ("PT1H2M3S", 3723), ("PT5M", 300), ("soon", None)])
def test_durations(spark, given, seconds):
    assert one(spark, dates.duration_seconds(F.lit(given))) == seconds


def test_iso_times_with_offsets(spark):
    for given in ("2026-01-12T15:30:45Z", "2026-01-12T15:30:45+00:00", "2026-01-12T17:30:45+02:00"):
        assert one(spark, dates.to_millis(F.lit(given))) == 1768231845000
    assert one(spark, dates.to_millis(F.lit("never"))) is None


def test_cosine_of_zero_and_unlike_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(0, 0), v(1, 2))) == 0.0
    assert one(spark, vectors.cosine(v(1, 0, 0), v(1, 2))) == 0.0
    assert one(spark, vectors.cosine(v(3, 4), v(3, 4))) == pytest.approx(1)
    assert one(spark, vectors.cosine(F.lit(None).cast("array<float>"), v(1, 2))) is None


def test_text_functions(spark):
    assert one(spark, text.slugify(F.lit("  Ada & Bob's Talk!"))) == "ada-bob-s-talk"
    assert one(spark, text.shortened(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, text.trace_ids(F.lit("x # @trace-id: a1\n#@TRACE-ID:b2"))) == ["a1", "b2"]
    assert one(spark, text.path_from_folder(F.lit("-Users-me-My%20Folder"))) == "/Users-me-My Folder"
    assert one(spark, text.fenced_json(F.lit('Sure:\n```json\n{"a": [1]}\n```'))) == '{"a": [1]}'
    assert one(spark, text.fenced_json(F.lit("none"))) is None
    assert one(spark, text.expert_slug(F.lit("expert-ada-b-12"))) == "ada-b"
    assert one(spark, text.cut_at_sentence(F.lit("One two three. Four five six"), 16)) == "One two three."
    h = 0
    for c in "question one":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert one(spark, text.script_hash(F.lit("question one"))) == abs(h)


def test_content_blocks(spark):
    block = lambda c: one(spark, logs.block_text(F.lit(c)))
    assert block('[{"type":"text","text":"Hello"},{"type":"text","text":"World"}]') == "Hello World"
    assert block('[{"type":"text","text":"Let me read"},{"type":"tool_use","name":"Read"},{"type":"text","text":"done"}]') == "Let me read [Tool: Read] done"
    assert block('[{"type":"text","text":"Query"},{"type":"tool_result","content":"x"},{"type":"text","text":"Response"}]') == "Query Response"
    assert (block("[]"), block(" plain ")) == ("", "plain")


def test_event_log_keeps_only_messages(spark, tmp_path):
    ok = '{"type":"user","timestamp":"2026-01-12T10:00:00Z","uuid":"u1","sessionId":"s","cwd":"/p","message":{"content":[{"type":"text","text":"Hello"}]}}'
    lines = [ok, "", "{invalid json}", '{"type":"session_start","timestamp":"2026-01-12T10:00:00Z"}', ok.replace("2026-01-12T10:00:00Z", "bad"), ok.replace("Hello", "  "), ok.replace("user", "assistant", 1).replace("u1", "u2")]
    folder = tmp_path / "projects" / "-Users-me"
    (folder / "s" / "subagents").mkdir(parents=True)
    (folder / "s.jsonl").write_text("\n".join(lines))
    (folder / "s" / "subagents" / "agent-1.jsonl").write_text(ok.replace("u1", "u3"))
    (folder / "s" / "subagents" / "other.txt").write_text(ok)
    rows = {r["uuid"]: r for r in logs.read_sessions(spark, str(tmp_path / "projects")).collect()}
    assert set(rows) == {"u1", "u2", "u3"} and rows["u3"]["is_subagent"] and not rows["u1"]["is_subagent"]
    assert rows["u1"]["workspace"] == "/Users-me" and rows["u1"]["ts_ms"] == 1768212000000
    assert logs.bad_lines(spark.createDataFrame([(x,) for x in lines], "value string")).first()["bad_lines"] == 1


def test_key_value_layouts(spark):
    kv = [
        ("composerData:a", '{"createdAt":1700000000000,"lastUpdatedAt":1700000000100,"fullConversationHeadersOnly":[{"bubbleId":"x","type":1},{"bubbleId":"y","type":2,"text":"fallback"}]}'),
        ("bubbleId:a:x", '{"text":"found"}'),
        ("chatData:b", '{"createdAt":1700000000,"text":"only text"}'),
        ("composerData:c", '{"conversationMap":{"k":{"messages":[{"type":"assistant","text":"in a map","timestamp":5000000000000}]}}}'),
        ("composerData:d", "no json"),
        ("composerData:e", '{"createdAt":1,"richText":"{\\"children\\":[{\\"text\\":\\"rich\\"},{\\"text\\":\\"text\\"}]}"}'),
        ("other:f", '{"text":"not a chat"}'),
    ]
    got = {(r["chat_id"], r["place"]): (r["message_type"], r["text"], r["ts_ms"]) for r in logs.parse_key_values(spark.createDataFrame(kv, "key string, value string")).collect()}
    assert got[("a", 0)] == ("user", "found", 1700000000000) and got[("a", 1)] == ("assistant", "fallback", 1700000000100)
    assert got[("b", 0)] == ("user", "only text", 1700000000000) and got[("c", 0)] == ("assistant", "in a map", 5000000000000)
    assert got[("e", 0)][1] == "rich text" and len(got) == 5


def test_progress_markers(spark):
    rows = logs.progress_events(spark.createDataFrame([(1, "x [PHASE:load] y [STAT:n≡3]"), (2, "nothing")], "line int, value string")).collect()
    assert [(r["line"], r["kind"], r["content"]) for r in rows] == [(1, "PHASE", "load"), (1, "STAT", "n=3")]


def test_markdown_and_todo_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "skip.md").write_text("# skipped because of its folder")
    (tmp_path / "a.md").write_text("# Title\n\nSome text that is long enough.")
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.py").write_text("x = 1\n# TODO: fix this\ny = 2\n// FIXME later\n")
    got = docs.markdown_documents(docs.read_texts(spark, str(tmp_path), "*.md")).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["a.md"] and got[0]["message_id"].startswith("workspace_docs:")
    todo = docs.todo_comments(docs.read_texts(spark, str(tmp_path), "*.py"))
    assert [(r["line"], r["kind"], r["note"]) for r in todo.orderBy("line").collect()] == [(2, "TODO", "fix this"), (4, "FIXME", "later")]
    assert todo.filter("line = 2").first()["context"] == "x = 1\n# TODO: fix this\ny = 2\n// FIXME later"
    assert docs.todo_counts(todo).first()["todo_count"] == 2


def test_front_matter_and_headings(spark):
    t = F.lit('---\nguest: "Ada"\ntitle: On Looms\n---\n# Head\nBody')
    assert one(spark, docs.front_matter(t, "guest")) == "Ada" and one(spark, docs.front_matter(t, "title")) == "On Looms"
    assert one(spark, docs.front_matter(F.lit("no matter"), "guest")) is None
    assert one(spark, docs.without_headings(docs.without_front_matter(t))) == "Body"


def test_transcripts(spark):
    rows = [
        (1, "# Title\n\nAda L. (00:00:01):\nHello there!\n## Part\nBob (01:02:03):\n\nAda L. (00:01:03): More words here.\n\nAnd more."),
        (2, "# A heading\nNo speaker at all (0:10):"),
        (3, ""),
        (4, "plain words\nEve (00:00:09):\nText"),
    ]
    got = [(r["k"], r["chunk_index"], r["speaker"], r["clock"], r["text"]) for r in docs.speaker_turns(spark.createDataFrame(rows, "k int, text string"), "k").orderBy("k", "chunk_index").collect()]
    assert got == [
        (1, 0, "Ada L.", "00:00:01", "Hello there!"),
        (1, 1, "Ada L.", "00:01:03", "More words here.\n\nAnd more."),
        (2, 0, "Unknown", "00:00:00", "No speaker at all (0:10):"),
        (4, 0, "plain words\nEve", "00:00:09", "Text"),
    ]


def test_packed_paragraphs_as_a_plain_loop(spark):
    rng = random.Random(4)
    given = [(i, "\n\n".join(" ".join(["w"] * rng.randint(1, 30)) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    want = set()
    for i, t in given:
        parts, now, n = [], [], 0
        for p in [p for p in t.split("\n\n") if p.strip()]:
            k = len(p.split())
            if now and n + k > 40:
                parts.append(("\n\n".join(now), n))
                now, n = [], 0
            now.append(p)
            n += k
        if now:
            parts.append(("\n\n".join(now), n))
        want |= {(i, j, x, n) for j, (x, n) in enumerate(parts)}
    got = docs.packed_paragraphs(spark.createDataFrame(given, "i int, text string"), ["i"], 40).collect()
    assert {tuple(r) for r in got} == want


def test_generated_items(spark):
    a = "```\n## Idea 2: Second Thing\n**Problem:** P two\n**Solution:** S two\n## Idea 1: First Thing\n**Problem:** P one\n## All Generated Candidates\nignored\n```"
    b = "1. a numbered line that is long enough\n2. short"
    got = {(r["k"], r["rank"]): r for r in docs.generated_items(spark.createDataFrame([(1, a), (2, b), (3, ""), (4, None)], "k int, text string"), "k").collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)} and got[1, 1]["is_best"] and got[1, 2]["fields"] == {"problem": "P two", "solution": "S two"}


@pytest.mark.parametrize(("given", "n", "cost"), [("Estimated cost: $0.123", 1, 0.123), ("estimated COST: 0.456", 1, 0.456), ("none", 5, 0.05), ("", 0, 0.05), ("none", 20, 0.2)])
def test_stated_cost(spark, given, n, cost):
    assert one(spark, docs.stated_cost(F.lit(given), F.lit(n))) == pytest.approx(cost)


def test_checkboxes(spark):
    x = one(spark, docs.checkboxes(F.lit("- [x] a\n- [X] b\n- [ ] c\n* [ ] d")))
    assert (x["done"], x["open"], x["completion"]) == (2, 2, 50)


def test_items_that_end_before_they_start_cover_nothing(spark):
    d = dt.date
    rows = [("a", "idea", "active", d(2024, 3, 6), d(2024, 3, 19), "2024-03"), ("b", "idea", "active", d(2024, 3, 6), d(2024, 3, 1), "2024-03"), ("c", "idea", "archived", d(2024, 3, 6), d(2024, 3, 6), "2024-03"), ("d", "idea", "active", None, None, "2024-04"), ("e", "idea", "active", None, None, "bad")]
    items = spark.createDataFrame(rows, "id string, item_type string, status string, source_start_date date, source_end_date date, first_seen string")
    assert sorted((r["week_start"].isoformat(), r["item_count"]) for r in temporal.coverage_by_week(items).collect()) == [("2024-03-04", 1), ("2024-03-11", 1), ("2024-03-18", 1), ("2024-04-01", 1)]


def test_trends_keep_unmentioned_entities(spark):
    e = spark.createDataFrame([("a", "A", "tool"), ("b", "B", "tool"), ("c", "C", "tool")], "id string, canonical_name string, entity_type string")
    now = 1_700_000_000_000
    m = spark.createDataFrame([("a", now - 86400000)] * 3 + [("b", now - 150 * 86400000)] * 2, "entity_id string, ts_ms long")
    got = {r["id"]: (r["trend_direction"], r["trend_score"]) for r in temporal.trending(m, e, now).collect()}
    assert got == {"a": ("rising", 100.0), "b": ("declining", -100.0), "c": ("stable", 0.0)}


def edges(spark, pairs):
    return spark.createDataFrame([(f"r{i}", a, b, "USED_WITH", 1) for i, (a, b) in enumerate(pairs)], "id string, source_entity_id string, target_entity_id string, relation_type string, occurrence_count int")


def test_shortest_paths_visit_nothing_twice(spark):
    r = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "d"), ("x", "d"), ("a", "b")])
    got = [(p["depth"], p["path"], p["path_relations"]) for p in graph.shortest_paths(r, "a", "d", 4).collect()]
    assert got == [(2, "a > b > d", "r0 > r5"), (2, "a > b > d", "r8 > r5"), (2, "a > c > d", "r3 > r4"), (3, "a > b > c > d", "r0 > r1 > r4"), (3, "a > b > c > d", "r8 > r1 > r4")]
    assert [p["path"] for p in graph.shortest_paths(r, "a", "d", 4, 1).collect()] == ["a > b > d"]
    assert graph.shortest_paths(r, "d", "a", 4).count() == 0 and graph.shortest_paths(r, "a", "a").count() == 0 and graph.shortest_paths(r.limit(0), "a", "d").count() == 0


def test_shortest_paths_as_a_search(spark):
    rnd = random.Random(2)
    pairs = sorted({(f"v{rnd.randrange(14)}", f"v{rnd.randrange(14)}") for _ in range(40)})
    out = {}
    for s, t in pairs:
        out.setdefault(s, []).append(t)
    every, todo = [], [["v0"]]
    while todo:
        p = todo.pop()
        if p[-1] == "v9":
            every.append((len(p) - 1, " > ".join(p)))
        elif len(p) <= 5:
            todo += [[*p, t] for t in out.get(p[-1], []) if t not in p]
    for limit in (1, 4, 50):
        assert [(r["depth"], r["path"]) for r in graph.shortest_paths(edges(spark, pairs), "v0", "v9", 5, limit).collect()] == sorted(every)[:limit]


@pytest.mark.parametrize("block", [512, 7])
def test_shared_pairs_in_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(g, m) for g, n in (("big", 60), ("small", 5), ("one", 1)) for m in rnd.sample(range(80), n)] + [(None, 3), ("big", None)]
    members = {}
    for g, m in rows:
        if g and m is not None:
            members.setdefault(g, set()).add(m)
    want = {}
    for ms in members.values():
        for a in ms:
            for b in ms:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r["a"], r["b"]): r["shared"] for r in graph.shared_pairs(spark.createDataFrame(rows, "g string, m int"), "g", "m", 1, block).collect()}
    assert got == want


def test_a_large_group_is_dealt_by_blocks(spark):
    rows = spark.range(1500).select(F.lit("g").alias("g"), F.col("id").alias("m"))
    pairs = graph.shared_pairs(rows, "g", "m", 1, 100)
    assert pairs.count() == 1500 * 1499 // 2


def test_chains_of_merges_end_in_one_call(spark):
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("q", "q"), ("m", "n"), ("m", "k")], "source_id string, target_id string")
    got = {r["source_id"]: r["target_id"] for r in knowledge.closed_mapping(mapping).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "y": "w", "x": "w", "m": "k"}
    e = spark.createDataFrame([(i, i.upper(), [], 1) for i in "abcd"], "id string, canonical_name string, aliases array<string>, mention_count long")
    mentions = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, entity_id string")
    rows = [("r1", "a", "d", "T", "m", 1, 0.3), ("r2", "b", "d", "T", "m", 2, 0.5), ("r3", "b", "d", "T", None, 4, 0.1), ("r4", "z", "d", "T", None, 4, 0.1), ("r5", "z", "c", "T", None, 1, 0.2)]
    r = spark.createDataFrame(rows, "id string, source_entity_id string, target_entity_id string, relation_type string, message_id string, occurrence_count long, confidence double")
    ents, ments, rels = knowledge.merged_entities(e, mentions, r, mapping)
    assert [(x["id"], x["mention_count"], x["aliases"]) for x in ents.collect()] == [("d", 4, ["A", "B", "C"])]
    assert {x["entity_id"] for x in ments.collect()} == {"d"}
    assert {(x["id"], x["source_entity_id"], x["occurrence_count"], x["confidence"]) for x in rels.collect()} == {("r1", "d", 3, 0.5), ("r3", "d", 4, 0.1), ("r4", "z", 5, 0.2)}


def test_saved_relations_add_up(spark):
    kind = "source_entity_id string, target_entity_id string, relation_type string, message_id string, evidence string, message_timestamp long, confidence double, seen_at long"
    first = spark.createDataFrame([("a", "b", "T", None, "x" * 600, 5, None, 10), ("a", "b", "T", None, "later", 6, 0.4, 12), ("a", "b", "T", "m", None, 6, 0.4, 12)], kind)
    stored = knowledge.saved_relations(knowledge.no_relations(spark), first)
    again = knowledge.saved_relations(stored, spark.createDataFrame([("a", "b", "T", None, "new", 9, 0.9, 99)], kind))
    got = {r["message_id"]: r for r in again.collect()}
    assert len(got) == 2 and (got[None]["occurrence_count"], got[None]["confidence"], len(got[None]["evidence"]), got[None]["first_seen"], got[None]["last_seen"]) == (3, 0.8, 500, 10, 99)
    assert got["m"]["evidence"] is None and got["m"]["occurrence_count"] == 1


def test_saved_relations_are_grouped_once(spark):
    """Ids that their keys don't give stay, and stored and new rows meet in one shuffle."""
    kind = "source_entity_id string, target_entity_id string, relation_type string, message_id string, evidence string, message_timestamp long, confidence double, seen_at long"
    stored = spark.createDataFrame([("given", "a", "b", "T", None, "old" * 300, 5, None, 2, 7, 8), (None, "c", "d", "T", "m", None, None, 0.3, 1, 9, 9)], knowledge.no_relations(spark).schema)
    out = knowledge.saved_relations(stored, spark.createDataFrame([("a", "b", "T", None, "new", 1, 0.9, 1), ("e", "f", "T", "m", "y" * 501, 2, 0.9, 3)], kind))
    got = {r["source_entity_id"]: tuple(r)[5:] for r in out.collect()}
    assert got == {"a": ("old" * 300, 5, None, 3, 7, 8), "c": (None, None, 0.3, 1, 9, 9), "e": ("y" * 500, 2, 0.9, 1, 3, 3)}
    ids = {r["source_entity_id"]: r["id"] for r in out.collect()}
    assert ids["a"] == "given" and ids["c"] is None and ids["e"].startswith("r-")
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(4))
def test_filled_budget_as_a_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, 0, rnd.randrange(1, 40), rnd.randrange(1, 400)])) for i in range(300)]
    budget = rnd.choice([0, 50, 700, 5000, 10**6])
    want, left = set(), budget
    for i, size in rows:
        if left > 0 and (size or 0) <= left:
            want.add(i)
            left -= size or 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = temporal.filled_budget(spark.createDataFrame(rows, "id int, size int").repartition(5), F.col("size"), [F.col("id")], budget)
        assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "size"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dates_move_back_only(spark):
    ms = lambda day: int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp() * 1000)
    messages = spark.createDataFrame([("m1", [1.0, 0.0], ms("2024-03-05")), ("m2", [1.0, 0.1], ms("2024-01-31")), ("m3", [-1.0, 0.0], ms("2020-01-01"))], "id string, embedding array<double>, ts_ms long")
    items = spark.createDataFrame([("later", [1.0, 0.0], "2024-06"), ("none", [1.0, 0.0], None), ("blank", [1.0, 0.0], ""), ("earlier", [1.0, 0.0], "2023-12"), ("far", [0.0, 1.0], None), ("bare", None, "2024-06")], "id string, embedding array<double>, first_seen string")
    got = {r["id"]: (r["first_seen"], r["corrected"]) for r in library.corrected_first_seen(items, messages).collect()}
    assert got == {"later": ("2024-01", True), "none": ("2024-01", True), "blank": ("2024-01", True), "earlier": ("2023-12", False), "far": (None, False), "bare": ("2024-06", False)}


def test_degrees_count_every_end(spark):
    r = edges(spark, [("a", "b"), ("a", "a"), ("b", "a")])
    got = {x["entity_id"]: (x["out_degree"], x["in_degree"], x["degree"]) for x in graph.degrees(r).collect()}
    assert got == {"a": (2, 2, 4), "b": (1, 1, 2)}


def test_normalised_relations(spark):
    raw = spark.createDataFrame([("A", "uses", "B", 2.0), ("A", "fixes", "a", 0.5), ("A", "sings", "B", 0.5), (" ", "uses", "B", 0.5), ("A", "part of", "C", None)], "subject string, predicate string, object string, confidence double")
    got = {tuple(r) for r in graph.normalised_relations(raw, {"USES": "USED_WITH", "FIXES": "SOLVES"}, ("USED_WITH", "SOLVES", "PART_OF")).collect()}
    assert got == {("A", "USED_WITH", "B", 1.0), ("A", "PART_OF", "C", 0.5)}


def random_vectors(spark, n, seed, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i:03d}", "p" if i % 2 else "q", [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    rows[3] = (rows[3][0], rows[3][1], [0.0] * dim)
    return spark.createDataFrame([*rows, ("none", "p", None)], "id string, part string, embedding array<float>"), rows


def unit(rows):
    m = np.array([np.array(r[2], np.float32) for r in rows], np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def test_similarity_join_by_broadcast_and_by_blocks(spark):
    df, rows = random_vectors(spark, 60, 1)
    u = np.round(unit(rows) @ unit(rows).T, 6)
    want = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(u >= 0.4), strict=True)}
    pairs = lambda **how: {(r["left_id"], r["right_id"]) for r in similarity.similar_pairs(df, df, 0.4, block=16, **how).collect()}
    assert pairs() == want
    assert pairs(values=0) == want
    assert similarity.similar_pairs(df.limit(0), df, 0.4).count() == 0
    kind, place = {r[0]: r[1] for r in rows}, {r[0]: i for i, r in enumerate(rows)}
    column = df.columns[1]
    for values in (0, 10**6):
        assert pairs(values=values, kind=column) == {(a, b) for a, b in want if kind[a] == kind[b]}
        best = similarity.best_per(similarity.similar_pairs(df, df, 0.0, values=values, block=16, k=2), "left_id", 2, "right_id").collect()
        for a in kind:
            order = sorted((b for b in kind if u[place[a], place[b]] >= 0), key=lambda b: (-u[place[a], place[b]], b))
            assert [r["right_id"] for r in sorted(best, key=lambda r: r["rank"]) if r["left_id"] == a] == order[:2]


def looped(u, least, rule):
    """Leaders in order, as a plain loop finds them; the leader of each row."""
    leaders, out = [], []
    for i in range(len(u)):
        near = [k for k in leaders if round(float(u[k] @ u[i]), 6) >= least]
        if not near:
            leaders.append(i)
            out.append(i)
        else:
            out.append(max(near, key=lambda k: (round(float(u[k] @ u[i]), 6), -k)) if rule == "leader" else near[0])
    return out


@pytest.mark.parametrize("rule, rows, least, how", [("leader", 120, 0.3, {}), ("sweep", 120, 0.3, {}), ("leader", 120, 0.3, {"values": 0, "block": 32}), ("leader", 3000, 0.85, {"values": 0, "block": 1000}), ("sweep", 3000, 0.85, {})])
def test_clusters_as_plain_loops(spark, rule, rows, least, how):
    rng = np.random.default_rng(rows)
    vectors = rng.normal(size=(rows, 6)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(rows + 1, None)], "id long, embedding array<double>")
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    run = {"leader": cluster.leader_clusters, "sweep": cluster.sweep_clusters}[rule]
    got = {r["id"]: r["cluster"] for r in run(df, least, **how).collect()}
    want = looped(u, least, rule)
    assert got == dict(enumerate(want))
    if rows == 120:
        kept = {r["id"] for r in cluster.without_duplicates(df, least, **how).collect()}
        assert kept == {i for i, k in enumerate(want) if i == k} | {rows + 1}
        assert run(df.limit(0), least).count() == 0


def test_density_clusters_as_a_plain_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * 0.45, rng.normal(size=(50, 8))]).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None)], "id long, embedding array<double>")
    for eps, least, scale in ((0.1, 4, False), (0.2, 6, True), (0.05, 3, False)):
        x = (vectors - vectors.mean(0)) / vectors.std(0) if scale else vectors
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = np.round(u @ u.T, 6) >= 1 - eps
        core, label = near.sum(1) >= least, [None] * len(u)
        for i in range(len(u)):
            if core[i] and label[i] is None:
                todo, label[i] = [i], i
                while todo:
                    for j in np.flatnonzero(near[todo.pop()]):
                        if label[j] is None:
                            label[j] = i
                            todo += [j] if core[j] else []
        got = cluster.density_clusters(cluster.standardised(df) if scale else df, eps, least).collect()
        assert {r["id"]: r["cluster"] for r in got} == dict(enumerate(label)) and {r["id"] for r in got if r["core"]} == set(np.flatnonzero(core))


def test_components_and_turns(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 300), (305, 305), (400, 7)] + [(500, 500 + k) for k in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in rounds.components(df).collect()}
    assert all(got[i] == 0 for i in [*range(201), 400]) and got[301] == 300 and got[549] == 500 and 305 not in got
    assert rounds.components(df.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["id"] for r in rounds.turned_away(path).collect()} == set(range(1, 21, 2))


def test_cluster_names(spark):
    rows = [("c", 1, "The Parser, (parser) of logs"), ("c", 2, "fast PARSER for logs 2024"), ("c", 3, None), ("d", 1, "to be or"), ("e", 1, ""), ("f", 1, "Zeta alpha 2024 1999")]
    got = {r["cluster"]: r["name"] for r in cluster.cluster_names(spark.createDataFrame(rows, "cluster string, place int, title string")).collect()}
    assert got == {"c": "Parser & Logs & 2024", "d": "to be or", "e": "Unknown", "f": "1999 & 2024 & Zeta"}


def test_merge_keeps_all_occurrences(spark):
    rows = [(1, "i1", "T1", 2, "2024-01", "2024-03", ["x"], "g"), (2, "i2", "T2", 5, "2023-12", "2024-02", ["y", "x"], "g"), (3, "i3", "T3", None, "2024-05", "2024-05", [], "h"), (4, "i4", "T4", 1, "2024-05", "2024-05", [], None)]
    items = spark.createDataFrame(rows, "n int, id string, title string, occurrence int, first_seen string, last_seen string, tags array<string>, grp string")
    got = {r["grp"]: r for r in library.merged(items, "grp").collect()}
    assert (got["g"]["id"], got["g"]["occurrence"], got["g"]["first_seen"], got["g"]["last_seen"], got["g"]["tags"]) == ("i2", 7, "2023-12", "2024-03", "x,y")
    assert got["h"]["occurrence"] == 1 and set(got) == {"g", "h"}


def test_categories_lose_deleted_items(spark):
    c = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["a"]), ("c3", [])], "id string, item_ids array<string>")
    gone = spark.createDataFrame([("a",)], "id string")
    kept = {r["id"]: r["item_ids"] for r in library.pruned_categories(c, gone, False).collect()}
    assert kept == {"c1": ["b"], "c2": [], "c3": []}
    assert [r["id"] for r in library.pruned_categories(c, gone, True).collect()] == ["c1"]


def test_entities_resolve_by_name_then_alias(spark):
    e = spark.createDataFrame([("e1", "Spark", ["apache spark"]), ("e2", "Loom", ["spark"])], "id string, canonical_name string, aliases array<string>")
    n = spark.createDataFrame([("SPARK", "tool"), ("Apache Spark", "tool"), ("New", "tool")], "name string, entity_type string")
    got = {r["name"]: (r["entity_id"], r["matched_by"]) for r in knowledge.resolved_entities(n, e).collect()}
    assert got == {"SPARK": ("e1", "name"), "Apache Spark": ("e1", "alias"), "New": (None, "new")}


def test_chunk_packer_matches_registered_query(spark, sf):
    from threadloom.plans import load_all
    from threadloom.registry import QUERIES

    load_all()
    got = QUERIES["packed_document_chunks"](spark, sf).toPandas()
    words = pd.DataFrame([(r["doc_id"], len(r["text"].split())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], columns=["doc_id", "n"])
    assert (got.groupby("doc_id")["words"].sum() == words.set_index("doc_id")["n"]).all()


@pytest.mark.parametrize("seed", range(3))
def test_harmonised_bank_as_a_loop(spark, seed):
    rnd = random.Random(seed)
    bank = [{"content": f"b{i}", "occurrence_count": rnd.choice([None, 1, 4]), "last_updated": 0, "solved": rnd.choice([None, "s"]), "posted": None} for i in range(5)]
    changes = [(f"h{k}", k // 7, k % 7, rnd.choice(["new", "update", "update", "odd"]), rnd.choice([None, *range(-1, 12)]), f"c{k}", k, rnd.choice([None, None, f"s{k}"]), rnd.choice([None, f"p{k}"])) for k in range(30)]
    done = {"h3", "h12"}
    want = [dict(e) for e in bank]
    for h, _, _, action, i, content, at, solved, posted in changes:
        new = {"content": content, "last_updated": at, "solved": solved, "posted": posted, "occurrence_count": 1}
        if h in done:
            continue
        if action == "new":
            want.append(new)
        elif action == "update" and i is not None and 0 <= i < len(want):
            old = want[i]
            new["occurrence_count"] = (old["occurrence_count"] or 1) + 1
            want[i] = {k: old[k] if v is None and k in ("solved", "posted") else v for k, v in new.items()}
    for e in want:
        e["occurrence_count"] = e["occurrence_count"] or 1
    b = spark.createDataFrame([(i, e["content"], e["occurrence_count"], 0, e["solved"], e["posted"]) for i, e in enumerate(bank)], "idx long, content string, occurrence_count long, last_updated long, solved string, posted string")
    c = spark.createDataFrame(changes, "item_hash string, batch int, place int, action string, id long, content string, made_at long, solved string, posted string")
    p = spark.createDataFrame([(h,) for h in done], "item_hash string")
    out, hashes = library.harmonised(b, c, p)
    again, same = library.harmonised(out, c, hashes)
    for df in (out, again):
        assert [{k: r[k] for k in want[0]} for r in df.orderBy("idx").collect()] == want
    assert hashes.count() == same.count() == 30


def test_rich_text_walks_children_only(spark):
    tree = {"root": {"text": "a", "attributes": {"text": "no"}, "children": [{"text": "b", "children": [{"children": [{"text": "c"}]}, {"text": "d \" é"}]}, [{"text": "e"}], "odd", {"mark": {"text": "no"}}]}, "text": "no"}
    deep = '{"root":' + '{"children":[' * 300 + '{"text":"deep"}' + "]}" * 300 + "}"
    rows = [(json.dumps(tree),), ("no json",), (None,), ("[1]",), ('{"root": {"text": 5}}',), ("{}",), (deep,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "v string").coalesce(1).select(logs.rich_text("v").alias("x")).collect()]
    assert got == ['a b c d " é e', "", "", "", "", "", "deep"]


def test_storage_files_are_read_by_ranges(spark, tmp_path):
    path = str(tmp_path / "state.vscdb")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE ON CONFLICT REPLACE, value BLOB)")
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"composerData:{i}", json.dumps({"n": i}).encode()) for i in range(250)] + [("chatData:x", "{}"), ("other:1", "{}"), ("composerdata:low", "{}"), ("bubbleId:1:2", b"\xff\xfe"), ("chatData:none", None)])
    con.commit()
    assert keyvalue.chat_storage(spark, path).filter("layout = 'legacy'").count() == 0
    con.execute("CREATE TABLE ItemTable (key TEXT, value BLOB)")
    con.executemany("INSERT INTO ItemTable VALUES (?, ?)", [("composer.composerData", "{}"), ("workbench.panel.aichat.view.aichat.chatdata.1", "{}"), ("theme", "dark")])
    con.commit()
    con.close()
    df = keyvalue.chat_storage(spark, path, 100)
    rows = {r["key"]: (r["value"], r["layout"]) for r in df.collect()}
    assert len(rows) == 255 and rows["composerData:249"] == ('{"n": 249}', "current") and rows["bubbleId:1:2"] == (None, "current") and rows["chatData:none"][0] is None
    assert {k for k, v in rows.items() if v[1] == "legacy"} == {"composer.composerData", "workbench.panel.aichat.view.aichat.chatdata.1"}
    assert df.filter("layout = 'current'").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="every machine"):
        spark.read.format("sqlite_kv").option("path", "hdfs://x/y").load().count()


def test_an_archive_is_indexed_by_content(spark):
    files = lambda **f: spark.createDataFrame([(k.replace("_", "/"), v, 1) for k, v in f.items()], "path string, content string, version int")
    scan = lambda index, f: rounds.written(archive.reindexed(index, f))
    rows = lambda df: {r["path"]: (r["action"], r["version"], r["deleted"]) for r in df.collect()}
    one = scan(archive.empty_index(files(a="x")), files(a="1", b="2", c="3", d="same", e="same", f=None))
    assert rows(one) == {p: ("added", 1, False) for p in "abcdef"}
    two = scan(one.drop("action"), files(a="1", b="changed", x_c="3", x_d="same", y_e="same", n="new"))
    assert rows(two) == {"a": ("unchanged", 1, False), "b": ("changed", 2, False), "x/c": ("moved", 1, False), "x/d": ("moved", 1, False), "y/e": ("moved", 1, False), "n": ("added", 1, False), "f": ("removed", 2, True)}
    ids = lambda df: {r["path"]: r["doc_id"] for r in df.collect()}
    assert ids(two)["x/c"] == ids(one)["c"] and ids(two)["x/d"] == ids(one)["d"] and ids(two)["y/e"] == ids(one)["e"]
    three = scan(two.drop("action"), files(a="1", f="back"))
    assert rows(three)["f"] == ("added", 3, False) and ids(three)["f"] == ids(one)["f"] and rows(three)["n"] == ("removed", 2, True)
    assert rows(scan(three.drop("action"), files(a="1", f="back"))) | {} == {p: (("kept", v, True) if gone else ("unchanged", v, False)) for p, (_, v, gone) in rows(three).items()}
    assert {r["path"] for r in archive.to_embed(two, files(a="1", b="changed", n="new")).collect()} == {"b", "n"}


def test_tasks_of_shared_pairs_grow_in_number(spark, monkeypatch):
    """Small partitions aren't joined to one large task, and their number grows with the rows."""
    monkeypatch.setattr(graph, "PAIRED_ROWS", 100)
    rows = spark.createDataFrame([(f"g{i // 3}", f"m{i % 50}") for i in range(1800)], "g string, m string")
    out = graph.shared_pairs(rows, "g", "m", 2)
    seen = {}
    for g in range(600):
        own = sorted({f"m{i % 50}" for i in range(3 * g, 3 * g + 3)})
        for x in range(len(own)):
            for y in own[x + 1 :]:
                seen[own[x], y] = seen.get((own[x], y), 0) + 1
    assert {tuple(r) for r in out.collect()} == {(*p, n) for p, n in seen.items() if n >= 2}
    plan = graph.shared_pairs(rows, "g", "m", 2, about=2100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 21), REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("name", ["saved_mentions", "saved_relations"])
def test_texts_are_written_out_after_grouping(spark, sf, name):
    """Only ids are sent and sorted, not the texts that repeat them: a grouping lies under each place that writes them."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    texts = [i for i, line in enumerate(plan) if "repeat(" in line]
    assert texts
    for i in texts:
        under = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
        # or the empty table that saving begins with
        assert "Project" in plan[i] and any("Aggregate" in line or "LogicalRDD" in line for line in plan[i + 1 : under])


def test_saved_relations_are_dealt_once(spark, sf):
    """Pairs went over the network in each grouping, those of the first call twice; now once, dealt by their ends."""
    from threadloom.plans.knowledge_queries import saved_relations

    plan = saved_relations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(source_entity_id" in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)
