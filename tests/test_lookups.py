"""Searches, matches and look-ups of single nodes, on hand-made rows and against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from threadloom.operators import knowledge, similarity

D = dt.date


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    return [(f"m{i:02}", [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(40)]


def unit(v):
    return np.array(v) / np.linalg.norm(v)


@pytest.mark.parametrize("how", [{}, {"values": 0, "block": 7}])
def test_searches_are_those_of_a_loop(spark, vectors, how):
    rows, queries = vectors + [("none", None)], vectors[::9]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in similarity.searched(df, spark.createDataFrame(queries, df.schema), 4, 0.1, **how).collect()}
    want = {}
    for q, v in queries:
        hits = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in vectors)
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(hits[:4]) if -s >= 0.1}
    assert {k: (i, pytest.approx(s, abs=2e-6)) for k, (i, s) in got.items()} == want
    q = queries[1]
    one = [r["id"] for r in similarity.top_k(df, q[1], 4, 0.1).collect()]
    assert one == [i for (k, _), (i, _) in sorted(want.items(), key=lambda kv: kv[0][1]) if k == q[0]]


def test_quotes_are_cut_after_the_filter(spark):
    rows = [(f"m{i}", [1.0, i / 10], "expert" if i in (2, 5, 6) else "editor", None if i == 2 else f"t{i}", "c") for i in range(8)]
    messages = spark.createDataFrame(rows, "id string, embedding array<double>, source string, text string, chat_id string")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "id string, embedding array<double>")
    found = lambda k: [(r["id"], r["text"], r["rank"]) for r in similarity.quotes(messages, query, "expert", k).orderBy("rank").collect()]
    assert found(1) == [("m2", "", 1)]  # of three
    assert found(2) == [("m2", "", 1), ("m5", "t5", 2)]  # of six, without m6


def test_sampled_messages_begin_differently(spark):
    same = "s" * 200
    rows = [("a", [1.0, 0.1], same + "1"), ("b", [1.0, 0.05], same + "2"), ("c", [1.0, 0.2], "other"), ("d", [1.0, 0.3], ""), ("e", [1.0, 0.3], None), ("f", [1.0, 0.2], "third"), ("g", [-1.0, 0.0], "far")]
    messages = spark.createDataFrame(rows, "id string, embedding array<double>, text string")
    queries = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.01])], "id string, embedding array<double>")
    got = lambda n: [r["id"] for r in similarity.sampled_messages(messages, queries, 10, 0.1, n).collect()]
    assert got(9) == ["b", "c", "f"]
    assert got(2) == ["b", "c"]


def test_matches_with_the_other_source(spark):
    rows = [("u1", [1.0, 0.0], "user"), ("u2", [1.0, 0.1], "both"), ("u3", [1.0, 0.2], "user"), ("x1", [1.0, 0.0], "expert"), ("x2", [1.0, 0.3], "expert"), ("x3", [0.0, 1.0], "expert"), ("o", [1.0, 0.0], "other"), ("z", None, "user")]
    entities = spark.createDataFrame(rows, "id string, embedding array<double>, source_type string")
    found = lambda *ids: {(r[0], r[1]) for r in similarity.other_source_matches(entities, entities.filter(entities.id.isin(*ids)), 0.9, 1).collect()}
    assert found("u1") == {("u1", "x1")}  # one best
    assert found("x1") == {("u1", "x1"), ("u2", "x1"), ("u3", "x1")}  # all that reach the threshold
    assert found("u1", "x1") == found("x1")
    assert found("o", "z", "x3") == set()


def test_items_are_implemented_by_the_first_of_the_best_files(spark):
    items = [("a", "active", [1.0, 0.0]), ("b", None, [0.0, 1.0]), ("c", "implemented", [1.0, 0.0]), ("d", "active", None), ("e", "active", [-1.0, 0.0])]
    files = [("/z.md", [2.0, 0.0]), ("/y.md", [1.0, 0.0]), ("/x.md", [0.2, 1.0])]
    args = spark.createDataFrame(items, "id string, status string, embedding array<double>"), spark.createDataFrame(files, "id string, embedding array<double>")
    got = {r["id"]: (r["status"], r["implemented_source"]) for r in similarity.implemented_by_files(*args).collect()}
    assert got == {"a": ("implemented", "/y.md"), "b": ("implemented", "/x.md"), "c": ("implemented", None), "d": ("active", None), "e": ("active", None)}
    assert {r["status"] for r in similarity.implemented_by_files(args[0].filter("id = 'a'"), args[1].limit(0)).collect()} == {"active"}


def test_node_dates_prefer_entities_and_earlier_dates(spark):
    convs = spark.createDataFrame([("conv-1", "1", None, D(2024, 2, 1)), ("conv-2", "2", D(2024, 1, 9), D(2024, 1, 1)), ("conv-3", "3", None, None)], "id string, conversation_id string, date_day date, date_month date")
    episodes = spark.createDataFrame([("ada", D(2020, 1, 1)), ("bob", None), ("ada", D(2019, 1, 1))], "slug string, published_date date")
    mentions = spark.createDataFrame([("e", "1"), ("e", "2"), ("f", "3"), ("conv-1", "2"), (None, "1")], "entity_id string, message_id string")
    got = {tuple(r) for r in knowledge.node_dates(convs, episodes, mentions).collect()}
    assert got == {("conv-1", D(2024, 1, 9), "entity"), ("conv-2", D(2024, 1, 9), "conversation"), ("episode-ada", D(2019, 1, 1), "episode"), ("e", D(2024, 1, 9), "entity")}


def test_recent_mentions_of_all_entities(spark):
    entities = spark.createDataFrame([("e", "E", "tool", None, None), ("f", "F", "tool", 0, 0.2)], "id string, canonical_name string, entity_type string, mention_count long, confidence double")
    mentions = spark.createDataFrame([(f"m{i}", "e", "x", None if i == 3 else i // 2) for i in range(7)], "id string, entity_id string, message_id string, ts_ms long")
    got = knowledge.recent_mentions(entities, mentions, 3).orderBy("id", "rank").collect()
    assert [(r["id"], r["mention_id"], r["rank"], r["confidence"], r["mention_count"]) for r in got] == [("e", "m3", 1, 1.0, 0), ("e", "m6", 2, 1.0, 0), ("e", "m4", 3, 1.0, 0), ("f", None, None, 0.2, 0)]


def test_entities_by_source_and_episodes_of_conversations(spark):
    schema = "id string, canonical_name string, entity_type string, source_type string, mention_count long, user_count long, expert_count long, first_seen long, last_seen long"
    entities = spark.createDataFrame([(i, i, "tool", s, n, None, n, 0, 1) for i, s, n in (("a", "user", 3), ("b", "both", 5), ("c", "user", 5), ("d", None, 9), ("e", "user", None))], schema)
    assert [r["id"] for r in knowledge.entities_by_source(entities, "user").collect()] == ["c", "a"]
    assert [(r["id"], r["user_mentions"]) for r in knowledge.entities_by_source(entities, None, 5, 2).collect()] == [("d", 0), ("b", 0)]
    relations = spark.createDataFrame([("episode-ada", "conv-1", "REFERENCES_EPISODE"), ("episode-bob", "conv-1", "REFERENCES_EPISODE"), ("episode-ada", "e-1", "REFERENCES_EPISODE"), ("episode-ada", "conv-2", "USED_WITH"), ("tool-episode-ada", "conv-3", "REFERENCES_EPISODE")], "source_entity_id string, target_entity_id string, relation_type string")
    nodes = spark.createDataFrame([("episode-ada", "episode"), ("episode-bob", "episode"), ("tool-episode-ada", "tool")], "id string, entity_type string")
    episodes = spark.createDataFrame([("ada", "Ada")], "slug string, guest_name string")
    assert [tuple(r) for r in knowledge.conversation_episodes(relations, nodes, episodes).collect()] == [("1", "episode-ada", "Ada", "REFERENCES_EPISODE")]
