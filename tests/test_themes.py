"""Themes and topics against plain loops, and rows that the fixture tables don't hold."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from threadloom.operators import themes

ITEMS = "id string, title string, category_id string, embedding array<float>"
CONVERSATIONS = "id string, title string, embedding array<double>, last_ts long"
MESSAGES = "message_id string, workspace string, chat_id string, chat_type string, message_type string, text string, ts_ms long, embedding array<float>"


def loop_name(titles, least):
    """A theme's name by a plain loop over its titles."""
    if len(titles) == 1:
        return titles[0]
    broad = least < 0.6
    sets = [list(dict.fromkeys(w for w in t.lower().split() if len(w) > 3 and w not in themes.THEME_STOP_WORDS)) for t in titles[:10]]
    found = Counter(w for s in sets for w in s)
    need = 2 if broad else -(-len(sets) // 2)
    top = [w for w, n in sorted(found.items(), key=lambda kv: -kv[1]) if n >= need][:3]
    if top:
        name = " & ".join(w[0].upper() + w[1:] for w in top)
        return f"{name} ({len(titles)})" if broad and len(titles) > 10 else name
    if broad and len(titles) > 5:
        longest = titles[0]
        for x in titles[1:]:
            longest = longest if len(longest) > len(x) else x
        part = longest.replace("-", ":").replace("–", ":").split(":")[0].strip() or longest
        return part[:32] + "..." if len(part) > 35 else part
    first = titles[0][:37] + "..." if len(titles[0]) > 40 else titles[0]
    return f"{first} (+{len(titles) - 1})"


@pytest.mark.parametrize("least", [0.45, 0.75])
def test_theme_names_are_those_of_a_loop(spark, least):
    rng = random.Random(5)
    words = ["Spark", "joins", "with", "skewed", "keys", "window", "a", "plan", "cost-based", "x" * 45, "graphs", "über"]
    sets = [[" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    sets += [[f"w{i}: only{i} - here{i}{'z' * i * 9}" for i in range(7)], ["aaa: b", "aab: c"], ["q" * 41] * 1 + ["abc"]]
    rows = [(i, p + 1, t) for i, ts in enumerate(sets) for p, t in enumerate(ts)]
    got = {r["theme"]: (r["name"], r["item_count"]) for r in themes.theme_names(spark.createDataFrame(rows, "theme long, place long, title string"), least).collect()}
    assert got == {i: (loop_name(ts, least), len(ts)) for i, ts in enumerate(sets)}


def test_theme_preview_follows_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    vec = lambda: [float(np.float32(x)) for x in base[rng.integers(6)] + rng.normal(size=8) * 0.5]
    items = [(f"i{n:03}", f"Item {n}", None, vec()) for n in range(60)] + [("none", "No vector", "c1", None), ("empty", None, "c1", [])]
    convs = [(f"conv-{n}", f"Talk {n}", vec(), 1000 + n % 7) for n in range(40)]
    order = sorted((r for r in items if r[3]), key=lambda r: r[0]) + sorted(convs, key=lambda r: (-r[3], r[0]))
    want: dict[str, list] = {}
    heads: list[tuple[str, np.ndarray]] = []
    for r in order:
        v = np.array(r[3] if r in items else r[2])
        v = v / np.linalg.norm(v)
        best = max(((round(float(v @ h), 6), -k) for k, (_, h) in enumerate(heads)), default=(0, 0))
        if best[0] >= 0.8:
            want[heads[-best[1]][0]].append(r[1])
        else:
            heads.append((f"theme-{r[0]}", v))
            want[heads[-1][0]] = [r[1]]
    ranked = sorted(want, key=lambda k: -len(want[k]))  # stable, so in order of the first member
    args = spark.createDataFrame(items, ITEMS), spark.createDataFrame(convs, CONVERSATIONS)
    got = sorted(themes.theme_preview(*args, 0.8).collect(), key=lambda r: r["rank"])
    assert [(r["theme"], r["item_count"], r["rank"], r["one_off"], r["name"]) for r in got] == [(k, len(want[k]), i + 1, len(want[k]) == 1, loop_name(want[k], 0.8)) for i, k in enumerate(ranked)]
    assert [r["theme"] for r in themes.theme_preview(*args, 0.8, limit=2).collect()] == ranked[:2]
    for wrong in (0.2, 1.0):
        with pytest.raises(ValueError, match="threshold"):
            themes.theme_preview(*args, wrong)


def test_theme_preview_by_category_without_embeddings(spark):
    items = spark.createDataFrame([("a", "First", "c1", None), ("b", "Second", None, []), ("c", "Third", "c1", None)], ITEMS)
    none = spark.createDataFrame([], CONVERSATIONS)
    got = [(r["theme"], r["item_count"], r["rank"]) for r in themes.theme_preview(items, none).orderBy("rank").collect()]
    assert got == [("c1", 2, 1), ("uncategorized", 1, 2)]
    assert themes.theme_preview(items.limit(0), none).count() == 0


def test_conversation_items_show_the_latest_messages(spark):
    rows = [
        ("m1", "w", "c", "chat", "user", "old question\nmore", 1, [1.0, 0.0]),
        ("m2", "w", "c", "chat", "assistant", "answer " * 40, 2, None),
        ("m3", "w", "c", "chat", "user", "  new question \nmore", 3, [0.0, 1.0]),
        ("m4", "w", "c", "chat", "assistant", None, 4, []),
        ("m5", "w", "d", "chat", "user", "", 1, [1.0, 1.0]),
        ("m6", "w", "d", "chat", "assistant", "x" * 101, 1, None),
        ("m7", "w", "e", "chat", "user", "no vector", 1, None),
        ("m8", None, None, None, "system", "only this", 1, [2.0, 4.0]),
    ]
    got = {r["id"]: r for r in themes.conversation_items(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert set(got) == {"conv-w:c:chat", "conv-w:d:chat", "conv-::"}
    c = got["conv-w:c:chat"]
    assert (c["title"], c["embedding"], c["last_ts"]) == ("new question", [0.5, 0.5], 4)
    assert c["description"] == "\n\n".join(["", "  new question \nmore", ("answer " * 40)[:197] + "..."])
    assert got["conv-w:d:chat"]["title"] == "x" * 97 + "..."
    assert got["conv-::"]["title"] == "Untitled Conversation"


def test_conversation_topics_need_messages_and_an_embedding(spark):
    rows = [("m1", "w", "c", "chat", "user", "first", 1, None), ("m2", "w", "c", "chat", "user", "y" * 250, 2, [1.0]), ("m3", "v", "c", "chat", "user", "third", 3, [2.0])]
    rows += [("n1", "w", "d", "chat", "user", "few", 1, [1.0]), ("o1", "w", None, "chat", "user", "no chat", 1, [1.0])]
    rows += [(f"p{i}", "w", "e", "chat", "user", "bare", i, None) for i in range(4)]
    got = themes.conversation_topics(spark.createDataFrame(rows, MESSAGES), 3).collect()
    assert [(r["chat_id"], r["workspace"], r["text"], r["ts_ms"], r["message_count"]) for r in got] == [("c", "w", "y" * 200, 2, 3)]


def test_unexplored_words_leave_out_what_titles_hold(spark):
    rows = [(f"m{i}", "w", f"c{i}", "chat", "user", f"'Catalyst!' plans {'SHUFFLES' if i < 6 else ''} 123abc456 library-word", i, None) for i in range(10)]
    rows += [("m10", "w", None, "chat", "user", None, 10, None), ("m11", "w", None, "chat", "user", "catalyst", 11, None)]
    messages = spark.createDataFrame(rows, MESSAGES)
    items = spark.createDataFrame([("Plans for all", "active"), ("old Catalyst", "archived"), ("library-word", "active"), (None, "active")], "title string, status string")
    got = [tuple(r) for r in themes.unexplored_words(messages, items).collect()]
    assert got == [("Catalyst", 11, "high", rows[0][5]), ("Shuffles", 6, "medium", rows[0][5])]
    assert themes.unexplored_words(messages.limit(9), items).count() == 0


def test_topic_titles(spark):
    rows = [(1, 1, "Deploy the service, please"), (1, 2, "deploy-ment of Service"), (1, 6, "later later later"), (2, 1, "to be or not " * 8), (3, 1, None)]
    got = {r["cluster"]: r["title"] for r in themes.topic_titles(spark.createDataFrame(rows, "cluster long, place long, text string")).collect()}
    assert got == {1: "Service & Deploy & Please", 2: ("to be or not " * 8)[:50] + "...", 3: ""}
