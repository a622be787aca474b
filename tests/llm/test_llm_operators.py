"""The training-data operators against brute force, round trips and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import bpe, hashing, html_extract, line_dedup, media_webp, near_dedup, packing, quality_mil, quality_rules, sharding, toxicity_crf
from threadloom.llm.common import spread_rank, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, `key` string, hub string"


def docs_of(spark, texts, schema=SCHEMA):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), 7, "k", "h") for i, t in enumerate(texts)], schema)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGES = [None, "", " \t\n", "one", "one two", "same text here again and again", "same text here again and again", "é ü ß 漢字 😀\n\n# $ % & | < >", LONG, "x" * 9000]


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(i, t, "en", "src0", len(t or ""), 7, "k", "h") for i, t in enumerate(EDGES)]
    rows += [rows[5], (None, "a row without an id", None, None, None, None, None, None), (20, "no source", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(
    "run",
    [
        lambda d, lab: line_dedup.drop_boilerplate(d),
        lambda d, lab: near_dedup.near_duplicates(d, 3, 85),
        lambda d, lab: sharding.hilbert_shards(d),
        lambda d, lab: bpe.round_trip_digests(d, vocabulary_path()),
        lambda d, lab: bpe.encode_decode(d, vocabulary_path()),
        lambda d, lab: quality_mil.score_quality(d, lab),
        lambda d, lab: toxicity_crf.score_toxicity(d, lab),
        lambda d, lab: quality_rules.quality_filter(d),
        lambda d, lab: media_webp.media_columns(d),
    ],
    ids=["op1", "op2", "op3", "op4", "op4_ids", "op5", "op7", "op9", "op10"],
)
def test_a_row_for_every_document_and_none_for_an_empty_table(spark, edge_docs, labels, run):
    out = run(edge_docs, labels)
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids == Counter(r["doc_id"] for r in edge_docs.select("doc_id").collect())
    assert run(edge_docs.limit(0), labels.limit(0)).count() == 0
    same = out.filter("doc_id = 5").drop("slot", "shard").collect()
    assert len(same) == 2 and same[0] == same[1]


# op1


def test_lines_over_the_ratio_of_their_host_go(spark):
    pages = [("a", "menu\nfirst\nmenu"), ("a", " menu \nsecond"), ("a", "menu"), ("a", "third\n\nfoot"), ("b", "menu\nfourth"), ("b", "fifth"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(pages)], "doc_id int, source string, text string")
    got = {r["doc_id"]: (r["text"], r["lines_in"], r["lines_dropped"]) for r in line_dedup.drop_boilerplate(df, ratio=0.5, min_pages=2).collect()}
    assert got == {0: ("first", 3, 2), 1: ("second", 2, 1), 2: ("", 1, 1), 3: ("third\n\nfoot", 3, 0), 4: ("menu\nfourth", 2, 0), 5: ("fifth", 1, 0), 6: ("x", 1, 0), 7: (None, 0, 0)}


@pytest.mark.parametrize("most", [0, 10**6], ids=["dealt by host", "broadcast"])
def test_hot_hosts_and_clashing_names(spark, most):
    rows = [(i, "hot" if i % 3 else f"h{i % 5}", f"menu {i % 2}\nline {i}\n\nfoot", 1, 2, 3, "k") for i in range(3000)] + [(i, "hot", "same page\nfoot", 1, 2, 3, "k") for i in range(3000, 4000)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string, _in int, _keys int, lines_in int, host string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, broadcast_keys=most).collect()}
    seen, total = defaultdict(set), Counter(r[1] for r in rows)
    for r in rows:
        for line in r[2].split("\n"):
            seen[r[1], line].add(r[0])
    assert len(got) == 4000
    for r in rows:
        lines = r[2].split("\n")
        kept = [x for x in lines if not x or len(seen[r[1], x]) < 3 or len(seen[r[1], x]) <= 0.05 * total[r[1]]]
        out = got[r[0]]
        assert (out["text"], out["lines_in"], out["lines_dropped"], out["_in"], out["_keys"], out["host"]) == ("\n".join(kept), len(lines), len(lines) - len(kept), 1, 2, "k")


# op2


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


def near_texts(seed, n):
    """Copies, chains of small changes, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(20))
    out = [None, "", "A", "a", "a b", "A  b\n"]
    while len(out) < n:
        base = [word() for _ in range(rng.choice([3, 5, 7, 12, 40, 90]))]
        if rng.random() < 0.3:
            base = passage.split() + base
        for _ in range(rng.randint(1, 8)):
            out.append(" ".join(base))
            if rng.random() < 0.8:
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base = base[:-1] or [word()]
    return out[:n]


@pytest.mark.parametrize(("k", "percent", "crowd"), [(3, 85, 48), (5, 80, 3)])
def test_near_duplicates_as_brute_force(spark, k, percent, crowd):
    texts = near_texts(k, 220)
    got = near_dedup.near_duplicates(docs_of(spark, texts), k, percent, crowd=crowd).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts, k, percent)


def test_many_copies_of_one_base_stay_linear(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            own[rng.randrange(120)] = f"n{rng.randrange(50)}"
        texts.append(" ".join(own))
    got = near_dedup.near_duplicates(docs_of(spark, texts), 3, 85).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts, 3, 85)


def test_rows_of_one_id_and_rows_without_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, b), (3, a), (None, a), (None, c), (None, c), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 3, 85).collect())
    assert got == Counter([(5, 38, 3, False), (5, 38, 3, False), (7, 38, 3, False), (3, 38, 3, True), (None, 38, 3, True), (None, 38, None, True), (None, 38, None, True), (9, 0, 9, True), (9, 0, 9, True)])


@pytest.mark.parametrize("sizes", [(3000, 3000), (300, 340), (40_000, 52_000)])
def test_registers_estimate_similarity(sizes):
    rng = np.random.default_rng(1)
    n, m = sizes
    common = int(0.8 * n)
    h = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
    a, b = np.sort(h[:n]), np.sort(h[n - common : n - common + m])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    [est] = near_dedup.estimates(*([near_dedup.compressed(near_dedup.registers(x))] for x in (a, b)), np.array([n]), np.array([m]))
    assert abs(est - j) < 5 * math.sqrt(j * (1 - j) / min(near_dedup.SKETCH, n / 2))


def test_unlike_registers_agree_as_often_as_said():
    rng = np.random.default_rng(3)
    for n, m in ((2000, 2000), (2000, 60_000), (60_000, 60_000)):
        same = []
        for _ in range(40):
            a, b = (near_dedup.compressed(near_dedup.registers(np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)))) for k in (n, m))
            same.append(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
        [c] = near_dedup.chance(np.array([n]), np.array([m]))
        assert abs(np.mean(same) - c) < 5 * math.sqrt(c / (40 * near_dedup.SKETCH))


def plain_components(pairs):
    label = {v: v for p in pairs for v in p if p[0] != p[1]}

    def root(v):
        while label[v] != v:
            label[v] = label[label[v]]
            v = label[v]
        return v

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            label[hi] = lo
    return {v: root(v) for v in label}


@pytest.mark.parametrize("kind", ["random", "ascending path"])
def test_components_take_the_least_id(spark, kind, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7)] if kind == "random" else [(i, i + 1) for i in range(10_000)]
    written = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, f=near_dedup.cut: written.append(1) or f(df))
    got = {r["doc_id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components(pairs)
    assert (len(written) - 3) // 2 < 25  # two tables a round, and a few more


@pytest.mark.parametrize(("few", "most"), [(0, 80), (100, 40), (200_000, 5)])
def test_components_end_in_one_task_when_few_edges_are_left(spark, few, most, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)] + [(1000 + i, 1001 + i) for i in range(300)]
    written = []
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "cut", lambda df, f=near_dedup.cut: written.append(1) or f(df))
    got = {r["doc_id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components(pairs)
    assert len(written) <= most


# op3


def test_curve_visits_every_cell_once_and_steps_to_neighbours():
    at = {sharding.curve_index((x, y, z), 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(511))


def test_shards_are_even_and_slots_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.hilbert_shards(docs, 8).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None and r["law"] == "rows"
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    ends = {s: (min(x), max(x)) for s, x in ((k, [r["curve"] for r in rows if r["shard"] == k]) for k in by)}
    assert all(ends[s][1] <= ends[s + 1][0] for s in range(7))


def test_ranks_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("key"), "id")
    rows = spread_rank(df, "key", ["id"], parts=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["key"]].append(r["rank_in_key"])
        assert r["key_count"] >= len(by[r["key"]])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 5000


# op4 and op8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(5)
    fixed = ["", "  ", "İstanbul ΣΑΣ don't I'LL we've", "a<|endoftext|>b <|startoftext|> c <|ENDOFTEXT|>", "a\x1cb\x85c　d e", "été Å", "½ ² ٣ १२ 漢字かな 😀👍🏽 naïve", "x" * 3000, "!" * 400, "'s's't", "lllllll llque", "\x00\x01﻿", "a" * 70 + ".,"]
    return fixed + ["".join(rng.choice("abcdefghij e'sthing.,!?ABC éüñß😀\n\t0123") for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_ids_and_decoded_text_as_the_library(spark, library):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs_of(spark, texts), vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_only_reachable_pairs_fit(library):
    v = bpe.vocabulary_at(vocabulary_path())
    rng = random.Random(1)
    names = [n for n in library.get_vocab() if n.endswith("</w>") and n[:-4].isascii() and n[:-4].isalpha() and n[:-4].islower()]
    for n in rng.sample(names, 500):
        assert v.encode_piece(n[:-4]) == library.encode(n[:-4], add_special_tokens=False).ids


def test_cache_keeps_two_generations():
    seen = bpe.Chunks(lambda p: [ord(c) for c in p], most=3)
    ids = lambda t: [c for p in t for c in map(ord, p)]
    for texts in ([["a", "b"], ["c,", "d"]], [["e", "a"], ["f", 7]], [["g"], ["y" * 100, "c,"]], [["a"], []]):
        for parts, raw in zip(texts, seen.of_texts(texts), strict=True):
            assert np.frombuffer(raw, np.uint32).tolist() == [x for p in parts for x in ([p] if isinstance(p, int) else ids(p))]
    assert len(seen) <= 3 + 6 and "y" * 100 not in seen and "y" * 100 not in seen.old


def check_packing(rows, pieces, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    return len(by)


def test_packed_pieces_are_the_documents(spark, library):
    texts = [*odd_texts()[:300], None, "the loom " * 900, "same", "same", "word " * 127, "word " * 255]
    rows = packing.pack(docs_of(spark, texts), vocabulary_path(), capacity=128).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 128):
            part = ids[k : k + 128]
            want[i, k // 128, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    used = check_packing(rows, want, 128)
    assert used == math.ceil(sum(r["length"] for r in rows) / 128)


@pytest.mark.parametrize("seed", range(30))
def test_plans_place_every_item_and_come_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
    plan = packing.plan(counts, capacity)
    placed = Counter()
    for n, content in plan:
        assert n > 0 and sum(w * k for w, k in content) <= capacity
        for w, k in content:
            placed[w] += n * k
    assert placed == Counter(counts)
    total = sum(w * n for w, n in counts.items())
    assert sum(n for n, _ in plan) <= math.ceil(1.25 * total / capacity) + 1 + sum(n for w, n in counts.items() if 2 * w > capacity)


def best(items, capacity):
    """The fewest bins, by trying everything."""
    items, found = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= found[0]:
            return
        if k == len(items):
            found[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_never_costs_a_bin(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(9)]
    rest = dict(Counter(items))
    fixed = packing.reduce_by_dominance(rest, 20)
    left = [w for w, n in rest.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + best(left, 20) == best(items, 20)


# op5


def test_quality_model_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_mil.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def plain_passages(text):
    """The features by loops, a passage at a time."""
    raw, words, at = text.encode(), [], 0
    for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" "):
        if w:
            words.append((at, w))
        at += len(w) + 1
    cls = lambda c: next((k for k, own in enumerate(quality_mil._CLASSES) if chr(c) in own), quality_mil.K - 1 if c > 127 else quality_mil.K - 2)
    seen3, out = set(), []
    for p in range(0, len(words), 64):
        own = words[p : p + 64]
        stretch = raw[own[0][0] if p else 0 : words[p + 64][0] if p + 64 < len(words) else len(raw)]
        row = [sum(cls(c) == k for c in stretch) / len(stretch) for k in range(quality_mil.K)]
        sizes = [len(w) for _, w in own]
        again = []
        for i in range(p, p + len(own)):
            key = tuple(w for _, w in words[i : i + 3])
            again.append(len(key) == 3 and key in seen3)
            if len(key) == 3:
                seen3.add(key)
        local = [own[i][1] in {w for _, w in own[:i]} for i in range(len(own))]
        same = [i > 0 and words[i][1] == words[i - 1][1] for i in range(p, p + len(own))]
        row += [np.mean(sizes) / 10, np.std(sizes) / 10, np.mean(same), np.mean(again), np.mean(local)]
        out.append([*row, np.mean([65 <= w[0] <= 90 for _, w in own]), np.mean([cls(w[-1]) in (5, 6, 7) for _, w in own]), min(2, stretch.count(b"\n") / len(own)), 0.0])
    return np.array(out)


def test_passages_of_long_texts_as_loops(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["Loom,", "warp", "é" * rng.randint(1, 9), "x\n", "a b", "#", "W" + "o" * 300]) for _ in range(3000))
    whole = quality_mil.passages(text)
    assert np.allclose(whole, plain_passages(text))
    for module in (quality_mil, hashing):
        monkeypatch.setattr(module, "STRETCH", 500)
    assert (quality_mil.passages(text) == whole).all()


def test_scores_of_very_long_texts(spark):
    docs, labels = mixed_corpus(spark, 400)
    big = " ".join(["loom warp weft thread"] * 150_000)  # over 3 MB in one line
    rows = docs.union(spark.createDataFrame([(1000, big), (1001, big + "\n" + "y" * 2_000_000)], docs.schema))
    for run in (quality_mil.score_quality, toxicity_crf.score_toxicity):
        got = {r["doc_id"]: r["score"] for r in run(rows, labels).collect()}
        assert len(got) == 402 and 0 <= got[1000] <= 1 and 0 <= got[1001] <= 1


def test_attention_gradient_is_the_losses_slope():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(rng.integers(1, 5), 6)) for _ in range(12)]
    y = rng.integers(0, 2, 12).astype(float)
    few, more = (quality_mil.fit_attention(bags, y, width=4, gates=3, steps=n) for n in (1, 200))
    loss = lambda m: -np.mean(y * np.log(m.score(bags)) + (1 - y) * np.log(1 - m.score(bags)))
    assert loss(more) < 0.5 * loss(few)


def mixed_corpus(spark, n=2400):
    """One document of ten is toxic and of low quality; half of these have a word that tells, the others look like all the rest."""
    rng, rows = random.Random(8), []
    for i in range(n):
        y = int(rng.random() < 0.1)
        words = ["loom", "warp", "weft", "thread"] * 3 + ["cloth"] * (i % 5)
        if y and rng.random() < 0.5:
            words[0] = "IDIOT"
        rng.shuffle(words)
        rows.append((i, " ".join(words), 1 - y, y))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label"), [(quality_mil.score_quality, "quality"), (toxicity_crf.score_toxicity, "toxic")], ids=["op5", "op7"])
def test_scores_keep_the_label_rate_when_classes_are_cut(spark, run, label):
    docs, labels = mixed_corpus(spark)
    rows = run(docs, labels, per_class=80).join(labels, "doc_id").filter("held_out").collect()
    assert abs(np.mean([r["score"] for r in rows]) - np.mean([r[label] for r in rows])) < 0.04
    assert np.mean([r["predicted"] == r[label] for r in rows]) > 0.85


# op6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">An advert with quite a few words in it to read.</div><article><h1>Head &amp; line</h1><p><b>First  part<br>of it.<br><p>Second part of the article with more words.</p><p>Ok.</p>
<section class="comments"><p>A reader's comment of some length on the article.</p></section></article><footer>&copy; site</footer></body></html>"""


def test_main_text_of_pages(spark):
    pages = [(1, "u", PAGE), (2, "u", ""), (3, None, None), (4, "u", "just text &lt;b&gt; &am"), (5, "u", "<div><p>unclosed <b>bold"), (6, "u", "<nav>only a menu</nav>"), (7, "u", "<article>" + "<p>word word word.</p>" * 5000 + "</article>")]
    rows = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[1]["text"] == "Head & line\n\nFirst part of it.\n\nSecond part of the article with more words.\n\nOk."
    assert [rows[k]["text"] for k in (2, 3, 4, 5, 6)] == ["", "", "just text <b> &am", "unclosed bold", ""]
    assert rows[7]["text"].count("\n\n") == 4999 and all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_region_without_article_elements():
    html = '<body><div id="header"><h2>Site</h2></div><div class="menu"><a>One</a><a>Two</a></div><div><div class="story"><h1>Title</h1><p>A long paragraph of the story with several words.<p>Another long paragraph, with more.<ul><li>item one<li>item two</ul></div><div class="sidebar"><p>Other things to read elsewhere</p></div></div><div id=footer>Copyright</div></body>'
    assert html_extract.main_text(html) == "Title\n\nA long paragraph of the story with several words.\n\nAnother long paragraph, with more.\n\nitem one\n\nitem two"


LONG_TEXT, SHORT_TEXT = "story " * 333 + "end", "short " * 49 + "end"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div><h1>Title</h1><p>{LONG_TEXT}</p><p>{SHORT_TEXT}</p></div>", ["Title", LONG_TEXT, SHORT_TEXT]),
        (f"<div><div><h1>Title</h1><p>{LONG_TEXT}</p></div><div><p>{SHORT_TEXT}</p></div></div>", ["Title", LONG_TEXT, SHORT_TEXT]),
        (f"<div><div><div><p>{LONG_TEXT}</p></div></div><div><p>{SHORT_TEXT}</p></div></div>", [LONG_TEXT, SHORT_TEXT]),
        (f"<div><p>Before it.</p><ul><li>{LONG_TEXT}</li><li>Last item</li></ul></div>", ["Before it.", LONG_TEXT, "Last item"]),
        (f"<article><p>{LONG_TEXT}</p></article><article><p>{SHORT_TEXT}</p></article><article><p>Brief.</p></article>", [LONG_TEXT, SHORT_TEXT, "Brief."]),
        (f'<div class="has-sidebar no-comments"><h1>Title</h1><p>{LONG_TEXT}</p></div><div class="sidebar2">Elsewhere</div><div class="post comments">A comment</div><div id="site-footer">Foot</div>', ["Title", LONG_TEXT]),
    ],
    ids=["dominant paragraph", "two divs", "wrapped div", "dominant item", "sibling articles", "class names"],
)
def test_nothing_else_of_the_article_goes(body, want):
    assert html_extract.main_text(f"<html><body><nav><a>Menu</a></nav>{body}<footer>Copyright</footer></body></html>") == "\n\n".join(want)


PLAIN = (
    '<html><body><div id=x1><div><a href=/1>Home of the site</a></div><div><a href=/2>All of the news</a></div><div><a href=/3>Pictures and films</a></div></div>'
    f"<div id=x2><div><p>{SHORT_TEXT}</p><p>Brief words.</p></div><div><div><a href=/4>See a picture</a></div><div><a href=/5>See another one</a></div><div><a href=/6>See the third one</a></div></div><div><p>{LONG_TEXT}</p></div></div>"
    "<div id=x3><div><span><b>Votes</b></span> <i>12</i> <u>3</u></div><div><span><b>Seen</b></span> <i>40</i></div><div><a href=/7>About us and others</a></div><div><a href=/8>Terms of this site</a></div></div></body></html>"
)


def test_the_ratio_decides_where_no_name_tells(monkeypatch):
    assert html_extract.main_text(PLAIN) == "\n\n".join([SHORT_TEXT, "Brief words.", LONG_TEXT])
    monkeypatch.setattr(html_extract, "smoothed", lambda ratio, sigma: np.ones(len(ratio)))
    assert "Votes 12 3\n\nSeen 40" in html_extract.main_text(PLAIN)


def test_a_region_is_whole_or_the_best_of_its_parts():
    assert html_extract.content_regions([5, -3, 4], [1, 2, 3], [0, 0, 0, 0]) == [False, True, False, True]
    assert html_extract.content_regions([5, -3, 4], [1, 1, 1], [0, 0]) == [False, True]
    assert html_extract.content_regions([5, 4], [2, 3], [0, 0, 1, 1]) == [False, True, True, True]
    assert html_extract.content_regions([-1, 0], [0, 1], [0, 0]) == [False, False]


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "end", "<p>" + "<b>x" * 50_000 + "<hr>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<div>" * 50_000 + "</i>" * 50_000 + "end"])
def test_deep_markup_takes_little(html):
    import time
    import tracemalloc

    began = time.process_time()
    assert html_extract.main_text(html)
    assert time.process_time() - began < 20
    tracemalloc.start()
    html_extract.main_text(html[:400_000])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_page_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, container int"
    rows = [(1, "u", PAGE, "t", 5, 1), (1, "u", PAGE, "t", 5, 1), (None, None, "<p>one", None, None, None), (2, "u", None, "x", 1, 1)]
    got = Counter(tuple(r) for r in html_extract.extract_main_text(spark.createDataFrame(rows, schema)).collect())
    text = html_extract.main_text(PAGE)
    assert got == Counter({(1, "u", text, len(text)): 2, (None, None, "one", 3): 1, (2, "u", "", 0): 1})
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0


# op7


def brute_marginals(pot, move):
    n, total, ones = len(pot), 0.0, np.zeros(len(pot))
    for code in range(2**n):
        s = [code >> i & 1 for i in range(n)]
        p = move[2, s[0]] * (pot[0] if s[0] else 1)
        for i in range(1, n):
            p *= move[s[i - 1], s[i]] * (pot[i] if s[i] else 1)
        total += p
        ones += p * np.array(s)
    return ones / total


def test_marginals_as_all_paths():
    rng = np.random.default_rng(2)
    move = np.exp(rng.normal(size=(3, 2)))
    chains = [np.exp(rng.normal(size=n)) for n in (1, 2, 5, 8, 3)]
    for got, pot in zip(toxicity_crf.marginals(chains, move), chains, strict=True):
        assert got == pytest.approx(brute_marginals(pot, move))
    n = max(map(len, chains))
    pot, there = np.ones((5, n)), np.zeros((5, n), bool)
    for i, c in enumerate(chains):
        pot[i, : len(c)], there[i, : len(c)] = c, True
    p, pair = toxicity_crf.chains(pot, there, move)
    for i, c in enumerate(chains):
        assert p[i, : len(c)] == pytest.approx(brute_marginals(c, move))
        for t in range(1, len(c)):
            assert pair[i, t].sum() == pytest.approx(1) and pair[i, t, 1] + pair[i, t, 3] == pytest.approx(p[i, t])


def test_a_long_line_is_one_chain():
    rng = np.random.default_rng(5)
    move = np.exp(rng.normal(size=(3, 2)))
    emissions = [np.exp(rng.normal(size=n) * 2) for n in (2000, 1, 0, 257, 258, 256, 3, 770)]
    for got, pot in zip(toxicity_crf.marginals(emissions, move), emissions, strict=True):
        if len(pot):
            want, _ = toxicity_crf.chains(pot[None], np.ones((1, len(pot)), bool), move)
            assert got == pytest.approx(want[0])
        assert len(got) == len(pot)


def test_quiet_texts_have_no_marginal_worth_noting():
    rng = np.random.default_rng(4)
    tagger = toxicity_crf.Tagger(np.zeros(toxicity_crf.HASHED, np.float32), np.exp(rng.normal(size=(3, 2))))
    for _ in range(50):
        pot = rng.uniform(0, tagger.quiet, rng.integers(1, 9))
        assert toxicity_crf.marginals([pot], tagger.move)[0].max() < tagger.least


def test_training_keeps_tokens_as_numbers():
    """The tagger learns on the driver: beside its batches and weights it takes little more than the texts."""
    rnd = random.Random(4)
    text = lambda y: " ".join([f"word{rnd.randrange(3000)}" for _ in range(4000)] + ["vilest"] * (3 * y))
    sample = [(i, text(i % 2), i % 2) for i in range(200)]
    tracemalloc.start()
    model = toxicity_crf.fit_tagger(sample, passes=1, batch=16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sample) * 4000 == 800_000 and peak < 50 * 800_000
    assert not model.potential


def toxic_corpus(seed=1):
    rng = random.Random(seed)
    words = ["loom", "thread", "warp", "weft", "cloth", "dye", "yarn", "spin"]
    rows = []
    for i in range(400):
        w = [rng.choice(words) + rng.choice(words)[:3] for _ in range(30)]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot,", "Scum", "grumfoo" + rng.choice("abcd")]))
        rows.append((i, " ".join(w[:15]) + "\n" + " ".join(w[15:]), y))
    return rows


def test_toxic_documents_and_spans(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity_crf.score_toxicity(docs, labels).collect()
    y = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and all(r["predicted"] == y[r["doc_id"]] for r in held)
    text = {r[0]: r[1] for r in rows}
    marked = {text[r["doc_id"]][s["start"] : s["end"]].split()[0].strip(",").lower()[:5] for r in held for s in r["spans"]}
    assert marked == {"idiot", "scum", "grumf"}


# pipeline


@pytest.mark.parametrize("labelled", [[], [(i, 1, 0) for i in range(30)], [(i, 0, 1) for i in range(30)]], ids=["none", "clean only", "toxic only"])
def test_toxicity_stage_keeps_all_without_a_model(spark, tmp_path, labelled):
    docs = docs_of(spark, [f"text {i} of the corpus" for i in range(30)]).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 30


def test_near_dedup_stage_keeps_rows_without_id_and_each_text_once(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (3, c), (None, b), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, a), (3, b), (3, c), (None, b), (None, None)])


# op9


def brute_counts(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, lines_seen, dup = defaultdict(list), set(), 0
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines_seen
            lines_seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_as_a_plain_loop(spark):
    rng = random.Random(6)
    texts = [*EDGES, "a b c a b c", "a a a a", "a a a", "x\ny\nx\n \n \nx"] + [" ".join(rng.choice("ab#c\n|é") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    out = quality_rules.quality_filter(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(t), t
        assert not (r["base_failed"] and r["kept"])


def test_order_changes_no_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counted = quality_rules.with_counts(docs)
    verdicts = [{r["doc_id"]: r["x"] for r in counted.select("doc_id", quality_rules.cascade(rules).isNull().alias("x")).collect()} for rules in (list(quality_rules.RULES), quality_rules.order_rules(docs))]
    assert verdicts[0] == verdicts[1] and {True, False} == set(verdicts[0].values())
    assert {r["doc_id"] for r in quality_rules.passing(docs).collect()} == {d for d, ok in verdicts[0].items() if ok}


def test_counts_are_made_only_where_no_earlier_rule_rejects(spark):
    """A condition that raises on what an earlier rule rejects is never reached for it."""
    docs = docs_of(spark, ["few words", None, "enough words " * 40 + " ".join(map(str, range(90)))])
    few = quality_rules.RULES[0]
    trap = quality_rules.Rule("trap", lambda c: F.when(c["n_repeat_words"] + c["n_words"] < 20, F.raise_error(F.lit("made")).cast("boolean")).otherwise(False))
    left = quality_rules.not_failing(docs, [few, trap])
    assert [r["doc_id"] for r in left.collect()] == [2] and left.columns == docs.columns
    with pytest.raises(Exception, match="made"):
        quality_rules.not_failing(docs, [trap, few]).collect()


def test_rules_that_reject_more_a_second_come_first(spark):
    docs = docs_of(spark, ["a few words"] * 300)
    assert quality_rules.order_rules(docs)[0].name == "few_words"


def test_names_of_results_in_the_input(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, 6, 7)], "doc_id long, text string, _words string, words_ int, n_words int, kept int")
    [row] = quality_rules.quality_filter(docs).collect()
    assert (row["n_words"], row["kept"], row["_words"], row["words_"]) == (2, False, "x", 5)


# op10


@pytest.mark.parametrize("text", [None, "", "a", "ab" * 40, "\0" * 300, "x" * 300_000, "line of text here\n" * 50, "".join(map(chr, range(1, 2000)))])
def test_payloads_come_back(text):
    n, payload = media_webp.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and n == len((text or "").encode())
    media = media_webp.store(payload)
    assert media_webp.load(media).tobytes() == payload and media == media_webp.store(payload)


def test_long_payloads_are_one_image(monkeypatch):
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 40)).astype(np.uint8)) for _ in range(300)]
    text = b"\n".join(words[i] for i in rng.integers(0, 300, 60_000)) + "é".encode() * 99
    payload = text + bytes(-len(text) % 64)
    payload += bytes(64 * (1 - len(payload) // 64 % 2))
    assert len(payload) > 64 * media_webp.ROWS
    media = media_webp.store(payload)
    assert media.count(b"RIFF") == 1 and media_webp.load(media).tobytes() == payload
    assert media_webp.decode(media)[0] == 128
    small = media_webp.store(payload[: 64 * 3000])
    monkeypatch.setattr(media_webp, "STRETCH", 1000)
    assert media_webp.load(small).tobytes() == payload[: 64 * 3000]


#: Two by two pixels by hand, from the format's description: simple codes for green 0 and 255, for red, blue and distance 0, for alpha 255.
HAND = [(1, 14), (1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)] * 2 + [(1, 1), (0, 1), (1, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)] + [(0, 1), (1, 1), (1, 1), (0, 1)]


def test_an_image_made_by_hand():
    value = n = 0
    for v, k in HAND:
        value |= v << n
        n += k
    body = b"\x2f" + value.to_bytes(-(-n // 8), "little")
    data = b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    width, height, p = media_webp.decode(data)
    assert (width, height, [hex(x) for x in p.tolist()]) == (2, 2, ["0xff000000", "0xff00ff00", "0xff00ff00", "0xff000000"])


def test_all_bytes_and_small_palettes_come_back():
    rng = np.random.default_rng(7)
    for colours in (1, 2, 3, 4, 5, 16, 17, 100, 256):
        raw = rng.choice(rng.permutation(256)[:colours], 64 * 30).astype(np.uint8).tobytes()
        assert media_webp.load(media_webp.store(raw)).tobytes() == raw


@pytest.mark.parametrize("trial", range(60))
def test_every_transform_comes_back(trial):
    rng = np.random.default_rng(trial)
    w, h = int(rng.integers(1, 40)), int(rng.integers(1, 30))
    kinds = [rng.integers(0, 2**32, w * h), np.repeat(rng.integers(0, 2**32, w * h // 3 + 1), 3)[: w * h], rng.integers(0, 6, w * h) * 0x01020304 + 0xFF000000]
    p = kinds[trial % 3].astype(np.uint32)
    media = media_webp.encode_pixels(p, w, predictor=[None, *range(14)][trial % 15], cross=[None, (7, 200, 33)][trial // 2 % 2], subtract_green=bool(trial % 2), cache_bits=[0, 1, 5, 11][trial % 4])
    width, height, got = media_webp.decode(media)
    assert (width, height) == (w, h) and (got == p).all()


def test_damaged_images_raise():
    media = media_webp.store(media_webp.payload_of("some text " * 100)[1])
    for bad in (b"", media[:20], b"RIFX" + media[4:], media[:20] + b"\x00" + media[21:], media[: len(media) // 2]):
        with pytest.raises((ValueError, IndexError)):
            media_webp.decode(bad)


def test_digest_columns(spark):
    rows = {r["doc_id"]: r for r in media_webp.media_columns(docs_of(spark, ["abc", "abc", None]), keep_media=True).collect()}
    payload = b"abc" + bytes(61)
    assert (rows[0]["n_bytes"], rows[0]["payload_bytes"], rows[0]["payload_sha256"], rows[0]["tail_crc32"]) == (3, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert rows[0]["media_sha256"] == hashlib.sha256(bytes(rows[0]["media"])).hexdigest() and rows[0]["media_bytes"] == len(rows[0]["media"])
    assert {k: v for k, v in rows[0].asDict().items() if k != "doc_id"} == {k: v for k, v in rows[1].asDict().items() if k != "doc_id"}
    assert rows[2]["payload_bytes"] == 64 and rows[2]["n_bytes"] == 0
