import random
import re
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.words import TOKEN, WORD
from quillspark.llm.components import connected_components
from quillspark.llm.knn import neighbour_pairs, neighbours
from quillspark.llm.neardup import bag_min_hash, bands_needed, near_duplicates, similar_pairs
from quillspark.llm.prefix import running_total
from quillspark.llm.split import RangeMaximum, oversized_ids, split_oversized, split_text

# ---- splitting


@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    best = max(values[lo : hi + 1])
    assert RangeMaximum(np.array(values)).argmax(lo, hi) == max(i for i in range(lo, hi + 1) if values[i] == best)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n中文。#-1", max_size=1500))
def test_pieces_cover_the_text_and_overlap(text):
    pieces = split_text(text, 100, 10)
    n = len(TOKEN.findall(text))
    assert all(j - i <= 100 and len(TOKEN.findall(text[b:e])) == j - i for b, e, i, j in pieces)
    if n:
        assert pieces[0][2] == 0 and pieces[-1][3] == n
    for (_, _, _, j), (_, _, i, _) in zip(pieces, pieces[1:]):
        assert i == j - 10


def test_cuts_at_the_strongest_boundary():
    text = " ".join(["word"] * 70) + ".\n\n" + " ".join(["next"] * 20) + ". " + " ".join(["tail"] * 60)
    (_, end, _, cut), *_ = split_text(text, 100, 10)
    assert cut == 71 and text[:end].endswith("word.")


SPLIT = "id string, document_version_id string, chunk_index int, section_path array<string>, previous_chunk_index int, text string, token_count int, piece int"


def test_split_oversized_edges(spark):
    long = " ".join(["word"] * 651)
    rows = [("a", "v", 3, ["s"], 2, long, 5, 9), ("a", "v", 3, ["s"], 2, long, 5, 9), ("b", "v", 4, None, None, " ".join(["w"] * 650), 9999, 9), ("c", None, None, None, None, None, None, None), ("d", "v", 5, [], 4, "", 0, 0), (None, "v", 6, [], 5, long, 0, 0), ("h", "v", 7, None, None, "x" * 200_000, 1, 1), ("l", "v", 8, ["t"], 7, "中" * 30_000, 1, 1)]
    df = spark.createDataFrame(rows, SPLIT)
    out = split_oversized(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in out} == {"a", None, "l"}
    a = [r for r in out if r.chunk_id == "a"]
    assert [(r.piece, r.previous_chunk_index, r.previous_piece, r.section_path) for r in a] == [(0, 2, None, ["s"]), (1, 3, 0, ["s"])]
    assert all(r.token_count <= 650 for r in out)
    assert sorted(r[0] or "" for r in oversized_ids(df).collect()) == ["", "a", "l"]
    assert split_oversized(df.limit(0)).count() == 0


# ---- near-duplicates


def brute_force(texts, words, threshold, multiset):
    from collections import Counter

    bags = {}
    for key, text in texts:
        if text is not None and (w := WORD.findall(text.lower())):
            grams = [tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
            bags[key] = Counter(grams) if multiset else Counter(set(grams))
    out = set()
    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()):
                out.add((a, b))
    return out


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(40):
        words = rng.choices(vocabulary, k=rng.choice([8, 60, 150]))
        for copy in range(4):
            w = list(words)
            for _ in range(rng.randint(0, 4) if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((f"{base:02}-{copy}", " ".join(w)))
    repeated = " ".join(["again and again"] * 30)
    return [*rows, ("r1", repeated), ("r2", repeated + " again"), ("r3", "again and again"), ("s1", "Hi"), ("s2", "hi!"), ("e1", ""), ("e2", "..."), ("n", None)]


@pytest.mark.parametrize(("words", "threshold", "multiset"), [(3, 0.5, False), (5, 0.8, True), (2, 0.6, True)])
def test_pairs_as_brute_force(spark, edited, words, threshold, multiset):
    df = spark.createDataFrame([*edited, edited[0]], "id string, text string")
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, words, threshold, multiset=multiset).collect()}
    assert got == brute_force(edited, words, threshold, multiset)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**63, 200).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
    row, element, weight = np.repeat([0, 1], 150), np.concatenate([ids[:150], ids[50:]]), np.concatenate([wa[:150], wb[50:]])
    s = bag_min_hash(row, element, weight, 2, 20_000)
    a, b = np.zeros(200), np.zeros(200)
    a[:150], b[50:] = wa[:150], wb[50:]
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015


def test_bands_needed():
    p, n = 0.5**3, bands_needed(0.5, agree=2)
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= 0.005 < (1 - p) ** (n - 1) + (n - 1) * p * (1 - p) ** (n - 2)


def test_bands_needed_for_three_agreements():
    p = 0.5**3
    fewer = lambda n: sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(3))
    n = bands_needed(0.5, agree=3)
    assert fewer(n) <= 0.005 < fewer(n - 1)


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [("a", base), ("b", base + " x"), ("c", base + " x y"), ("c", base + " x y"), ("d", base), ("e", "quite another text here"), ("f", None), ("g", ""), (None, base)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "id string, text string, cls int, links string")
    got = {r.id: (r.group_id, r.links, r.copies) for r in near_duplicates(df).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 2, 0), "c": ("a", 2, 0), "d": ("a", 2, 1), "e": ("e", 0, 0), "f": ("f", 0, 0), "g": ("g", 0, 0)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest vectors


def test_neighbours_as_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 48))
    v = (centre[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 48))).astype(np.float32)
    v[10] = v[11] = v[12]
    rows = [(f"{i:04}", x.tolist()) for i, x in enumerate(v)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 48), ("nan", [float("nan")] * 48), ("hole", [None] + [1.0] * 47), (None, [1.0] * 48), rows[0]]
    df = spark.createDataFrame([(i, x, "q") for i, x in rows + bad], "id string, vector array<float>, cls string")
    got = {(r.id, r.other) for r in neighbours(df, lists=60).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    want = {(f"{i:04}", f"{j:04}") for i in range(900) for j in np.argsort(-sim[i], kind="stable")[:5]}
    assert len(got) == 4500 and len(got & want) / len(want) > 0.97


def test_equal_vectors_and_few_rows(spark):
    same = [(f"{i:02}", [1.0] * 48) for i in range(20)] + [("x", [1.0] * 47 + [1.1])]
    df = spark.createDataFrame(same, "id string, vector array<float>")
    got = {}
    for r in neighbours(df).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["07"] == ["00", "01", "02", "03", "04"] and got["02"] == ["00", "01", "03", "04", "05"] and got["x"] == ["00", "01", "02", "03", "04"]
    assert [tuple(r) for r in neighbour_pairs(df.filter("id in ('00', 'x')")).collect()] == [("00", "x")]
    assert neighbours(df.limit(0)).count() == 0 and neighbours(df.filter("id = 'x'")).count() == 0


# ---- running totals


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.s for r in running_total(df, ["k"], F.floor(F.col("i") / 7), [F.col("i")], F.col("v"), "s").collect()}
    for key in "ab":
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == key and True if r[0] == key):
            assert got[key, i] == total
            total += v or 0
    assert running_total(df.limit(0), ["k"], F.col("i"), [F.col("i")], F.col("v"), "s").count() == 0


def test_line_patterns():
    assert re.fullmatch(WORD, "né1")


# ---- long lists, two levels, hot bands


@pytest.fixture(scope="module")
def dense():
    """6,000 vectors around 12 centres, which lie far apart from each other."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(12, 48))[rng.integers(0, 12, 6000)] + 0.25 * rng.normal(size=(6000, 48))).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    return v, np.argsort(-sim, axis=1, kind="stable")[:, :5]


@pytest.mark.parametrize("options", [{"lists": 8}, {"lists": 12, "block": 200}, {"lists": 150, "sample": 640, "probes": 16}])
def test_recall_in_lists_far_longer_than_the_shortlist(spark, dense, options):
    v, true = dense
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<float>")
    got = {(r.id, r.other) for r in neighbours(df, **options).collect()}
    want = {(i, int(j)) for i, near in enumerate(true) for j in near}
    assert len(got) == 30_000 and len(got & want) / len(want) > 0.97


def test_a_hot_vector_leaves_the_sample_clean(spark, monkeypatch):
    from quillspark.llm import knn

    rng, seen, fit = np.random.default_rng(5), [], knn.fit
    x = rng.normal(size=(300, 48)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(300)] + [(300 + i, x[7].tolist()) for i in range(900)]
    monkeypatch.setattr(knn, "fit", lambda sample, lists, parts, codes: seen.append((sample, lists)) or fit(sample, lists, parts, codes))
    got = {}
    for r in neighbours(spark.createDataFrame(rows, "id long, vector array<float>"), sample=1000).collect():
        got.setdefault(r.id, []).append(r.other)
    (sample, lists), = seen
    assert len(sample) == 300 == len(np.unique(sample, axis=0)) and abs(lists - 2 * 300**0.5) < 2
    assert len(got) == 1200 and set(got[1000]) == {7, 300, 301, 302, 303}


def test_hot_bands_are_parted(spark):
    from quillspark.llm.neardup import candidates

    rows = [(i, 1) for i in range(40)] + [(i, 2) for i in range(40)] + [(i, 100 + i) for i in range(40)] + [(90, 7), (91, 7)]
    banded = spark.createDataFrame(rows, "cls long, band long")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    for hot in (3, 1000):
        assert {(r.cls_a, r.cls_b) for r in candidates(banded, 2, hot).collect()} == want
    assert candidates(banded.limit(0), 2).count() == 0


def test_texts_that_share_one_hash_are_both_checked(spark, monkeypatch):
    from quillspark.llm import neardup

    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, 0, a), (1, 1, b), (2, 0, a + " x"), (3, 0, b + " y")]
    texts = spark.createDataFrame(rows, "cls long, sub long, text string")
    got = {(r.cls_a, r.sub_a, r.cls_b, r.sub_b) for r in neardup.similar_classes(texts).collect()}
    assert got == {(1, 0, 2, 0), (1, 1, 3, 0)}
