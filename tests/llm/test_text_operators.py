import random
import re
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.words import TOKEN
from quillspark.llm import leakage, lookalike, mixing, ocr, readability

# ---- one form for look-alikes

PAIRS = [
    ("Pump ＡＢ－１２", "Pump AB-12"),
    ("Resumé", "Résumé".replace("é", "e").replace("ú", "ú")),
    ("Résumé", "Résumé"),
    ("inspeсtor", "inspector"),
    ("flοw", "flow"),
    ("ВВ-1027 valve", "BB-1027 valve"),
    ("a b c", "a b c"),
    ("so­ft​", "soft"),
    ("oﬃce", "office"),
    ("10 K", "10 K"),
    ("5 µm", "5 μm"),
    ("high‑speed", "high-speed"),
    ("Ангел Βeta", "Ангел Beta"),
]


def forms(spark, texts):
    df = spark.createDataFrame([(str(i), t, "x", "y") for i, t in enumerate(texts)], "key string, text string, form string, plain string")
    return {r.key: r.form for r in lookalike.uniform_text(df).collect()}


def test_equal_looking_texts_have_one_form(spark):
    texts = [t for pair in PAIRS for t in pair]
    got = forms(spark, texts)
    for i in range(0, len(texts), 2):
        assert got[str(i)] == got[str(i + 1)], texts[i]


def test_visible_differences_stay(spark):
    texts = ["12 m²", "12 m2", "GAP", "gap", "a  b", "a b", "x – y", "x - y", "“q”", '"q"', "w", "ω", "m", "м", "é", "e", "0", "O", "", " ", "a\nb"]
    got = forms(spark, texts)
    assert len(set(got.values())) == len(texts)


def test_russian_and_greek_words_stay(spark):
    texts = ["Насос и фильтр проверены, см. приложение.", "Ωμέγα και άλφα", "中文 и насос", "xx"]
    assert forms(spark, texts) == {str(i): unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_the_vocabulary_decides_between_scripts(spark):
    # Two unambiguous letters each way; only the Cyrillic form is a word of the corpus.
    got = forms(spark, ["чаc", "час пик"])
    assert got["0"] == "час"


def test_lookalike_pairs(spark):
    rows = [("q-1", "AB 1"), ("b-1", "AB 1"), ("b-1", "AB 1"), ("b-2", "AB 1"), ("b-3", "ab 1"), ("n", None), (None, "АB 1"), ("e", ""), ("l", "z" * 100_000), ("m", "z" * 100_000 + "​")]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {("b-1", "b-2"), ("b-1", "q-1"), ("l", "m")}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0 and lookalike.uniform_text(df.limit(0)).count() == 0
    assert lookalike.uniform_text(df).count() == len(rows)


# ---- leaks


def test_masks_cover_every_choice_of_places():
    from itertools import combinations

    for k in (1, 2, 3):
        kept = [set(m) for m in leakage.masks(12, k)]
        assert all(any(not set(c) & m for m in kept) for c in combinations(range(12), k))


def test_words_ignore_breaks_and_looks():
    assert leakage.words_of("Ма­in zentr-\nale, ＡＢ! in-\nside") == leakage.words_of("MAIN zentrale AB inside")


def test_broken_words_are_read_both_ways():
    units = leakage.units_of("one cross-\ncheck two half-\nway off well-\nknown end", lambda c: c in ("cross-check", "well-known"))
    assert units == [("one",), ("crosscheck", "cross", "check"), ("two",), ("halfway",), ("off",), ("wellknown", "well", "known"), ("end",)]
    got = {tuple(w) for _, w in leakage.parted_windows(units, 4) if len(w) == 4}
    joined, first = "one crosscheck two halfway off {} end", "one cross check two halfway off {} end"
    every = set()
    for a in (joined, first):
        for b in ("wellknown", "well known"):
            w = a.format(b).split()
            every |= {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    plain = joined.format("wellknown").split()
    assert got == every - {tuple(plain[i : i + 4]) for i in range(len(plain) - 3)}


def test_a_full_bit_filter_only_lets_more_pass(spark):
    x = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(v),) for v in x[:2500].view(np.int64)], "hash long")
    f = leakage.BitFilter.of(df, "hash", 2500)
    assert len(f(x[:2500])) == 2500 and len(f(x[2500:])) < 125
    few = leakage.BitFilter.of(df.limit(0), "hash", 0)
    assert not len(few(x))


def _windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("most_bits", [30, 5])
def test_leaks_as_brute_force(spark, most_bits, monkeypatch):
    monkeypatch.setattr(leakage, "_LEAST_BITS", 5)
    monkeypatch.setattr(leakage, "_MOST_BITS", most_bits)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([11, 12, 30])))) for k in range(30)] + [("zh", "中文检索系统的评测问题集合在此"), ("n", None), ("", "x")]
    docs = []
    for d in range(150):
        w = rng.choices(vocabulary, k=60)
        if d % 3 == 0:
            src = rng.choice(items[:30])[1].split()
            n = rng.randint(8, len(src))
            w[10 : 10 + n] = src[:n]
        docs.append((d, ("\n" if d % 2 else " ").join(w).upper()))
    docs += [(900, None), (901, ""), (902, "。" + items[30][1][:13]), (None, items[0][1]), docs[0], (903, " ".join(rng.choices(vocabulary, k=50_000)))]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, case_id string, hash int")
    it = spark.createDataFrame([*items, items[0]], "key string, text string")
    want = {(d, k) for d, t in docs if t and d is not None for k, s in items if s and _windows(leakage.words_of(t), 12) & _windows(leakage.words_of(s), 12)}
    assert {tuple(r) for r in leakage.leaked(df, it).collect()} == want and want
    assert leakage.leaked(df.limit(0), it).count() == leakage.leaked(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_substitutions_are_tolerated(spark, k):
    item = [f"w{i}" for i in range(12)]
    docs = []
    for n, changed in enumerate([(0,), (5,), (11,), (0, 1), (3, 7), (0, 5, 9)]):
        docs.append((n, " ".join("zz" if i in changed else w for i, w in enumerate(item))))
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r.doc_id for r in leakage.leaked(df, spark.createDataFrame([("i", " ".join(item))], "key string, text string"), differing=k).collect()}
    assert got == ({0, 1, 2} if k == 1 else {0, 1, 2, 3, 4})


def test_passages_are_extended_around_hits(spark):
    item = [f"w{i}" for i in range(40)]
    other = [f"x{i}" for i in range(30)]
    changed = [*item[:20], "zz", *item[21:35]]
    docs = [(1, " ".join(other[:5] + changed + other[5:])), (2, " ".join(item[:15] + other + item[20:33])), (3, " ".join(other)), (4, " ".join(item[:11])), (5, None)]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id int, text string")
    got = {tuple(r) for r in leakage.leaked_passages(df, spark.createDataFrame([("i", " ".join(item))], "key string, text string")).collect()}
    # A word before or behind a passage counts as one replaced, where that leaves enough words.
    assert {(d, k) for d, k, _, _ in got} == {(1, "i"), (2, "i")}
    words = {d: (n, w) for d, _, n, w in got}
    assert words[1][0] == 1 and 35 <= words[1][1] <= 37 and words[2][0] == 2 and 15 <= words[2][1] <= 17


def test_broken_compounds_leak(spark):
    item = "the well-known valve of the third pump house was closed by hand today again"
    docs = [(1, item.replace("well-known", "well-\nknown")), (2, item.replace("third", "th-\nird").replace("well-known", "well-\nknown")), (3, item.replace("-", " "))]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    assert {r.doc_id for r in leakage.leaked(df, spark.createDataFrame([("i", item)], "key string, text string")).collect()} == {1, 2, 3}


# ---- mixing


def _mix_tables(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["t"] * rng.randint(1, 40)), rng.choice(["a_b", "A-B ", "big", "big", "big", "big", "other", None])) for i in range(3000)]
    docs += [(9001, None, "big"), (9002, "", "a_b"), (9003, "x " * 20_000, "big")]
    targets = [("a-b", 0.5, 2), ("big", 0.4, 1), ("none", 0.1, 3), ("big", 0.1, 9), ("bad", None, 1), ("neg", -1.0, 1)]
    return docs, targets, spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, tokens int, copy int"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


def test_shares_and_short_sources(spark):
    docs, _, d, t = _mix_tables(spark)
    size = {}
    for _, text, source in docs:
        size[source and source.strip().lower().replace("-", "_")] = size.get(source and source.strip().lower().replace("-", "_"), 0) + len(TOKEN.findall(text or ""))
    total = sum(size.values())
    want = {s for s, k, w, m in (("a-b", "a_b", 0.5, 2), ("big", "big", 0.4, 1), ("none", "none", 0.1, 3)) if size.get(k, 0) * m < w * total}
    assert {r.source for r in mixing.short_sources(d, t).collect()} == want
    assert mixing.short_sources(d.limit(0), t).count() == mixing.short_sources(d, t.limit(0)).count() == 0


def test_mix_is_whole_and_even(spark):
    docs, _, d, t = _mix_tables(spark)
    rows = mixing.mix(d, t, block=200, bucket_rows=100, slot_rows=64).toPandas().sort_values(["slot", "offset", "doc_id"])
    plan = {r.source: r for r in mixing.source_shares(d, t).collect()}
    assert not rows.duplicated(["source", "doc_id", "copy"]).any()
    for source, group in rows.groupby("source"):
        assert group["copy"].max() <= plan[source].max_repeats
        assert 0 <= group.tokens.sum() - plan[source].planned_tokens < 40_001 or plan[source].short
        if plan[source].short:
            assert group.tokens.sum() == plan[source].capacity
    assert (rows.groupby("slot").source.nunique() == 1).all()
    reached = {r.source: r for r in mixing.reached_shares(d, t, block=200).collect()}
    assert reached["none"].rows == 0 and sum(r.actual_share for r in reached.values()) == pytest.approx(1)
    half = rows.iloc[: len(rows) // 2]
    for source, group in half.groupby("source"):
        assert group.tokens.sum() / half.tokens.sum() == pytest.approx(reached[source].actual_share, abs=0.12)


def _slots(spark, plan, **options):
    return mixing.slots(spark.createDataFrame(plan, "key string, weight double, blocks long"), **options)


def test_slots_are_van_der_corput_points_in_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNITS", 12)
    plan = [("a", 5.0, 40), ("b", 2.5, 20), ("c", 0.1, 3), ("d", 1.4, 1)]
    got = {}
    for r in _slots(spark, plan, slot_rows=7).collect():
        got.setdefault(r.key, {})[r.n] = r.slot
    lo = 0
    for key, weight, blocks in plan:
        hi = lo + int(weight / 9.0 * (4096 - 4)) + 1
        mine = (k for k in range(1 << 20) if lo <= int(f"{k % 4096:012b}"[::-1], 2) < hi)
        want = [next(mine) for _ in range(blocks)]
        assert [got[key][n] for n in range(blocks)] == want and len(got[key]) == blocks, key
        lo = hi


def test_a_tiny_source_needs_few_slots(spark):
    got = _slots(spark, [("big", 1e9, 244_142), ("tiny", 10.0, 2)]).groupBy("key").agg(F.count("*").alias("n"), F.max("n").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    assert {r.key: (r.n, r["last"], r.slots) for r in got} == {"big": (244_142, 244_141, 244_142), "tiny": (2, 1, 2)}
    assert [tuple(r) for r in _slots(spark, [("one", 3.0, 3)]).orderBy("n").collect()] == [("one", 0, 0), ("one", 1, 1), ("one", 2, 2)]


def test_prefixes_keep_the_shares(spark):
    _, _, d, t = _mix_tables(spark)
    rows = mixing.prefix_shares(d.filter("doc_id < 9000"), t, block=200).collect()
    assert {r.part for r in rows} == set(range(1, 11)) and max(r.deviation for r in rows if r.part >= 3) < 0.05
    assert all(r.deviation == 0 for r in rows if r.part == 10)
    assert mixing.prefix_shares(d.limit(0), t).count() == 0


def test_mix_of_nothing(spark):
    _, _, d, t = _mix_tables(spark)
    assert mixing.mix(d.limit(0), t).count() == mixing.mix(d, t.limit(0)).count() == 0
    assert mixing.reached_shares(d.limit(0), t).filter("actual_share is not null").count() == 0


# ---- reading level


def _levels(spark):
    rng = random.Random(6)
    pools = [[f"l{k}word{i}" for i in range(60)] for k in range(1, 6)]
    docs, labels = [], []
    for i in range(600):
        level = rng.randint(1, 5)
        words = [rng.choice(pools[level - 1] if rng.random() < 0.5 else pools[rng.randrange(5)]) for _ in range(rng.choice([70, 120]))]
        docs.append((i, " ".join(f"the {w}" for w in words), level))
        if i % 3 == 0:
            labels.append((i, level, "r", datetime(2024, 1, 1)))
    return docs, labels


def test_levels_on_held_out_documents(spark):
    docs, labels = _levels(spark)
    extra = [(1000, None, 0), (1001, "", 0), (1002, "der die das und ist nicht " * 30, 0), (1003, "the pump " * 5, 0), (1004, "的" * 100, 0), (1005, "the l5word1 of " * 30_000, 0), (5, docs[5][1], 0)]
    d = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in docs + extra], "doc_id long, text string, level string, words int")
    lab = spark.createDataFrame([*labels, labels[0], (1, None, "r", None), (None, 3, "r", None)], "doc_id long, reading_level int, rater string, rated_at timestamp")
    rows = readability.reading_levels(d, lab).collect()
    assert len(rows) == 607
    got = {r.doc_id: r for r in rows}
    held = [(lvl, got[i].level) for i, _, lvl in docs if i % 3]
    assert np.mean([a == b for a, b in held]) > 0.85
    assert all(got[i].level is None for i in (1000, 1001, 1002, 1004)) and got[1003].words == 10 and got[1005].level == 5
    fives = {r.doc_id for r in readability.documents_of_level(d, lab).collect()}
    assert 1003 not in fives and len(fives ^ {i for i, _, lvl in docs if lvl == 5}) < 25
    assert readability.reading_levels(d.limit(0), lab).count() == 0
    assert readability.reading_levels(d, lab.limit(0)).filter("level is not null").count() == 0


def test_difficulties_meet_the_mean_level():
    base = np.array([0.3, 0.2, 0.2, 0.2, 0.1])
    b = readability.difficulties(np.array([450.0, 100.0, 0.0]), np.array([100.0, 100.0, 0.0]), base)
    p = base[:, None] * np.exp((readability.LEVELS[:, None] - 3) * b[None])
    mean = (readability.LEVELS[:, None] * p).sum(0) / p.sum(0)
    prior = (readability.LEVELS * base).sum()
    assert mean == pytest.approx([(450 + 3 * prior) / 103, max(1.02, (100 + 3 * prior) / 103), prior], abs=1e-3)


def test_language_by_a_column_with_errors(spark):
    rng = random.Random(9)
    pools = {"en": [f"en{i}" for i in range(80)], "de": [f"de{i}" for i in range(80)], "zh": list("检索系统的评测问题集合在此")}
    docs, truth = [], {}
    for i in range(400):
        lang = rng.choice(list(pools))
        truth[i] = lang == "en"
        label = rng.choice([lang] * 7 + [lang.upper() + " ", None, "und", rng.choice(list(pools))])
        docs.append((i, " ".join(rng.choices(pools[lang], k=40) + rng.choices(["10", "mm"], k=5)), label))
    d = spark.createDataFrame([*docs, (900, "", "en"), (901, None, None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1 + i % 5, "r") for i in range(400) if truth[i]][:50], "doc_id long, reading_level int, rater string")
    got = {r.doc_id: r for r in readability.reading_levels(d, lab, labelled=300).collect()}
    assert {i: got[i].english for i in truth} == truth and not got[900].english and not got[901].english
    assert all((got[i].level is not None) == truth[i] for i in truth)
    assert readability.words_of("circu-\nmstance") == ["circumstance"]


def test_bags_keep_all_counts():
    import pyarrow as pa

    texts = ["a " * 300 + "b c c", "", None, "x"]
    batch = pa.record_batch([pa.array(range(4)), pa.array([1, 0, None, 1], pa.int32()), pa.array(texts)], names=["doc_id", "label", "text"])
    (out,) = readability._bag(18)(iter([batch]))
    row, term, count = readability.flat_bags(out, 18)
    assert sorted(count[row == 0]) == [1, 2, 300] and sorted(row) == [0, 0, 0, 3] and out.column("words").to_pylist() == [303, 0, 0, 1]
    assert term.max() < 1 << 18 and (np.diff(term[:3]) > 0).all()


def test_steps_between_levels():
    s = readability.Steps(np.array([0.0, 0.1, 1.0, 1.1, 5.0]), np.array([1, 1, 3, 3, 5]))
    assert list(s.level(np.array([-1, 0.5, 0.6, 2.9, 3.1]))) == [1, 1, 3, 3, 5] and s.expected(np.array([0.05, 1.05, 9.0])) == pytest.approx([1, 3, 5])


# ---- scanned pages


def _page_lines():
    """Pages of one version: head with page number, body with broken and misread words, foot, page number."""
    body = "the controller reads every valve and the sensor tracks the modern turbine near the furnace at 50 bar".split()
    rows, n, rng = [], 0, random.Random(3)
    for page in range(1, 9):
        lines = [f"Service Manual {page}" if page != 4 else "Servlce Manua1 4"]
        for k in range(14):
            rng.shuffle(body)
            lines.append(" ".join(body))
        if page == 2:
            lines[3] = lines[3].replace("turbine", "tiirbine")
            lines[5] = "the con-"
            lines[6] = "troller " + lines[6]
            lines[8] = "at 5O bar and the sensor"
            lines[9] = "a cross-check of the valve and a cross-check of the sensor"
            lines[10] = "the cross-"
            lines[11] = "check of the valve"
            lines[-1] = "and every tur-"
        if page == 3:
            lines[1] = "blne near the furnace"
        lines += ["Internal copy", f"- {page} -"]
        for k, text in enumerate(lines):
            rows.append((f"{page}-{k}", "v", page, k, text, 0.9))
            n += 1
    return rows


LINE = "line_id string, version string, page int, line int, text string, confidence double"


def test_defects_of_a_small_scan(spark):
    rows = _page_lines()
    extra = [rows[0], (None, "v", 1, 99, "x", 0.5), ("t1", "w", None, None, None, None), ("t2", "w", 1, 0, "", None), ("t3", None, None, 3, "long " * 20_000, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows + extra], LINE + ", role string, top int")
    got = {tuple(r) for r in ocr.defects(df).collect()}
    heads = {(f"{p}-0", "running_head") for p in range(1, 9)} | {(f"{p}-15", "running_head") for p in range(1, 9)}
    want = heads | {(f"{p}-16", "page_number") for p in range(1, 9)}
    want |= {("2-3", "misread"), ("2-5", "broken_word"), ("2-8", "misread"), ("2-14", "broken_word"), ("3-1", "misread")}
    assert got == want
    assert ocr.defects(df.limit(0)).count() == 0 and ocr.paragraphs(df.limit(0)).count() == 0


def test_paragraphs_of_a_small_scan(spark):
    df = spark.createDataFrame(_page_lines(), LINE)
    text = {r.page: r.text for r in ocr.paragraphs(df).filter("paragraph = 0").collect()}
    assert "Manual" not in text[2] and "Internal" not in text[2] and "controller" in text[2] and "con-" not in text[2]
    assert "5O" not in text[2] and "50 bar" in text[2] and text[2].endswith("every turbine") and text[3].startswith("near the furnace")
    assert "cross-check" in text[2] or "cross- check" in text[2]


def test_lines_of_blocks(spark):
    df = spark.createDataFrame([(1, "v", 1, "a\nb", 0.5, "ocr_text"), (1, "v", 1, "a\nb", 0.5, "ocr_text"), (2, "v", 1, "c", 0.5, "native_text"), (3, "v", 2, None, None, "mixed")], "block_id long, document_version_id string, page_no int, text string, confidence double, source_type string")
    assert sorted((r.line_id, r.text) for r in ocr.lines_of_blocks(df).collect()) == [("1:0", "a"), ("1:1", "b")]


def test_roman_numbers_and_skeletons(spark):
    df = spark.createDataFrame([(i,) for i in (1, 4, 9, 14, 40, 99, 400, 999, 0, 1000)], "n int")
    assert [r[0] for r in df.select(ocr.roman(F.col("n"))).collect()] == ["i", "iv", "ix", "xiv", "xl", "xcix", "cd", "cmxcix", "", ""]
    words = ["modern", "rnodern", "moclern", "circuit", "circiiit", "tab1e", "table", "wheel", "vvheel", "manifolcl", "manifold"]
    s = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(ocr.skeleton(F.col("w"))).collect()]
    assert s[0] == s[1] == s[2] and s[3] == s[4] and s[5] == s[6] and s[7] == s[8] and s[9] == s[10] and s[0] != s[3]
    assert re.fullmatch("[a-z]+", s[0])


def test_pairs_of_popular_texts_in_parts(spark):
    rows = [(f"k{i:02}", "pump") for i in range(12)] + [(f"m{i}", "рump") for i in range(5)] + [("z", "puｍp"), ("q", "valve"), ("q2", "valve"), ("k00", "pump"), (None, "pump"), ("n", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key string, text string, parts int")
    text = {k: t for k, t in rows if k and t and k not in ("q", "q2")}
    want = {(a, b) for a in text for b in text if a < b and text[a] != text[b]}
    for hot in (2, 1000):
        assert {tuple(r) for r in lookalike.lookalike_pairs(df, hot).collect()} == want
    got = {r.key: (r.class_key, r.texts) for r in lookalike.lookalike_classes(df).collect()}
    assert got == {k: ("k00", 3) for k in text} | {"q": ("q", 1), "q2": ("q", 1)}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == lookalike.lookalike_classes(df.limit(0)).count() == 0


def test_only_the_misread_occurrence_is_replaced(spark):
    body = [f"w{i} x{i} and the pump feeds y{i} valve z{i} at 50 bar" for i in range(12)]
    body[5] = "the purnp and the pump, the pump"
    body[6] = "the valve at 5O bar and at 50 bar"
    rows = [(f"{i}", "v", 1, i, t, 0.9) for i, t in enumerate(body)]
    text = " ".join(r.text for r in ocr.paragraphs(spark.createDataFrame(rows, LINE)).orderBy("page", "paragraph").collect())
    assert "the pump and the pump, the pump" in text and "at 50 bar and at 50 bar" in text and "purnp" not in text


def test_lines_without_a_page_are_read_in_sheets(spark):
    rows = [(f"{i}", "v", None, i, f"the pump feeds valve number w{i} of the line", 0.9) for i in range(2500)]
    rows[1499] = ("1499", "v", None, 1499, "the pump feeds the con-", 0.9)
    rows[1500] = ("1500", "v", None, 1500, "troller and stops", 0.9)
    df = spark.createDataFrame(rows, LINE)
    assert {tuple(r) for r in ocr.defects(df).collect()} == {("1499", "broken_word")}
    got = ocr.paragraphs(df).collect()
    assert all(r.page is None for r in got) and sum(r.text.count("pump") for r in got) == 2499 and any("controller and stops" in r.text for r in got)
