import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.words import TOKEN, WORD, token_count

TEXTS = ["", "  a  b \n\n c\td ", "Ä_b % 中文x1", "one\n\ntwo\n\n one \n\nthree", "文件名：a\nbody  \n文件路径：b", "　wide\xa0space here", "éÉ ß ﬁ", "x" * 5000]


def column(spark, expression, values=TEXTS):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_tokens_as_in_python(spark):
    assert column(spark, token_count, [*TEXTS, None]) == [len(TOKEN.findall(t)) for t in TEXTS] + [0]


def test_words():
    assert WORD.findall("Ab_c 中文d1-é") == ["Ab", "c", "中", "文", "d1", "é"]


def test_normalize(spark):
    expected = ["\n".join(x for line in t.splitlines() if (x := " ".join(line.split()))) for t in TEXTS]
    assert column(spark, X.normalize_text) == expected


def test_unique_paragraphs_and_display(spark):
    assert column(spark, X.unique_paragraphs)[3] == "one\n\ntwo\n\nthree"
    assert column(spark, X.display_text)[4] == "body"
    assert column(spark, X.text_key)[2] == "b中文x1"


def test_like_ignores_ascii_case_only(spark):
    df = spark.createDataFrame([("ABC", "b"), ("Ä", "ä"), ("a_b", "A_"), ("axb", "a_b"), ("50 %", "%")], "t string, p string")
    assert [r[0] for r in df.select(X.contains_like(F.col("t"), F.col("p"))).collect()] == [True, False, True, False, True]


def test_path_parts(spark):
    assert column(spark, X.suffix, ["a/b.TXT", "a/.hidden", "x.tar.gz", "none"]) == [".txt", "", ".gz", ""]
    assert column(spark, X.file_name, ["a/b.TXT", "c"]) == ["b.TXT", "c"]


def test_occurrences_and_excerpt(spark):
    assert column(spark, lambda t: X.occurrences(t, F.lit("aa")), ["aaaa", "Aa", ""]) == [2, 0, 0]
    assert column(spark, lambda t: X.excerpt(t, F.lit("mid"), 2), ["xxxxmidyyyy", "none"]) == ["...xxmidyy...", "none"]


def test_hash_embedding_by_hand(spark):
    got = column(spark, X.hash_embedding, ["alpha beta", "", "gamma"])
    assert np.allclose(got, column(spark, X.embed, ["alpha beta", "", "gamma"]))
    for text, vector in zip(["alpha beta", "", "gamma"], got):
        v = np.zeros(32)
        for word in text.split() or [text]:
            v += np.frombuffer(hashlib.sha256(word.encode()).digest(), np.uint8) / 255 - 0.5
        assert np.allclose(vector, v / np.linalg.norm(v))


def test_index_tokens(spark):
    assert column(spark, X.index_tokens, ["Café foo_bar 中文 A1-b2"]) == [["cafe", "foo", "bar", "中文", "a1", "b2"]]


def test_html(spark):
    assert column(spark, X.html_escape, ["<a href='x'>&\""]) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"]


def test_no_module_of_the_core_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quillspark"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert not re.search(r"quillspark\.llm|from \.+llm", file.read_text()), file
