"""One form for texts that look the same.

A text is decomposed, full-width forms, ligatures, spaces and hyphens that only differ in code are
replaced by their usual characters, invisible ones are dropped. Then tokens are repaired by script:
a token's dominant script is that of its letters that no other script can imitate, else that of the
text's; look-alikes are substituted in tokens that mix scripts, or that consist of look-alikes in a
text of another script, first into the form that the corpus vocabulary knows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.knn import wide_hash
from quillspark.session import cut_lineage

HOT = 1000

# Letters of other scripts that have the glyph of a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝӏ", "ABEKMHOPCTYXIJSaeopcyxijsdhqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
# Other characters that differ from a usual one in code only.
SAME = {"‐": "-", "‑": "-", "µ": "μ"}

TO_LATIN = CYRILLIC | GREEK
FROM_LATIN = {"Cyrillic": {v: k for k, v in CYRILLIC.items()}, "Greek": {v: k for k, v in GREEK.items()}}
_TOKEN = re.compile(r"[^\W\d_㐀-䶿一-鿿豈-﫿](?:[^\W_㐀-䶿一-鿿豈-﫿]|[̀-ͯ])*")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_DOUBTS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))]))
_FOLD: dict[str, str] = {}


def _fold(ch: str) -> str:
    """The usual character for one that only differs in code; '' for an invisible one."""
    if (out := _FOLD.get(ch)) is None:
        kind = unicodedata.category(ch)
        if ch in SAME:
            out = SAME[ch]
        elif "！" <= ch <= "～" or "￠" <= ch <= "￦" or "ﬀ" <= ch <= "ﬆ":
            out = unicodedata.normalize("NFKC", ch)
        elif kind == "Zs":
            out = " "
        elif kind == "Cf" or "︀" <= ch <= "️":
            out = ""
        else:
            out = ch
        _FOLD[ch] = out
    return out


def fold(text: str) -> str:
    """The text with the usual characters, decomposed (NFD). ASCII texts stay as they are."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", "".join(map(_fold, text)))


def script(letter: str) -> str:
    if letter < "Ͱ":
        return "Latin"
    return "Greek" if letter < "Ѐ" else "Cyrillic" if letter < "԰" else "other"


def imitable(letter: str) -> bool:
    """Whether another script has a letter of the same glyph."""
    return letter in TO_LATIN or letter in FROM_LATIN["Cyrillic"] or letter in FROM_LATIN["Greek"]


def as_script(token: str, name: str) -> str:
    """The token with its look-alikes in the given script, where that has them."""
    latin = "".join(TO_LATIN.get(ch, ch) for ch in token)
    return latin if name == "Latin" else "".join(FROM_LATIN[name].get(ch, ch) for ch in latin)


def _dominant(letters: str) -> str | None:
    own = Counter(script(ch) for ch in letters if ch.isalpha() and not imitable(ch))
    own.pop("other", None)
    return max(sorted(own, reverse=True), key=own.get) if own else None


def doubtful(folded: str) -> list[tuple[str, list[str]]]:
    """Tokens of a folded text whose look-alikes may be of the wrong script, with their forms in the
    order of preference: the dominant script's, then Latin, Cyrillic, Greek."""
    if not FOREIGN.search(folded):
        return []
    tokens = set(_TOKEN.findall(folded))
    main = _dominant(folded) or "Latin"
    out = []
    for token in tokens:
        letters = [ch for ch in token if ch.isalpha()]
        scripts = {script(ch) for ch in letters}
        fixed = {script(ch) for ch in letters if not imitable(ch)}
        if not any(map(imitable, letters)) or (len(scripts) == 1 and fixed):
            continue
        own = _dominant(token) or main
        forms = list(dict.fromkeys(as_script(token, x) for x in (own, "Latin", "Cyrillic", "Greek")))
        if forms != [token]:
            out.append((token, forms))
    return out


def repair(folded: str, known: dict[str, str]) -> str:
    """The composed text with doubtful tokens replaced as given."""
    if known:
        folded = _TOKEN.sub(lambda m: known.get(m[0], m[0]), folded)
    return folded if folded.isascii() else unicodedata.normalize("NFC", folded)


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(_DOUBTS)
def _doubtful(folded: pd.Series) -> pd.Series:
    return pd.Series([[{"token": t, "forms": f} for t, f in doubtful(x)] if x is not None else None for x in folded])


@F.pandas_udf(T.StringType())
def _repaired(folded: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else repair(x, {k["token"]: k["form"] for k in m} if m is not None else {}) for x, m in zip(folded, known)])


def _ascii(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\x{0}-\x{7f}]"))


def uniform_text(texts: DataFrame) -> DataFrame:
    """(key, text, form) of a table (key, text): form is the one form of all texts that look like it.

    ASCII texts are their own form and never leave the JVM; null stays null, an empty text empty; every row
    is kept, repeated ones too. A doubtful token takes the first of its forms that occurs in a text of the
    table as an undoubted token; if none does, the dominant script's form, so that two damaged copies of an
    unknown word still agree. Case, line breaks, the number of spaces and everything else visible stay.
    """
    rows = texts.select("key", "text").withColumn("plain", F.coalesce(_ascii(F.col("text")), F.lit(True)))
    odd = rows.filter("not plain").select("text").distinct().withColumn("folded", fold_text("text"))
    odd = odd.withColumn("doubtful", F.when(F.regexp_like("folded", F.lit(r"[\x{370}-\x{52f}]")), _doubtful("folded")))
    odd = cut_lineage(odd)
    asked = odd.filter(F.size("doubtful") > 0).select("text", F.explode("doubtful").alias("d")).select("text", "d.token", F.posexplode("d.forms").alias("rank", "form"))

    # The vocabulary: tokens of all texts that are not in doubt themselves. Pure ASCII tokens never are.
    word = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z][A-Za-z0-9]*"), F.lit(0)))
    other = odd.select(F.explode(F.regexp_extract_all(F.regexp_replace("folded", r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]", " "), F.lit(r"\p{L}[\p{L}\p{N}\x{300}-\x{36f}]*"), F.lit(0))).alias("form"))
    vocabulary = rows.filter("plain").select("text").distinct().select(word.alias("form")).distinct().unionByName(other.distinct()).distinct()
    vocabulary = vocabulary.join(asked.select("token").distinct().withColumnRenamed("token", "form"), "form", "left_anti")
    forms = asked.select("form").distinct().join(vocabulary.withColumn("seen", F.lit(True)), "form", "left")
    best = asked.join(forms, "form").groupBy("text", "token").agg(F.min(F.struct(F.when(F.col("seen"), 0).otherwise(1), "rank", "form")).alias("b"))
    known = best.groupBy("text").agg(F.collect_list(F.struct("token", F.col("b.form").alias("form"))).alias("known"))
    repaired = odd.join(known, "text", "left").select("text", _repaired("folded", "known").alias("form"))
    plain = rows.filter("plain").select("key", "text", F.col("text").alias("form"))
    kept = rows.filter("not plain").select("key", "text").join(repaired, "text").select("key", "text", "form")
    return plain.unionByName(kept)


def _keyed(texts: DataFrame) -> DataFrame:
    """(key, f, c) of the records of a table (key, text): 128-bit hashes of the form and of the text."""
    formed = uniform_text(texts.filter("key is not null and text is not null"))
    return cut_lineage(formed.select("key", wide_hash("form").alias("f"), wide_hash("text").alias("c")).distinct())


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(key, class_key, texts), one row per record of a table (key, text): the smallest key of the records that look
    the same, and how many different texts these have.

    Null keys and texts take no part; repeated rows count once. A key repeated with texts of several forms has a row for each.
    """
    keyed = _keyed(texts)
    forms = keyed.groupBy("f", "c").agg(F.min("key").alias("k")).groupBy("f").agg(F.min("k").alias("class_key"), F.count("*").cast("int").alias("texts"))
    return keyed.select("key", "f").distinct().join(forms, "f").select("key", "class_key", "texts")


def lookalike_pairs(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key_a < key_b) of records of a table (key, text) that have one form but different texts.

    Null keys and texts take no part; repeated rows count once. Different texts of one form are paired first;
    then each takes its records, those of a text of more than ``hot`` records in parts, so that no task holds
    all copies of a popular text. Texts that no other looks like are never joined.
    """
    keyed = _keyed(texts)
    classes = keyed.groupBy("f", "c").agg(F.count("*").alias("n"))
    several = classes.groupBy("f").agg(F.count("*").alias("texts")).filter("texts > 1").drop("texts")
    mixed = cut_lineage(classes.join(several, "f").withColumn("parts", F.ceil(F.col("n") / hot).cast("int")))
    members = keyed.join(mixed.select("f", "c", "parts"), ["f", "c"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    one, other = mixed.select("f", F.col("c").alias("c_a"), F.col("parts").alias("p_a")), mixed.select("f", F.col("c").alias("c_b"), F.col("parts").alias("p_b"))
    spread = lambda p: F.sequence(F.lit(0), F.col(p) - 1)
    pairs = one.join(other, "f").filter("c_a < c_b").select("c_a", "c_b", F.explode(spread("p_a")).alias("part_a"), "p_b")
    pairs = pairs.join(members.select(F.col("c").alias("c_a"), F.col("part").alias("part_a"), F.col("key").alias("x")), ["c_a", "part_a"])
    pairs = pairs.select("x", "c_b", F.explode(spread("p_b")).alias("part_b")).join(members.select(F.col("c").alias("c_b"), F.col("part").alias("part_b"), F.col("key").alias("y")), ["c_b", "part_b"])
    return pairs.filter("x != y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def blocks_and_queries(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, text) of all layout blocks and search requests."""
    return blocks.select(F.concat(F.lit("block-"), "block_id").alias("key"), "text").unionByName(requests.select(F.concat(F.lit("query-"), "request_id").alias("key"), F.col("query").alias("text")))
