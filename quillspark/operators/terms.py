"""What a query asks for: terms of its full-text, exact and weighted-contains searches.

A scanner gives the terms of a query by kind, with the run of ideographs they come from; each of the three
searches is a table of kinds, with the least length, the weight and the stage of each.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the query language: operations on tables and words that ask for one, endings of questions,
# characters that part phrases, marks of complex questions, of tables and of images, and the most terms of a search.
OPERATIONS = ("数量", "销量", "金额", "价格", "最高", "最大", "最低", "最小")
TABLE_WORDS = ("数量", "销量", "金额", "价格", "合计", "总和", "最高", "最大", "最低", "最小")
TOTAL_WORDS = ("总价", "总和", "合计", "总额", "总报价")
PHRASE_ENDINGS = ("是什么", "有哪些", "怎么办", "如何")
EXACT_ENDINGS = ("是什么", "是多少", "有哪些", "哪些", "怎么理解", "怎么办", "如何", "为什么", "是否", "需要", "多少")
PHRASE_PARTERS, EXACT_PARTERS = "的中里", "的中里与及对于"
COMPLEX_MARKS = ("哪些", "全部", "原则", "步骤", "合计", "总和", "详细", "包括", "分别", "条件", "要求", "是否", "区别", "如何", "为什么", "需要", "做什么")
TABLE_MARKS = ("表", "表格", "型号", "参数", "合计", "总计", "table", "total")
IMAGE_MARKS = ("图", "流程图", "架构", "曲线", "figure", "diagram", "chart")
FTS_MOST, EXACT_MOST, CONTAINS_MOST = 16, 8, 24
# What a query is scanned for.
PATTERNS = {
    "quoted": "[“\"]([^”\"]{2,120})[”\"]",
    "mixed": "[一-鿿]+[A-Za-z0-9]+|[A-Za-z0-9]+[一-鿿]+",
    "operated": "([一-鿿]{2,}?)(?:数量|销量|金额|价格|最高|最大|最低|最小)",
    "word": "[A-Za-z0-9_]+",
    "name": "[A-Za-z0-9][A-Za-z0-9_.-]*",
    "run": "[一-鿿]+",
}
_PATTERNS = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


@dataclass(frozen=True)
class Term:
    kind: str
    text: str
    run: int = 0


def _bare(text: str) -> str:
    return "".join(text.split())


def _without(run: str, endings: tuple[str, ...]) -> str:
    """The run without the longest of the endings that it has."""
    return run[: len(run) - max((len(e) for e in endings if run.endswith(e)), default=0)]


def _cut(run: str, parters: str) -> list[str]:
    return run.translate(dict.fromkeys(map(ord, parters), " ")).split(" ")


def scan(query: str) -> list[Term]:
    """All terms of a query: quoted texts, labels that mix ideographs with letters or digits, the two characters before
    an operation on a table, words, names, and of each run of ideographs the run, its phrases, parts and pairs."""
    out = []
    for kind in ("quoted", "mixed", "operated", "word", "name"):
        for text in _PATTERNS[kind].findall(query):
            if kind == "operated":
                text = text[text.rfind("的") + 1 :][-2:]
            text = " ".join(text.split())
            if len(text) >= (3 if kind == "mixed" else 1 if kind == "quoted" else 2):
                out.append(Term(kind, text))
    for n, run in enumerate(_PATTERNS["run"].findall(query)):
        core = _without(run, PHRASE_ENDINGS).lstrip(PHRASE_PARTERS)
        out.append(Term("run", run, n))
        out += [Term("phrase", x, n) for x in (core, *_cut(core, PHRASE_PARTERS)) if 2 <= len(x) <= 12]
        out += [Term("part", x, n) for x in _cut(_without(run, EXACT_ENDINGS), EXACT_PARTERS)]
        out += [Term("pair", run[i : i + 2], n) for i in range(len(run) - 1)]
    return out


@dataclass(frozen=True)
class Rule:
    """Which terms of a kind a search takes: those of at least so many characters, with their weight. Terms come by stage, then by run."""

    kind: str
    stage: int
    least: int = 1
    weight: Callable[[str], float] = float


_same = lambda x: lambda _: x
FTS = (Rule("mixed", 1), Rule("operated", 2), Rule("word", 3), Rule("phrase", 4))
EXACT = (Rule("quoted", 1, 3), Rule("mixed", 2, 3), Rule("operated", 3), Rule("name", 4, 3), Rule("part", 5, 3))
# The weights.
CONTAINS = (Rule("quoted", 1, 1, _same(100.0)), Rule("mixed", 2, 1, _same(80.0)), Rule("operated", 3, 1, _same(60.0)), Rule("name", 4, 1, _same(20.0)), Rule("run", 5, 9, _same(40.0)), Rule("phrase", 5, 1, lambda x: 20.0 + 2.0 * len(x)), Rule("pair", 5, 1, _same(2.0)))


def chosen(found: list[Term], rules: tuple[Rule, ...], most: int) -> list[tuple[str, Rule]]:
    """The first ``most`` different texts that the rules take, each with the rule that took it first."""
    quoted = {t.text for t in found if t.kind == "quoted"}
    place = {r.kind: (r.stage, n, r) for n, r in enumerate(rules)}
    taken = [(stage, t.run, n, t.text, rule) for t in found if t.kind in place for stage, n, rule in [place[t.kind]] if len(t.text) >= rule.least and not (t.kind == "run" and t.text in quoted)]
    first: dict[str, Rule] = {}
    for *_, text, rule in sorted(taken, key=lambda x: x[:3]):
        first.setdefault(text, rule)
    return list(first.items())[:most]


def _texts(query: str, kind: str) -> list[str]:
    return list(dict.fromkeys(t.text for t in scan(query) if t.kind == kind))


def quoted(query: str) -> list[str]:
    return _texts(query, "quoted")


def identifiers(query: str) -> list[str]:
    return _texts(query, "mixed")


def table_fields(query: str) -> list[str]:
    return _texts(query, "operated")


def phrases(run: str) -> list[str]:
    """A run of ideographs without its question ending, whole and in parts."""
    return _texts(run, "phrase")


def asks_table(query: str) -> bool:
    return bool(table_fields(query)) and any(x in _bare(query) for x in TABLE_WORDS)


def is_complex(query: str) -> bool:
    bare = _bare(query)
    return len(bare) >= 20 or any(x in bare for x in COMPLEX_MARKS)


def fts_terms(query: str) -> list[str]:
    """Quoted texts alone, if there are any."""
    found = scan(query)
    return [t for t, _ in chosen(found, (Rule("quoted", 1),), len(found))] or [t for t, _ in chosen(found, FTS, FTS_MOST)]


def exact_terms(query: str) -> list[str]:
    return [t for t, _ in chosen(scan(query), EXACT, EXACT_MOST)]


def weighted_terms(query: str) -> list[tuple[str, float]]:
    return [(t, rule.weight(t)) for t, rule in chosen(scan(query), CONTAINS, CONTAINS_MOST)]


_WEIGHTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))
_PARSED = T.StructType(
    [
        T.StructField("fts", T.ArrayType(T.StringType())),
        T.StructField("exact", T.ArrayType(T.StringType())),
        T.StructField("weighted", _WEIGHTED),
        T.StructField("quoted", T.ArrayType(T.StringType())),
        T.StructField("complex", T.BooleanType()),
        T.StructField("table", T.BooleanType()),
    ]
)


@F.pandas_udf(_PARSED)
def parse(queries: pd.Series) -> pd.DataFrame:
    """All terms of each query; null as the empty query."""
    rows = [q or "" for q in queries]
    return pd.DataFrame(
        {
            "fts": [fts_terms(q) for q in rows],
            "exact": [exact_terms(q) for q in rows],
            "weighted": [[{"term": t, "weight": w} for t, w in weighted_terms(q)] for q in rows],
            "quoted": [quoted(q) for q in rows],
            "complex": [is_complex(q) for q in rows],
            "table": [asks_table(q) for q in rows],
        }
    )
