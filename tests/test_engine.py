import gzip
import io
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, claims, context, layout, metrics, packer, review, sync, tables_qa
from quillspark.sources import parsers
from quillspark.sources.store import Store, read_jsonl, write_jsonl
from quillspark.streaming import feed


def piece(n, kind="paragraph", section=(), word="w"):
    return packer.Piece(" ".join(f"{word}{i}" for i in range(n)), kind, section, 1, "native_text", None, n)


def sizes(blocks, **k):
    return [sum(p.tokens for p in c.all) for c in packer.pack(blocks, **k)]


def test_packing_by_worked_examples():
    blocks = [piece(30, word=f"b{i}_") for i in range(14)]
    assert sizes(blocks) == [480]
    assert sizes([*blocks, piece(200, word="z")]) == [420, 260]
    assert sizes([piece(1400)]) == [650, 650, 100]
    assert sizes([piece(10, "table"), piece(10, "table")]) == [10]
    assert sizes([piece(200), piece(5, "heading", ("a",)), piece(200, word="y")]) == [200, 205]
    assert sizes([piece(400), piece(300, word="y")]) == [400, 300]
    with pytest.raises(ValueError):
        packer.pack([], target=40, overlap=40)


def test_long_tables_repeat_their_header():
    text = "\n".join(["| a | b |", "| --- | --- |", *(f"| r{i} | {i} |" for i in range(200))])
    n = len(packer.TOKEN.findall(text))
    parts = packer.pack([packer.Piece(text, "table", (), 1, "native_text", None, n)])
    assert len(parts) > 1 and all(p.text.startswith("| a | b |\n| ---") for p in parts)
    assert sum(p.text.count("| r") for p in parts) == 200


def test_windows_as_packing(spark):
    texts = ["one two", "", None, " ".join(f"t{i}" for i in range(1500)), "a  b\n\n c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.chunk_index): r.token_count for r in packer.windows(df).collect()}
    assert got == {(0, 0): 2, (3, 0): 650, (3, 1): 650, (3, 2): 200, (4, 0): 3}


def test_reconcile(spark):
    known = [("same", "1", 5, 1, "s1", False, "s1"), ("touched", "2", 5, 1, "s2", False, "s2"), ("edited", "3", 5, 1, "s3", False, "s3"), ("gone", "4", 5, 1, "s4", False, "s4"), ("moved", "5", 5, 1, "s5", False, "s5"), ("broken", "6", 5, 1, "s6", True, None)]
    seen = [("same", 5, 1, "s1"), ("touched", 5, 2, "s2"), ("edited", 6, 2, "x3"), ("there", 5, 9, "s5"), ("new", 1, 1, "n"), ("broken", 5, 2, "s6"), ("copy", 5, 1, "s1")]
    k = spark.createDataFrame(known, "path string, document_id string, size_bytes long, mtime_ns long, sha256 string, failed boolean, active_sha256 string")
    s = spark.createDataFrame(seen, "path string, size_bytes long, mtime_ns long, sha256 string")
    got = {(r.path, r.event, r.old_path) for r in sync.reconcile(k, s).collect()}
    assert got == {("same", "unchanged", None), ("touched", "unchanged", None), ("edited", "update", None), ("gone", "delete", None), ("there", "move", "moved"), ("new", "add", None), ("broken", "unchanged", None), ("copy", "add", None)}


def test_job_queue(spark):
    jobs = spark.createDataFrame([("a", "failed", 1, "e", None, 1), ("b", "leased", 1, None, "w", 2), ("c", "queued", 0, None, None, 3)], "job_key string, state string, attempts int, error string, lease_owner string, created_at int")
    new = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "job_key string")
    got = {r.job_key: (r.state, r.error) for r in sync.upsert_jobs(jobs, new).collect()}
    assert got == {"a": ("queued", None), "b": ("leased", None), "c": ("queued", None), "d": ("queued", None)}
    assert {r.job_key: (r.state, r.attempts) for r in sync.lease_jobs(jobs, "me").collect()}["c"] == ("leased", 1)
    assert {r.state for r in sync.release_jobs(jobs).collect()} == {"failed", "queued"}


def test_ranking_metrics_by_hand(spark):
    df = spark.createDataFrame([("x", [False, True, True], 2), ("x", [], 0)], "category string, relevance array<boolean>, total int")
    r = {x.k: x for x in metrics.ranking_metrics(df, ["category"], (1, 3)).collect()}
    assert (r[1].hit, r[3].hit, r[3].recall, r[3].precision, r[3].mrr) == (0.0, 0.5, 0.5, round(1 / 3, 6), 0.25)
    import math

    assert abs(r[3].ndcg - (1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)) / 2) < 1e-6


def test_answer_matches(spark):
    assert metrics.character_f1("ab", "abc") == pytest.approx(0.8)
    assert metrics.longest_common_run("xxabcdyy", "zabcdz") == 4 and metrics.longest_common_run("", "a") == 0
    df = spark.createDataFrame([("Ａ-b", "ab", None), ("no", "x", ["N.O."])], "a string, e string, l array<string>")
    assert [r[0] for r in df.select(metrics.exact_match(F.col("a"), F.col("e"), F.col("l"))).collect()] == [True, True]
    n = spark.createDataFrame([("about 1,050 mm", "1050 mm"), ("5 bar", "5 mm"), ("5", "5"), ("x", "5"), ("5", "x")], "a string, e string")
    # The first number of "1,050" is 1: thousands commas aren't part of the rule.
    assert [r[0].both_correct for r in n.select(metrics.numeric_match(F.col("a"), F.col("e"))).collect()] == [False, False, True, False, False]


def test_index_percentiles(spark):
    values = [5, 1, 4, 4, 9, 2, 7, None]
    r = metrics.index_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    v = sorted(x for x in values if x is not None)
    assert (r.n, r.least, r.median, r.p90, r.p95, r.most) == (7, 1, v[3], v[5], v[5], 9)


TABLE = "| 名称 | 天猫 | 京东 |\n| --- | :---: | ---: |\n| 产品A | 90 | 1,085 |\n| 产品B | 7 | 85.5 |\n| short |\n\ntext"


def test_table_answers(spark):
    asked = ["产品A 的合计", "天猫 总和", "京东最高", "产品B 的天猫", "无关", "最高", "京东最低", "产品B 求和"]
    df = spark.createDataFrame([(i, q, TABLE) for i, q in enumerate(asked)] + [(90, "京东最高", "no table"), (91, None, TABLE), (92, "京东最高", None), (93, "产品C 的 v", "| a | b |\n| --- | --- |\n| x | 1 |\n\n| k | v |\n| --- | --- |\n| 产品C | 0.125 |")], "key int, question string, text string")
    got = {r.key: r.answer for r in tables_qa.answer_tables(df).collect()}
    assert "合计为 1175（90 + 1085）" in got[0] and "天猫 列的数值合计为 97" in got[1]
    assert "最大值是 1085，对应 产品A" in got[2] and got[3] == "表格中，产品B 的 天猫 是 7。"
    assert "最小值是 85.5，对应 产品B" in got[6] and "合计为 92.5（7 + 85.5）" in got[7] and got[93] == "表格中，产品C 的 v 是 0.125。"
    assert set(got) == {0, 1, 2, 3, 6, 7, 93} and tables_qa.answer_tables(df.limit(0)).count() == 0
    head = ["名称", "天猫", "京东"]
    cells = tables_qa.table_cells(spark.createDataFrame([("t", TABLE), ("n", None)], "id string, m string"), "id", "m").collect()
    assert len(cells) == 6 and {r.header for r in cells} == set(head)
    s = {r.header: r for r in tables_qa.column_summary(spark.createDataFrame(cells)).collect()}
    assert (s["京东"].total, s["京东"].most_label, s["天猫"].least_label) == (1170.5, "产品A", "产品B")


def test_total_line(spark):
    text = "工作表：x\n序号：合计 | 总价：=SUM(A)（计算值：1,200.5） | 医院总价：=B（计算值：99）"
    df = spark.createDataFrame([("总价是多少", text), ("其他", text)], "q string, t string")
    got = [r[0] for r in df.select(tables_qa.total_line_answer(F.col("q"), F.col("t"), F.lit("f.xlsx"))).collect()]
    assert got == ["根据《f.xlsx》的合计行，总价为 1,200.5，医院总价为 99。", None]


def test_claims(spark):
    drafts = [(1, "A is 5.[1] B is 6. Cold. 中文。尾"), (2, "- one [2][1]\nat 3 V"), (3, ""), (4, None)]
    got = {}
    for r in claims.claims(spark.createDataFrame(drafts, "query_id int, draft string")).orderBy("query_id", "at").collect():
        got.setdefault(r.query_id, []).append((r.claim, r.bare, r.cited))
    assert [c for c, _, _ in got[1]] == ["A is 5.[1]", "B is 6. Cold.", "中文。", "尾"] and set(got) == {1, 2}
    assert got[2] == [("- one [2][1]", "one", [2, 1]), ("at 3 V", "at 3 V", [])] or [b for _, b, _ in got[2]][0] == "one"


def test_claims_are_held_by_quotes(spark):
    pairs = [("The pump runs at 50 bar", "pump: 50 bar, runs"), ("The pump runs at 60 bar", "pump runs at 50 bar"), ("", "x"), ("Literal Text", "a literaltext b"), ("12 kg", "12kg")]
    df = spark.createDataFrame(pairs, "c string, q string").select(claims.held(F.col("c"), F.col("q")))
    assert [r[0] for r in df.collect()] == [True, False, False, True, True]
    rows = [
        (1, "pump pressure", "The pump runs at 50 bar. The moon is 7 km wide.", ["pump runs at 50 bar"], [1.0]),
        (2, "pump", "Nothing 9.", ["pump text"], [1.0]),
        (3, "q", "", [], []),
        (4, "pump valve", "The valve closes.[2][9] The pump runs.", ["pump runs", "valve closes"], [1.0, 2.0]),
        (5, "pump", None, ["other", "a pump", "the pump"], [3.0, 1.0, 1.0]),
    ]
    answers = spark.createDataFrame(rows, "query_id int, question string, draft string, quotes array<string>, scores array<double>")
    got = {r.query_id: r.text for r in claims.verified(answers).collect()}
    assert got == {1: "The pump runs at 50 bar.[1]", 2: "pump text [1]", 3: "", 4: "The valve closes.[2]\nThe pump runs.[1]", 5: "a pump [2]"}


def test_review_of_answers(spark):
    c = lambda f, *rows: [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(f(F.col("a"), F.col("b"))).collect()]
    assert c(lambda a, b: review.finalized(a, F.lit(2)), ("<think>x\ny</think>答案：ok [3][02]  go", ""), ("none", ""), ("<think>", ""), ("", ""), (None, "")) == ["ok [2] go", "none [1]", None, None, None]
    assert c(review.reviewed, ("a", "b"), ("a", None), ("a", "证据不足"), ("证据不足", "证据不足!")) == ["b", "a", "a", "证据不足!"]
    text = "intro\n1. one\n2. two\n\n1. first\n2. second\n3. third\nend\n5. no"
    (items,) = c(lambda a, b: review.outline(a), (text, ""))
    assert [(x.number, x.title) for x in items] == [(1, "first"), (2, "second"), (3, "third")]
    done = c(lambda a, b: review.completed(a, b, F.array(review.outline(F.lit("x")), review.outline(F.lit(text)))), ("有哪些", "first and second"), ("有哪些", "first second third"), ("other", "no"))
    assert done == ["依据原文，共有 3 项：1. first；2. second；3. third。[2]", "first second third", "no"]
    assert c(lambda a, b: review.wants_second(a, b, F.array(F.lit(text)), F.array(review.outline(F.lit(text)))), ("q", "first second third"), ("q", "first")) == [False, True]
    assert c(lambda a, b: review.wants_review(a, F.lit(False), F.array(review.outline(F.lit("x")))), ("为什么", ""), ("pump", "")) == [True, False]
    assert c(lambda a, b: review.heading_level(a), ("第一章 x", ""), ("二、y", ""), ("■ z", ""), ("3. w", ""), ("plain", "")) == [0, 1, 2, 3, None]
    rows = [(1, "pump pressure", "one\n\ntwo\n\nthe pump\n\nnext\n\nlast"), (2, "阀门", "一、阀门\n关\n1. a\n二、泵\n开"), (3, "x", " "), (4, "one", "one\n\ntwo\n\nthree"), (5, "x", None), (6, "pump", "the pump " * 400)]
    part = {r.key: r.text for r in review.focused(spark.createDataFrame(rows, "key int, question string, text string"), claims.content_terms).collect()}
    assert part[1] == "two\n\nthe pump\n\nnext" and part[2] == "一、阀门\n关\n1. a" and part[3] == " " and part[4] == "one\n\ntwo" and part[5] is None and len(part[6]) == 2200 + 2 and part[6].endswith("...")


def test_context(spark):
    chunks = spark.createDataFrame([(f"c{i}", "v", i, ["s"] if i < 4 else ["t"], f"t{i}") for i in range(8)], "id string, document_version_id string, chunk_index int, section_path array<string>, text string")
    anchors = chunks.filter("chunk_index in (1, 6)").select(F.col("id").alias("anchor_id"), "document_version_id", "chunk_index", "section_path")
    near = context.neighbours(anchors, chunks, 2)
    assert {(r.anchor_id, r.chunk_index) for r in near.collect()} == {("c1", 0), ("c1", 1), ("c1", 2), ("c1", 3), ("c6", 4), ("c6", 5), ("c6", 6), ("c6", 7)}
    runs = context.segments(near).collect()
    assert [(r.first_index, r.last_index, r.chunks) for r in runs] == [(0, 7, 8)] and "【命中块】\nt1" in runs[0].text


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(monkeypatch):
    inner = {"a/x.md": "# T\nbody", "../evil.txt": "x", "__MACOSX/y.txt": "x", "z.bin": "x", "g.txt": "中文".encode("gb18030")}
    blocks = parsers.parse_bytes("p.zip", _zip(inner))
    assert [(b.text, b.section) for b in blocks] == [("T", ("压缩包内文件：a/x.md", "T")), ("body", ("压缩包内文件：a/x.md", "T")), ("中文", ("压缩包内文件：g.txt",))]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("x.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    assert parsers.parse_bytes("p.tar.gz", out.getvalue())[0].text == "hello"
    assert parsers.parse_bytes("note.txt.gz", gzip.compress(b"plain"))[0].text == "plain"
    with pytest.raises(ValueError):
        parsers.parse_bytes("p.zip", _zip({"a.bin": "x"}))
    with pytest.raises(ValueError):
        parsers.parse_bytes("bomb.zip", _zip({"a.txt": "0" * 10_000_000}))
    monkeypatch.setattr(parsers, "MEMBERS", 2)
    with pytest.raises(ValueError):
        parsers.parse_bytes("many.zip", _zip({f"{i}.txt": "x" for i in range(3)}))


def test_office_files():
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(b.kind, b.text, b.section) for b in parsers.parse_bytes("d.docx", docx)] == [("heading", "Top", ("Top",)), ("paragraph", "Text", ("Top",)), ("table", "a\tb", ())]
    pptx = _zip({f"ppt/slides/slide{n}.xml": f'<sld xmlns:a="a"><a:p><a:t>S{n}</a:t></a:p></sld>' for n in (10, 2)})
    assert [(b.page, b.text) for b in parsers.parse_bytes("d.pptx", pptx)] == [(1, "S2"), (2, "S10")]
    rows = [(1, ["Title"]), (2, ["a", "a", ""]), (3, ["1", "", "x"]), (4, ["", "", ""])]
    (block,) = parsers.row_blocks("S", rows)
    assert block.text == "工作表：S\n表格标题：Title\n行：3\na：1 | 列3：x"
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>sum</t></is></c></row><row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2"><f>A1</f><v>7</v></c></row></sheetData></worksheet>'
    xlsx = _zip({"xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="i" Target="worksheets/s.xml"/></R>', "xl/worksheets/s.xml": sheet})
    assert parsers.parse_bytes("d.xlsx", xlsx)[0].text.endswith("k：是 | sum：=A1（计算值：7）")


def test_parse_files(spark):
    df = spark.createDataFrame([("a.md", b"# A\n\nx\n## B\ny"), ("b.pdf", b"%PDF"), ("c.txt", b"")], "path string, content binary")
    rows = parsers.parse_files(df).orderBy("path", "block_no").collect()
    assert [(r.text, r.section_path) for r in rows[:4]] == [("A", ["A"]), ("x", ["A"]), ("B", ["A", "B"]), ("y", ["A", "B"])]
    assert rows[4].path == "b.pdf" and rows[4].error.startswith("Unsupported") and len(rows) == 5


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, body in {"a.txt": "x", "sub/b.md": "y", "~$c.txt": "z", "d.bin": "q", "sub/skip.txt": "s"}.items():
        (tmp_path / "in" / name).write_text(body)
    files = parsers.read_files(spark, str(tmp_path / "in"), exclude=("sub/skip*",))
    assert {r.relative for r in files.select("relative").collect()} == {"a.txt", "sub/b.md"}
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert store.write("t", df) == 2
    store.upsert("t", spark.createDataFrame([("b", 3, "x"), ("c", 4, "y")], "id string, n int, extra string"), "id")
    assert {(r.id, r.n, r.extra) for r in store.read("t").collect()} == {("a", 1, None), ("b", 3, "x"), ("c", 4, "y")}
    with pytest.raises(ValueError):
        store.write("t", df, expected=5)
    assert store.delete("t") == 0 and store.delete("t", id=["a", "c"]) == 2 and store.read("t").count() == 1
    store.snapshot("t", str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 1
    write_jsonl(df, str(tmp_path / "j"))
    assert read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "click", float(m), f"k{m % 3}") for m in range(12)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double, job_key string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, job_key string").parquet(str(tmp_path / "e"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sum(r.n for r in run(feed.event_windows(stream), "w", "complete")) == 12
    assert len(run(feed.unique_jobs(stream.select("job_key", F.col("ts").alias("created_at"))), "u", "append")) == 3
    seen = stream.select(F.col("job_key").alias("path"), F.col("ts").alias("seen_at"), F.lit(1).cast("long").alias("size_bytes"), F.when(F.col("value") > 5, "b").otherwise("a").alias("sha256"))
    events = [r.event for r in run(feed.path_changes(seen), "p", "append")]
    assert (events.count("add"), events.count("update"), events.count("unchanged")) == (3, 3, 6)


def test_layout(spark):
    box = "block_id long, document_version_id string, page_no int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, block_type string, font_size double, is_bold boolean"
    rows = [
        (1, "v", 1, "Running title", (50.0, 20.0, 545.0, 40.0), "paragraph", 9.0, False),
        (2, "v", 1, "2 Heading", (50.0, 100.0, 545.0, 120.0), "paragraph", 16.0, True),
        (3, "v", 1, "left one is a longer text", (50.0, 200.0, 280.0, 220.0), "paragraph", 10.0, False),
        (4, "v", 1, "right one is a longer text", (310.0, 190.0, 545.0, 220.0), "paragraph", 10.0, False),
        (5, "v", 1, "left two is a longer text", (50.0, 230.0, 280.0, 250.0), "paragraph", 10.0, False),
        (6, "v", 1, "right two is a longer text", (310.0, 230.0, 545.0, 250.0), "paragraph", 10.0, False),
        (7, "v", 2, "Running title", (50.0, 20.0, 545.0, 40.0), "paragraph", 9.0, False),
        (8, "v", 2, "", (100.0, 300.0, 300.0, 400.0), "image", None, None),
        (9, "v", 2, "far", (100.0, 405.0, 300.0, 415.0), "paragraph", 10.0, False),
        (10, "v", 2, "Figure 3 shows", (100.0, 440.0, 300.0, 450.0), "paragraph", 10.0, False),
        (11, "v", 2, "3", (280.0, 800.0, 290.0, 810.0), "paragraph", 9.0, False),
        (12, "v", 2, "", (110.0, 310.0, 290.0, 390.0), "image", None, None),
        (13, "v", 2, None, None, "paragraph", None, None),
    ]
    df = spark.createDataFrame(rows, box)
    order = [r.block_id for r in layout.reading_order(df.filter("page_no = 1")).orderBy("place").collect()]
    assert order == [1, 2, 3, 5, 4, 6]
    role = {r.block_id: (r.role, r.level) for r in layout.classify(df).collect()}
    assert role[1][0] == role[7][0] == "header" and role[2] == ("heading", 1) and role[11][0] == "page_number" and role[3][0] == "body"
    part = {r.block_id: r.section for r in layout.sections(layout.reading_order(layout.classify(df))).collect()}
    assert part[6] == ["2 Heading"] and part[1] == []
    assert {r.block_id: r.caption for r in layout.captions(df.filter("block_type = 'image'"), df).collect()} == {8: "Figure 3 shows", 12: "Figure 3 shows"}
    assert layout.image_regions(df.filter("block_type = 'image'")).count() == 1
    cells = spark.createDataFrame([("v", 1, f"r{i}c{j}", (50.0 + 100 * j, 20.0 * i, 90.0 + 100 * j, 20.0 * i + 10)) for i in range(4) for j in range(3)], "document_version_id string, page_no int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert layout.ocr_tables(cells).first().table_markdown.splitlines()[2] == "| r1c0 | r1c1 | r1c2 |"


def test_segments(spark):
    from quillspark.operators import evalset

    same = "This sentence stands in both of the texts."
    rows = [(1, f"{same} Only the first text says this one here.\nshort"), (2, f"{same}\n{same}"), (3, None), (4, "")]
    found = evalset.segments(spark.createDataFrame(rows, "doc_id int, text string"))
    assert found.count() == 3
    assert [r.segment for r in evalset.unique_segments(found).collect()] == ["Only the first text says this one here."]
