"""Parsers of files into blocks, inside executors.

Each takes bytes and gives rows of BLOCK; unreadable files give one row with an error. Formats that need
readers which aren't installed (PDF, DOC, PPT, XLS) are refused as unsupported; a reader can be added to READERS.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "path string, block_no int, text string, page_no int, section_path array<string>, block_type string, source_type string, heading_level int, table_markdown string, error string"
MEMBERS, MEMBER_BYTES, TOTAL_BYTES, RATIO = 500, 50 << 20, 200 << 20, 100
ARCHIVE_SECTION = "压缩包内文件："


class Unsupported(ValueError):
    pass


@dataclass
class Block:
    text: str
    page: int | None = None
    section: tuple[str, ...] = ()
    kind: str = "paragraph"
    source: str = "native_text"
    level: int | None = None
    table: str | None = None


def decode(data: bytes) -> str:
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def tidy(text: str) -> str:
    return "\n".join(x for line in text.splitlines() if (x := " ".join(line.split())))


def text_blocks(text: str, markdown: bool) -> list[Block]:
    """Paragraphs at blank lines; in Markdown, headings open sections."""
    out, lines, section = [], [], []

    def close():
        if body := tidy("\n".join(lines)):
            out.append(Block(body, section=tuple(section)))
        lines.clear()

    for line in text.splitlines():
        if markdown and (m := re.match(r"(#{1,6})\s+(.+)$", line.strip())):
            close()
            level, title = len(m[1]), m[2].strip()
            section[:] = [*section[: level - 1], title]
            out.append(Block(title, section=tuple(section), kind="heading", level=level))
        elif line.strip():
            lines.append(line)
        else:
            close()
    close()
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs, those of a heading style as headings, then tables with cells parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(_read(z.open("word/document.xml"), MEMBER_BYTES))
    body = next(x for x in body if _local(x.tag) == "body")
    out, section = [], []
    for node in body:
        if _local(node.tag) != "p" or not (text := tidy(_runs(node))):
            continue
        style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        if m := re.fullmatch(r"[Hh]eading\s?([1-6])", style):
            section[:] = [*section[: int(m[1]) - 1], text]
            out.append(Block(text, section=tuple(section), kind="heading", level=int(m[1])))
        else:
            out.append(Block(text, section=tuple(section)))
    for node in body:
        if _local(node.tag) == "tbl":
            rows = [[tidy(" ".join(_runs(p) for p in c if _local(p.tag) == "p")) for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]
            if text := "\n".join("\t".join(r) for r in rows if any(r)):
                out.append(Block(text, kind="table", table=markdown_table(rows)))
    return out


def pptx_blocks(data: bytes) -> list[Block]:
    """One block per slide with text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        slides = [ElementTree.fromstring(_read(z.open(n), MEMBER_BYTES)) for n in names]
    texts = [tidy("\n".join(_runs(p) for p in s.iter() if _local(p.tag) == "p")) for s in slides]
    return [Block(t, page=i) for i, t in enumerate(texts, 1) if t]


def xlsx_blocks(data: bytes) -> list[Block]:
    """Rows of all sheets, by row_blocks."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda n: ElementTree.fromstring(_read(z.open(n), MEMBER_BYTES))
        shared = [_runs(x) for x in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {x.attrib["Id"]: x.attrib["Target"] for x in xml("xl/_rels/workbook.xml.rels")}
        for sheet in (x for x in xml("xl/workbook.xml").iter() if _local(x.tag) == "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            rows = []
            for row in (x for x in xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for cell in row:
                    column = 0
                    for ch in re.match("[A-Z]+", cell.attrib.get("r", ""))[0] if cell.attrib.get("r") else "":
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * max(0, (column or len(cells) + 1) - 1 - len(cells))
                    cells.append(_cell(cell, shared))
                rows.append((int(row.attrib.get("r", len(rows) + 1)), cells))
            out += row_blocks(sheet.attrib["name"], rows)
    return out


def _cell(cell, shared: list[str]) -> str:
    parts = {_local(x.tag): x for x in cell}
    kind, value = cell.attrib.get("t"), (parts["v"].text or "") if "v" in parts else ""
    if kind == "s":
        value = shared[int(value)]
    elif kind == "inlineStr":
        value = _runs(cell)
    elif kind == "b":
        value = "是" if value == "1" else "否"
    elif re.fullmatch(r"-?\d+\.0", value):
        value = value[:-2]
    if "f" in parts and parts["f"].text:
        return f"={parts['f'].text}" + (f"（计算值：{value}）" if value else "")
    return tidy(value)


def row_blocks(sheet: str, rows: list[tuple[int, list[str]]]) -> list[Block]:
    """A block per row below the header: sheet, title, row number, "header：value" pairs.

    Rows before the first with two cells are titles, that one is the header; empty headers are numbered,
    repeated ones counted.
    """
    title, headers, out = [], None, []
    for number, cells in rows:
        filled = [c for c in cells if c]
        if headers is None:
            if len(filled) < 2:
                title += filled
                continue
            seen: dict[str, int] = {}
            headers = []
            for i, name in enumerate(cells, 1):
                name = name or f"列{i}"
                seen[name] = seen.get(name, 0) + 1
                headers.append(name if seen[name] == 1 else f"{name}（{seen[name]}）")
        elif filled:
            pairs = [f"{headers[i] if i < len(headers) else f'列{i + 1}'}：{c}" for i, c in enumerate(cells) if c]
            head = [f"工作表：{sheet}", *([f"表格标题：{' '.join(title)}"] if title else []), f"行：{number}"]
            out.append(Block("\n".join([*head, " | ".join(pairs)]), section=(sheet,), kind="table_row"))
    return out


def markdown_table(rows: list[list[str]]) -> str | None:
    """Without empty rows and columns, padded; None unless it has 2 rows, 2 columns and 4 filled cells."""
    rows = [[tidy(c or "").replace("\n", "<br>").replace("|", r"\|") for c in r] for r in rows if any((c or "").strip() for c in r)]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    keep = [i for i in range(width) if any(r[i] for r in rows)]
    rows = [[r[i] for i in keep] for r in rows]
    dense = sum(sum(map(bool, r)) > 1 for r in rows)
    if len(rows) < 2 or len(keep) < 2 or sum(bool(c) for r in rows for c in r) < 4 or dense < max(2, len(rows) // 2):
        return None
    head = [c or f"Column {i}" for i, c in enumerate(rows[0], 1)]
    return "\n".join("| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), *rows[1:]))


def _read(stream, most: int) -> bytes:
    """At most ``most`` bytes; a stream that holds more is refused."""
    data = stream.read(most + 1)
    if len(data) > most:
        raise ValueError(f"larger than {most} bytes")
    return data


def _safe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ".." in parts or "__MACOSX" in parts or re.match("[A-Za-z]:", name)) and suffix_of(name) in READERS


def suffix_of(name: str) -> str:
    last = name.replace("\\", "/").rpartition("/")[2]
    stem, dot, end = last.rpartition(".")
    return (dot + end).lower() if stem else ""


def archive_members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the members that can be parsed, within the limits on number, size, total and ratio.

    Links, encrypted members and names that lead outside are left out.
    """
    total = count = 0
    if zipfile.is_zipfile(io.BytesIO(data)):
        archive = zipfile.ZipFile(io.BytesIO(data))
        entries = [(i.filename, i.file_size, i.compress_size, (lambda i=i: archive.open(i))) for i in archive.infolist() if not i.is_dir() and not i.flag_bits & 1]
    else:
        try:
            tar = tarfile.open(fileobj=io.BytesIO(data))
            entries = [(m.name, m.size, None, (lambda m=m: tar.extractfile(m))) for m in tar if m.isfile()]
        except tarfile.ReadError:
            inner = re.sub(r"\.gz$", "", name.rpartition("/")[2], flags=re.I)
            entries = [(inner, 0, len(data), lambda: gzip.GzipFile(fileobj=io.BytesIO(data)))]
    if len(entries) > MEMBERS:
        raise ValueError(f"more than {MEMBERS} members")
    for member, size, packed, stream in entries:
        if not _safe(member):
            continue
        if size > MEMBER_BYTES or packed and size > RATIO * packed:
            raise ValueError(f"member {member} breaks the size limits")
        body = _read(stream(), MEMBER_BYTES)
        total, count = total + len(body), count + 1
        if total > TOTAL_BYTES or packed and len(body) > RATIO * packed:
            raise ValueError("archive breaks the size limits")
        yield member, body
    if not count:
        raise ValueError("no readable member")


def archive_blocks(name: str, data: bytes) -> list[Block]:
    out, errors = [], 0
    for member, body in archive_members(name, data):
        try:
            blocks = READERS[suffix_of(member)](member, body)
        except Exception:  # noqa: BLE001 - an unreadable member doesn't spoil the others
            errors += 1
            continue
        for b in blocks:
            b.section = (f"{ARCHIVE_SECTION}{member}", *b.section)
            out.append(b)
    if errors and not out:
        raise ValueError("no readable member")
    return out


READERS: dict[str, Callable[[str, bytes], list[Block]]] = {
    ".txt": lambda n, d: text_blocks(decode(d), False),
    ".md": lambda n, d: text_blocks(decode(d), True),
    ".docx": lambda n, d: docx_blocks(d),
    ".pptx": lambda n, d: pptx_blocks(d),
    ".xlsx": lambda n, d: xlsx_blocks(d),
    ".xlsm": lambda n, d: xlsx_blocks(d),
}
ARCHIVES = (".zip", ".tar", ".gz", ".tgz")


def parse_bytes(name: str, data: bytes) -> list[Block]:
    end = suffix_of(name)
    if end in ARCHIVES:
        return archive_blocks(name, data)
    if end not in READERS:
        raise Unsupported(f"unsupported file type: {end or name}")
    return READERS[end](name, data)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCK.split(", ")]
    for batch in batches:
        for begin in range(0, len(batch), 64):
            rows = []
            for path, content in zip(batch["path"].iloc[begin : begin + 64], batch["content"].iloc[begin : begin + 64]):
                try:
                    rows += [(path, i, b.text, b.page, list(b.section), b.kind, b.source, b.level, b.table, None) for i, b in enumerate(parse_bytes(path, content))]
                except Exception as e:  # noqa: BLE001 - the error is a result
                    rows.append((path, 0, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            frame = pd.DataFrame(rows, columns=names)
            for c in ("page_no", "heading_level"):
                frame[c] = frame[c].astype("Int32")
            yield frame


def parse_files(files: DataFrame) -> DataFrame:
    """Blocks of files (path, content)."""
    return files.select("path", "content").mapInPandas(_parse, BLOCK)


def read_files(spark: SparkSession, root: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below root (path, relative, size_bytes, mtime_ns, sha256, content) of a supported type.

    The relative path must match an include pattern and no exclude pattern; * also matches across folders.
    Times have microseconds.
    """
    from quillspark.operators.sync import supported

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    like = lambda p: relative.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$")
    keep = F.lit(False)
    for p in include:
        keep = keep | like(p)
    for p in exclude:
        keep = keep & ~like(p)
    return files.filter(keep & supported(F.col("path"))).select("path", relative.alias("relative"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"), "content")
