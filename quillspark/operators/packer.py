"""Packing parsed blocks into chunks, and plain texts into windows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_text
from quillspark.functions.words import TOKEN, TOKEN_JAVA

TARGET, OVERLAP, LEAST, MOST = 420, 40, 180, 650
_ALONE = ("table", "table_row", "image")


@dataclass
class Piece:
    """A block, or part of one that was too long."""

    text: str
    kind: str
    section: tuple[str, ...]
    page: int | None
    source: str | None
    confidence: float | None
    tokens: int
    split: bool = False


@dataclass
class Packed:
    pieces: list[Piece]
    extra: list[Piece] = field(default_factory=list)  # of a tail merged in

    @property
    def all(self) -> list[Piece]:
        return self.pieces + self.extra

    @property
    def text(self) -> str:
        return "\n\n".join(x for x in ("\n\n".join(p.text for p in self.pieces).strip(), "\n\n".join(p.text for p in self.extra).strip()) if x)


def _cut(piece: Piece, most: int) -> list[Piece]:
    spans = [m.span() for m in TOKEN.finditer(piece.text)]
    if len(spans) <= most:
        return [piece]
    lines = piece.text.split("\n")
    if piece.kind == "table" and len(lines) > 2 and lines[0].startswith("|"):
        return _cut_table(piece, lines, most)
    out, begin = [], 0
    for at in range(0, len(spans), most):
        last = min(at + most, len(spans))
        end = spans[last - 1][1]
        out.append(Piece(piece.text[begin:end].strip(), piece.kind, piece.section, piece.page, piece.source, piece.confidence, last - at, True))
        begin = end
    return out


def _cut_table(piece: Piece, lines: list[str], most: int) -> list[Piece]:
    """By rows, each part under the two header lines; a single row longer than that stays whole."""
    size = lambda x: len(TOKEN.findall(x))
    head = lines[:2]
    room, out, rows, used = most - sum(map(size, head)), [], [], 0

    def close():
        text = "\n".join([*head, *rows])
        out.append(Piece(text, piece.kind, piece.section, piece.page, piece.source, piece.confidence, size(text), True))

    for line in lines[2:]:
        if rows and used + size(line) > room:
            close()
            rows, used = [], 0
        rows.append(line)
        used += size(line)
    close()
    return out


def pack(blocks: list[Piece], target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> list[Packed]:
    """Chunks of a document's blocks, in order.

    Tables, table rows and images stand alone; a heading of another section closes a chunk; chunks close at
    the target and never pass the limit; each begins with the whole last blocks of the one before that make
    up the overlap. A short tail joins the last chunk if it fits. Of equal chunks without cut blocks the first stays.
    """
    if overlap >= target:
        raise ValueError("overlap must be smaller than target")
    total = lambda ps: sum(p.tokens for p in ps)
    done: list[Packed] = []
    open_: list[Piece] = []
    repeated = False  # open_ holds nothing but the overlap

    def carry(pieces: list[Piece]) -> list[Piece]:
        kept: list[Piece] = []
        while overlap > 0 and len(kept) < len(pieces) and total(kept) < overlap:
            kept.insert(0, pieces[-1 - len(kept)])
        return kept

    for piece in (part for block in blocks for part in _cut(block, most)):
        if piece.kind in _ALONE:
            done += [Packed(open_)] if open_ and not repeated else []
            done.append(Packed([piece]))
            open_, repeated = [], False
            continue
        if open_ and piece.kind == "heading" and not piece.split and piece.section != open_[-1].section:
            done += [Packed(open_)] if not repeated else []
            open_, repeated = [], False
        if open_ and total(open_) + piece.tokens > most:
            if not repeated:
                done.append(Packed(open_))
                open_ = carry(open_)
            room, fit = most - piece.tokens, []
            while len(fit) < len(open_) and total(fit) + open_[-1 - len(fit)].tokens <= room:
                fit.insert(0, open_[-1 - len(fit)])
            open_ = fit
        open_, repeated = [*open_, piece], False
        if total(open_) >= target:
            done.append(Packed(open_))
            open_, repeated = carry(open_), True
    if open_ and not (repeated and any(p.split for p in open_)):
        if done and total(open_) < least and len(TOKEN.findall(done[-1].text)) + total(open_) <= most:
            done[-1].extra = open_
        else:
            done.append(Packed(open_))
    seen, out = set(), []
    for chunk in done:
        whole = not any(p.split for p in chunk.all)
        if whole and chunk.text in seen:
            continue
        seen |= {chunk.text} if whole else set()
        out.append(chunk)
    return out


SCHEMA = "document_version_id string, chunk_index int, text string, token_count int, text_hash string, page_no int, first_page int, last_page int, section_path array<string>, content_type string, source_type string, ocr_confidence double, block_types array<string>, deduplicable boolean, previous_chunk_index int, next_chunk_index int"


def _kind(kinds: list[str]) -> str:
    content = {"table" if k in ("table", "table_row") else "image" if k == "image" else "text" for k in kinds if k not in ("header", "footer")}
    return content.pop() if len(content) == 1 else "mixed"


def _packer(target: int, overlap: int, least: int, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_no", "reading_order", "block_id"], na_position="first")
        none = lambda x, f: None if x is None or x != x else f(x)
        blocks = [
            Piece(r.text or "", r.block_type or "paragraph", tuple(r.section_path) if r.section_path is not None else (), none(r.page_no, int), r.source_type, none(r.confidence, float), len(TOKEN.findall(r.text or "")))
            for r in rows.itertuples()
            if (r.text or "").strip()
        ]
        out, chunks = [], pack(blocks, target, overlap, least, most)
        for i, chunk in enumerate(chunks):
            pieces, first = chunk.all, chunk.pieces[0]
            kinds, pages = list(dict.fromkeys(p.kind for p in pieces)), [p.page for p in pieces if p.page is not None]
            sources, trust = {p.source for p in pieces}, [p.confidence for p in pieces if p.source == "ocr_text" and p.confidence is not None]
            text = chunk.text
            out.append(
                (rows["document_version_id"].iloc[0], i, text, len(TOKEN.findall(text)), hashlib.sha256(text.encode()).hexdigest(), first.page, min(pages, default=None), max(pages, default=None), list(first.section), _kind(kinds))
                + (sources.pop() if len(sources) == 1 else "mixed", sum(trust) / len(trust) if trust else None, kinds, not any(p.split for p in pieces), i - 1 if i else None, i + 1 if i + 1 < len(chunks) else None)
            )
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for c in ("page_no", "first_page", "last_page", "previous_chunk_index", "next_chunk_index"):
            frame[c] = frame[c].astype("Int32")
        return frame

    return run


def pack_blocks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chunks of every document version of a layout_blocks table. Packing is a fold over a version's blocks with
    look-back, so one version is one group: the unit is a file, whatever the number of versions."""
    columns = ["block_id", "document_version_id", "text", "page_no", "section_path", "block_type", "confidence", "reading_order", "source_type"]
    one = blocks.filter("document_version_id is not null").select(*columns).dropDuplicates(["block_id"])
    return one.groupBy("document_version_id").applyInPandas(_packer(target, overlap, least, most), SCHEMA)


def windows(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, chunk_index, text, token_count, text_hash of plain documents: windows of ``most`` tokens of the
    normalised text, which is what packing makes of a text of one paragraph. Blank and null texts give none."""
    spaced = r"[\s\p{Z}]*(?:" + TOKEN_JAVA + ")"
    parts = F.regexp_extract_all(normalize_text(F.col("text")), F.lit(spaced), F.lit(0))
    df = documents.select("doc_id", parts.alias("a")).filter(F.size("a") > 0)
    df = df.select("doc_id", "a", F.explode(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / most).cast("int"))).alias("chunk_index"))
    part = F.slice("a", F.col("chunk_index") * most + 1, F.lit(most))
    text = F.regexp_replace(F.array_join(part, ""), r"^\s+|\s+$", "")
    return df.select("doc_id", "chunk_index", text.alias("text"), F.size(part).alias("token_count"), F.sha2(text, 256).alias("text_hash"))
