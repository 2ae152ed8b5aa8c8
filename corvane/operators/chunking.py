"""Chunkers: files to rows (path, start_line, end_line, language, content).

Line windows, overlap and usages are DataFrame operations. Language chunkers are
registered by extension: most take a language's outermost declarations as ``syntax``
finds them, the others blocks of lines that close by indentation, by the next heading
or by an end mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import syntax as sx
from corvane.sources import shared

Piece = tuple  # first line, last line, text, and for declarations a description
Chunker = Callable[[str], list[Piece]]
MAX_LINES, MAX_CHARS = 100, 8000
PACK, LEAST = 4000, 300
RANGE = 32 << 20  # bytes of text a range of chunks


def line_windows(files: DataFrame, lines: int = MAX_LINES, path: str = "path", text: str = "text") -> DataFrame:
    """Blocks of ``lines`` lines, trimmed; blank ones are left out. One expression a row, no shuffle."""
    parts = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(lines))
    out = files.select(F.col(path).alias("path"), parts.alias("p"), F.explode(starts).alias("s"))
    end = F.least(F.col("s") + lines, F.size("p"))
    body = F.regexp_replace(F.array_join(F.slice("p", F.col("s") + 1, F.lit(lines)), "\n"), r"^\s+|\s+$", "")
    return out.select("path", (F.col("s") + 1).alias("start_line"), end.alias("end_line"), body.alias("content")).where("content <> ''")


def with_overlap(chunks: DataFrame, lines: int, by: str = "path", order: str = "start_line") -> DataFrame:
    """Each chunk begins with the last ``lines`` lines of the one before.

    No group is one task's: all chunks are dealt by ranges of (by, order), and the first of a range looks at the
    last of the range before.
    """
    size = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = size // RANGE + 1
    ranged = chunks.repartitionByRange(parts, by, order).withColumn("__part", F.spark_partition_id())
    ranged = shared.table(ranged, "ranges")
    p = F.split("content", "\n")
    tail = F.array_join(F.slice(p, F.greatest(F.size(p) - lines + 1, F.lit(1)), F.lit(lines)), "\n")
    own = F.struct(F.col(by).alias("by"), tail.alias("tail"))
    ends = ranged.groupBy("__part").agg(F.max_by(own, F.struct(by, order)).alias("end"))
    # A row for each range.
    ends = ends.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("__end"))
    before = F.coalesce(F.lag(own).over(Window.partitionBy("__part").orderBy(by, order)), "__end")
    out = ranged.repartition(parts, "__part").join(F.broadcast(ends), "__part").withColumn("__before", before)
    kept = F.when(F.col("__before.by").eqNullSafe(F.col(by)), F.col("__before.tail"))
    return out.withColumn("content", F.when(kept.isNull(), F.col("content")).otherwise(F.concat(kept, F.lit("\n"), "content"))).select(*chunks.columns)


def find_usages(files: DataFrame, symbol: str, definition: Column, around: int = 2, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, context): lines with the whole word, the definition's line left out, ``around`` lines about them."""
    lines = F.split(F.col(text), "\n")
    hit = files.where(F.col(text).contains(symbol)).select(F.col(path).alias("path"), lines.alias("all"), definition.alias("own"), F.posexplode(lines).alias("at", "line"))
    hit = hit.where(F.col("line").rlike(rf"\b{re.escape(symbol)}\b") & ((F.col("at") + 1) != F.coalesce("own", F.lit(-1))))
    first = F.greatest(F.col("at") + 1 - around, F.lit(1))
    return hit.select("path", (F.col("at") + 1).alias("line"), F.array_join(F.slice("all", first, F.col("at") + 1 + around - first + 1), "\n").alias("context"))


def sections(files: DataFrame, heading: str = r"^#{1,6}\s", path: str = "path", text: str = "text") -> DataFrame:
    """From each heading to the line before the next."""
    lines = files.select(F.col(path).alias("path"), F.size(F.split(text, "\n")).alias("n"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    heads = lines.where(F.col("line").rlike(heading))
    nxt = F.lead("at").over(Window.partitionBy("path").orderBy("at"))
    return heads.select("path", (F.col("at") + 1).alias("start_line"), F.coalesce(nxt, F.col("n")).alias("end_line"), F.col("line").alias("title"))


def windows(text: str, lines: int = MAX_LINES) -> list[Piece]:
    rows = text.split("\n")
    out = [(s + 1, min(s + lines, len(rows)), "\n".join(rows[s : s + lines]).strip()) for s in range(0, len(rows), lines)]
    return [p for p in out if p[2]]


def split_large(piece: Piece, lines: int = MAX_LINES, chars: int = MAX_CHARS, overlap: int = 0) -> list[Piece]:
    """Windows within both budgets; a longer line is cut hard; the next window starts with the last ``overlap`` lines."""
    start, end, text = piece
    rows = text.split("\n")
    if len(rows) <= (lines or MAX_LINES) and len(text) <= chars:
        return [piece]
    lines = lines or MAX_LINES
    out: list[Piece] = []
    held: list[str] = []
    first, size = start, 0

    def flush(at: int) -> None:
        nonlocal held, size, first
        body = "\n".join(held)
        if body.strip():
            out.append((first, at, body))
        held = held[-overlap:] if overlap else []
        size = sum(map(len, held)) + len(held)
        first = at + 1 - len(held)

    for k, row in enumerate(rows):
        at = start + k
        for j in range(0, max(len(row), 1), chars):
            cut = row[j : j + chars]
            if held and (len(held) >= lines or size + len(cut) + 1 > chars):
                flush(at - 1 if j == 0 else at)
            held.append(cut)
            size += len(cut) + 1
    if held:
        flush(end)
    return out


def paragraphs(text: str) -> list[Piece]:
    """Paragraphs packed up to PACK characters; a group of LEAST or more closes unless the next is under LEAST. Lines are ordinals."""
    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out: list[Piece] = []
    group: list[str] = []
    size = 0

    def flush(at: int) -> None:
        nonlocal group, size
        if group:
            out.append((at - len(group) + 1, at, "\n\n".join(group)))
        group, size = [], 0

    for k, p in enumerate(paras, 1):
        if len(p) > PACK:
            flush(k - 1)
            out.append((k, k, p))
            continue
        if group and size + len(p) > PACK:
            flush(k - 1)
        group.append(p)
        size += len(p)
        if size >= LEAST and not (k < len(paras) and len(paras[k]) < LEAST):
            flush(k)
    flush(len(paras))
    return out


def sheets(text: str) -> list[Piece]:
    """[Sheet: name] parts, rows batched up to PACK characters."""
    out: list[Piece] = []
    for part in re.split(r"(?=^\[Sheet:)", text, flags=re.M):
        rows = part.strip().split("\n")
        if not rows[0]:
            continue
        head, first, held = rows[0], 1, []
        for k, row in enumerate(rows[1:], 1):
            if held and sum(map(len, held)) + len(row) > PACK:
                out.append((first, k - 1, "\n".join([head, *held])))
                first, held = k, []
            held.append(row)
        out.append((first, len(rows) - 1, "\n".join([head, *held])))
    return out


def braces(pattern: str) -> Chunker:
    """Blocks from a line that fits the pattern to the brace that closes it, or to its semicolon."""
    opens = re.compile(pattern)

    def run(text: str) -> list[Piece]:
        rows, out, k = text.split("\n"), [], 0
        while k < len(rows):
            if not opens.search(rows[k]):
                k += 1
                continue
            depth, seen, e = 0, False, k
            for e in range(k, len(rows)):
                bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", rows[e])
                depth += bare.count("{") - bare.count("}")
                seen |= "{" in bare
                if (seen and depth <= 0) or (not seen and bare.rstrip().endswith(";")):
                    break
            s = k
            while s and re.match(r"\s*(//|/\*|\*|@|#\[)", rows[s - 1]):
                s -= 1
            out.append((s + 1, e + 1, "\n".join(rows[s : e + 1])))
            k = e + 1
        return out

    return run


def indented(pattern: str) -> Chunker:
    """Blocks from a line that fits the pattern over all deeper lines."""
    opens = re.compile(pattern)

    def run(text: str) -> list[Piece]:
        rows, out, k = text.split("\n"), [], 0
        while k < len(rows):
            if not opens.match(rows[k]):
                k += 1
                continue
            depth = len(rows[k]) - len(rows[k].lstrip())
            s, e = k, k
            while s and rows[s - 1].lstrip().startswith("@"):
                s -= 1
            for j in range(k + 1, len(rows)):
                if rows[j].strip():
                    if len(rows[j]) - len(rows[j].lstrip()) <= depth and not rows[j].lstrip().startswith(")"):
                        break
                    e = j
            out.append((s + 1, e + 1, "\n".join(rows[s : e + 1])))
            k = e + 1
        return out

    return run


def ended(pattern: str, end: str) -> Chunker:
    """Blocks from a line that fits ``pattern`` to the next that fits ``end``."""

    def run(text: str) -> list[Piece]:
        rows, out, s = text.split("\n"), [], None
        for k, row in enumerate(rows):
            if s is None and re.search(pattern, row):
                s = k
            if s is not None and re.search(end, row):
                out.append((s + 1, k + 1, "\n".join(rows[s : k + 1])))
                s = None
        return out

    return run


def headed(pattern: str, whole: bool = False) -> Chunker:
    """Blocks from a line that fits the pattern to the line before the next; ``whole``: a text without any is one block."""

    def run(text: str) -> list[Piece]:
        rows = text.split("\n")
        at = [k for k, row in enumerate(rows) if re.search(pattern, row)]
        if not at:
            return [(1, len(rows), text)] if whole and text.strip() else []
        return [(a + 1, b, "\n".join(rows[a:b])) for a, b in zip(at, [*at[1:], len(rows)], strict=True)]

    return run


def statements(text: str) -> list[Piece]:
    """SQL statements up to their semicolons."""
    out, line = [], 1
    for part in re.split(r"(?<=;)", text):
        lead = len(part) - len(part.lstrip())
        start = line + part[:lead].count("\n")
        line += part.count("\n")
        if part.strip():
            out.append((start, line, part.strip()))
    return out


# Extensions of each language.
REGISTRY: dict[str, tuple[str, Chunker]] = {}


def register(language: str, extensions: str, chunker: Chunker) -> None:
    """Make ``chunker`` the one of these extensions; later registrations win."""
    for e in extensions.split():
        REGISTRY[e.lower()] = (language, chunker)


def _python(text: str) -> list[Piece]:
    """By the parser; texts that it refuses by indentation."""
    return sx.chunks("python")(text) or indented(r"\s*(async\s+)?def\s|\s*class\s")(text)


register("typescript", ".ts .tsx", sx.chunks("typescript"))
register("javascript", ".js .jsx .mjs .cjs", sx.chunks("javascript"))
register("python", ".py", _python)
register("java", ".java", sx.chunks("java"))
register("csharp", ".cs", sx.chunks("csharp"))
register("go", ".go", sx.chunks("go"))
register("c", ".c .h", sx.chunks("c"))
register("cpp", ".cpp .cc .cxx .hpp .hxx", sx.chunks("cpp"))
register("rust", ".rs", sx.chunks("rust"))
register("ruby", ".rb", indented(r"\s*def\s"))
register("kotlin", ".kt .kts", sx.chunks("kotlin"))
register("swift", ".swift", sx.chunks("swift"))
register("php", ".php", sx.chunks("php"))
register("bash", ".sh .bash .zsh", sx.chunks("bash"))
register("powershell", ".ps1 .psm1 .psd1", sx.chunks("powershell"))
register("sql", ".sql", statements)
register("css", ".css", sx.chunks("css"))
register("html", ".html .htm", sx.chunks("html"))
register("xml", ".xml .csproj .svg", sx.chunks("xml"))
register("json", ".json", sx.chunks("json"))
register("yaml", ".yaml .yml", indented(r"[\w\"'-][^#]*:(\s|$)|- "))
register("toml", ".toml", sx.chunks("toml"))
register("ini", ".ini .cfg", headed(r"^\s*\["))
register("markdown", ".md .mdx", headed(r"^#{1,6}\s"))
register("dockerfile", ".dockerfile dockerfile", headed(r"^\s*(FROM|RUN|CMD|LABEL|EXPOSE|ENV|ADD|COPY|ENTRYPOINT|VOLUME|USER|WORKDIR|ARG|ONBUILD|STOPSIGNAL|HEALTHCHECK|SHELL|MAINTAINER)\b"))
register("latex", ".tex .latex", headed(r"^\s*\\(chapter|section|subsection|subsubsection)\b", whole=True))
register("sln", ".sln", ended(r"^\s*(Project\(|Global\s*$)", r"^\s*(EndProject|EndGlobal)\s*$"))
register("ssl", ".ssl", ended(r"(?i)^\s*:(PROCEDURE|CLASS)\b", r"(?i)^\s*:(ENDPROC|ENDCLASS)\b"))
register("razor", ".razor .cshtml", braces(r"@(code|functions)\b"))
register("doc", ".pdf .docx .doc", paragraphs)
register("excel", ".xlsx .xls", sheets)


IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp")  # their text is a description


def chunk(path: str, text: str, overrides: dict[str, str] | None = None, lines: int = MAX_LINES, overlap: int = 0) -> list[tuple[int, int, str, str, str]]:
    """(start, end, language, content, description) by the path's chunker, else line windows; then split and overlapped.

    An image's text is one chunk below its path. A description is the comment above a
    declaration, for its first chunk.
    """
    base = path.rsplit("/", 1)[-1].lower()
    ext = "." + base.rsplit(".", 1)[-1] if "." in base else base
    if ext in IMAGES:
        return [(1, 1, "image", f"[image] [{ext[1:]}] [{path}] {text}", "")] if text.strip() else []
    language, run = REGISTRY.get(ext, ("text", windows))
    if overrides and ext in overrides:
        language, run = next(((n, c) for n, c in REGISTRY.values() if n == overrides[ext]), (language, run))
    pieces = run(text) or windows(text)
    out = [(*p, piece[3] if len(piece) > 3 and not k else "") for piece in pieces for k, p in enumerate(split_large(piece[:3], lines or MAX_LINES, overlap=overlap))]
    if overlap:
        tails = [None, *["\n".join(p[2].split("\n")[-overlap:]) for p in out[:-1]]]
        out = [(a, b, c if t is None else f"{t}\n{c}", d) for (a, b, c, d), t in zip(out, tails, strict=True)]
    return [(a, b, language, c, d) for a, b, c, d in out]


def chunk_files(files: DataFrame, overrides: dict[str, str] | None = None, overlap: int = 0, path: str = "path", text: str = "text") -> DataFrame:
    """Every file's chunks, with ids from their content and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *c) for p, t in zip(pdf["path"], pdf["text"], strict=True) for c in chunk(p or "", t or "", overrides, overlap=overlap)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "language", "content", "description"])

    out = files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, start_line int, end_line int, language string, content string, description string")
    return out.withColumn("id", F.sha2(F.concat_ws("|", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "content"), 256))


# Line patterns of declarations in languages without blocks, by extension; the last group is the name.
LINES = {
    ".json": r'^\s*"(\w+)":', ".yaml": r"^(\w+):", ".yml": r"^(\w+):", ".toml": r"^\[(\w+)\]",
    ".sh": r"^(?:function\s+(\w+)|(\w+)\s*\(\)\s*\{)", ".bash": r"^(?:function\s+(\w+)|(\w+)\s*\(\)\s*\{)", ".zsh": r"^(?:function\s+(\w+)|(\w+)\s*\(\)\s*\{)",
    ".sql": r"(?i)^(CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\s", ".md": r"^(#{1,6}\s.*)$",
}


def outline(path: str, text: str, overrides: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of a file's declarations: by its language, by line patterns, each name
    once, or else one entry that tells the number of lines."""
    ext = "." + path.rsplit(".", 1)[-1].lower()
    language = (overrides or {}).get(ext) or REGISTRY.get(ext, ("", None))[0]
    if ext in LINES and not (overrides and ext in overrides):
        found: dict[str, tuple] = {}
        for k, row in enumerate(text.split("\n"), 1):
            m = re.search(LINES[ext], row)
            if m:
                name = next(g for g in m.groups() if g).strip()
                found.setdefault(name, ("atx_heading" if ext == ".md" else ext[1:], name.lstrip("# ") if ext == ".md" else name, k, k))
        return list(found.values())
    told = sx.outline(language, text) if language else None
    if told is not None:
        return told
    n = text.count("\n") + 1
    return [("file", f"{n} lines", 1, n)]


def outlines(files: DataFrame, overrides: dict[str, str] | None = None, path: str = "path", text: str = "text", most: int = 4 << 20) -> DataFrame:
    """(path, kind, name, start_line, end_line) of every file's outline. Texts are taken out of a batch one by one, and rows
    handed on after about ``most`` bytes of text or 10 000 rows, so that a task holds a batch and a file's outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for p, t in zip(b.column(0), b.column(1), strict=True):
                name, content = p.as_py() or "", t.as_py() or ""
                rows += [(p.as_py(), *x) for x in outline(name, content, overrides)]
                size += len(content)
                if size > most or len(rows) > 10_000:
                    yield _outlined(rows)
                    rows, size = [], 0
            if rows:
                yield _outlined(rows)

    given = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "path string, kind string, name string, start_line int, end_line int")


def _outlined(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "kind": pa.string(), "name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))
