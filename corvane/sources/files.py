"""File, log and document sources and sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.operators import incremental
from corvane.sources import shared

# XML namespaces of the office formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_BYTES = 64 << 20


def scan(spark: SparkSession, root: str, extensions: list[str] = (), names: list[str] = (), globs: list[str] = (), include: list[str] = (), least_bytes: int = 0) -> DataFrame:
    """(path, content, hash, bytes, mtime, is_empty, is_too_small) of the wanted files below ``root``.

    Paths are relative to root. Names and globs exclude, include admits. Spark's
    reader does not list files of no bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.removeprefix("file://").rstrip("/"))
    path = F.regexp_replace("path", rf"^(file:/+)?/*{base.lstrip('/')}/", "")
    f = raw.select(path.alias("path"), "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    f = f.where(paths.has_extension(F.col("path"), list(extensions)) & ~paths.excluded(F.col("path"), list(names), list(globs)) & paths.included(F.col("path"), list(include)))
    return f.select("path", "content", F.sha2("content", 256).alias("hash"), "bytes", "mtime", (F.col("bytes") == 0).alias("is_empty"), (F.col("bytes") < least_bytes).alias("is_too_small"))


def docx_text(data: bytes) -> str:
    """Paragraph texts of a Word file, apart by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("document.xml is too large")
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join(t for p in tree.iter(f"{WORD}p") if (t := "".join(x.text or "" for x in p.iter(f"{WORD}t"))).strip())


def xlsx_text(data: bytes) -> str:
    """[Sheet: name] and comma-separated rows of every sheet, apart by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet")]
        out = []
        for k, name in enumerate(book, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{SHEET}row"):
                cells = []
                for c in row.iter(f"{SHEET}c"):
                    v = c.find(f"{SHEET}v")
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    text = strings[int(text)] if c.get("t") == "s" and text else text
                    cells.append('"' + text.replace('"', '""') + '"' if re.search(r'[",\n]', text) else text)
                rows.append(",".join(cells))
            out.append("\n".join([f"[Sheet: {name}]", *rows]))
    return "\n\n".join(out)


#: Extractors by extension; PDF, legacy Office and images need libraries or models that are not here and can be added.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".xlsx": xlsx_text}


def extract(files: DataFrame) -> DataFrame:
    """(path, text, status): text by the extension's extractor, else UTF-8; a failure is told in status."""

    def one(path: str, data: bytes) -> tuple[str | None, str]:
        ext = "." + path.rsplit(".", 1)[-1].lower()
        try:
            if ext in (".pdf", ".doc", ".xls", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp") and ext not in EXTRACTORS:
                return None, "unsupported"
            return EXTRACTORS.get(ext, lambda d: d.decode("utf-8", "replace"))(data), "ok"
        except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            return None, f"failed: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in got], "status": [s for _, s in got]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, status string")


def tolerant_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by file; a file with any bad line is left out whole."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    row = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.select("file", row.alias("r"))
    hurt = rows.groupBy("file").agg(F.max(F.col("r.__bad").isNotNull()).alias("hurt")).where("hurt").select("file")
    return rows.join(hurt, "file", "left_anti").select("file", "r.*").drop("__bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rewrite_log(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Put the rows as JSON lines in the place of a log, as ``swap`` does."""
    swap(spark, rows, path, "json")


def versioned_rows(spark: SparkSession, path: str, schema: str, keys: list[str], version: str = "ver", deleted: str = "deleted", epoch: int | None = None) -> DataFrame:
    """A table's exported JSON rows, one an insertion, as the table stands: of an epoch, if one is given, each key's newest version unless that is deleted."""
    rows = spark.read.schema(schema).json(path)
    if epoch is not None:
        rows = rows.where(F.col("epoch") == epoch)
    return incremental.latest(rows, keys, version, deleted)


def swap(spark: SparkSession, rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Write beside ``path``, then take its place by two renames.

    If the second fails the old table is put back. Between them a reader finds no table
    at ``path``; ``epochs.EpochTable`` has no such moment.
    """
    at, new, old = (shared.at(spark, path + x) for x in ("", ".new", ".old"))
    fs = shared.files(spark, path)
    rows.write.mode("overwrite").format(form).save(path + ".new")
    there = fs.exists(at)
    if there:
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, at):
        if there:
            fs.rename(old, at)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
