"""Files of a folder as paragraphs: text, Markdown, and the XML of word-processor files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.parsed import parse_text

EXTENSIONS = ("docx", "pdf", "txt", "md")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH = "path string, index int, level int, style string, text string, error string"


def discover(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, file_type, file_size_bytes, modified_at) of supported files below a folder, without paths that hold an excluded part."""
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pdf,txt,md}").load(path)
        .select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
    )
    for part in exclude:
        df = df.filter(~F.contains("path", F.lit(part)))
    return df


def read_text(spark: SparkSession, path: str, separator: str = r"\n{2,}") -> DataFrame:
    """Paragraphs of text and Markdown files, whole files being one value each."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_text(raw, separator).withColumn("error", F.lit(None).cast("string"))


def _level(style: str) -> int:
    m = re.match(r"heading\s*(\d+)", style, re.I)
    return int(m.group(1)) if m else {"title": 1, "subtitle": 2}.get(style.lower(), 0)


def _runs(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            out.append(" ")
    return "".join(out)


def parse_docx(content: bytes) -> list[tuple[int, str, str]]:
    """(level, style, text) in the order of the body; a row of a table gives each of its texts once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                if name is not None:
                    names[s.get(f"{_W}styleId")] = name.get(f"{_W}val")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            style = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal"
            text = _runs(node).strip()
            if text:
                out.append((_level(style), style, text))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                seen = set()
                for p in row.iter(f"{_W}p"):
                    text = " ".join(_runs(p).split())
                    if text and text not in seen:
                        seen.add(text)
                        out.append((0, "Table Cell", text))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of word-processor files; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for at, content in zip(d["path"], d["content"]):
                try:
                    rows += [(at, i, *x, None) for i, x in enumerate(parse_docx(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((at, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "index", "level", "style", "text", "error"]).astype({"index": "Int32", "level": "Int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return raw.select("path", "content").mapInPandas(run, PARAGRAPH)
