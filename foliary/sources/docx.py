"""docx files as rows: paragraphs and table cells read, and plain texts written, inside Arrow tasks.

A docx is a zip with one XML part of content; reading needs nothing but that part. Files come as (key, content), as
``binaryFile`` gives them, so Spark splits and recovers the work.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliary.functions import text as T

# Names of the format.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def parts_of(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, style, text) of paragraphs and, after them, of table cells, in order."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    name = lambda n: f"{{{WORD}}}{n}"
    out, cells = [], []
    for block in root.find(name("body")):
        if block.tag == name("p"):
            style = block.find(f"{name('pPr')}/{name('pStyle')}")
            out.append(("paragraph", "" if style is None else style.get(name("val"), ""), "".join(x.text or "" for x in block.iter(name("t")))))
        elif block.tag == name("tbl"):
            cells += [("cell", "", "".join(x.text or "" for x in c.iter(name("t")))) for c in block.iter(name("tc"))]
    return out + cells


def docx_of(lines: list[str]) -> bytes:
    """A docx with one paragraph a line."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{MAIN}"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{RELATIONS}"><Relationship Id="r1" Type="{OFFICE}" Target="word/document.xml"/></Relationships>')
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def paragraphs(made: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, pos, kind, style, text): normalised texts of paragraphs and cells; those without text go. A broken file has none."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            for k, raw in zip(batch[key], batch["content"], strict=True):
                try:
                    found = parts_of(bytes(raw))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    continue
                yield pd.DataFrame({key: [k] * len(found), "pos": range(len(found)), "kind": [x[0] for x in found], "style": [x[1] for x in found], "text": [x[2] for x in found]})

    form = StructType([made.schema[key]]).add("pos", "integer").add("kind", "string").add("style", "string").add("text", "string")
    rows = made.select(key, F.col(content).alias("content")).mapInPandas(run, form)
    return rows.withColumn("text", T.clean(F.col("text"))).where("text <> ''")


def written(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): each text as a docx, a paragraph a line. Null is a docx without paragraphs."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            yield pd.DataFrame({key: batch[key], "content": [docx_of((x or "").split("\n")) for x in batch["text"]]})

    return texts.select(key, F.col(text).alias("text")).mapInPandas(run, StructType([texts.schema[key]]).add("content", "binary"))


def chapter_name(text: Column, style: Column) -> Column:
    """Whether a paragraph names a chapter: numbered and under 80 characters, or in a heading's style and under 100."""
    numbered = text.rlike(T.CHAPTER) | text.rlike(T.DOTTED) | text.rlike(T.CN_NUMBER) | text.rlike(T.NUMBER)
    return (numbered & (F.length(text) < 80)) | (F.startswith(style, F.lit("Heading")) & (F.length(text) < 100))
