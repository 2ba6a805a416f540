"""Files as DataFrames: whole texts, directories by pattern, Word documents, pre-segmented clauses, tables found in pages."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of input by extension, and extensions that are accepted.
KINDS = {"txt": "text", "md": "text", "docx": "docx", "doc": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image"}
ALLOWED = ["txt", "pdf", "docx", "doc", "png", "jpg", "jpeg", "tiff", "bmp"]


def extension(name: Column) -> Column:
    """The lower-case extension of a name, empty where it has none."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def input_kind(name: Column) -> Column:
    """``text``, ``docx``, ``pdf``, ``image`` or ``unknown``, by extension."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), extension(name)), F.lit("unknown"))


def is_allowed(name: Column, allowed: list[str] = ALLOWED) -> Column:
    return F.coalesce(extension(name).isin(allowed), F.lit(False))


def texts(spark: SparkSession, path: str, glob: str = "*.txt", limit: int | None = None) -> DataFrame:
    """``path, text`` of whole UTF-8 files, one row a file; ``limit`` takes the first by path."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.orderBy("path").limit(limit) if limit else t


def directory(spark: SparkSession, path: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """``path, kind, length``: files of a directory by pattern; contents aren't read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", input_kind(F.col("path")).alias("kind"), "length")
    return d.orderBy("path").limit(limit) if limit else d


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes | None) -> str | None:
    """Non-empty paragraphs of a Word document, one a line; null for what is no such document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
        return None
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in paragraphs if p)


def documents(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """``path, text`` of Word documents; broken ones give a null text."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [docx_text(c) for c in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, "path string, text string")


def extracted(spark: SparkSession, path: str, glob: str, extract) -> DataFrame:
    """``path, text`` of any other kind of file by a plug-in ``extract(bytes) -> str`` (an OCR or PDF engine)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [extract(c) for c in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, "path string, text string")


# Words that mark the columns of a laboratory table.
COLUMNS = {"test": "(?i)test|investigation|parameter|name", "value": "(?i)result|value|observed", "unit": "(?i)unit", "reference": "(?i)ref|range|normal|interval"}


def _fits(headers: str, pattern: str) -> Column:
    return F.transform(headers, lambda h: F.coalesce(h.rlike(pattern), F.lit(False)))


def laboratory_table(tables: DataFrame, key: str, headers: str, rows: str) -> DataFrame:
    """``key, row_no, test, value, unit, reference`` of tables (``headers array<string>, rows array<array<string>>``).

    Columns are told by their headers, the first that fits; rows without a test or a value are dropped.
    """
    at = {c: F.array_position(_fits(headers, p), True) for c, p in COLUMNS.items()}
    cells = tables.select(key, *[a.alias(f"_{c}") for c, a in at.items()], F.posexplode(rows).alias("row_no", "_r"))
    get = lambda c: F.when(F.col(f"_{c}") > 0, F.nullif(F.trim(F.get("_r", (F.col(f"_{c}") - 1).cast("int"))), F.lit("")))
    return cells.select(key, "row_no", *[get(c).alias(c) for c in COLUMNS]).where("test is not null and value is not null")


def spelling_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``term, n`` of a dictionary file of ``term count`` lines."""
    return spark.read.schema("term string, n long").csv(path, sep=" ")
