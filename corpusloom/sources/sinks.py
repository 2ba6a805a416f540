"""Results as files: texts by name, JSON responses, tables as markdown, CSV or plain text, reports, rows of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_texts(rows: DataFrame, name: str, text: str, path: str) -> None:
    """Texts in a folder per name (``name=.../part-*.txt``)."""
    rows.select(name, F.col(text).alias("value")).repartition(F.col(name)).write.partitionBy(name).mode("overwrite").text(path)


def write_batch(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def legal_response(doc: Column, kind: Column, clauses: Column, summary: Column) -> Column:
    """The JSON of a processed document: null fields are left out."""
    return F.to_json(F.struct(doc.alias("document_id"), kind.alias("document_type"), clauses.alias("clauses"), summary.alias("summary")))


def _cells(row: Column) -> Column:
    return F.transform(row, lambda x: F.coalesce(x, F.lit("")))


def as_markdown(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(_cells(cells), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(rows, line), "\n"))


def as_csv(headers: Column, rows: Column) -> Column:
    """Cells with a comma, quote or line end are quoted."""
    cell = lambda x: F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = lambda cells: F.array_join(F.transform(_cells(cells), cell), ",")
    return F.concat_ws("\n", line(headers), F.array_join(F.transform(rows, line), "\n"))


def as_plain(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.array_join(_cells(cells), " | ")
    return F.concat_ws("\n", line(headers), F.array_join(F.transform(rows, line), "\n"))
