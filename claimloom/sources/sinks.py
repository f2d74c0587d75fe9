"""Writing rows in the formats that people and other programs read, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import temporary


def escaped(x: Column) -> Column:
    """HTML-escaped text; NULL becomes ''."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def html_row(columns: list[str]) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns), F.lit("</tr>"))


def markdown_row(columns: list[str]) -> Column:
    """A list item with one line per column; line breaks inside values become blanks."""
    return F.concat(*(F.concat(F.lit("- " if i == 0 else "  "), F.lit(f"{c}: "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\n")) for i, c in enumerate(columns)))


def page_marker(page: Column) -> Column:
    return F.concat(F.lit("\n<!-- PAGE "), page.cast("string"), F.lit(" -->\n"))


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, NULL fields kept. The folder appears whole or not at all (job commit)."""
    df.write.option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; quotes inside are doubled, NULL is told from ''."""
    df.write.options(header="true", quoteAll="true", escape='"', nullValue="\\N", emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_jsonl(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """Reads what :func:`csv` writes; values may hold line breaks."""
    return spark.read.schema(schema).options(header="true", multiLine="true", escape='"', nullValue="\\N", emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """Write and read again, in a new folder of the shared one."""
    path = temporary(df.sparkSession, kind)
    if kind == "csv":
        csv(df, path)
        return read_csv(df.sparkSession, path, df.schema)
    if kind == "jsonl":
        jsonl(df, path)
        return read_jsonl(df.sparkSession, path, df.schema)
    df.write.format(kind).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).load(path)
