"""Writers: JSON and CSV reports, an append-only log, a status store of events, a page of HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def printable(x: Column) -> Column:
    """Doubles for JSON: infinities and NaN as text."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Audit rows, one JSON line each; extra columns go along."""
    entries.write.mode("append").json(path)


def append_status(events: DataFrame, path: str) -> None:
    """Status changes are only ever appended; the current state is the last event."""
    events.write.mode("append").parquet(path)


def current_status(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("analysis_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1 and status <> 'deleted'").drop("__n")


def escaped(x: Column) -> Column:
    """Text that shows as itself in a page."""
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(shown))
    return x


def html_rows(report: DataFrame, title: str) -> Column:
    """A self-contained page per report row: its columns as a table, binary ones as embedded pictures, nulls as a dash."""
    cells = []
    for name, kind in report.dtypes:
        own = F.col(f"`{name}`")
        shown = F.concat(F.lit("<img src='data:image/png;base64,"), F.base64(own), F.lit("'>")) if kind == "binary" else escaped(own.cast("string"))
        cells.append(F.concat(F.lit(f"<tr><th>{escape(name)}</th><td>"), F.coalesce(shown, F.lit("—")), F.lit("</td></tr>")))
    return F.concat(F.lit(f"<!DOCTYPE html><title>{escape(title)}</title><table>"), *cells, F.lit("</table>"))
