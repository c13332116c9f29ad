"""Markdown corpora: research notes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import labelled_line
from ..functions.urls import canonical_url

# Labels of a research note, and the columns they become.
NOTE_LABELS = {
    "What they do": "what_they_do",
    "How they describe themselves": "self_description",
    "Size / stage / funding": "stage",
    "Locations / HQ": "locations",
    "Remote policy": "remote_policy",
    "Remote-Canada eligibility": "remote_eligibility",
    "Engineering & tech": "engineering",
    "Notable / other": "notable",
    "Open relevant roles (sample)": "open_roles",
    "Sources": "sources",
}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file name and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text")
    )


def parse_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """Research notes as columns: title, key, company_type and one column per label."""
    head = r"(?m)^Provider/key:\s*([^|\n]*?)\s*\|\s*company_type:\s*(\S+)\s*$"
    body = F.col(text)
    return notes.withColumns({
        "title": F.regexp_extract(body, r"^#\s*(.+?)(?:\s+—\s+research)?\s*(?:\n|$)", 1),
        "key": F.regexp_extract(body, head, 1),
        "company_type": F.regexp_extract(body, head, 2),
        **{column: labelled_line(body, label) for label, column in NOTE_LABELS.items()},
    })


def parse_reports(reports: DataFrame, text: str = "text") -> DataFrame:
    """Reports → file, leading number of the name, canonical URL of the ``**URL:**`` line."""
    url = F.regexp_extract(text, r"\*\*URL:\*\*\s*(\S+)", 1)
    return reports.where(F.col("file").endswith(".md")).select(
        "file", F.regexp_extract("file", r"^(\d+)", 1).alias("num"), canonical_url(url).alias("url")
    ).where("url <> ''")


def labelled_columns(notes: DataFrame, labels: dict[str, str], text: str = "text") -> DataFrame:
    """Any labelled text → one column per label, missing labels null."""
    return notes.withColumns({column: labelled_line(F.col(text), label) for label, column in labels.items()})
